"""Scores of pairs, antecedent choice and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components

BY_MENTION = ["doc_key", "m"]
#: Vectors of a chunk of ``largest_products``, about; of one product of matrices on either side, at most.
CHUNK, PRODUCT = 8192, 1024
#: Ids of weights that are sent as one vector end before this (8 bytes each).
DENSE = 1 << 20


def linear_scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_key, m, a and ``score``: the sum of the weights of a pair's feature ids, 0 for unknown ones.

    ``pairs``: doc_key, m, a, feats array<int>; ``weights``: feat_idx, weight.
    """
    return with_scores(pairs.select("doc_key", "m", "a", "feats"), weights).select("doc_key", "m", "a", "score")


def with_scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """All columns and ``score``, as ``linear_scores``: a pair is scored where it is, neither exploded nor shuffled.

    The weights are sent to all executors as one vector. If their ids reach DENSE, they are joined by feature.
    """
    known = weights.where("feat_idx is not null").groupBy("feat_idx").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    table = known.limit(DENSE + 1).toArrow()  # bounded
    ids, values = (table.column(c).to_numpy() for c in ("feat_idx", "weight"))
    if not len(ids):
        return pairs.withColumn("score", F.lit(0.0))
    if len(ids) > DENSE or ids.min() < 0 or ids.max() >= DENSE:
        keys = ["doc_key", "m", "a"]
        each = pairs.select(*keys, F.explode_outer("feats").alias("feat_idx")).join(known, "feat_idx", "left")
        return pairs.join(each.groupBy(*keys).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score")), keys)
    dense = np.zeros(int(ids.max()) + 1)
    dense[ids] = values
    shared, at = pairs.sparkSession.sparkContext.broadcast(dense), pairs.columns.index("feats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            feats = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(feats), 0).to_numpy()
            ids = pc.fill_null(feats.flatten(), -1).to_numpy()
            known = np.where((ids >= 0) & (ids < len(w)), w[np.clip(ids, 0, len(w) - 1)], 0.0)
            scores = np.bincount(np.repeat(np.arange(len(sizes)), sizes), known, len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return pairs.mapInArrow(run, pairs.limit(0).withColumn("score", F.lit(0.0)).schema)


def marginals(pairs: DataFrame) -> DataFrame:
    """``marginal``: softmax of the scores of each mention's antecedents."""
    w = Window.partitionBy(*BY_MENTION)
    top = F.max("score").over(w)
    return pairs.withColumn("_e", F.exp(F.col("score") - top)).withColumn("marginal", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def log_likelihood(pairs: DataFrame, gold: str = "coreferent") -> DataFrame:
    """Per document the log of the gold antecedents' marginals, -30 where they have none (L2)."""
    each = pairs.groupBy(*BY_MENTION).agg(F.sum(F.when(F.col(gold), F.col("marginal")).otherwise(0.0)).alias("p"))
    return each.groupBy("doc_key").agg(F.sum(F.when(F.col("p") > 0, F.log("p")).otherwise(-30.0)).alias("log_likelihood"))


def best_antecedent(pairs: DataFrame, score: str = "score") -> DataFrame:
    """The antecedent of the highest score; of equals the first."""
    return pairs.groupBy(*BY_MENTION).agg(F.max_by("a", F.struct(F.col(score), -F.col("a"))).alias("a"), F.max(score).alias(score))


def best_or_new(pairs: DataFrame) -> DataFrame:
    """As ``best_antecedent`` with pairs a = m for "new", which must be strictly better than all others."""
    is_new = F.col("a") == F.col("m")
    best = pairs.groupBy(*BY_MENTION).agg(F.max_by(F.when(~is_new, F.col("a")), F.when(~is_new, F.struct("score", -F.col("a")))).alias("ante"), F.max(F.when(~is_new, F.col("score"))).alias("s"), F.max(F.when(is_new, F.col("score"))).alias("new"))
    return best.select(*BY_MENTION, F.when(F.col("ante").isNull() | (F.col("new") > F.col("s")), F.col("m")).otherwise(F.col("ante")).alias("a"))


def best_gold(pairs: DataFrame, gold: str = "coreferent", most_back: int | None = None) -> DataFrame:
    """The best antecedent among the gold ones, within ``most_back`` mentions if given."""
    near = F.lit(True) if most_back is None else F.col("m") - F.col("a") <= most_back
    return best_antecedent(pairs.where(F.col(gold) & near))


def loss_augmented(pairs: DataFrame, latent: DataFrame, loss: str = "loss") -> DataFrame:
    """The antecedent that violates the margin most: the largest loss times (1 + score - latent score)."""
    late = latent.select(*BY_MENTION, F.col("score").alias("late"))
    return best_antecedent(pairs.join(late, BY_MENTION).withColumn("violation", F.col(loss) * (1 + F.col("score") - F.col("late"))), "violation")


def closest_first(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The nearest antecedent above the threshold."""
    return pairs.where(F.col("score") > threshold).groupBy(*BY_MENTION).agg(F.max("a").alias("a"))


def best_first(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The best antecedent above the threshold; of equals the nearest."""
    return pairs.where(F.col("score") > threshold).groupBy(*BY_MENTION).agg(F.max_by("a", F.struct("score", "a")).alias("a"))


def transitive_closure(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """All links above the threshold; the antecedent is the nearest earlier mention of the same component."""
    node = lambda c: F.struct("doc_key", F.col(c).alias("ment_idx"))
    found = components(pairs.where(F.col("score") > threshold).select(node("m").alias("x"), node("a").alias("y")), "x", "y")
    w = Window.partitionBy("doc_key", "component").orderBy("m")
    return found.select("node.doc_key", F.col("node.ment_idx").alias("m"), "component").withColumn("a", F.coalesce(F.lag("m").over(w), "m")).drop("component")


def expected_counts(pairs: DataFrame, gold: str = "gold_marginal") -> DataFrame:
    """Gold minus predicted expectation of each feature: the gradient of the log-likelihood."""
    each = pairs.select(F.explode("feats").alias("feat_idx"), (F.col(gold) - F.col("marginal")).alias("d"))
    return each.groupBy("feat_idx").agg(F.sum("d").alias("gradient"))


def antecedent_accuracy(chosen: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of anaphoric mentions whose chosen antecedent is a gold one."""
    marks = gold.where("coreferent").select("doc_key", "m", "a", F.lit(1).alias("right"))
    anaphoric = gold.where("coreferent").select("doc_key", "m").distinct()
    return anaphoric.join(chosen.select("doc_key", "m", "a"), BY_MENTION, "left").join(marks, [*BY_MENTION, "a"], "left").agg(F.count("*").alias("anaphoric"), F.count("right").alias("correct"), F.coalesce(F.try_divide(F.count("right"), F.count("*")), F.lit(0.0)).alias("accuracy"))


def largest_products(vectors: DataFrame) -> DataFrame:
    """label, pairs, best: of all pairs of a label's vectors their number and the largest inner product; ``vectors``: label, id, v.

    Each label is cut into chunks by a hash of the ids; a task holds one chunk and multiplies it with the rows of another as they
    come, so a row is sent as often as its label has chunks, and no pair is a row. Rows of one id are no pair; a null
    vector's products are null.
    """
    rows = vectors.where("label is not null and id is not null").select("label", F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("v").cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).cast("bigint").alias("n"))
    own = rows.join(sizes, "label").withColumn("c", F.pmod(F.xxhash64("id"), F.col("n")))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    after = F.transform(F.sequence("c", F.col("n") - 1), lambda j: cell(F.col("c"), j, 0))
    before = F.transform(F.sequence(F.lit(0).cast("bigint"), "c"), lambda i: cell(i, F.col("c"), 1))
    dealt = own.select("label", "id", "v", F.explode(F.concat(after, before)).alias("x")).select("label", "x.i", "x.j", "x.side", "id", "v")
    dealt = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "side")
    kind, step = vectors.schema["label"].dataType.simpleString(), PRODUCT

    def matrix(column: pa.ListArray) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        out = np.full((len(sizes), max(1, int(sizes.max()))), np.nan)
        if sizes.any():
            out[sizes > 0] = column.flatten().to_numpy(zero_copy_only=False).reshape((sizes > 0).sum(), -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            ids, out = batch.column(4).to_numpy(), []
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:]) if keys else ():
                label, i, j, side = keys[lo]
                if (label, i, j) != cell:
                    cell, held = (label, i, j), []
                parts = [(ids[k : min(k + step, hi)], matrix(batch.column(5).slice(k, min(step, hi - k)))) for k in range(lo, hi, step)]
                if not side:
                    held += parts
                    continue
                for x, v in parts:
                    for y, w in held:
                        width = max(v.shape[1], w.shape[1])
                        wide = lambda z: z if z.shape[1] == width else np.full((len(z), width), np.nan)  # noqa: E731  all of its vectors are null
                        products, met = wide(v) @ wide(w).T, y[None] < x[:, None] if i == j else np.True_
                        n = int(met.sum()) if i == j else products.size
                        best = np.fmax.reduce(np.where(met, products, np.nan), None)
                        out.append((label, n, None if np.isnan(best) else float(best)))
            names, counts, bests = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(counts, pa.int64()), pa.array(bests, pa.float64())], names=["label", "pairs", "best"])

    found = dealt.mapInArrow(run, f"label {kind}, pairs bigint, best double").where("pairs > 0")
    return found.groupBy("label").agg(F.sum("pairs").alias("pairs"), F.max("best").alias("best"))
