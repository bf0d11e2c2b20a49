"""Clustering metrics from counts of shared mentions.

Both clusterings are rows of doc_key, mention, cluster_id; a mention is whatever
identifies it in its document. One full join on (doc_key, mention) and one
grouping by pairs of clusters carry every metric but the alignments, which solve
an assignment for each block of clusters that overlap.
"""

from __future__ import annotations

from heapq import heappop, heappush
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Scratch
from .components import components
from .pairs import with_prf

PARTS = ["r_num", "r_den", "p_num", "p_den"]


def deduplicated(mentions: DataFrame, order: str) -> DataFrame:
    """Of mentions of one span only the first stays."""
    w = Window.partitionBy("doc_key", "mention").orderBy(order)
    return mentions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlaps(key: DataFrame, response: DataFrame) -> DataFrame:
    """doc_key, k, r, n: mentions that key cluster k and response cluster r share; k or r null for those of one side."""
    side = lambda df, name: df.select("doc_key", "mention", F.col("cluster_id").alias(name))
    return side(key, "k").join(side(response, "r"), ["doc_key", "mention"], "full").groupBy("doc_key", "k", "r").agg(F.count("*").alias("n"))


def _sized(shared: DataFrame) -> DataFrame:
    size = lambda c: F.when(F.col(c).isNotNull(), F.sum("n").over(Window.partitionBy("doc_key", c)))
    return shared.withColumns({"k_size": size("k"), "r_size": size("r")})


def muc(shared: DataFrame) -> DataFrame:
    """Links kept per cluster: mentions minus the parts that the other side cuts it into (M1)."""

    def half(own: str, other: str, num: str, den: str) -> DataFrame:
        parts = F.sum(F.when(F.col(other).isNull(), F.col("n")).otherwise(1))
        each = shared.where(F.col(own).isNotNull()).groupBy("doc_key", own).agg(F.sum("n").alias("size"), parts.alias("parts"))
        return each.groupBy("doc_key").agg(F.sum(F.col("size") - F.col("parts")).alias(num), F.sum(F.col("size") - 1).alias(den))

    return half("k", "r", "r_num", "r_den").join(half("r", "k", "p_num", "p_den"), "doc_key", "full").select("doc_key", *(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in PARTS))


def b_cubed(shared: DataFrame) -> DataFrame:
    """Per mention the share of its cluster that the other side keeps with it (M2)."""
    s = _sized(shared)
    both = F.when(F.col("k").isNotNull() & F.col("r").isNotNull(), F.col("n") * F.col("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return s.groupBy("doc_key").agg(
        total(both / F.col("k_size")).alias("r_num"), total(F.when(F.col("k").isNotNull(), F.col("n"))).alias("r_den"),
        total(both / F.col("r_size")).alias("p_num"), total(F.when(F.col("r").isNotNull(), F.col("n"))).alias("p_den"),
    )


def blanc(shared: DataFrame) -> DataFrame:
    """Counts of coreferent and other links on either side and on both (M5): no pair is made."""
    pairs = lambda n: n * (n - 1) / 2
    s = _sized(shared).groupBy("doc_key").agg(
        F.sum(F.when(F.col("k").isNotNull() & F.col("r").isNotNull(), pairs(F.col("n")))).alias("both_c"),
        F.sum(F.when(F.col("k").isNotNull(), F.col("n"))).alias("k_n"), F.sum(F.when(F.col("r").isNotNull(), F.col("n"))).alias("r_n"),
        F.sum(F.when(F.col("k").isNotNull() & F.col("r").isNotNull(), F.col("n"))).alias("both_n"),
        # of the mentions of both sides, those together in the key and those together in the response
        F.sum(F.when(F.col("k").isNotNull(), F.col("n") * (F.col("k_size") - 1)) / 2).alias("k_c"),
        F.sum(F.when(F.col("r").isNotNull(), F.col("n") * (F.col("r_size") - 1)) / 2).alias("r_c"),
    )
    common = shared.where("k is not null and r is not null")
    inner = lambda c, name: common.groupBy("doc_key", c).agg(F.sum("n").alias("s")).groupBy("doc_key").agg(F.sum(pairs(F.col("s"))).alias(name))
    s = s.join(inner("k", "k_common"), "doc_key", "left").join(inner("r", "r_common"), "doc_key", "left").na.fill(0)
    n_both = pairs(F.col("both_n")) - F.col("k_common") - F.col("r_common") + F.col("both_c")
    return s.select("doc_key", "both_c", "k_c", "r_c", n_both.alias("both_no"), (pairs(F.col("k_n")) - F.col("k_c")).alias("k_no"), (pairs(F.col("r_n")) - F.col("r_c")).alias("r_no"))


def blanc_scores(counts: DataFrame) -> DataFrame:
    """recall, precision, f1 from ``blanc``'s counts; one kind of link alone counts where the key has only it."""
    c, n = ("both_c", "k_c", "r_c"), ("both_no", "k_no", "r_no")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    def prf(names: tuple[str, str, str]) -> tuple[Column, Column, Column]:
        r, p = ratio(names[0], names[1]), ratio(names[0], names[2])
        return r, p, F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0))

    of_c, of_n = prf(c), prf(n)
    pick = lambda k: F.when(F.col("k_c") == 0, of_n[k]).when(F.col("k_no") == 0, of_c[k]).otherwise((of_c[k] + of_n[k]) / 2)
    return counts.withColumns({"recall": pick(0), "precision": pick(1), "f1": pick(2)})


def best_assignment(edges: list[tuple]) -> float:
    """The largest sum of gains of edges (k, r, gain > 0) of which no two meet: shortest augmenting paths, with potentials,
    over the edges there are. Every k may also stay alone, at no gain, so only edges and ends are held."""
    near, alone = {}, object()
    for k, r, gain in edges:
        near.setdefault(k, []).append((r, -gain))
    price, value, owner, held = {}, {}, {}, {}  # of columns, of rows; the row that has a column, and the column it has
    for start, own in near.items():
        value[start] = min(0.0, min(c - price.get(r, 0.0) for r, c in own))
        reached, back, done, heap, at, far, n = {}, {}, {}, [], start, 0.0, 0
        while True:
            for r, c in (*near[at], ((alone, at), 0.0)):
                d = far + c - value[at] - price.get(r, 0.0)
                if r not in done and d < reached.get(r, inf):  # rounding may seem to improve what is settled
                    reached[r], back[r], n = d, at, n + 1
                    heappush(heap, (d, n, r))
            far, _, end = heappop(heap)
            while far > reached[end] or end in done:  # an older way to it
                far, _, end = heappop(heap)
            if end not in owner:
                break
            done[end] = True
            at = owner[end]
        value[start] += far
        for r in done:
            value[owner[r]] += far - reached[r]
            price[r] = price.get(r, 0.0) + reached[r] - far
        while end is not None:
            k = back[end]
            owner[end], held[k], end = k, end, held.get(k)
    gains = {(k, r): -c for k, own in near.items() for r, c in own}
    return float(sum(gains.get((k, r), 0.0) for r, k in owner.items()))


def ceaf(shared: DataFrame, entity: bool) -> DataFrame:
    """The best one-to-one alignment of clusters by shared mentions (M3), or by their share (M4, ``entity``).

    A pair of clusters that share mentions with each other only is aligned. What is left hangs together in blocks, the
    components of the graph of overlaps, and no alignment crosses blocks: each is solved alone, from its overlaps.
    """
    s = _sized(shared)
    both = s.where("k is not null and r is not null").withColumn("gain", 2 * F.col("n") / (F.col("k_size") + F.col("r_size")) if entity else F.col("n").cast("double"))
    degree = lambda c: F.count("*").over(Window.partitionBy("doc_key", c))
    scratch = Scratch(shared.sparkSession, "ceaf")
    edges = scratch.store(both.select("doc_key", "k", "r", "gain", ((degree("k") == 1) & (degree("r") == 1)).alias("apart")), "edges")
    node = lambda side, c: F.struct("doc_key", F.lit(side).alias("side"), F.col(c).cast("string").alias("id"))
    left = edges.where("not apart").withColumns({"x": node("k", "k"), "y": node("r", "r")})
    blocks = components(left.select("x", "y"), "x", "y")
    placed = left.join(blocks.withColumnRenamed("node", "x"), "x").select("doc_key", F.xxhash64("component").alias("block"), F.xxhash64("k").alias("k"), F.xxhash64("r").alias("r"), "gain")
    kind = shared.schema["doc_key"].dataType.simpleString()

    def align(key: tuple, rows: pa.Table) -> pa.Table:
        best = best_assignment(list(zip(*(rows[c].to_pylist() for c in ("k", "r", "gain")))))
        return pa.table({"doc_key": rows["doc_key"].slice(0, 1), "best": pa.array([best])})

    solved = placed.groupBy("doc_key", "block").applyInArrow(align, f"doc_key {kind}, best double")
    best = solved.unionByName(edges.where("apart").select("doc_key", F.col("gain").alias("best"))).groupBy("doc_key").agg(F.sum("best").alias("best"))
    count = lambda c: F.count_distinct(c) if entity else F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0))
    dens = shared.groupBy("doc_key").agg(count("k").cast("double").alias("r_den"), count("r").cast("double").alias("p_den"))
    num = F.coalesce("best", F.lit(0.0))
    return dens.join(best, "doc_key", "left").select("doc_key", num.alias("r_num"), "r_den", num.alias("p_num"), "p_den")


def scored(parts: DataFrame) -> DataFrame:
    """recall, precision, f1 beside numerators and denominators (M7)."""
    return with_prf(parts, F.col("p_num"), F.col("p_den"), F.col("r_num"), F.col("r_den"))


def in_total(parts: DataFrame) -> DataFrame:
    """Sums over all documents, scored."""
    return scored(parts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in PARTS)))


def two_digits(x: Column) -> Column:
    """Half up at two digits, as scores are printed (M6)."""
    return F.floor((x + 0.005) * 100) / 100


def conll_average(shared: DataFrame) -> DataFrame:
    """muc, b_cubed, ceaf_e and their mean, in per cent (M6)."""
    f1 = lambda parts, name: in_total(parts).select((F.col("f1") * 100).alias(name))
    three = f1(muc(shared), "muc").crossJoin(f1(b_cubed(shared), "b_cubed")).crossJoin(f1(ceaf(shared, True), "ceaf_e"))  # single rows
    return three.withColumn("average", (F.col("muc") + F.col("b_cubed") + F.col("ceaf_e")) / 3)
