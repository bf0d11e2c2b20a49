"""Error analyses over choices of antecedents.

A choice is a row of doc_key, m, a (a = m: a new cluster); ``judged`` adds what
the analyses group by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import capped


def judged(choices: DataFrame, gold: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each choice with its gold status: anaphoric, new, correct, error, and both mentions' type, head and sentence.

    ``gold``: doc_key, ment_idx, cluster_id. Error types (A15): 0 right, 1 false
    new, 2 false link, 3 wrong link.
    """
    start = F.min("ment_idx").over(Window.partitionBy("doc_key", "cluster_id"))
    known = gold.withColumn("anaphoric", F.col("ment_idx") != start).select("doc_key", F.col("ment_idx").alias("m"), F.col("cluster_id").alias("m_cluster"), "anaphoric")
    other = gold.select("doc_key", F.col("ment_idx").alias("a"), F.col("cluster_id").alias("a_cluster"))
    about = lambda p: mentions.select("doc_key", F.col("ment_idx").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("ment_type", "head", "sent_idx")))
    rows = choices.join(known, ["doc_key", "m"]).join(other, ["doc_key", "a"]).join(about("m"), ["doc_key", "m"]).join(about("a"), ["doc_key", "a"])
    rows = rows.withColumn("new", F.col("a") == F.col("m"))
    rows = rows.withColumn("correct", F.when(F.col("new"), ~F.col("anaphoric")).otherwise(F.col("m_cluster") == F.col("a_cluster")))
    return rows.withColumn("error", F.when(F.col("correct"), 0).when(F.col("new"), 1).when(~F.col("anaphoric"), 2).otherwise(3))


def accuracy(rows: DataFrame) -> DataFrame:
    """Right and all choices by anaphoric and mention type, with all totals."""
    return rows.rollup("anaphoric", "m_ment_type").agg(F.count_if(F.expr("correct")).alias("right"), F.count("*").alias("total"))


def by_prefixes(rows: DataFrame, properties: str = "properties") -> DataFrame:
    """Right and all choices for every beginning of a list of properties."""
    starts = F.transform(F.sequence(F.lit(0), F.size(properties)), lambda n: F.slice(properties, F.lit(1), n))
    return rows.select(F.explode(starts).alias("prefix"), "correct").groupBy("prefix").agg(F.count_if(F.expr("correct")).alias("right"), F.count("*").alias("total"))


def linkage(rows: DataFrame) -> DataFrame:
    """Links by kind of both ends, pronoun or not, and those of different heads."""
    kind = lambda c: F.when(F.col(c).isin("PRONOMINAL", "DEMONSTRATIVE"), "P").otherwise("NP")
    links = rows.where("not new").select(F.concat(kind("m_ment_type"), F.lit("->"), kind("a_ment_type")).alias("kind"), (F.lower("m_head") != F.lower("a_head")).alias("other_head"), "correct")
    return links.groupBy("kind").agg(F.count("*").alias("links"), F.count_if(F.expr("correct")).alias("right"), F.count_if(F.expr("other_head")).alias("different_head"))


def head_matches(pairs: DataFrame) -> DataFrame:
    """Anaphoric mentions without a gold antecedent of their head (bridging), and mentions with a false one (misleading) (A10).

    ``pairs``: doc_key, m, a, coreferent, m_head, a_head.
    """
    same = F.lower("m_head") == F.lower("a_head")
    each = pairs.groupBy("doc_key", "m").agg(F.bool_or(F.expr("coreferent")).alias("anaphoric"), F.bool_or(F.col("coreferent") & same).alias("matched"), F.bool_or(~F.col("coreferent") & same).alias("misled"))
    return each.agg(F.count("*").alias("mentions"), F.count_if(F.expr("anaphoric and not matched")).alias("bridging"), F.count_if(F.expr("misled")).alias("misleading"), F.count_if(F.expr("misled and not anaphoric")).alias("misleading_new"))


def trivial(pairs: DataFrame) -> DataFrame:
    """What pruning leaves to decide, by anaphoric: one right candidate, no right one, or a choice.

    ``pairs``: doc_key, m, correct, pruned, anaphoric, m_ment_type.
    """
    each = pairs.where("not pruned").groupBy("doc_key", "m", "anaphoric", "m_ment_type").agg(F.count_if(F.expr("correct")).alias("right"), F.count("*").alias("n"))
    kind = F.when(F.col("right") == F.col("n"), "trivially right").when(F.col("right") == 0, "trivially wrong").otherwise("open")
    return each.groupBy("anaphoric", "m_ment_type", kind.alias("state")).agg(F.count("*").alias("mentions"))


def entity_grid(clusters: DataFrame, mentions: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """A row for each cluster and sentence: the mentions' types, or the error codes given."""
    rows = clusters.join(mentions.select("doc_key", "ment_idx", "sent_idx", "ment_type"), ["doc_key", "ment_idx"])
    mark = F.left("ment_type", F.lit(1))
    if codes is not None:
        rows = rows.join(codes.select("doc_key", F.col("m").alias("ment_idx"), F.col("error").cast("string").alias("code")), ["doc_key", "ment_idx"], "left")
        mark = F.coalesce("code", F.lit("-"))
    return rows.groupBy("doc_key", "cluster_id", "sent_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ment_idx", mark.alias("c")))), lambda x: x["c"]), "").alias("cell"))


def entities_per_sentence(clusters: DataFrame, mentions: DataFrame, most: int = 10) -> DataFrame:
    """How many sentences mention so many clusters, ``most`` and more together."""
    each = clusters.join(mentions.select("doc_key", "ment_idx", "sent_idx"), ["doc_key", "ment_idx"]).groupBy("doc_key", "sent_idx").agg(F.count_distinct("cluster_id").alias("n"))
    return each.groupBy(capped(F.col("n"), most).alias("entities")).agg(F.count("*").alias("sentences"))


def errors_by_distance(rows: DataFrame, most: int = 10) -> DataFrame:
    """Error types by the sentence distance to the mention before in the gold cluster, -1 for the first."""
    before = F.lag("m_sent_idx").over(Window.partitionBy("doc_key", "m_cluster").orderBy("m"))
    gap = F.coalesce(capped(F.col("m_sent_idx") - before, most), F.lit(-1))
    return rows.withColumn("distance", gap).groupBy("distance", "error").agg(F.count("*").alias("mentions"), F.count_if(F.expr("m_ment_type <> 'PRONOMINAL'")).alias("referring"), F.count_if(F.expr("m_ment_type <> 'PRONOMINAL' and a_ment_type <> 'PRONOMINAL'")).alias("both_referring"))


def top_head_pairs(rows: DataFrame, top: int = 100) -> DataFrame:
    """The most frequent head pairs of wrong referring links (A16, A17); a top-k report."""
    wrong = rows.where("not correct and m_ment_type <> 'PRONOMINAL'")
    return wrong.groupBy(F.lower("m_head").alias("head"), F.lower("a_head").alias("other")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "head", "other").limit(top)


def recall_errors(pairs: DataFrame, choices: DataFrame) -> DataFrame:
    """Per wrongly resolved referring mention: has it a referring antecedent, one of its head."""
    referring = (F.col("m_ment_type") != "PRONOMINAL") & (F.col("a_ment_type") != "PRONOMINAL") & F.col("coreferent")
    each = pairs.groupBy("doc_key", "m").agg(F.bool_or(referring).alias("has_referring"), F.bool_or(referring & (F.lower("m_head") == F.lower("a_head"))).alias("has_head_match"))
    return choices.where("not correct and m_ment_type <> 'PRONOMINAL'").select("doc_key", "m", "a").join(each, ["doc_key", "m"], "left").na.fill(False)


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn of two boolean columns; rows with a null are left out."""
    g, p = F.col(gold), F.col(predicted)
    return rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def bio_chunks(labels: DataFrame, label: str) -> DataFrame:
    """Runs of B-x, I-x, ... as chunks doc_key, sent_idx, start_idx, end_idx, label; a stray I starts one."""
    w = Window.partitionBy("doc_key", "sent_idx").orderBy("tok_idx")
    kind, name = F.left(label, F.lit(1)), F.substring(label, 3, 100)
    rows = labels.withColumns({"_k": kind, "_x": name})
    opens = (F.col("_k") == "B") | ((F.col("_k") == "I") & ((F.coalesce(F.lag("_k").over(w), F.lit("O")) == "O") | (F.lag("_x").over(w) != F.col("_x"))))
    rows = rows.withColumn("_g", F.sum(opens.cast("int")).over(w)).where("_k <> 'O'")
    return rows.groupBy("doc_key", "sent_idx", "_g").agg(F.min("tok_idx").alias("start_idx"), (F.max("tok_idx") + 1).alias("end_idx"), F.min("_x").alias("label")).drop("_g")


def chunk_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, predicted and gold chunks of equal span and label, with precision, recall and f1."""
    from .pairs import with_prf

    keys = ["doc_key", "sent_idx", "start_idx", "end_idx", "label"]
    both = gold.select(*keys, F.lit(1).alias("g")).join(predicted.select(*keys, F.lit(1).alias("p")), keys, "full").agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("gold"))
    return with_prf(both, F.col("tp"), F.col("predicted"), F.col("tp"), F.col("gold"))
