"""Clusterings as one row for each mention: doc_key, ment_idx, cluster_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .components import components


def ordered(clusters: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Clusters numbered from 0 by their first mention."""
    first = F.min("ment_idx").over(Window.partitionBy("doc_key", label))
    return clusters.withColumn("_first", first).withColumn("cluster_id", (F.dense_rank().over(Window.partitionBy("doc_key").orderBy("_first")) - 1).cast("bigint")).drop("_first")


def from_back_pointers(pointers: DataFrame) -> DataFrame:
    """Clusters of doc_key, m, a: a mention is in its antecedent's cluster; itself means a new one.

    Chains are followed by contraction of all documents' links at once; the
    number of rounds grows with the logarithm of the longest chain.
    """
    node = lambda c: F.struct("doc_key", F.col(c).alias("ment_idx"))
    found = components(pointers.select(node("m").alias("x"), node("a").alias("y")), "x", "y")
    return ordered(found.select("node.doc_key", "node.ment_idx", F.col("component.ment_idx").alias("root")), "root").drop("root")


def oracle(matches: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted mentions clustered as the gold mentions of their spans; others alone."""
    labels = matches.join(gold.select("doc_key", F.col("ment_idx").alias("gold_idx"), F.col("cluster_id").alias("gold_cluster")), ["doc_key", "gold_idx"])
    one = labels.groupBy("doc_key", F.col("pred_idx").alias("ment_idx")).agg(F.min("gold_cluster").alias("gold_cluster"))
    all_mentions = predicted.select("doc_key", "ment_idx").join(one, ["doc_key", "ment_idx"], "left")
    label = F.when(F.col("gold_cluster").isNull(), F.struct(F.lit(1).alias("k"), F.col("ment_idx").alias("v"))).otherwise(F.struct(F.lit(0).alias("k"), F.col("gold_cluster").alias("v")))
    return ordered(all_mentions.withColumn("label", label), "label").select("doc_key", "ment_idx", "cluster_id")


def without_singletons(clusters: DataFrame) -> DataFrame:
    """Clusters of two mentions or more, numbered anew."""
    size = F.count("*").over(Window.partitionBy("doc_key", "cluster_id"))
    return ordered(clusters.withColumn("_size", size).where("_size > 1").drop("_size"))


def restricted(clusters: DataFrame, mentions: DataFrame) -> DataFrame:
    """Only the mentions given, mentions and clusters numbered anew."""
    kept = clusters.join(mentions.select("doc_key", "ment_idx").distinct(), ["doc_key", "ment_idx"], "left_semi")
    again = (F.row_number().over(Window.partitionBy("doc_key").orderBy("ment_idx")) - 1).cast("bigint")
    return ordered(kept.withColumn("ment_idx", again))


def places(clusters: DataFrame) -> DataFrame:
    """Place in the cluster from 0, cluster size, immediate antecedent or -1, antecedents and consequents."""
    w = Window.partitionBy("doc_key", "cluster_id").orderBy("ment_idx")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return clusters.withColumns({
        "place": (F.row_number().over(w) - 1).cast("bigint"),
        "size": F.count("*").over(Window.partitionBy("doc_key", "cluster_id")),
        "antecedent": F.coalesce(F.lag("ment_idx").over(w), F.lit(-1)),
        "antecedents": F.collect_list("ment_idx").over(before),
        "consequents": F.collect_list("ment_idx").over(after),
    })


def back_pointers(clusters: DataFrame) -> DataFrame:
    """doc_key, m, a of a clustering: the immediate antecedent, or itself."""
    w = Window.partitionBy("doc_key", "cluster_id").orderBy("ment_idx")
    return clusters.select("doc_key", F.col("ment_idx").alias("m"), F.coalesce(F.lag("ment_idx").over(w), "ment_idx").alias("a"))


def chunks(clusters: DataFrame, mentions: DataFrame) -> DataFrame:
    """A chunk for each clustered mention, labelled with its cluster."""
    return mentions.join(clusters.select("doc_key", "ment_idx", "cluster_id"), ["doc_key", "ment_idx"]).select("doc_key", "sent_idx", "start_idx", "end_idx", F.col("cluster_id").alias("label"))


def size_batches(clusters: DataFrame) -> DataFrame:
    """Clusters with their row among those of equal size, for batches of one length."""
    sized = clusters.groupBy("doc_key", "cluster_id").agg(F.count("*").alias("size"))
    return sized.withColumn("batch_row", (F.row_number().over(Window.partitionBy("doc_key", "size").orderBy("cluster_id")) - 1).cast("bigint"))
