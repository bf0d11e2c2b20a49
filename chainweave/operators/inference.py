"""Latent properties and features of partial clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import agreement_bucket, smoothed_choice
from ..storage import Scratch
from .pairs import SORTED


def phi_posteriors(mentions: DataFrame, value: str, values: list[str], confidence: float = 0.75, kept: Sequence[str] = ()) -> DataFrame:
    """doc_key, ment_idx, columns ``kept``, posterior: mostly the known value, uniform if it is unknown."""
    place = F.array_position(F.array(*(F.lit(v) for v in values)), F.col(value)) - 1
    return mentions.select("doc_key", "ment_idx", *kept, smoothed_choice(F.when(place >= 0, place.cast("int")), len(values), confidence).alias("posterior"))


#: Mentions of a document that meet its earlier ones under one key.
BLOCK = 128


def entity_features(mentions: DataFrame, clusters: DataFrame, properties: list[str]) -> DataFrame:
    """Per mention and earlier cluster of its document, how many members agree with it in each property.

    The counts need no order but m > member, so this is one join and one grouping. Members are sent to each block of mentions
    after them, so a document is many keys; both sides are dealt by these keys for SORTED pairs a task, about, and pairs are
    counted where they meet: they are not shuffled, and what a task holds does not follow the input.
    """
    cols = ["ment_idx", *properties]
    rows = Scratch(mentions.sparkSession, "members").store(mentions.select("doc_key", *cols).join(clusters.select("doc_key", "ment_idx", "cluster_id"), ["doc_key", "ment_idx"], "left"), "members")
    pairs = rows.agg(F.sum("ment_idx")).first()[0] or 0
    n = max(-(-pairs // SORTED), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    last = rows.groupBy("doc_key").agg(F.floor(F.max("ment_idx") / BLOCK).alias("last_block"))
    m = rows.select("doc_key", block("ment_idx").alias("block"), *(F.col(c).alias(f"m_{c}") for c in cols)).repartition(n, "doc_key", "block")
    member = rows.where("cluster_id is not null").join(last, "doc_key").select("doc_key", F.explode(F.sequence(block("ment_idx"), F.col("last_block"))).alias("block"), "cluster_id", *(F.col(c).alias(f"c_{c}") for c in cols)).repartition(n, "doc_key", "block")
    both = m.join(member, ["doc_key", "block"]).where("c_ment_idx < m_ment_idx")
    counts = both.groupBy("doc_key", "block", F.col("m_ment_idx").alias("m"), "cluster_id").agg(F.count("*").alias("size"), *(F.count_if(F.col(f"m_{p}") == F.col(f"c_{p}")).alias(p) for p in properties))
    return counts.select("doc_key", "m", "cluster_id", "size", *(F.concat(F.lit(f"{p}="), agreement_bucket(F.col(p), F.col("size"))).alias(p) for p in properties))
