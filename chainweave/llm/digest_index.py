"""Exact deduplication against a persistent digest index.

``DigestIndex`` is a Parquet table of digests, bucketed by the digest and sorted
within buckets, that outlives the session: ``open`` declares it anew from its
folder. A batch is signed (SHA-256 of each text without the characters
``[\\x20\\x09-\\x0D]``), reduced to the best row of each digest, and joined to the
index by a sort-merge anti-join: what the index has nothing as good for is
appended. The index is read bucket by bucket and never shuffled.

Of equal texts the row with the most code points stays, then the smallest id, a
missing id last, then any one row. A row of a later batch that is better than the one
that stood for its text takes its place: its entry is appended too, and
``standing`` is the best entry of each digest.

A digest that very many rows share is reduced before the shuffle; where rows are
joined to the outcome both sides are read from storage, so that adaptive
execution can split it. Adding a batch again under its name adds nothing and
gives the same rows. One batch is added at a time.

Defined results: null counts as empty; texts of white space only are equal to
empty ones; repeated rows are copies of each other, of which one stays; texts
are taken whole; columns of any name are handed through; an empty batch adds
nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, fresh, shared_folder

_ENTRY = "digest BINARY, n_chars BIGINT, doc_id BIGINT, batch STRING, row BIGINT"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, as binary."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), "UTF-8"), 256))


def signature(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """What stands for a row: digest, n_chars, doc_id and a number. To be stored before use, which fixes the numbers."""
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return {"digest": digest_of(plain), "n_chars": F.char_length(plain).cast("bigint"), "doc_id": F.col(f"`{doc_id}`").cast("bigint"), "row": F.monotonically_increasing_id()}


def signed(docs: DataFrame) -> DataFrame:
    """The ``signature`` of each row."""
    return docs.select(*(c.alias(n) for n, c in signature().items()))


def _rank(side: str = "") -> Column:
    """Smaller is better."""
    return F.struct((-F.col(f"{side}n_chars")).alias("n"), F.col(f"{side}doc_id").isNull().alias("missing"), F.col(f"{side}doc_id").alias("doc_id"))


class DigestIndex:
    """Entries: digest, n_chars and doc_id of a row that stood for its text, the batch that brought it and its row there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"chainweave_digests_{hashlib.md5(self.path.encode()).hexdigest()}"

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new, empty index in a folder that all machines share.

        A bucket is sorted by one task, so an index of 500 GB wants some 4,000. As many
        as the session's shuffles have partitions if not said; with these a batch is shuffled once.
        """
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = cls(spark, path or shared_folder(spark, "digest-index"), buckets)
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{index.path}/layout")
        return index._declared()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """The index that is in a folder."""
        return cls(spark, path, spark.read.parquet(f"{path.rstrip('/')}/layout").first()["buckets"])._declared()

    def _declared(self) -> DigestIndex:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({_ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'")
        return self

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def standing(self) -> DataFrame:
        """The best entry of each digest; equal digests are in one bucket, so nothing is shuffled."""
        best = F.min(F.struct(_rank().alias("rank"), "n_chars", "doc_id", "batch", "row")).alias("e")
        return self.entries().groupBy("digest").agg(best).select("digest", "e.n_chars", "e.doc_id", "e.batch", "e.row")

    def unbeaten(self, rows: DataFrame) -> DataFrame:
        """Of ``rows`` (as ``signed`` gives them) the best of each digest, if the index has none as good."""
        best = F.min(F.struct(_rank().alias("rank"), "n_chars", "doc_id", "row")).alias("e")
        new = rows.groupBy("digest").agg(best).select("digest", "e.n_chars", "e.doc_id", "e.row")
        known = self.entries().select(F.col("digest").alias("k_digest"), F.col("n_chars").alias("k_n_chars"), F.col("doc_id").alias("k_doc_id"))
        return new.hint("merge").join(known, (F.col("digest") == F.col("k_digest")) & (_rank("k_") <= _rank()), "left_anti")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append what ``unbeaten`` leaves of the batch; returns the batch's entries."""
        new = self.unbeaten(rows).select("digest", "n_chars", "doc_id", F.lit(batch).alias("batch"), "row")
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/entries").saveAsTable(self.name)
        return self.entries().where(F.col("batch") == batch)

    def new_documents(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add a batch of documents; returns those whose text the index did not have, or not as good, with all columns."""
        own = signature(doc_id, text)
        names = dict(zip(own, fresh(docs.columns, *own)))
        landed = Scratch(docs.sparkSession, "landed").store(docs.withColumns({names[n]: c for n, c in own.items()}), "batch")
        added = self.add(landed.select(*(F.col(c).alias(n) for n, c in names.items())), batch)
        return landed.join(added.select(F.col("row").alias(names["row"])), names["row"], "left_semi").select(docs.columns)

    def compacted(self, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new index of the standing entries only, one file a bucket; the old one stays as it is."""
        index = DigestIndex.create(self.spark, path, buckets or self.buckets)
        self.standing().repartition(index.buckets, "digest").write.mode("append").format("parquet").bucketBy(index.buckets, "digest").sortBy("digest").option("path", f"{index.path}/entries").saveAsTable(index.name)
        return index

    def drop(self) -> None:
        """Forget the table's declaration; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def copies(docs: DataFrame, deliveries: int = 2) -> DataFrame:
    """One row for each of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The rows come to a new index in so many deliveries, each row in one of them:
    the first fills the index, the next are deduplicated against it.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows = scratch.store(signed(docs), "signed")
    index = DigestIndex.create(docs.sparkSession, scratch.path("index"))
    for k in range(deliveries):
        index.add(rows.where(F.pmod(F.xxhash64("row"), F.lit(deliveries)) == k), f"delivery-{k}")
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    best = index.standing().select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    groups = scratch.store(best.join(sizes, "digest"), "groups")
    index.drop()
    scratch.close("signed", "groups")
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


COPIES_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
r as (select *, row_number() over w as k, first_value(doc_id) over w as keep_id from t window w as (partition by text_sha256 order by n desc, doc_id))
select doc_id, keep_id, count(*) over (partition by text_sha256) as group_size, k = 1 as kept, text_sha256 from r
"""
