"""Order, limits and top-k of documents and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Scratch


def by_name(docs: DataFrame, doc_id: str = "doc_id", part: str = "part_no") -> DataFrame:
    """Documents by their printable name ``id (part n)``."""
    return docs.withColumn("doc_key", F.concat(F.col(doc_id), F.lit(" (part "), F.col(part).cast("string"), F.lit(")"))).orderBy("doc_key")


def shuffled(docs: DataFrame, key: str = "doc_key", seed: int = 0) -> DataFrame:
    """A fixed random order: by a hash of the key and the seed, then the key."""
    return docs.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).orderBy("_h", key).drop("_h")


def first_documents(rows: DataFrame, most: int, key: str = "doc_key") -> DataFrame:
    """All rows of the first so many documents (T5). The cap is on documents, not files."""
    if most < 0:
        return rows
    return rows.join(rows.select(key).distinct().orderBy(key).limit(most), key, "left_semi")


def top_keys(counts: DataFrame, most: int, key: str = "key", cnt: str = "cnt") -> DataFrame:
    """The keys of the largest counts; of equals the smaller key."""
    return counts.orderBy(F.desc(cnt), key).limit(most)


def top_antecedents(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The best antecedents of each mention, with their rank from 1 (T4)."""
    order = Window.partitionBy("doc_key", "m").orderBy(F.desc("score"), "a")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def in_key_order(rows: DataFrame, key: str) -> DataFrame:
    """By the elements of an array key, a beginning before what it begins."""
    return rows.orderBy(key)


def training_pool(train: DataFrame, held_out: DataFrame, ignore: bool = False) -> DataFrame:
    """Both sets for counting words, or the first alone."""
    return train if ignore else train.unionByName(held_out)


def totals_before(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """The rows with the sums of columns over all rows before them; ``order`` tells all rows apart.

    The rows are dealt by ranges of the order and stored, so that the sums within
    ranges and over ranges see the same ranges; one row a range meets in one task.
    """
    ranged = Scratch(rows.sparkSession, "totals").store(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    earlier = (Window.unboundedPreceding, -1)
    within, over = Window.partitionBy("_p").orderBy(*order).rowsBetween(*earlier), Window.orderBy("_p").rowsBetween(*earlier)
    sizes = ranged.groupBy("_p").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = sizes.select("_p", *(F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"_{n}") for n in sums))
    placed = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    return placed.join(F.broadcast(before), "_p").select(*rows.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def maxima(clusters: DataFrame, batch: int = 1) -> DataFrame:
    """Most mentions and clusters of a document, and most mentions of ``batch`` documents in a row."""
    each = clusters.groupBy("doc_key").agg(F.count("*").alias("mentions"), F.count_distinct("cluster_id").alias("clusters"))
    batches = totals_before(each, ["doc_key"], place=F.lit(1)).groupBy(F.floor(F.col("place") / batch).alias("b")).agg(F.sum("mentions").alias("in_batch"), F.max("mentions").alias("mentions"), F.max("clusters").alias("clusters"))
    return batches.agg(F.max("mentions").alias("most_mentions"), F.max("clusters").alias("most_clusters"), F.max("in_batch").alias("most_in_batch"))


def of_words(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Counts of the listed keys only."""
    return counts.join(words.select(F.col("word").alias("key")).distinct(), "key", "left_semi")


def either(a: Column, b: Column) -> Column:
    """Element-wise or of two binary vectors (U4)."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def cluster_vector(first: Column, middle: Column, last: Column, size: Column, distance: Column, width: int) -> Column:
    """Binary vectors of first, middle (or-merged) and last mention, then size and distance buckets of 11 places."""
    bucket = lambda x: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: (k == F.least(x, F.lit(10))).cast("int"))
    none = F.array_repeat(F.lit(0), width)
    return F.concat(F.coalesce(first, none), F.coalesce(middle, none), F.coalesce(last, none), bucket(size), bucket(distance))
