"""Threshold-scaled sketches of documents, in DataFrame functions only.

A sketch keeps every 5-word-shingle hash below a fixed fraction of the hash
range. Two sketches estimate likeness and containment whatever the texts'
lengths, since the same hashes survive in both, and sketches of parts merge to
exactly the sketch of the whole. A text so short that none of its hashes is below
the threshold keeps its least hash as a witness: a single value above the
threshold, known by that. It tells such texts apart, says nothing of containment
(null), and goes when a sketch with other hashes is merged in.

``beside`` gives each document its successor in descending id order without one
task seeing all rows: ids are cut into ranges at approximate quantiles, each
range is ordered on its own, and the first document of each range is also put
after the last of the range before it.

Defined results: null text counts as empty. Two witnesses, or two empty sketches
(no words), are alike (1) if equal, else not (0); the containment of a text
without words is 1. A text of fewer than five words is
one shingle; documents of equal id are ordered by text; null ids come last; the
only document of a table follows itself; long texts are used whole; other columns
are kept by ``with_sketch`` and ``beside``, but those with the names they add
(``next``, and names that begin with an underscore).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
#: Share of the hashes that a sketch keeps.
FRACTION = 0.25
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, RANGES = 2000, 1 << 16


def words(text: Column) -> Column:
    """Lower-cased A-Z; a word is a run of ASCII letters, digits and non-ASCII characters."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingle_hashes(terms: Column, length: int = SHINGLE) -> Column:
    """A 64-bit hash for each shingle of an array of words."""
    count = F.size(terms)
    places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count - (length - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(terms, i, length)))


def _threshold(fraction: float) -> Column:
    return F.lit(int(-(2**63) + fraction * 2**64))


def kept(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch of an array of hashes: sorted, each once; the witness if none is below the threshold."""
    below = F.filter(hashes, lambda h: h < _threshold(fraction))
    return F.array_sort(F.array_distinct(F.when((F.size(below) > 0) | (F.size(hashes) == 0), below).otherwise(F.array(F.array_min(hashes)))))


def with_sketch(docs: DataFrame, text: str, sketch: str) -> DataFrame:
    """``docs`` and a sketch column; each step is a projection, so nothing is computed twice."""
    steps = docs.withColumn("_words", words(F.col(text)))
    steps = steps.withColumn("_hashes", shingle_hashes(F.col("_words"))).drop("_words")
    return steps.withColumn(sketch, kept(F.col("_hashes"))).drop("_hashes")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; null if a is only a witness."""
    there = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.array_min(a) < _threshold(fraction), there)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the shingles of both: equal to that of their union."""
    return kept(F.array_union(a, b), fraction)


def as_text(sketch: Column) -> Column:
    """Hexadecimal, 16 digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _range_of(id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below the id, by two short searches; -1 for null."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)] or [[]]
    heads = F.from_json(F.lit(str([g[0] for g in groups[1:]])), "array<bigint>")
    inner = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    group = F.size(F.filter(heads, lambda c: c <= id))
    return F.coalesce(F.when(id.isNotNull(), group * step + F.size(F.filter(F.element_at(inner, group + 1), lambda c: c <= id))), F.lit(-1))


def beside(docs: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """``docs`` and, as ``next``, a struct of ``columns`` of its successor in descending order of id."""
    spark = docs.sparkSession
    rows = docs.select(id).agg(F.count("*")).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = max(1, min(RANGES, max(4 * parts, rows // RANGE_ROWS), rows))
    shares = [k / many for k in range(1, many)]
    cuts = docs.select(F.percentile_approx(id, shares, max(10_000, 4 * many)).alias("q")).first()[0] if shares else []
    ranged = docs.withColumn("_range", _range_of(F.col(id), sorted({int(c) for c in cuts or []})))
    # the first id of each range: at most RANGES rows
    firsts = sorted((r[0], r[1]) for r in ranged.groupBy("_range").agg(F.max(id)).collect())
    before = [r for r, _ in firsts[1:]] + [r for r, _ in firsts[:1]]
    after = spark.createDataFrame([(f, t) for (_, f), t in zip(firsts, before)], "_first bigint, _to int")
    extra = docs.join(F.broadcast(after), F.col(id).eqNullSafe(F.col("_first"))).drop("_first").withColumnRenamed("_to", "_range").withColumn("_extra", F.lit(True))
    both = ranged.withColumn("_extra", F.lit(False)).unionByName(extra)
    order = Window.partitionBy("_range").orderBy("_extra", F.col(id).desc_nulls_last(), *columns)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("not _extra").drop("_extra", "_range")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they and the next document's are."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = beside(source, "doc_id", ["text"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - cut)"), F.expr("left(next.text, cut)"))
    rows = paired.withColumns({"n_chars": n, "cut": cut}).withColumn("edited", edited).withColumn("next_text", F.col("next.text")).drop("next", "cut")
    for text, sketch in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = with_sketch(rows, text, sketch)
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
