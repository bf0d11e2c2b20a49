"""Dictionaries, n-grams, features, clusterings and pointers as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import totals_before


def numbered_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """file, line_no, line of whole files read with ``wholetext``."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(value, "\r?\n")).alias("line_no", "line")).where("line <> ''")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark.read.text(path, wholetext=True))


def gender_dictionary(lines: DataFrame, line: str = "value") -> DataFrame:
    """key and counts (male, female, neutral, plural) of ``word [word...] m f n p``; equal keys are summed."""
    f = F.split(F.trim(line), r"\s+")
    number = lambda k: F.element_at("f", k).try_cast("bigint")
    rows = lines.select(f.alias("f")).where("size(f) >= 5").select(F.array_join(F.slice("f", F.lit(1), F.size("f") - 4), " ").alias("key"), *(number(k - 5).alias(f"c{k}") for k in (1, 2, 3, 4)))
    return rows.where("c1 is not null and c2 is not null and c3 is not null and c4 is not null").groupBy("key").agg(F.array(*(F.sum(f"c{k}") for k in (1, 2, 3, 4))).alias("counts"))


def word_list(lines: DataFrame, lower: bool = True, line: str = "value") -> DataFrame:
    """word: each once."""
    word = F.trim(line)
    return lines.select((F.lower(word) if lower else word).alias("word")).where("word <> ''").distinct()


def ngrams(lines: DataFrame, line: str = "value") -> DataFrame:
    """words and cnt of ``word ... word count``."""
    f = F.split(F.trim(line), r"\s+")
    return lines.select(f.alias("f")).where("size(f) >= 2").select(F.slice("f", F.lit(1), F.size("f") - 1).alias("words"), F.element_at("f", -1).try_cast("bigint").alias("cnt")).where("cnt is not null")


def query_counts(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Word counts (two fields) and word pair counts (three fields)."""
    f = lines.select(F.split(F.trim(line), r"\s+").alias("f"))
    one = f.where("size(f) = 2").select(F.col("f")[0].alias("word"), F.col("f")[1].cast("double").alias("cnt"))
    return one, f.where("size(f) = 3").select(F.col("f")[0].alias("x"), F.col("f")[1].alias("y"), F.col("f")[2].cast("double").alias("cnt"))


def query_counts_text(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Lines ``key ... count`` in order of the keys, counts cut to integers."""
    return counts.select(F.concat_ws(" ", *keys, F.floor("cnt").cast("string")).alias("value")).orderBy("value")


def _cells(line: str) -> Column:
    return F.slice(F.split(line, r"\|"), F.lit(2), F.size(F.split(line, r"\|")))


def mention_features(lines: DataFrame, doc: str = "doc_key", line: str = "line") -> DataFrame:
    """doc_key, m, feats of ``n|f f|f f``."""
    ids = lambda c: F.transform(F.filter(F.split(F.trim(c), " "), lambda x: x != ""), lambda x: x.cast("int"))
    return lines.select(F.col(doc).alias("doc_key"), F.posexplode(_cells(line)).alias("m", "cell")).select("doc_key", F.col("m").cast("bigint").alias("m"), ids(F.col("cell")).alias("feats"))


def pair_features(lines: DataFrame, doc: str = "doc_key", line: str = "line") -> DataFrame:
    """doc_key, m, a, feats of ``n|self|f|self|f|f|self``: row m has m pair cells, then one of its own, which is skipped."""
    ids = lambda c: F.transform(F.filter(F.split(F.trim(c), " "), lambda x: x != ""), lambda x: x.cast("int"))
    cells = lines.select(F.col(doc).alias("doc_key"), F.posexplode(_cells(line)).alias("k", "cell"))
    # cell k is in row m where m (m + 1) / 2 <= k
    m = F.floor((F.sqrt(8 * F.col("k") + 1) - 1) / 2).cast("bigint")
    rows = cells.withColumn("m", m).withColumn("a", (F.col("k") - F.col("m") * (F.col("m") + 1) / 2).cast("bigint"))
    return rows.where("a < m").select("doc_key", "m", "a", ids(F.col("cell")).alias("feats"))


def _joined(rows: DataFrame, keys: list[str], order: list[str], cell: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, cell.alias("_cell")))), lambda x: x["_cell"]), glue)


def _ids(feats: str, sort: bool) -> Column:
    return F.array_join(F.transform(F.array_sort(feats) if sort else F.col(feats), lambda x: x.cast("string")), " ")


def mention_features_text(vectors: DataFrame) -> DataFrame:
    """doc_key and ``n|f f|f f``, ids ascending (K3)."""
    return vectors.groupBy("doc_key").agg(F.concat(F.count("*").cast("string"), F.lit("|"), _joined(vectors, [], ["m"], _ids("feats", True), "|")).alias("value"))


def pair_features_text(vectors: DataFrame, mentions: DataFrame, own: Column | None = None, blank: DataFrame | None = None) -> DataFrame:
    """doc_key and ``n|self|f|self|f|f|self`` (K1, K2, K4).

    ``own`` is the text of a mention's own cell (column doc_key, m of ``mentions``),
    the bias id by default; cells of pairs in ``blank`` are left empty.
    """
    cells = vectors.select("doc_key", "m", "a", _ids("feats", False).alias("cell"))
    if blank is not None:
        cells = cells.join(blank.select("doc_key", "m", "a", F.lit(True).alias("_b")), ["doc_key", "m", "a"], "left").withColumn("cell", F.when(F.col("_b"), "").otherwise(F.col("cell"))).drop("_b")
    selves = mentions.select("doc_key", F.col("ment_idx").alias("m"), F.col("ment_idx").alias("a"), (F.lit("0") if own is None else own).alias("cell"))
    both = cells.unionByName(selves)
    return both.groupBy("doc_key").agg(F.concat(F.count_if(F.expr("a = m")).cast("string"), F.lit("|"), _joined(both, [], ["m", "a"], F.col("cell"), "|")).alias("value"))


def clusters_from_text(lines: DataFrame, doc: str = "doc_key", line: str = "line") -> DataFrame:
    """doc_key, ment_idx, cluster_id of ``0|1 2 4|3``."""
    groups = lines.select(F.col(doc).alias("doc_key"), F.posexplode(F.split(line, r"\|")).alias("cluster_id", "members"))
    return groups.select("doc_key", F.explode(F.split(F.trim("members"), " ").cast("array<bigint>")).alias("ment_idx"), F.col("cluster_id").cast("bigint").alias("cluster_id"))


def clusters_text(clusters: DataFrame) -> DataFrame:
    """doc_key and ``0|1 2 4|3``, clusters by first mention (K5)."""
    each = clusters.groupBy("doc_key", "cluster_id").agg(F.array_sort(F.collect_list("ment_idx")).alias("ms"))
    return each.groupBy("doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ms")), lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), " ")), "|").alias("value"))


def pointers_from_text(lines: DataFrame, docs: DataFrame, line: str = "line") -> DataFrame:
    """doc_key, m, a of one line for each document, in order of the documents' names.

    ``lines``: line_no, line; ``docs``: doc_key.
    """
    named = totals_before(docs.select("doc_key").distinct(), ["doc_key"], line_no=F.lit(1))
    return lines.join(named, "line_no").select("doc_key", F.posexplode(F.split(F.trim(line), r"\s+")).alias("m", "a")).select("doc_key", F.col("m").cast("bigint").alias("m"), F.col("a").cast("bigint").alias("a"))


def pointers_text(pointers: DataFrame) -> DataFrame:
    """doc_key and ``0 0 2 1``."""
    return pointers.groupBy("doc_key").agg(_joined(pointers, [], ["m"], F.col("a").cast("string"), " ").alias("value"))


def heads_text(mentions: DataFrame, shown: str = "head") -> DataFrame:
    """doc_key and ``n|head|head`` (K6)."""
    return mentions.groupBy("doc_key").agg(F.concat(F.count("*").cast("string"), F.lit("|"), _joined(mentions, [], ["ment_idx"], F.col(shown), "|")).alias("value"))


def index_text(index: DataFrame) -> DataFrame:
    """``idx : feature`` by idx (K7)."""
    return index.orderBy("feat_idx").select(F.concat_ws(" : ", "feat_idx", "feat").alias("value"))


def index_from_text(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.select(F.regexp_extract(line, r"^(\d+) : ", 1).cast("bigint").alias("feat_idx"), F.regexp_replace(line, r"^\d+ : ", "").alias("feat"))


def paragraphs(texts: DataFrame, mode: str = "blank", text: str = "text") -> DataFrame:
    """par_idx and paragraph of each text: by line, by empty lines, or the whole."""
    cut = {"line": F.split(text, "\r?\n"), "blank": F.split(text, r"\r?\n[ \t]*\r?\n"), "whole": F.array(text)}[mode]
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(cut).alias("par_idx", "paragraph"))


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """``value`` as lines of text in order of the keys; an existing folder is not overwritten."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Features, weights and models as compressed Parquet (K14, K17); read with ``spark.read.parquet``."""
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)
