"""Annotated text in columns: reading and writing (S1-S6, K8-K13), all by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FIELDS = 12


def read_lines(spark: SparkSession, path: str, pattern: str = "*_conll") -> DataFrame:
    """file, line_no, line of every file whose name fits.

    A file is one row until its lines are numbered, since a document's lines must
    keep their order; files are small, and are dealt to tasks by size.
    """
    whole = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_documents(spark: SparkSession, path: str, pattern: str = "*_conll") -> DataFrame:
    """As ``documents`` of ``read_lines``: a file is cut into documents, sentences and lines where it is read.

    Numbers are places in what is cut, so no line is shuffled or sorted, and a task holds a file at a time.
    """
    whole = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    docs = whole.select(F.explode(F.split("value", r"(?<=\n)(?=#begin document)")).alias("doc")).where(F.startswith(F.col("doc"), F.lit("#begin document")))
    head = lambda k: F.regexp_extract("doc", r"^#begin document \((.*)\); part (\d+)", k)
    told = lambda sentence: F.filter(F.split(sentence, "\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    sentences = F.filter(F.transform(F.split("doc", r"\r?\n(?: *\r?\n)+"), told), lambda x: F.size(x) > 0)
    rows = docs.select(head(1).alias("doc_id"), head(2).cast("int").alias("part_no"), F.posexplode(sentences).alias("sent_idx", "lines"))
    rows = rows.select("doc_id", "part_no", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.posexplode("lines").alias("tok_idx", "line"))
    return _fields(rows.withColumn("tok_idx", F.col("tok_idx").cast("bigint")))


def documents(lines: DataFrame) -> DataFrame:
    """doc_key ``id (part n)``, sent_idx, tok_idx and the fields of each token line.

    ``#begin document (id); part n`` opens a document, an empty line a sentence.
    A line of fewer than twelve fields raises.
    """
    by_file = Window.partitionBy("file").orderBy("line_no")
    opens = F.regexp_extract("line", r"^#begin document \((.*)\); part (\d+)", 1)
    rows = lines.withColumns({"_open": F.startswith(F.col("line"), F.lit("#begin document")), "_id": opens, "_part": F.regexp_extract("line", r"^#begin document \(.*\); part (\d+)", 1)})
    rows = rows.withColumn("_doc", F.sum(F.col("_open").cast("int")).over(by_file)).where("_doc > 0")
    by_doc = Window.partitionBy("file", "_doc").orderBy("line_no")
    rows = rows.withColumns({"doc_id": F.first("_id").over(by_doc), "part_no": F.first("_part").over(by_doc).cast("int"), "_gap": F.sum((F.trim("line") == "").cast("int")).over(by_doc)})
    tokens = rows.where("trim(line) <> '' and not startswith(line, '#')")
    sentence = (F.dense_rank().over(Window.partitionBy("file", "_doc").orderBy("_gap")) - 1).cast("bigint")
    place = (F.row_number().over(Window.partitionBy("file", "_doc", "_gap").orderBy("line_no")) - 1).cast("bigint")
    return _fields(tokens.withColumns({"sent_idx": sentence, "tok_idx": place}))


def _fields(tokens: DataFrame) -> DataFrame:
    tokens = tokens.withColumn("f", F.split(F.trim("line"), r"\s+"))
    f = F.when(F.size("f") < FIELDS, F.raise_error(F.concat(F.lit("fewer than twelve fields: "), F.col("line")))).otherwise(F.col("f"))
    tokens = tokens.withColumn("f", f)
    name = F.concat("doc_id", F.lit(" (part "), "part_no", F.lit(")"))
    return tokens.select(
        name.alias("doc_key"), "doc_id", "part_no", "sent_idx", "tok_idx", F.col("f")[3].alias("word"), F.col("f")[4].alias("pos"), F.col("f")[5].alias("parse_bit"),
        F.col("f")[9].alias("speaker"), F.col("f")[10].alias("ner_bit"), F.element_at("f", -1).alias("coref_bit"), F.col("line").alias("raw_line"),
    )


def entity_chunks(tokens: DataFrame) -> DataFrame:
    """Spans of ``(X)`` and ``(X*`` ... ``*)``."""
    w = Window.partitionBy("doc_key", "sent_idx").orderBy("tok_idx")
    opened = F.startswith(F.col("ner_bit"), F.lit("("))
    rows = tokens.withColumn("_g", F.sum(opened.cast("int")).over(w))
    name = F.regexp_extract("ner_bit", r"^\(([^*)]+)", 1)
    ends = F.min(F.when(F.endswith(F.col("ner_bit"), F.lit(")")), F.col("tok_idx")))
    return rows.where("_g > 0").groupBy("doc_key", "sent_idx", "_g").agg(F.min("tok_idx").alias("start_idx"), (ends + 1).alias("end_idx"), F.max(name).alias("label")).where("end_idx is not null").select("doc_key", "sent_idx", "start_idx", "end_idx", "label")


def coref_chunks(tokens: DataFrame, pattern: str = r"\(\d+\)|\(\d+|\d+\)") -> DataFrame:
    """Spans of nested coreference bits (S6): a label's brackets match last in, first out.

    Marks may be separated by ``|`` or follow each other. Of labels on one span
    the smallest is kept.
    """
    marks = tokens.select("doc_key", "sent_idx", "tok_idx", F.posexplode(F.regexp_extract_all("coref_bit", F.lit(pattern), F.lit(0))).alias("k", "mark"))
    label = F.regexp_extract("mark", r"(\d+)", 1).cast("bigint")
    opens, closes = F.startswith(F.col("mark"), F.lit("(")), F.endswith(F.col("mark"), F.lit(")"))
    # a single-token mark is an opening and a closing one
    events = marks.withColumn("label", label).select("doc_key", "sent_idx", "tok_idx", "k", "label", F.explode(F.filter(F.array(F.when(opens, F.lit(1)), F.when(closes, F.lit(-1))), lambda x: x.isNotNull())).alias("step"))
    w = Window.partitionBy("doc_key", "sent_idx", "label").orderBy("tok_idx", "k", F.desc("step"))
    depth = F.sum("step").over(w)
    # an opening and its closing bracket have the same depth around them, and alternate there
    level = events.withColumn("_d", depth).withColumn("_level", F.when(F.col("step") == 1, F.col("_d")).otherwise(F.col("_d") + 1))
    order = Window.partitionBy("doc_key", "sent_idx", "label", "_level").orderBy("tok_idx", "k", F.desc("step"))
    spans = level.withColumns({"_next": F.lead("step").over(order), "_end": F.lead("tok_idx").over(order)}).where("step = 1 and _next = -1")
    return spans.groupBy("doc_key", "sent_idx", F.col("tok_idx").alias("start_idx"), (F.col("_end") + 1).alias("end_idx")).agg(F.min("label").alias("label"))


def coref_bits(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """``coref_bit`` of every token: openings, single tokens, closings, by ``|``; ``-`` for none.

    Longer spans open first and close last; every mention of one token is written.
    """
    c = chunks.select("doc_key", "sent_idx", "start_idx", "end_idx", "label")
    single = F.col("end_idx") - F.col("start_idx") == 1
    mark = lambda at, kind, order, text: F.struct(at.alias("tok_idx"), F.lit(kind).alias("kind"), order.alias("order"), text.alias("mark"))
    name = F.col("label").cast("string")
    events = F.when(single, F.array(mark(F.col("start_idx"), 1, F.lit(0).cast("bigint"), F.concat(F.lit("("), name, F.lit(")"))))).otherwise(
        F.array(mark(F.col("start_idx"), 0, -F.col("end_idx"), F.concat(F.lit("("), name)), mark(F.col("end_idx") - 1, 2, -F.col("start_idx"), F.concat(name, F.lit(")"))))
    )
    marks = c.select("doc_key", "sent_idx", "label", F.explode(events).alias("e")).groupBy("doc_key", "sent_idx", F.col("e.tok_idx").alias("tok_idx"))
    bits = marks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e.kind", "e.order", "label", "e.mark"))), lambda x: x["mark"]), "|").alias("bits"))
    return tokens.drop("coref_bit").join(bits, ["doc_key", "sent_idx", "tok_idx"], "left").withColumn("coref_bit", F.coalesce("bits", F.lit("-"))).drop("bits")


def entity_bits(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ner_bit`` of every token."""
    covers = [F.col("t.doc_key") == F.col("c.doc_key"), F.col("t.sent_idx") == F.col("c.sent_idx"), F.col("t.tok_idx") >= F.col("c.start_idx"), F.col("t.tok_idx") < F.col("c.end_idx")]
    opens, closes = F.col("tok_idx") == F.col("c.start_idx"), F.col("tok_idx") == F.col("c.end_idx") - 1
    bit = F.when(opens & closes, F.concat(F.lit("("), "c.label", F.lit(")"))).when(opens, F.concat(F.lit("("), "c.label", F.lit("*"))).when(closes, F.lit("*)")).otherwise(F.lit("*"))
    return tokens.drop("ner_bit").alias("t").join(chunks.alias("c"), covers, "left").select("t.*", F.when(F.col("c.label").isNull(), F.lit("*")).otherwise(bit).alias("ner_bit"))


def bio_labels(tokens: DataFrame, chunks: DataFrame, dropped: tuple[str, ...] = ("CARDINAL", "DATE", "MONEY", "ORDINAL", "PERCENT", "QUANTITY", "TIME")) -> DataFrame:
    """``bio`` of every token, of the chunks whose labels are not dropped."""
    covers = [F.col("t.doc_key") == F.col("c.doc_key"), F.col("t.sent_idx") == F.col("c.sent_idx"), F.col("t.tok_idx") >= F.col("c.start_idx"), F.col("t.tok_idx") < F.col("c.end_idx")]
    kept = chunks.where(~F.col("label").isin(*dropped))
    return tokens.alias("t").join(kept.alias("c"), covers, "left").select("t.*", F.when(F.col("c.label").isNull(), "O").when(F.col("t.tok_idx") == F.col("c.start_idx"), F.concat(F.lit("B-"), "c.label")).otherwise(F.concat(F.lit("I-"), "c.label")).alias("bio"))


def _as_text(lines: DataFrame) -> DataFrame:
    """One value for each document: head line, sentences with an empty line after each, end line."""
    sentences = lines.groupBy("doc_id", "part_no", "sent_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "line"))), lambda x: x["line"]), "\n").alias("s"))
    docs = sentences.groupBy("doc_id", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "s"))), lambda x: x["s"]), "\n\n").alias("body"))
    head = F.concat(F.lit("#begin document ("), "doc_id", F.lit("); part "), F.lpad(F.col("part_no").cast("string"), 3, "0"))
    return docs.select(F.concat(head, F.lit("\n"), "body", F.lit("\n\n#end document")).alias("value"))


def rewritten(tokens: DataFrame) -> DataFrame:
    """Documents as text, their raw lines by tabs with the last column replaced (K8)."""
    columns = F.split(F.trim("raw_line"), r"\s+")
    return _as_text(tokens.withColumn("line", F.array_join(F.concat(F.slice(columns, F.lit(1), F.size(columns) - 1), F.array("coref_bit")), "\t")))


def composed(tokens: DataFrame) -> DataFrame:
    """Documents as text from their parts; columns that are not known are ``-``."""
    dash = F.lit("-")
    return _as_text(tokens.withColumn("line", F.concat_ws("\t", "doc_id", "part_no", "tok_idx", "word", "pos", "parse_bit", dash, dash, dash, "speaker", "ner_bit", "coref_bit")))


def scoring_mentions(tokens: DataFrame) -> DataFrame:
    """doc_key, mention, cluster_id, order of a scoring file, repeated spans included (FIXTURES 1).

    Here an opening bracket is closed by the next closing one of its label.
    """
    chunks = coref_chunks(tokens)
    return chunks.select("doc_key", F.concat_ws(":", "sent_idx", "start_idx", "end_idx").alias("mention"), F.col("label").alias("cluster_id"))
