"""From raw documents to token ids: each stage's result is written and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns all rows that it keeps; all but
the last return the columns of ``docs`` with their values, others than those of
the documents table (whatever their names) included. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chainweave.llm import bpe, decontamination, language, near_duplicates, pii
from chainweave.llm.common import Scratch, fresh, table


#: Entries of the caches of the last stage: fewer than a job of its own has, as earlier stages have grown the executors' heaps.
CACHED_WORDS = 40_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a certain language go; a missing language is filled in.

    A null, empty or letterless text has no language, so it goes; long texts are
    judged whole; a tie of two languages is not certain; repeated rows are judged alike.
    """
    pred, score, ambiguous = fresh(docs.columns, "lang_pred", "score", "ambiguous")
    found = language.predict(docs, language.fit(docs, ~language.held_out()), added=(pred, score, ambiguous))
    kept = found.where((F.col(pred) != language.UNDETERMINED) & ~F.col(ambiguous))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest id.

    Texts without words (null, empty) are no copies of each other and stay; long
    texts are compared whole; of equal rows with the smallest id any one stays; a
    missing id counts as the largest.
    """
    return near_duplicates.distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go.

    Each row is judged by its whole text, so null and repeated ids need no rule;
    null and empty texts stay; an empty benchmark lets all stay. Items count by
    their texts: their ids may be text, repeated or missing.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind in brackets; no document goes.

    n_chars becomes the new text's; a null text stays null, with null n_chars.
    Spans that overlap become one; repeated rows stay as they are.
    """
    (spans,) = fresh(docs.columns, "spans")
    return pii.detect(docs, spans=spans, redacted="text").withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the number of the text's ids, and hashes of them and of the text decoded from them.

    A null text counts as empty, which has no ids; repeated rows are each encoded; other columns go.
    """
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.round_trip(rows, tokenizer, cached=CACHED_WORDS).select(
        "doc_id", "lang", "source", "n_chars", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("pii", redact), ("bpe", tokenize)]

#: The stages are Python operators (classifiers, MinHash, byte-pair merges) that SQL can't express;
#: tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last, scratch = table(spark, sf_dir, "documents"), None, Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
