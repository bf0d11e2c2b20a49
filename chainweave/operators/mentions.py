"""From tokens and chunks to ordered, typed mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.linguistic import NON_MENTION_NER, mention_type
from ..plans.config import LanguagePack

SPAN = ["doc_key", "sent_idx", "start_idx", "end_idx"]


def proto_mentions(entities: DataFrame, phrases: DataFrame, pronouns: DataFrame) -> DataFrame:
    """Candidate spans with heads: entities, the largest phrases of each head, pronouns.

    All three have doc_key, sent_idx, start_idx, end_idx, head_idx; ``entities``
    also label, ``phrases`` also next_pos (the tag after the span). A phrase that
    is not the largest of its head stays if a comma or a conjunction follows.
    Ties among equally large phrases go to the earliest start, then the latest end.
    """
    names = entities.where(~F.col("label").isin(*NON_MENTION_NER))
    inside = [F.col(f"p.{c}") == F.col(f"e.{c}") for c in ("doc_key", "sent_idx")] + [F.col("e.start_idx") <= F.col("p.start_idx"), F.col("p.end_idx") <= F.col("e.end_idx")]
    outside = lambda df: df.alias("p").join(names.alias("e"), inside, "left_anti")
    heads = Window.partitionBy("doc_key", "sent_idx", "head_idx").orderBy("start_idx", F.col("end_idx").desc())
    largest = outside(phrases).withColumn("n", F.row_number().over(heads)).where((F.col("n") == 1) | F.col("next_pos").isin(",", "CC"))
    columns = [*SPAN, "head_idx"]
    return names.select(columns).union(largest.select(columns)).union(outside(pronouns).select(columns)).distinct()


def with_possessive(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans that a possessive ending follows are extended by it (F2)."""
    after = tokens.where(F.col("word").isin("'s")).select("doc_key", "sent_idx", F.col("tok_idx").alias("end_idx"), F.lit(1).alias("one"))
    return entities.join(after, ["doc_key", "sent_idx", "end_idx"], "left").withColumn("end_idx", F.col("end_idx") + F.coalesce("one", F.lit(0))).drop("one").select(entities.columns)


def numbered(spans: DataFrame) -> DataFrame:
    """Mentions in order of sentence, head, end and start, numbered from 0 in each document."""
    order = Window.partitionBy("doc_key").orderBy("sent_idx", "head_idx", "end_idx", "start_idx")
    return spans.withColumn("ment_idx", (F.row_number().over(order) - 1).cast("bigint"))


def with_entity_label(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ner``: the label of the last chunk that covers the head, else O (F8)."""
    covers = [F.col("m.doc_key") == F.col("c.doc_key"), F.col("m.sent_idx") == F.col("c.sent_idx"), F.col("c.start_idx") <= F.col("m.head_idx"), F.col("m.head_idx") < F.col("c.end_idx")]
    last = mentions.alias("m").join(chunks.alias("c"), covers).groupBy("m.doc_key", "m.ment_idx").agg(F.max_by("c.label", F.struct("c.start_idx", "c.end_idx")).alias("ner"))
    return mentions.join(last, ["doc_key", "ment_idx"], "left").withColumn("ner", F.coalesce("ner", F.lit("O")))


def typed(mentions: DataFrame) -> DataFrame:
    """``ment_type`` of mentions that have head, ner and, if known, pos."""
    pos = F.col("pos") if "pos" in mentions.columns else None
    return mentions.withColumn("ment_type", mention_type(F.col("end_idx") - F.col("start_idx"), F.col("head"), F.col("ner"), pos))


def span_head(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``head_idx`` of each span: its last token whose parent is outside, else its last token."""
    within = [F.col("s.doc_key") == F.col("t.doc_key"), F.col("s.sent_idx") == F.col("t.sent_idx"), F.col("t.tok_idx") >= F.col("s.start_idx"), F.col("t.tok_idx") < F.col("s.end_idx")]
    leaves = (F.col("t.parent_idx") < F.col("s.start_idx")) | (F.col("t.parent_idx") >= F.col("s.end_idx"))
    heads = spans.alias("s").join(tokens.alias("t"), within).groupBy(*(F.col(f"s.{c}") for c in SPAN)).agg(F.max(F.when(leaves, F.col("t.tok_idx"))).alias("head_idx"))
    return spans.join(heads, SPAN, "left").withColumn("head_idx", F.coalesce("head_idx", F.col("end_idx") - 1))


def gold_mentions(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Annotated chunks as numbered mentions; of labels on one span the smallest counts (G1)."""
    spans = chunks.groupBy(*SPAN).agg(F.min("label").alias("cluster_label"))
    return numbered(span_head(tokens, spans))


def i_within_i(a: str, b: str) -> Column:
    """Whether one of two spans of a sentence contains the other."""
    c = lambda side, name: F.col(f"{side}.{name}")
    covers = lambda x, y: (c(x, "start_idx") <= c(y, "start_idx")) & (c(x, "end_idx") >= c(y, "end_idx"))
    return (c(a, "sent_idx") == c(b, "sent_idx")) & (covers(a, b) | covers(b, a))


def place_in_sentence(mentions: DataFrame, name: str = "sent_ment_idx") -> DataFrame:
    """The mention's place in its sentence, from 1."""
    order = Window.partitionBy("doc_key", "sent_idx").orderBy("ment_idx")
    return mentions.withColumn(name, F.row_number().over(order).cast("bigint"))


def context_words(tokens: DataFrame) -> DataFrame:
    """Words one and two before and after each token, with sentence-end marks beyond."""
    order = Window.partitionBy("doc_key", "sent_idx").orderBy("tok_idx")
    near = {"prev2": F.lag("word", 2), "prev1": F.lag("word", 1), "next1": F.lead("word", 1), "next2": F.lead("word", 2)}
    marks = {"prev2": "<S>", "prev1": "<s>", "next1": "</s>", "next2": "</S>"}
    return tokens.withColumns({n: F.coalesce(f.over(order), F.lit(marks[n])) for n, f in near.items()})


def with_governors(mentions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Parent and grandparent of each mention's head (J12). ``dependencies``: doc_key, sent_idx, tok_idx, parent_idx, word, pos."""
    d = lambda p, at: dependencies.select("doc_key", "sent_idx", F.col("tok_idx").alias(at), *(F.col(c).alias(f"{p}_{c}") for c in ("parent_idx", "word", "pos")))
    key = ["doc_key", "sent_idx"]
    one = mentions.join(d("own", "head_idx").drop("own_word", "own_pos"), [*key, "head_idx"], "left")
    two = one.join(d("gov", "own_parent_idx"), [*key, "own_parent_idx"], "left")
    return two.join(d("grand", "gov_parent_idx").drop("grand_parent_idx"), [*key, "gov_parent_idx"], "left")


def matched(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted and gold mentions of one span."""
    return predicted.select(*SPAN, F.col("ment_idx").alias("pred_idx")).join(gold.select(*SPAN, F.col("ment_idx").alias("gold_idx")), SPAN)


def missed(gold: DataFrame, predicted: DataFrame, loose: bool = False) -> DataFrame:
    """Gold mentions that no prediction has (J3); ``loose`` compares places without the sentence."""
    return gold.join(predicted, [c for c in SPAN if not (loose and c == "sent_idx")], "left_anti")


def recall(gold: DataFrame, predicted: DataFrame, loose: bool = False) -> DataFrame:
    """found and all gold mentions."""
    on = [c for c in SPAN if not (loose and c == "sent_idx")]
    known = predicted.select(on).distinct().withColumn("found", F.lit(1))
    return gold.join(known, on, "left").agg(F.coalesce(F.sum("found"), F.lit(0)).cast("bigint").alias("found"), F.count("*").alias("gold"))


def phrase_spans(constituents: DataFrame, tokens: DataFrame, pack: LanguagePack) -> DataFrame:
    """doc_key, sent_idx, start_idx, end_idx, head_idx of the phrases that may be mentions in a language (X27, G34): its phrase
    labels and pronouns, without punctuation at the ends; what is punctuation only goes."""
    label = F.regexp_extract("label", r"^([^-=]+)", 1)
    phrases = constituents.where(label.isin(*pack.mention_phrases)).select("doc_key", "sent_idx", "start_idx", "end_idx", "head_idx")
    pronouns = tokens.where(F.col("pos").isin(*pack.pronoun_tags)).select("doc_key", "sent_idx", F.col("tok_idx").alias("start_idx"), (F.col("tok_idx") + 1).alias("end_idx"), F.col("tok_idx").alias("head_idx"))
    words = tokens.where(~F.col("pos").isin(*pack.punctuation_tags)).select(F.col("doc_key").alias("d"), F.col("sent_idx").alias("s"), "tok_idx")
    spans = phrases.unionByName(pronouns)
    inside = (F.col("doc_key") == F.col("d")) & (F.col("sent_idx") == F.col("s")) & (F.col("tok_idx") >= F.col("start_idx")) & (F.col("tok_idx") < F.col("end_idx"))
    cut = spans.join(words, inside).groupBy("doc_key", "sent_idx", "start_idx", "end_idx", "head_idx").agg(F.min("tok_idx").alias("first"), (F.max("tok_idx") + 1).alias("stop"))
    head = F.least(F.greatest("head_idx", "first"), F.col("stop") - 1)
    return cut.select("doc_key", "sent_idx", F.col("first").alias("start_idx"), F.col("stop").alias("end_idx"), head.alias("head_idx")).distinct()
