"""Feature templates as arrays of strings, native columns only.

A mention's own features are made once per mention and joined to its pairs, so
of the 53 features of a pair only those that compare two mentions are computed
per pair. Every vector has a fixed arity: 21 for anaphoricity, 53 for a pair.

Mentions have: doc_key, ment_idx, sent_idx, start_idx, end_idx, head, first,
last, prev1, next1, syn_uni, syn_bi, governor, sent_ment_idx, ner, animacy,
gender, number, speaker, genre, ment_type, contained_by_speaker,
contains_speaker, text (the span's words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.linguistic import canonical_pronoun, person_compat
from ..functions.strings import contained, feature, same_text, speaker_name
from .ordering import totals_before
from .pairs import mention_pairs

ANAPHORICITY, PAIR = 21, 53
MENTION_COLUMNS = ["sent_idx", "start_idx", "end_idx", "head", "text", "speaker", "ment_type", "genre", "contained_by_speaker", "contains_speaker"]


def _c(name: str) -> Column:
    return F.col(name)


def pronoun_or_type() -> Column:
    """The canonical pronoun of a pronominal mention, the type of any other."""
    canonical = canonical_pronoun(_c("head"))
    return F.when(_c("ment_type") == "PRONOMINAL", F.when(canonical == "", F.lower("head")).otherwise(canonical)).otherwise(_c("ment_type"))


def anaphoricity_features() -> Column:
    """The 21 features of a mention alone."""
    f = feature
    return F.array(
        f("SNMentLen", _c("end_idx") - _c("start_idx")), f("SNMentHead", F.lower("head")), f("SNMentFirst", F.lower("first")), f("SNMentLast", F.lower("last")),
        f("SNMentPreceding", F.lower("prev1")), f("SNMentFollowing", F.lower("next1")), f("SNSynPos", _c("syn_uni")), f("SNSynPos2", _c("syn_bi")),
        f("SNGovernor", _c("governor")), f("SNSentMentIdx", F.least(_c("sent_ment_idx"), F.lit(10))), f("SNNerStr", _c("ner")), f("SNAnimacy", _c("animacy")),
        f("SNGend", _c("gender")), f("SNNumber", _c("number")), f("SNPerson", person_compat(_c("head"))), f("CurrPronConjStr", pronoun_or_type()),
        f("SNSpeaker", speaker_name(_c("speaker"))), f("SNDocType", _c("genre")), f("SNMentHeadTrueCase", _c("head")),
        f("SNCurrContainedBySpeaker", _c("contained_by_speaker")), f("SNCurrContainsSpeaker", _c("contains_speaker")),
    )


def side_features(side: str) -> Column:
    """The 19 features of one mention of a pair; ``side`` is Prev (the antecedent) or Curr."""
    f = lambda name, value: feature(f"{side}{name}", value)
    return F.array(
        f("MentLen", _c("end_idx") - _c("start_idx")), f("MentHead", F.lower("head")), f("MentFirst", F.lower("first")), f("MentLast", F.lower("last")),
        f("MentPreceding", F.lower("prev1")), f("MentFollowing", F.lower("next1")), f("SynPos", _c("syn_uni")), f("SynPos2", _c("syn_bi")), f("MentGovernor", _c("governor")),
        f("SentMentIdx", F.least(_c("sent_ment_idx"), F.lit(10))), f("NerStr", _c("ner")), f("Animacy", _c("animacy")), f("Gend", _c("gender")), f("Number", _c("number")),
        f("Person", person_compat(_c("head"))), f("Speaker", speaker_name(_c("speaker"))), f("HeadTrueCase", _c("head")),
        f("ContainedBySpeaker", _c("contained_by_speaker")), f("ContainsSpeaker", _c("contains_speaker")),
    )


def pair_features() -> Column:
    """The 15 features of a pair's two mentions together (names m_<column> and a_<column>)."""
    return F.array(*_of_pair())


def _of_pair() -> list[Column]:
    f, m, a = feature, lambda c: _c(f"m_{c}"), lambda c: _c(f"a_{c}")
    same_speaker = speaker_name(m("speaker")) == speaker_name(a("speaker"))
    within = (m("sent_idx") == a("sent_idx")) & (((m("start_idx") <= a("start_idx")) & (m("end_idx") >= a("end_idx"))) | ((a("start_idx") <= m("start_idx")) & (a("end_idx") >= m("end_idx"))))
    return [
        f("Dist", F.least(_c("m") - _c("a"), F.lit(10))), f("SentDist", F.least(m("sent_idx") - a("sent_idx"), F.lit(10))), f("iWi", within), f("SameSpeaker", same_speaker), f("DocType", m("genre")),
        f("ExactStrMatch", same_text(m("text"), a("text"))), f("ThisContained", contained(m("text"), a("text"))), f("AntContained", contained(a("text"), m("text"))),
        f("ExactHeadMatch", same_text(m("head"), a("head"))), f("ThisHeadContained", contained(m("head"), a("text"))), f("AntHeadContained", contained(a("head"), m("text"))),
        f("CurrPronConjStr", m("conj")), f("PrevPronConjStr", a("conj")),
        f("AntContainedByDifferentSpeaker", a("contained_by_speaker") & ~same_speaker), f("AntContainsDifferentSpeaker", a("contains_speaker") & ~same_speaker),
    ]


def featurized_pairs(mentions: DataFrame, keep: Column | None = None, back: int | None = None) -> DataFrame:
    """doc_key, m, a and ``feats``, the 53 features of each pair (strings); ``keep`` and ``back`` as for ``mention_pairs``."""
    own = mentions.withColumns({"as_ante": side_features("Prev"), "as_curr": side_features("Curr"), "conj": pronoun_or_type()})
    pairs = mention_pairs(own, [*MENTION_COLUMNS, "conj", "as_ante", "as_curr"], keep=keep, back=back)
    return pairs.select("doc_key", "m", "a", F.concat("a_as_ante", "m_as_curr", pair_features()).alias("feats"))


def pair_templates(mentions: DataFrame) -> DataFrame:
    """template, cnt over the vectors of all pairs. The names of a mention's own features are cut once a mention, not once a pair;
    those of a pair's are generated code, and pairs are counted by their names before these are rows."""
    cut = lambda x: F.substring_index(x, "=", 1)
    own = mentions.withColumns({"as_ante": F.array_join(F.transform(side_features("Prev"), cut), " "), "as_curr": F.array_join(F.transform(side_features("Curr"), cut), " "), "conj": pronoun_or_type()})
    pairs = mention_pairs(own, [*MENTION_COLUMNS, "conj", "as_ante", "as_curr"])
    counts = pairs.groupBy("a_as_ante", "m_as_curr", F.concat_ws(" ", *map(cut, _of_pair())).alias("of_pair")).agg(F.count("*").alias("n"))
    each = counts.select(F.explode(F.split(F.concat_ws(" ", "a_as_ante", "m_as_curr", "of_pair"), " ")).alias("template"), "n")
    return each.groupBy("template").agg(F.sum("n").alias("cnt"))


def with_ids(vectors: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``feats`` as ids in place of strings, 0 for unknown ones, their order kept.

    Each distinct feature is looked up by a join; vectors are put together again
    by one grouping on their keys.
    """
    each = vectors.select(*keys, F.posexplode("feats").alias("at", "feat"))
    coded = each.join(index, "feat", "left").withColumn("feat_idx", F.coalesce("feat_idx", F.lit(0)).cast("int"))
    return coded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "feat_idx"))).alias("x")).select(*keys, F.transform("x", lambda e: e["feat_idx"]).alias("feats"))


def unknown_replaced(vectors: DataFrame, dummy: int) -> DataFrame:
    """Id 0 as the dummy id, one above the largest known."""
    return vectors.withColumn("feats", F.transform("feats", lambda x: F.when(x == 0, F.lit(dummy)).otherwise(x)))


def offsets(vectors: DataFrame, order: list[str]) -> DataFrame:
    """Per document the number of ids and the sum over the documents before it."""
    sizes = vectors.groupBy("doc_key").agg(F.sum(F.size("feats")).cast("bigint").alias("n_ids"), F.count("*").alias("n_vectors"))
    return totals_before(sizes, order, ids_before=F.col("n_ids"), vectors_before=F.col("n_vectors"))


def triangular_place(m: Column, a: Column) -> Column:
    """The place of pair (m, a), a < m, both from 0, in a document's list of pairs."""
    return (m * (m - 1) / 2).cast("bigint") + a


def mentions_of_pairs(pairs: Column) -> Column:
    """How many mentions a document of so many pairs has: n (n - 1) / 2 of them."""
    return ((1 + F.sqrt(1 + 8 * pairs)) / 2).cast("bigint")


def document_rows(vectors: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The vectors with ``row``, their place in their document's list, from 0, and ``rows``, its length (G25): a document or one
    mention is then a filter, and a list of pairs in order of (m, a) has pair (m, a) at ``triangular_place``."""
    w = Window.partitionBy("doc_key")
    return vectors.withColumns({"row": F.row_number().over(w.orderBy(*keys)) - 1, "rows": F.count("*").over(w)}).withColumnRenamed("row", place)


def topic_label(ment_type: Column, cluster: Column, feature_set: str = "") -> Column:
    """The label of a mention's likeliest cluster; ``noprons`` and ``nonomsprops`` mask it."""
    out = cluster.cast("string")
    if "nonomsprops" in feature_set:
        out = F.when(ment_type.isin("NOMINAL", "PROPER"), "NOMPROP").otherwise(out)
    return F.when(ment_type == "PRONOMINAL", "PRON").otherwise(out) if "noprons" in feature_set else out


def feature_stats(vectors: DataFrame) -> DataFrame:
    """Vectors, their mean size and largest id."""
    return vectors.agg(F.count("*").alias("vectors"), F.avg(F.size("feats")).alias("mean_size"), F.max(F.array_max("feats")).cast("bigint").alias("largest_id"))


def weight_stats(weights: DataFrame) -> DataFrame:
    """Nonzero weights, squared norm and sum of magnitudes."""
    return weights.agg(F.count_if(F.expr("weight <> 0")).alias("nonzero"), F.sum(F.col("weight") * F.col("weight")).alias("squared_norm"), F.sum(F.abs("weight")).alias("l1_norm"))
