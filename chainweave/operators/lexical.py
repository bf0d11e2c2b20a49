"""Counted vocabularies and dictionary codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import prefixes, suffixes, word_class, word_shape
from .ordering import totals_before


def counted(df: DataFrame, template: str, key: Column, cutoff: int = 20) -> DataFrame:
    """template, key, cnt of the keys that occur often enough (A1)."""
    return df.select(F.lit(template).alias("template"), key.alias("key")).where("key is not null").groupBy("template", "key").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= cutoff)


def positional_counts(mentions: DataFrame, cutoff: int = 20) -> DataFrame:
    """Words by position in the mention and around it (A2), in one pass: each mention gives at most ten rows.

    The five positions within a mention count those that are no pronouns.
    """
    open_class = ~F.col("ment_type").isin("PRONOMINAL", "DEMONSTRATIVE")
    n = F.col("end_idx") - F.col("start_idx")
    word = lambda name, c, when=None: F.struct(F.lit(name).alias("template"), (F.when(when, F.lower(c)) if when is not None else F.lower(c)).alias("key"))
    rows = F.array(
        word("head", F.col("head"), open_class), word("first", F.col("first"), open_class & (n > 1)),
        word("last", F.col("last"), open_class & (n > 1) & (F.col("head") != F.col("last"))),
        word("penultimate", F.col("penultimate"), open_class & (n > 2)), word("second", F.col("second"), open_class & (n > 3)),
        word("preceding", F.col("prev1")), word("following", F.col("next1")), word("preceding2", F.col("prev2")), word("following2", F.col("next2")), word("governor", F.col("governor")),
    )
    return mentions.select(F.explode(rows).alias("x")).select("x.*").where("key is not null").groupBy("template", "key").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= cutoff)


def affix_counts(tokens: DataFrame, cutoff: int = 20) -> DataFrame:
    """Prefixes and suffixes of 1-3 characters, shape and class of all words (A3): words are counted first."""
    words = tokens.groupBy("word").agg(F.count("*").alias("c"))
    lower = F.lower("word")
    tag = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("template"), v.alias("key")))
    rows = F.concat(tag("prefix", prefixes(lower)), tag("suffix", suffixes(lower)), tag("shape", F.array(word_shape(F.col("word")))), tag("class", F.array(word_class(F.col("word")))))
    return words.select(F.explode(rows).alias("x"), "c").groupBy("x.template", "x.key").agg(F.sum("c").alias("cnt")).where(F.col("cnt") >= cutoff)


def bilexical_counts(pairs: DataFrame, cutoff: int = 10) -> DataFrame:
    """Head pairs of current mention and antecedent, as written (A4)."""
    return pairs.groupBy(F.col("m_head").alias("current"), F.col("a_head").alias("antecedent")).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= cutoff)


def template_counts(features: DataFrame, feature: str = "feat", top: int = 200) -> DataFrame:
    """The most frequent feature templates, the text before ``=`` (A5); a top-k report."""
    counts = features.groupBy(F.substring_index(feature, "=", 1).alias("template")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "template").limit(top)


def feature_index(features: DataFrame, feature: str = "feat") -> DataFrame:
    """feat_idx, feat: dense ids from 1 in order of the feature's text; 0 is for unknown ones.

    Numbering goes by ranges of the text (``totals_before``).
    """
    known = features.select(F.col(feature).alias("feat")).where("feat is not null").distinct()
    return totals_before(known, ["feat"], feat_idx=F.lit(1)).select((F.col("feat_idx") + 1).alias("feat_idx"), "feat")


def indexed(features: DataFrame, index: DataFrame, feature: str = "feat") -> DataFrame:
    """``feat_idx`` of each feature; 0 for those that the index lacks."""
    return features.join(index.withColumnRenamed("feat", feature), feature, "left").withColumn("feat_idx", F.coalesce("feat_idx", F.lit(0)))


def word_or_fallback(df: DataFrame, words: DataFrame, word: str, fallback: Column, name: str) -> DataFrame:
    """The lower-cased word if it is in the vocabulary (column key), else the fallback."""
    known = words.select(F.col("key").alias("_key")).distinct()
    return df.join(known, F.lower(F.col(word)) == F.col("_key"), "left").withColumn(name, F.coalesce("_key", fallback)).drop("_key")


def affix_fallback(df: DataFrame, affixes: DataFrame, word: str, name: str, kind: str = "suffix") -> DataFrame:
    """The longest known suffix or prefix (``kind``) of a word, of 3, 2 or 1 characters, else empty."""
    known = affixes.where(F.col("template") == kind).select("key").distinct()
    out, cut = df, F.right if kind == "suffix" else F.left
    for n in (3, 2, 1):
        part = F.when(F.char_length(word) >= n, cut(F.lower(word), F.lit(n)))
        out = out.join(known.withColumnRenamed("key", f"_s{n}"), part == F.col(f"_s{n}"), "left")
    return out.withColumn(name, F.coalesce("_s3", "_s2", "_s1", F.lit(""))).drop("_s1", "_s2", "_s3")


def gender_counts(phrases: DataFrame, dictionary: DataFrame, phrase: str, head: str) -> DataFrame:
    """Counts of a phrase, or of its head where the phrase has none (J8). ``dictionary``: key, counts."""
    d = lambda k, c: dictionary.select(F.col("key").alias(k), F.col("counts").alias(c))
    some = F.exists("_pc", lambda x: x > 0)
    both = phrases.join(d("_p", "_pc"), F.lower(phrase) == F.col("_p"), "left").join(d("_h", "_hc"), F.lower(head) == F.col("_h"), "left")
    return both.withColumn("counts", F.when(some, F.col("_pc")).otherwise(F.col("_hc"))).drop("_p", "_h", "_pc", "_hc")


def copula_counts(grams: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of ``X is Y`` and ``X is a Y`` among n-grams, for wanted head pairs in either order.

    ``grams``: words array, cnt; ``heads``: head; ``pairs``: x, y.
    """
    w = F.col("words")
    n = F.size(w)
    hit = ((n == 3) & (w[1] == "is")) | ((n == 4) & (w[1] == "is") & w[2].isin("a", "an", "the"))
    both = grams.where(hit).select(w[0].alias("x"), F.element_at(w, -1).alias("y"), "cnt")
    wanted = heads.select("head").distinct()
    both = both.join(wanted.withColumnRenamed("head", "x"), "x", "left_semi").join(wanted.withColumnRenamed("head", "y"), "y", "left_semi")
    either = pairs.select("x", "y").union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    return both.join(either, ["x", "y"], "left_semi").groupBy("x", "y").agg(F.sum("cnt").alias("cnt"))


def speaker_containment(mentions: DataFrame, speakers: DataFrame, text: str = "head") -> DataFrame:
    """Whether a document's speaker names contain the mention, or it contains one."""
    names = speakers.groupBy("doc_key").agg(F.collect_set("speaker_name").alias("_names"))  # of one document
    own = F.lower(text)
    return mentions.join(names, "doc_key", "left").withColumns({
        "contained_by_speaker": F.coalesce(F.exists("_names", lambda s: F.contains(s, own)), F.lit(False)),
        "contains_speaker": F.coalesce(F.exists("_names", lambda s: F.contains(own, s)), F.lit(False)),
    }).drop("_names")
