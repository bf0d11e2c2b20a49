"""Further feature templates: the larger pair set, sentence splits, entity tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.linguistic import person_compat, pronoun_gender, pronoun_number
from ..functions.strings import feature, word_class, word_shape

LARGER = 9


def larger_pair_features(common: Column) -> Column:
    """What the larger set adds to a pair: both positions, heads, pronoun properties, agreements, types.

    ``common`` says whether the head pair is counted often enough; others are
    marked as backed off. Needs m_/a_ head, syn_uni, gender, number, ner, ment_type.
    """
    f, m, a = feature, lambda c: F.col(f"m_{c}"), lambda c: F.col(f"a_{c}")
    both = lambda x: F.concat(x("a"), F.lit("-"), x("m"))
    of = lambda fn: F.concat(fn(a("head")), F.lit("-"), fn(m("head")))
    return F.array(
        f("SynPoses", both(lambda s: F.col(f"{s}_syn_uni"))), f("Heads", F.when(common, both(lambda s: F.lower(f"{s}_head"))).otherwise("BACKOFF_INDICATOR")),
        f("PronNumbs", of(pronoun_number)), f("PronGends", of(pronoun_gender)), f("PronPersons", of(person_compat)),
        f("Gends", both(lambda s: F.col(f"{s}_gender"))), f("Numbs", both(lambda s: F.col(f"{s}_number"))), f("Nerts", both(lambda s: F.col(f"{s}_ner"))), f("TypeStrs", both(lambda s: F.col(f"{s}_ment_type"))),
    )


def split_examples(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each sentence-end candidate: its number and the eleven features of the split model."""
    keys = [c for c in texts.columns if c != text]
    words = F.split(F.trim(text), r"\s+")
    n = F.size("_words") - 1
    w = F.posexplode(F.arrays_zip(F.slice("_words", F.lit(1), n).alias("left"), F.slice("_words", F.lit(2), n).alias("right")))
    each = texts.select(*keys, words.alias("_words")).where("size(_words) > 1").select(*keys, w.alias("at", "x")).where(F.rlike("x.left", F.lit(r"[.?!](\"|''|``|'|\))?$")))
    left, right = F.col("x.left"), F.col("x.right")
    mark = F.regexp_extract(left, r"([.?!])(\"|''|``|'|\))?$", 1)
    bare = F.regexp_replace(left, r"[.?!](\"|''|``|'|\))?$", "")
    yes = lambda c: F.when(c, "true").otherwise("false")
    capital = F.rlike(right, F.lit(r"^\p{Lu}"))
    feats = F.array(
        feature("Left", F.lower(bare)), feature("Right", F.lower(right)), feature("Mark", mark), feature("LeftLen", F.least(F.char_length(bare), F.lit(10))), feature("RightCap", yes(capital)),
        feature("LeftCap", yes(F.rlike(bare, F.lit(r"^\p{Lu}")))), feature("LeftDot", yes(F.contains(bare, F.lit(".")))), feature("LeftDigit", yes(F.rlike(bare, F.lit("[0-9]$")))),
        feature("Quote", yes(~F.endswith(left, mark))), feature("RightQuote", yes(F.rlike(right, F.lit("^[\"'`(]")))), feature("MarkCap", F.concat(mark, yes(capital))),
    )
    return each.select(*keys, F.col("at").cast("bigint").alias("at"), feats.alias("feats"))


def split_decisions(examples: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the summed weights of a candidate's features are above 0 (X10). ``weights``: feat, weight."""
    each = examples.select(*keys, F.explode("feats").alias("feat")).join(weights, "feat", "left")
    return each.groupBy(*keys).agg((F.coalesce(F.sum("weight"), F.lit(0.0)) > 0).alias("split"))


def train_splits(examples: DataFrame, label: str, width: int = 1 << 12, rounds: int = 50):
    """An L2-regularised logistic model over hashed features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    hashed = HashingTF(numFeatures=width, binary=True, inputCol="feats", outputCol="features").transform(examples)
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=rounds).fit(hashed)


def entity_tag_features(tokens: DataFrame, *kept: str) -> DataFrame:
    """``feats`` of each token for entity tagging, beside columns ``kept``: words, tags, shapes and classes at -2..2, and their conjunctions."""
    w = Window.partitionBy("doc_key", "sent_idx").orderBy("tok_idx")
    word, shape, cls = F.lower("word"), word_shape(F.col("word")), word_class(F.col("word"))
    rows = tokens.withColumns({"_w": word, "_s": shape, "_c": cls})
    at = lambda c, k: F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) if k else F.col(c), F.lit("<none>"))
    feats = [feature(f"{k}W", at("_w", k)) for k in (-2, -1, 0, 1, 2)] + [feature(f"{k}S", at("_s", k)) for k in (-1, 0, 1)] + [feature(f"{k}C", at("_c", k)) for k in (-2, -1, 0, 1, 2)]
    pairs = [feature("-1W0W", F.concat(at("_w", -1), F.lit("|"), F.col("_w"))), feature("0W1W", F.concat(F.col("_w"), F.lit("|"), at("_w", 1))), feature("-1C0C", F.concat(at("_c", -1), F.lit("|"), F.col("_c")))]
    return rows.select("doc_key", "sent_idx", "tok_idx", *kept, F.array(*feats, *pairs).alias("feats"))


def name_gender(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``name_gender``: of a person whose capitalised head follows a capitalised word, the gender counted for that first name; else for the head.

    A first name that is not counted leaves the gender unknown, whatever the head is.
    """
    from ..functions.linguistic import gender_of

    counted = dictionary.select(F.col("key").alias("_key"), F.col("counts").alias("_counts"))
    upper = lambda c: F.rlike(c, F.lit(r"^\p{Lu}"))
    named = (F.col("ner") == "PERSON") & upper("head") & upper("prev1")
    asked = mentions.withColumn("_asked", F.lower(F.when(named, F.col("prev1")).otherwise(F.col("head"))))
    found = asked.join(counted, F.col("_asked") == F.col("_key"), "left")
    return found.withColumn("name_gender", gender_of(F.col("_counts"))).drop("_asked", "_key", "_counts")
