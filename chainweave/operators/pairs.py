"""Mention pairs and their pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Antecedents of a document that are one key of the pair join.
BLOCK = 512


def mention_pairs(mentions: DataFrame, columns: list[str], diagonal: bool = False, keep: Column | None = None, back: int | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Every mention ``m`` with each earlier mention ``a`` of its document.

    ``columns`` come twice, as m_<name> and a_<name>. With ``diagonal`` a mention
    is also paired with itself, for "starts a cluster". ``keep`` (over these names)
    is part of the join, so pruned pairs are never made (F9); ``back``, if given,
    is the most mentions between a pair that ``keep`` lets through, so that farther
    blocks are not visited. Only the columns asked for are shuffled, by document
    and block of antecedents: a long document is many keys, each with at most
    BLOCK pairs a mention. Mentions are numbered from 0. ``beside``: doc_key, m, m_block and ``of_pairs``, a value for
    each antecedent of the block in order (``head_pair_counts``), which each pair gets as ``of_pair``.
    """
    side = lambda p, i: mentions.select("doc_key", F.col("ment_idx").alias(i), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    block = lambda c: F.floor(c / BLOCK)
    first = F.lit(0).cast("bigint") if back is None else block(F.greatest(F.col("m") - back, F.lit(0)))
    m = side("m", "m").withColumn("m_block", F.explode(F.sequence(first, block(F.col("m")))))
    if beside is not None:
        m = m.join(beside, ["doc_key", "m", "m_block"], "left")
    a = side("a", "a").withColumnRenamed("doc_key", "a_doc").withColumn("a_block", block(F.col("a")))
    on = (m["doc_key"] == a["a_doc"]) & (m["m_block"] == a["a_block"]) & ((a["a"] <= m["m"]) if diagonal else (a["a"] < m["m"]))
    if back is not None:
        on &= a["a"] >= m["m"] - back
    both = m.join(a, on & keep if keep is not None else on)
    if beside is not None:
        both = both.withColumn("of_pair", F.get("of_pairs", (F.col("a") - F.col("m_block") * BLOCK).cast("int"))).drop("of_pairs")
    return both.drop("a_doc", "m_block", "a_block")


def head_pair_counts(mentions: DataFrame, least: int, ordered: bool = True) -> DataFrame:
    """doc_key, m, m_block, of_pairs: how often each pair's two heads are a pair of the corpus, null for fewer times than ``least``.

    Only keys and heads of the pairs are shuffled, not the columns that features need: those meet the counts where pairs are made.
    """
    heads = ("m_head", "a_head") if ordered else (F.least("m_head", "a_head"), F.greatest("m_head", "a_head"))
    narrow = mention_pairs(mentions, ["head"]).select("doc_key", "m", "a", *(F.col(h).alias(n) if ordered else h.alias(n) for h, n in zip(heads, "xy")))
    counts = narrow.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    met = F.array_sort(F.collect_list(F.struct("a", "n")))
    blocks = narrow.join(counts, ["x", "y"], "left").groupBy("doc_key", "m", F.floor(F.col("a") / BLOCK).alias("m_block")).agg(met.alias("met"))
    return blocks.select("doc_key", "m", "m_block", F.col("met.n").alias("of_pairs"))


def near_enough(most_mentions: int = 10_000, most_sentences: int = 5_000) -> Column:
    """Whether a pair is within the distances; sentences count for pronouns only (F9). Needs sent_idx, ment_type."""
    return (F.col("a") >= F.col("m") - most_mentions) & ((F.col("m_ment_type") != "PRONOMINAL") | (F.col("m_sent_idx") - F.col("a_sent_idx") <= most_sentences))


def by_strategy(pairs: DataFrame, strategy: str) -> DataFrame:
    """``distance:<mentions>:<sentences>`` or ``c2flogratio:<ratio>``."""
    return marked(pairs, strategy).where(~F.col("pruned")).drop("pruned")


def marked(pairs: DataFrame, strategy: str) -> DataFrame:
    """All pairs, with ``pruned``: whether ``by_strategy`` drops them."""
    kind, *numbers = strategy.split(":")
    if kind == "distance":
        kept = near_enough(*map(int, numbers))
    elif kind == "c2flogratio":
        kept = _within(float(numbers[0]) if numbers else 2.0)
    else:
        raise ValueError(f"no pruning strategy {strategy!r}")
    return pairs.withColumn("pruned", ~F.coalesce(kept, F.lit(False)))


def _within(ratio: float) -> Column:
    own = F.round("score", 9)
    return own + ratio >= F.max(own).over(Window.partitionBy("doc_key", "m"))


def log_ratio_pruned(pairs: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Pairs whose score is within ``ratio`` of their mention's best, at nine digits: the best always stays."""
    return pairs.withColumn("within", _within(ratio)).where("within").drop("within")


#: Pairs that a task sorts by mention, about (some 150 bytes each).
SORTED = 400_000


def by_mention(pairs: DataFrame, rows: int) -> DataFrame:
    """So many pairs dealt by mention, SORTED to a task: what a window over them sorts does not follow the input."""
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(max(-(-rows // SORTED), least), "doc_key", "m")


def chart(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Scores of all pairs, minus infinity where pruned."""
    marks = kept.select("doc_key", "m", "a", F.lit(True).alias("kept"))
    return pairs.join(marks, ["doc_key", "m", "a"], "left").withColumn("score", F.when(F.col("kept"), F.col("score")).otherwise(F.lit(float("-inf")))).drop("kept")


def gold_antecedents(pairs: DataFrame, gold: str = "coreferent", fallback: bool = True) -> DataFrame:
    """Per mention the gold antecedents among the pairs; with ``fallback`` all if there are none."""
    both = pairs.groupBy("doc_key", "m").agg(F.sort_array(F.collect_list(F.when(F.col(gold), F.col("a")))).alias("gold"), F.sort_array(F.collect_list("a")).alias("every"))
    return both.select("doc_key", "m", F.when(F.size("gold") > 0, F.col("gold")).otherwise(F.col("every") if fallback else F.col("gold")).alias("antecedents"))


def pruning_stats(pairs: DataFrame) -> DataFrame:
    """Counts over pairs with ``coreferent`` and ``pruned``, in one pass by mention."""
    each = pairs.groupBy("doc_key", "m").agg(
        F.max(F.col("coreferent").cast("int")).alias("anaphoric"),
        F.max((F.col("coreferent") & ~F.col("pruned")).cast("int")).alias("kept_gold"),
        F.count_if(~F.col("pruned")).alias("kept"), F.count_if(F.col("pruned")).alias("dropped"), F.count_if(F.col("coreferent") & F.col("pruned")).alias("dropped_gold"),
    )
    return each.agg(
        F.count("*").alias("mentions"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.sum("dropped_gold").alias("dropped_gold"),
        F.count_if(F.expr("anaphoric = 1")).alias("anaphoric"), F.count_if(F.expr("anaphoric = 1 and kept_gold = 0")).alias("lost"),
        F.count_if(F.expr("kept = 0")).alias("emptied"), F.count_if(F.expr("kept = 1")).alias("decided"),
    )


def pairwise_scores(pairs: DataFrame, gold: str = "key_link", predicted: str = "response_link") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over all pairs."""
    g, p = F.col(gold), F.col(predicted)
    counts = pairs.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return with_prf(counts, F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp"), F.col("tp") + F.col("fn"))


def with_prf(df: DataFrame, p_num: Column, p_den: Column, r_num: Column, r_den: Column) -> DataFrame:
    """precision, recall and f1; 0 where a denominator is 0."""
    ratio = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    both = df.withColumns({"precision": ratio(p_num, p_den), "recall": ratio(r_num, r_den)})
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
