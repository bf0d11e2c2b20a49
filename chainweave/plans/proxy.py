"""The mention proxy: conversations as annotated documents, as DataFrames and as SQL.

A conversation is a document, a turn a sentence, a role a speaker; a token is a
run of letters, a mention a token that begins with a capital. Key clusters share
the lower-cased word, response clusters its first four letters. Labels that need
an annotator (entity, number, gender, governor) follow plain rules on the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.linguistic import animacy, governor, mention_type, syntactic_position
from ..functions.strings import speaker_name
from ..operators import clusters as C
from ..operators.lexical import speaker_containment
from ..operators.mentions import context_words, place_in_sentence
from ..operators.pairs import mention_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    words = F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("tok_idx", "word")
    return rows.select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("sent_idx"), F.col("role").alias("speaker"), words).withColumn("tok_idx", F.col("tok_idx").cast("bigint"))


def _tag(word: str):
    return F.when(F.rlike(word, F.lit(r"^\p{Lu}")), "CAP").otherwise("LOW")


def plain_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_key, ment_idx, sent_idx, tok_idx, word: without their contexts, so that only mentions are shuffled."""
    order = Window.partitionBy("doc_key").orderBy("sent_idx", "tok_idx")
    kept = tokens(spark, sf_dir).where(F.rlike("word", F.lit(r"^\p{Lu}")))
    return kept.withColumn("ment_idx", (F.row_number().over(order) - 1).cast("bigint"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns that the features need."""
    t = context_words(tokens(spark, sf_dir)).where(F.rlike("word", F.lit(r"^\p{Lu}")))
    order = Window.partitionBy("doc_key").orderBy("sent_idx", "tok_idx")
    m = t.withColumn("ment_idx", (F.row_number().over(order) - 1).cast("bigint"))
    n = F.char_length("word")
    parent, grand = F.when(F.col("tok_idx") > 0, F.col("tok_idx") - 1).otherwise(-1), F.when(F.col("tok_idx") > 1, F.col("tok_idx") - 2).otherwise(-1)
    m = m.select(
        "doc_key", "ment_idx", "sent_idx", F.col("tok_idx").alias("start_idx"), (F.col("tok_idx") + 1).alias("end_idx"), F.col("tok_idx").alias("head_idx"),
        *(F.col("word").alias(c) for c in ("head", "first", "last", "text")), F.lit(None).cast("string").alias("penultimate"), F.lit(None).cast("string").alias("second"),
        "prev1", "prev2", "next1", "next2", "speaker", F.left("speaker", F.lit(2)).alias("genre"),
        F.when(n >= 8, "PERSON").when(n == 7, "ORG").otherwise("O").alias("ner"),
        F.when(F.endswith(F.col("word"), F.lit("s")), "PLURAL").otherwise("SINGULAR").alias("number"),
        F.when(F.endswith(F.col("word"), F.lit("a")), "FEMALE").when(F.endswith(F.col("word"), F.lit("o")), "MALE").otherwise("UNKNOWN").alias("gender"),
        governor(F.col("tok_idx"), parent, F.col("prev1")).alias("governor"),
        syntactic_position(F.col("tok_idx"), parent, _tag("prev1")).alias("syn_uni"),
        syntactic_position(F.col("tok_idx"), parent, _tag("prev1"), grand, _tag("prev2")).alias("syn_bi"),
    )
    m = m.withColumn("animacy", animacy(F.col("ner"), F.col("head"), F.lit(False), F.lit(False))).withColumn("ment_type", mention_type(F.lit(1), F.col("head"), F.col("ner")))
    speakers = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_key"), speaker_name(F.col("role")).alias("speaker_name")).distinct()
    return place_in_sentence(speaker_containment(m, speakers))


def key_clusters(m: DataFrame, word: str = "head") -> DataFrame:
    return C.ordered(m.select("doc_key", "ment_idx", F.lower(word).alias("label")), "label").drop("label")


def response_clusters(m: DataFrame, word: str = "head") -> DataFrame:
    return C.ordered(m.select("doc_key", "ment_idx", F.left(F.lower(word), F.lit(4)).alias("label")), "label").drop("label")


def both_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Key and response as doc_key, mention, cluster_id; the labels serve as clusters."""
    m = plain_mentions(spark, sf_dir)
    side = lambda label: m.select("doc_key", F.col("ment_idx").alias("mention"), label.alias("cluster_id"))
    return side(F.lower("word")), side(F.left(F.lower("word"), F.lit(4)))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both clusterings are of the same mentions, so their overlaps need no join."""
    m = plain_mentions(spark, sf_dir)
    return m.groupBy("doc_key", F.lower("word").alias("k"), F.left(F.lower("word"), F.lit(4)).alias("r")).agg(F.count("*").alias("n"))


def scored_pairs(spark: SparkSession, sf_dir: str, diagonal: bool = False, anaphoric: bool = False) -> DataFrame:
    """doc_key, m, a, score, coreferent, response_link, heads, types and sentences; a = m scores 0.5.

    With ``anaphoric``: whether m has any coreferent antecedent, told of the mention before there are pairs.
    """
    m = plain_mentions(spark, sf_dir).withColumn("ment_type", mention_type(F.lit(1), F.col("word"), F.when(F.char_length("word") >= 7, "X").otherwise("O")))
    m = m.withColumnRenamed("word", "head")
    if anaphoric:
        m = m.withColumn("anaphoric", F.min("ment_idx").over(Window.partitionBy("doc_key", F.lower("head"))) < F.col("ment_idx"))
    p = mention_pairs(m, ["head", "sent_idx", "ment_type", *(["anaphoric"] if anaphoric else [])], diagonal)
    if anaphoric:
        p = p.withColumnRenamed("m_anaphoric", "anaphoric").drop("a_anaphoric")
    return scored(p)


def scored(p: DataFrame) -> DataFrame:
    """Pairs with heads: score, coreferent, response_link."""
    same = (F.lower("m_head") == F.lower("a_head")) & (F.col("a") < F.col("m"))
    near = (F.left(F.lower("m_head"), F.lit(4)) == F.left(F.lower("a_head"), F.lit(4))) & (F.col("a") < F.col("m"))
    score = F.when(F.col("a") == F.col("m"), F.lit(0.5)).otherwise(same.cast("int") * 2.0 + near.cast("int") * 1.0 - 0.05 * (F.col("m") - F.col("a")).cast("double"))
    return p.withColumns({"score": score, "coreferent": same, "response_link": near})


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best choice of each mention, a new cluster included."""
    from ..operators.scoring import best_antecedent

    return best_antecedent(scored_pairs(spark, sf_dir, diagonal=True))


# -- the same in SQL -------------------------------------------------------------

TOKENS = r"""
tokens as (
  select conv_id as doc_key, turn as sent_idx, role as speaker, word, cast(k - 1 as bigint) as tok_idx
  from (select conv_id, turn, role, unnest(w) as word, unnest(range(1, len(w) + 1)) as k
        from (select conv_id, turn, role, regexp_extract_all(text, '\p{L}+') as w from conversations)))"""
PLAIN = TOKENS + r""",
plain as (
  select *, cast(row_number() over (partition by doc_key order by sent_idx, tok_idx) - 1 as bigint) as ment_idx
  from tokens where regexp_matches(word, '^\p{Lu}'))"""
# The pronouns, apart from the engine's own table.
_PRONOUNS = "('i','me','myself','mine','my','we','us','ourself','ourselves','ours','our','you','yourself','yours','your','yourselves','he','him','himself','his','she','her','herself','hers','it','itself','its','one','oneself','one''s','they','them','themself','themselves','theirs','their','''em','who','whom','whose','where','when','which')"
_DEMONSTRATIVE = "('this','that','these','those')"
TYPE = f"case when lower(word) in {_DEMONSTRATIVE} then 'DEMONSTRATIVE' when lower(word) in {_PRONOUNS} then 'PRONOMINAL' when length(word) >= 7 then 'PROPER' else 'NOMINAL' end"
PAIRS = PLAIN + f""",
typed as (select *, {TYPE} as ment_type, lower(word) as low, left(lower(word), 4) as four from plain),
pairs as (
  select m.doc_key, m.ment_idx as m, a.ment_idx as a, m.word as m_head, a.word as a_head, m.sent_idx as m_sent_idx, a.sent_idx as a_sent_idx,
    m.ment_type as m_ment_type, a.ment_type as a_ment_type, m.low = a.low and a.ment_idx < m.ment_idx as coreferent, m.four = a.four and a.ment_idx < m.ment_idx as response_link,
    case when a.ment_idx = m.ment_idx then 0.5::double
      else (case when m.low = a.low then 2.0::double else 0.0::double end) + (case when m.four = a.four then 1.0::double else 0.0::double end) - 0.05::double * cast(m.ment_idx - a.ment_idx as double) end as score
  from typed m join typed a on m.doc_key = a.doc_key and a.ment_idx <= m.ment_idx),
strict as (select * from pairs where a < m),
labels as (select doc_key, ment_idx, low as k, four as r from typed),
firsts as (select *, min(ment_idx) over (partition by doc_key, k) as k_first, min(ment_idx) over (partition by doc_key, r) as r_first from labels),
clusters as (select doc_key, ment_idx, cast(dense_rank() over (partition by doc_key order by k_first) - 1 as bigint) as key_id, cast(dense_rank() over (partition by doc_key order by r_first) - 1 as bigint) as response_id from firsts),
shared as (select doc_key, k, r, count(*) as n from labels group by all)"""
FULL = PAIRS + rf""",
context as (
  select *, coalesce(lag(word, 1) over w, '<s>') as prev1, coalesce(lag(word, 2) over w, '<S>') as prev2, coalesce(lead(word, 1) over w, '</s>') as next1, coalesce(lead(word, 2) over w, '</S>') as next2
  from tokens window w as (partition by doc_key, sent_idx order by tok_idx)),
speakers as (select conv_id as doc_key, list(distinct lower(translate(role, '-_.', ''))) as names from conversations group by 1),
mentions as (
  select c.*, p.ment_idx, p.tok_idx as start_idx, p.tok_idx + 1 as end_idx, c.word as head, left(c.speaker, 2) as genre,
    case when length(c.word) >= 8 then 'PERSON' when length(c.word) = 7 then 'ORG' else 'O' end as ner,
    case when c.word like '%s' then 'PLURAL' else 'SINGULAR' end as number, case when c.word like '%a' then 'FEMALE' when c.word like '%o' then 'MALE' else 'UNKNOWN' end as gender,
    case when c.tok_idx = 0 then '[ROOT]' else 'R-' || prev1 end as governor,
    case when c.tok_idx = 0 then '[ROOT]' else (case when regexp_matches(prev1, '^\p{{Lu}}') then 'CAP(L)' else 'LOW(L)' end) end as syn_uni,
    (case when c.tok_idx = 0 then '[ROOT]' else (case when regexp_matches(prev1, '^\p{{Lu}}') then 'CAP(L)' else 'LOW(L)' end) end) || '-' ||
    (case when c.tok_idx <= 1 then '[ROOT]' else (case when regexp_matches(prev2, '^\p{{Lu}}') then 'CAP(L)' else 'LOW(L)' end) end) as syn_bi,
    case when lower(c.word) in {_PRONOUNS} then 'UNKNOWN' when length(c.word) >= 8 then 'ANIMATE' when length(c.word) = 7 then 'INANIMATE' else 'UNKNOWN' end as animacy,
    {TYPE.replace("word", "c.word")} as ment_type,
    row_number() over (partition by c.doc_key, c.sent_idx order by p.ment_idx) as sent_ment_idx,
    len(list_filter(s.names, lambda x: contains(x, lower(c.word)))) > 0 as contained_by_speaker, len(list_filter(s.names, lambda x: contains(lower(c.word), x))) > 0 as contains_speaker
  from context c join plain p on c.doc_key = p.doc_key and c.sent_idx = p.sent_idx and c.tok_idx = p.tok_idx left join speakers s on s.doc_key = c.doc_key)"""
