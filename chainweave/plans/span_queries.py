"""Queries over mentions of several words: nested, extended and contained spans, and the plain text functions.

The spans follow plain rules on the proxy's tokens. An entity is a word with a
capital and its successor; the phrases of a word of five letters are it with its
neighbours on the left, and on both sides; pronouns stand alone. A word's parent
is its predecessor, or its successor where it ends in a vowel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import linguistic, strings
from ..operators import lexical, mentions as M, ordering
from . import proxy
from .registry import query

SPANS = f"""with {proxy.TOKENS},
w as (select *, lead(word) over s as nxt, lag(word) over s as prv, count(*) over (partition by doc_key, sent_idx) as n from tokens window s as (partition by doc_key, sent_idx order by tok_idx)),
parents as (select *, case when regexp_matches(word, '[aeiou]$') and nxt is not null then tok_idx + 1 else tok_idx - 1 end as parent_idx from w),
entities as (
  select doc_key, sent_idx, tok_idx as start_idx, tok_idx + 2 as end_idx, tok_idx + 1 as head_idx, case when length(word) >= 8 then 'PERSON' when length(word) >= 6 then 'QUANTITY' else 'ORG' end as label
  from w where regexp_matches(word, '^\\p{{Lu}}') and nxt is not null),
phrases as (
  select doc_key, sent_idx, tok_idx - 1 as start_idx, tok_idx + k as end_idx, tok_idx as head_idx, case when k = 1 and nxt = 'and' then 'CC' else 'NN' end as next_pos
  from w cross join (values (1), (2)) v(k) where length(word) = 5 and prv is not null and (k = 1 or nxt is not null)),
pronouns as (select doc_key, sent_idx, tok_idx as start_idx, tok_idx + 1 as end_idx, tok_idx as head_idx from w where lower(word) in ('it', 'you')),
names as (select * from entities where label not in ('O', 'QUANTITY', 'CARDINAL', 'PERCENT')),
ranked as (
  select *, row_number() over (partition by doc_key, sent_idx, head_idx order by start_idx, end_idx desc) as nth
  from phrases p where not exists (select 1 from names e where e.doc_key = p.doc_key and e.sent_idx = p.sent_idx and e.start_idx <= p.start_idx and p.end_idx <= e.end_idx)),
found as (
  select doc_key, sent_idx, start_idx, end_idx, head_idx from names
  union select doc_key, sent_idx, start_idx, end_idx, head_idx from ranked where nth = 1 or next_pos in (',', 'CC')
  union select doc_key, sent_idx, start_idx, end_idx, head_idx from pronouns p
    where not exists (select 1 from names e where e.doc_key = p.doc_key and e.sent_idx = p.sent_idx and e.start_idx <= p.start_idx and p.end_idx <= e.end_idx)),
spans as (select *, cast(row_number() over (partition by doc_key order by sent_idx, head_idx, end_idx, start_idx) - 1 as bigint) as ment_idx from found)
"""


def wide_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens with the words around them, taken from the sentence's own array: nothing is shuffled."""
    rows = proxy.table(spark, sf_dir, "conversations")
    rows = rows.select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("sent_idx"), F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    t = rows.select("doc_key", "sent_idx", "words", F.posexplode("words").alias("tok_idx", "word"))
    at = lambda k: F.get("words", F.col("tok_idx") + k)
    t = t.select("doc_key", "sent_idx", F.col("tok_idx").cast("bigint").alias("tok_idx"), "word", at(1).alias("nxt"), at(-1).alias("prv"), at(2).alias("nxt2"), at(-2).alias("prv2"))
    ahead = F.rlike("word", F.lit("[aeiou]$")) & F.col("nxt").isNotNull()
    return t.withColumn("parent_idx", F.when(ahead, F.col("tok_idx") + 1).otherwise(F.col("tok_idx") - 1))


def _span(rows: DataFrame, start: Column, end: Column, head: Column, *more: Column) -> DataFrame:
    return rows.select("doc_key", "sent_idx", start.cast("bigint").alias("start_idx"), end.cast("bigint").alias("end_idx"), head.cast("bigint").alias("head_idx"), *more)


def entities(t: DataFrame) -> DataFrame:
    n, at = F.char_length("word"), F.col("tok_idx")
    label = F.when(n >= 8, "PERSON").when(n >= 6, "QUANTITY").otherwise("ORG").alias("label")
    return _span(t.where(F.rlike("word", F.lit(r"^\p{Lu}")) & F.col("nxt").isNotNull()), at, at + 2, at + 1, label)


def spans(t: DataFrame) -> DataFrame:
    at = F.col("tok_idx")
    fives = t.where((F.char_length("word") == 5) & F.col("prv").isNotNull())
    short = _span(fives, at - 1, at + 1, at, F.when(F.col("nxt") == "and", "CC").otherwise("NN").alias("next_pos"))
    wide = _span(fives.where(F.col("nxt").isNotNull()), at - 1, at + 2, at, F.lit("NN").alias("next_pos"))
    alone = _span(t.where(F.lower("word").isin("it", "you")), at, at + 1, at)
    return M.numbered(M.proto_mentions(entities(t), short.unionByName(wide), alone))


@query("spans", SPANS + "select doc_key, ment_idx, sent_idx, start_idx, end_idx, head_idx from spans")
def spans_query(s, d):
    return spans(wide_tokens(s, d)).select("doc_key", "ment_idx", "sent_idx", "start_idx", "end_idx", "head_idx")


@query("possessive_spans", SPANS + "select e.doc_key, e.sent_idx, e.start_idx, e.end_idx + (case when w.word = 'of' then 1 else 0 end) as end_idx, e.label from entities e left join w on w.doc_key = e.doc_key and w.sent_idx = e.sent_idx and w.tok_idx = e.end_idx")
def possessive_spans(s, d):
    """The word ``of`` stands for a possessive ending, which the proxy's tokens lack."""
    t = wide_tokens(s, d)
    return M.with_possessive(entities(t), t.withColumn("word", F.when(F.col("word") == "of", "'s").otherwise(F.col("word")))).drop("head_idx")


@query("entity_labels", SPANS + "select m.doc_key, m.ment_idx, coalesce(max_by(e.label, e.start_idx * 1000000 + e.end_idx), 'O') as ner from spans m left join entities e on e.doc_key = m.doc_key and e.sent_idx = m.sent_idx and e.start_idx <= m.head_idx and m.head_idx < e.end_idx group by 1, 2")
def entity_labels(s, d):
    t = wide_tokens(s, d)
    return M.with_entity_label(spans(t), entities(t)).select("doc_key", "ment_idx", "ner")


@query("span_heads", SPANS + "select m.doc_key, m.sent_idx, m.start_idx, m.end_idx, coalesce(max(case when p.parent_idx < m.start_idx or p.parent_idx >= m.end_idx then p.tok_idx end), m.end_idx - 1) as head_idx from spans m join parents p on p.doc_key = m.doc_key and p.sent_idx = m.sent_idx and p.tok_idx >= m.start_idx and p.tok_idx < m.end_idx group by 1, 2, 3, 4")
def span_heads(s, d):
    t = wide_tokens(s, d)
    return M.span_head(t, spans(t).select(*M.SPAN).distinct())


@query("gold_spans", SPANS + """, gold as (select e.doc_key, e.sent_idx, e.start_idx, e.end_idx, min(e.label) as cluster_label from entities e group by all),
headed as (select g.*, coalesce(max(case when p.parent_idx < g.start_idx or p.parent_idx >= g.end_idx then p.tok_idx end), g.end_idx - 1) as head_idx
  from gold g join parents p on p.doc_key = g.doc_key and p.sent_idx = g.sent_idx and p.tok_idx >= g.start_idx and p.tok_idx < g.end_idx group by g.doc_key, g.sent_idx, g.start_idx, g.end_idx, g.cluster_label)
select doc_key, sent_idx, start_idx, end_idx, head_idx, cluster_label, cast(row_number() over (partition by doc_key order by sent_idx, head_idx, end_idx, start_idx) - 1 as bigint) as ment_idx from headed""")
def gold_spans(s, d):
    """Every entity is annotated twice, with two labels."""
    t = wide_tokens(s, d)
    e = entities(t)
    again = e.withColumn("label", F.lit("X"))
    return M.gold_mentions(e.unionByName(again), t).select("doc_key", "sent_idx", "start_idx", "end_idx", "head_idx", "cluster_label", "ment_idx")


@query("contained_spans", SPANS + "select m.doc_key, m.ment_idx as m, a.ment_idx as a from spans m join spans a on a.doc_key = m.doc_key and a.sent_idx = m.sent_idx and a.ment_idx < m.ment_idx where (a.start_idx <= m.start_idx and a.end_idx >= m.end_idx) or (m.start_idx <= a.start_idx and m.end_idx >= a.end_idx)")
def contained_spans(s, d):
    found = spans(wide_tokens(s, d))
    m, a = found.alias("m"), found.alias("a")
    on = (F.col("m.doc_key") == F.col("a.doc_key")) & M.i_within_i("a", "m") & (F.col("a.ment_idx") < F.col("m.ment_idx"))
    return m.join(a, on).select(F.col("m.doc_key"), F.col("m.ment_idx").alias("m"), F.col("a.ment_idx").alias("a"))


@query("governors", SPANS + """select m.doc_key, m.ment_idx, o.parent_idx as own_parent_idx, g.word as gov_word, g.parent_idx as gov_parent_idx, h.word as grand_word
from spans m left join parents o on o.doc_key = m.doc_key and o.sent_idx = m.sent_idx and o.tok_idx = m.head_idx
left join parents g on g.doc_key = m.doc_key and g.sent_idx = m.sent_idx and g.tok_idx = o.parent_idx
left join parents h on h.doc_key = m.doc_key and h.sent_idx = m.sent_idx and h.tok_idx = g.parent_idx""")
def governors(s, d):
    t = wide_tokens(s, d)
    parents = t.select("doc_key", "sent_idx", "tok_idx", "parent_idx", "word", F.left("word", F.lit(2)).alias("pos"))
    return M.with_governors(spans(t), parents).select("doc_key", "ment_idx", "own_parent_idx", "gov_word", "gov_parent_idx", "grand_word")


@query("matched_spans", SPANS + ", gold as (select *, cast(row_number() over (partition by doc_key order by sent_idx, head_idx, end_idx, start_idx) - 1 as bigint) as gold_idx from entities) select m.doc_key, m.sent_idx, m.start_idx, m.end_idx, m.ment_idx as pred_idx, g.gold_idx from spans m join gold g using (doc_key, sent_idx, start_idx, end_idx)")
def matched_spans(s, d):
    t = wide_tokens(s, d)
    return M.matched(spans(t), M.numbered(entities(t)))


_WORDS = """, worded as (
  select m.*, m.end_idx - m.start_idx as len, case when m.end_idx - m.start_idx = 1 then 'PRONOMINAL' else 'NOMINAL' end as ment_type, h.word as head, f.word as first, l.word as last,
    case when m.end_idx - m.start_idx > 1 then p.word end as penultimate, case when m.end_idx - m.start_idx > 1 then z.word end as second, f.prv as prev1, f.prv2 as prev2, l.nxt as next1, l.nxt2 as next2, h.prv as governor
  from spans m join x h on h.doc_key = m.doc_key and h.sent_idx = m.sent_idx and h.tok_idx = m.head_idx join x f on f.doc_key = m.doc_key and f.sent_idx = m.sent_idx and f.tok_idx = m.start_idx
  join x l on l.doc_key = m.doc_key and l.sent_idx = m.sent_idx and l.tok_idx = m.end_idx - 1
  left join x p on p.doc_key = m.doc_key and p.sent_idx = m.sent_idx and p.tok_idx = m.end_idx - 2 left join x z on z.doc_key = m.doc_key and z.sent_idx = m.sent_idx and z.tok_idx = m.start_idx + 1)
"""
_OUTER = ", x as (select *, lead(word, 2) over s as nxt2, lag(word, 2) over s as prv2 from w window s as (partition by doc_key, sent_idx order by tok_idx))"


def worded(s: SparkSession, d: str) -> DataFrame:
    """Spans with their words by position."""
    t = wide_tokens(s, d)
    m = spans(t)
    key = ["doc_key", "sent_idx"]
    of = lambda at, **names: t.select(*key, F.col("tok_idx").alias(at), *(F.col(c).alias(n) for n, c in names.items()))
    m = m.withColumns({"_last": F.col("end_idx") - 1, "_before": F.col("end_idx") - 2, "_second": F.col("start_idx") + 1, "ment_type": F.when(F.col("end_idx") - F.col("start_idx") == 1, "PRONOMINAL").otherwise("NOMINAL")})
    m = m.join(of("head_idx", head="word", governor="prv"), [*key, "head_idx"]).join(of("start_idx", first="word", prev1="prv", prev2="prv2"), [*key, "start_idx"])
    m = m.join(of("_last", last="word", next1="nxt", next2="nxt2"), [*key, "_last"])
    m = m.join(of("_before", penultimate="word"), [*key, "_before"], "left").join(of("_second", second="word"), [*key, "_second"], "left")
    several = F.col("end_idx") - F.col("start_idx") > 1
    return m.withColumns({c: F.when(several, F.col(c)) for c in ("penultimate", "second")})


_POSITIONS = {
    "head": ("head", "ment_type = 'NOMINAL'"), "first": ("first", "ment_type = 'NOMINAL' and len > 1"), "last": ("last", "ment_type = 'NOMINAL' and len > 1 and head <> last"),
    "penultimate": ("penultimate", "ment_type = 'NOMINAL' and len > 2"), "second": ("second", "ment_type = 'NOMINAL' and len > 3"),
    "preceding": ("prev1", "true"), "following": ("next1", "true"), "preceding2": ("prev2", "true"), "following2": ("next2", "true"), "governor": ("governor", "true"),
}


@query("span_word_counts", SPANS + _OUTER + _WORDS + ", keys as (" + " union all ".join(f"select '{n}' as template, lower({c}) as key from worded where {w}" for n, (c, w) in _POSITIONS.items()) + ") select template, key, count(*) as cnt from keys where key is not null group by 1, 2 having count(*) >= 2")
def span_word_counts(s, d):
    return lexical.positional_counts(worded(s, d), 2)


# -- text functions over whole columns ----------------------------------------------


@query("text_forms", r"""select doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as masked, md5(regexp_replace(translate(text, '“”‘’«»', '""''''""'), '[ \t\n\x0b\f\r]+', ' ', 'g')) as quoted,
md5(replace(replace(replace(replace(replace(replace(replace(replace(esc, '-LRB-', '('), '-RRB-', ')'), '-LSB-', '['), '-RSB-', ']'), '-LCB-', '{'), '-RCB-', '}'), '\/', '/'), '\*', '*')) as plain
from (select *, replace(replace(text, ', ', ' -LRB- '), '. ', ' -RRB- \/ ') as esc from documents)""")
def text_forms(s, d):
    """Masked digits, plain quotes and white space, and escapes put back, of whole texts; hashed, to be short."""
    docs = proxy.table(s, d, "documents").withColumn("esc", F.replace(F.replace("text", F.lit(", "), F.lit(" -LRB- ")), F.lit(". "), F.lit(r" -RRB- \/ ")))
    return docs.select("doc_id", F.md5(strings.digits_masked(F.col("text"))).alias("masked"), F.md5(strings.plain_quotes(F.col("text"))).alias("quoted"), F.md5(strings.brackets_back(F.col("esc"))).alias("plain"))


@query("name_fields", "select p_partkey, x[1] as first, x[3] as third, x[-1] as last, x[9] as ninth from (select p_partkey, string_split(p_name, ' ') as x from part)")
def name_fields(s, d):
    part = proxy.table(s, d, "part")
    return part.select("p_partkey", *(strings.field(F.col("p_name"), k).alias(n) for n, k in (("first", 1), ("third", 3), ("last", -1), ("ninth", 9))))


_KEYED = "select distinct case role when 'user' then 'nw/' when 'assistant' then 'bc/' else 'wb/' end || conv_id as id, turn from conversations"


@query("document_kinds", f"select id || ' (part ' || turn || ')' as doc_key, id[1:2] as genre, id like 'nw%' as newswire, id like 'bc%' or id like 'wb%' as conversation from ({_KEYED})")
def document_kinds(s, d):
    rows = proxy.table(s, d, "conversations")
    kind = F.when(F.col("role") == "user", "nw/").when(F.col("role") == "assistant", "bc/").otherwise("wb/")
    named = ordering.by_name(rows.select(F.concat(kind, F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("part_no")).distinct())
    return named.select("doc_key", strings.genre(F.col("doc_id")).alias("genre"), strings.is_newswire(F.col("doc_id")).alias("newswire"), strings.is_conversation(F.col("doc_id")).alias("conversation"))


@query("definite_words", f"with {proxy.TOKENS} select case when lower(word) = 'the' then 'DEF' when lower(word) in ('a', 'an') then 'INDEF' else 'NONE' end as kind, count(*) as cnt from tokens group by 1")
def definite_words(s, d):
    return proxy.tokens(s, d).groupBy(linguistic.definiteness(F.col("word")).alias("kind")).agg(F.count("*").alias("cnt"))


_BITS = "[cast({0} // 1 % 2 as int), cast({0} // 2 % 2 as int), cast({0} // 4 % 2 as int)]"
_HOT = "list_transform(range(0, 11), lambda k: case when k = least({0}, 10) then 1 else 0 end)"


@query("cluster_vectors", f"""select o_orderkey, array_to_string({_BITS.format('o_orderkey')}, '') as first, array_to_string(list_transform(range(1, 4), lambda i: greatest({_BITS.format('o_orderkey')}[i], {_BITS.format('o_custkey')}[i])), '') as merged,
array_to_string({_BITS.format('o_orderkey')} || {_BITS.format('o_custkey')} || [0, 0, 0] || {_HOT.format('o_custkey % 14')} || {_HOT.format('o_orderkey % 13')}, '') as vector from orders""")
def cluster_vectors(s, d):
    """Vectors of three bits of the keys; the last mention's is missing."""
    bits = lambda c: F.array(*(F.expr(f"cast({c} div {k} % 2 as int)") for k in (1, 2, 4)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    first, middle = bits("o_orderkey"), bits("o_custkey")
    vector = ordering.cluster_vector(first, middle, F.lit(None).cast("array<int>"), F.expr("cast(o_custkey % 14 as int)"), F.expr("cast(o_orderkey % 13 as int)"), 3)
    return proxy.table(s, d, "orders").select("o_orderkey", text(first).alias("first"), text(ordering.either(first, middle)).alias("merged"), text(vector).alias("vector"))
