"""One query for each operator of the inventory, over the mention proxy and the other driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import linguistic, numeric, strings
from ..operators import analysis, clusters, features, inference, lexical, metrics, mentions as M, pairs as P, scoring
from ..sources import conll, text_formats
from ..storage import Scratch
from . import proxy
from .registry import query

T, PL, PR, FU = f"with {proxy.TOKENS} ", f"with {proxy.PLAIN} ", f"with {proxy.PAIRS} ", f"with {proxy.FULL} "


def six(c):
    return F.round(c, 6)


# -- tokens and mentions --------------------------------------------------------


@query("tokens_profile", T + "select count(*) as tokens, count(distinct word) as words, count(distinct lower(word)) as lower_words, cast(sum(length(word)) as bigint) as letters from tokens")
def tokens_profile(s: SparkSession, d: str) -> DataFrame:
    # words first, so that the distinct counts run over the vocabulary
    words = proxy.tokens(s, d).groupBy("word").agg(F.count("*").alias("n"))
    lower = words.groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.sum(F.col("n") * F.char_length("word")).alias("letters"))
    return lower.agg(F.sum("n").alias("tokens"), F.sum("words").alias("words"), F.count("*").alias("lower_words"), F.sum("letters").alias("letters"))


@query("mentions", PL + "select doc_key, ment_idx, sent_idx, tok_idx, word from plain")
def mentions(s, d):
    return proxy.plain_mentions(s, d).select("doc_key", "ment_idx", "sent_idx", "tok_idx", "word")


@query("typed_mentions", FU + "select doc_key, ment_idx, ment_type, ner, animacy, number, gender, governor, syn_uni, syn_bi, contained_by_speaker, contains_speaker from mentions")
def typed_mentions(s, d):
    return proxy.mentions(s, d).select("doc_key", "ment_idx", "ment_type", "ner", "animacy", "number", "gender", "governor", "syn_uni", "syn_bi", "contained_by_speaker", "contains_speaker")


@query("mention_pairs", PR + "select doc_key, count(*) as pairs, cast(sum(m - a) as bigint) as distance from strict group by 1")
def mention_pairs(s, d):
    return P.mention_pairs(proxy.plain_mentions(s, d), []).groupBy("doc_key").agg(F.count("*").alias("pairs"), F.sum(F.col("m") - F.col("a")).alias("distance"))


@query("sent_ment_idx", PL + "select doc_key, ment_idx, row_number() over (partition by doc_key, sent_idx order by ment_idx) as sent_ment_idx from plain")
def sent_ment_idx(s, d):
    return M.place_in_sentence(proxy.plain_mentions(s, d)).select("doc_key", "ment_idx", "sent_ment_idx")


@query("context_words", FU + "select doc_key, sent_idx, tok_idx, prev2, prev1, next1, next2 from context")
def context_words(s, d):
    return M.context_words(proxy.tokens(s, d)).select("doc_key", "sent_idx", "tok_idx", "prev2", "prev1", "next1", "next2")


@query("immediate_antecedent", PR + "select doc_key, ment_idx, coalesce(lag(ment_idx) over w, -1) as antecedent, row_number() over w - 1 as place, count(*) over (partition by doc_key, key_id) as size from clusters window w as (partition by doc_key, key_id order by ment_idx)")
def immediate_antecedent(s, d):
    return clusters.places(proxy.key_clusters(proxy.plain_mentions(s, d), "word")).select("doc_key", "ment_idx", "antecedent", "place", "size")


@query("antecedents_and_consequents", PR + "select doc_key, ment_idx, coalesce(string_agg(cast(ment_idx as varchar), ' ') over (partition by doc_key, key_id order by ment_idx rows between unbounded preceding and 1 preceding), '') as antecedents, coalesce(string_agg(cast(ment_idx as varchar), ' ') over (partition by doc_key, key_id order by ment_idx rows between 1 following and unbounded following), '') as consequents from clusters")
def antecedents_and_consequents(s, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return clusters.places(proxy.key_clusters(proxy.plain_mentions(s, d), "word")).select("doc_key", "ment_idx", text("antecedents"), text("consequents"))


@query("capped_distance", PR + "select least(m - a, 10) as dist, least(m_sent_idx - a_sent_idx, 10) as sent_dist, count(*) as pairs from strict group by 1, 2")
def capped_distance(s, d):
    p = P.mention_pairs(proxy.plain_mentions(s, d), ["sent_idx"])
    return p.groupBy(numeric.capped(F.col("m") - F.col("a")).alias("dist"), numeric.capped(F.col("m_sent_idx") - F.col("a_sent_idx")).alias("sent_dist")).agg(F.count("*").alias("pairs"))


@query("document_position", PL + "select doc_key, ment_idx, round(coalesce((2 * (ment_idx + 1) - n - 1) / nullif(n - 1, 0)::double, 0.0), 6) as position from (select doc_key, ment_idx, count(*) over (partition by doc_key) as n from plain)")
def document_position(s, d):
    n = F.count("*").over(Window.partitionBy("doc_key"))
    return proxy.plain_mentions(s, d).withColumn("n", n).select("doc_key", "ment_idx", six(numeric.relative_position(F.col("ment_idx") + 1, F.col("n"))).alias("position"))


# -- metrics ----------------------------------------------------------------------

_PRF = "case when {pd} > 0 then {pn} / {pd} else 0.0 end as precision, case when {rd} > 0 then {rn} / {rd} else 0.0 end as recall"


def _metric_sql(parts: str) -> str:
    return PR + f""", parts as ({parts}), both_sides as (select *, case when p_den > 0 then p_num / p_den else 0.0 end as precision, case when r_den > 0 then r_num / r_den else 0.0 end as recall from parts)
select doc_key, round(r_num, 6) as r_num, round(r_den, 6) as r_den, round(p_num, 6) as p_num, round(p_den, 6) as p_den, round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 6) as f1 from both_sides"""


def _rounded(parts: DataFrame) -> DataFrame:
    return metrics.scored(parts).select("doc_key", *(six(c).alias(c) for c in (*metrics.PARTS, "precision", "recall", "f1")))


B_CUBED_SQL = """select doc_key, sum(n * n / k_size::double) as r_num, cast(sum(n) as double) as r_den, sum(n * n / r_size::double) as p_num, cast(sum(n) as double) as p_den
  from (select *, sum(n) over (partition by doc_key, k) as k_size, sum(n) over (partition by doc_key, r) as r_size from shared) group by doc_key"""
MUC_SQL = """select doc_key, cast((select sum(c) from (select sum(n) - count(*) as c from shared s where s.doc_key = x.doc_key group by k)) as double) as r_num,
  cast((select sum(c) from (select sum(n) - 1 as c from shared s where s.doc_key = x.doc_key group by k)) as double) as r_den,
  cast((select sum(c) from (select sum(n) - count(*) as c from shared s where s.doc_key = x.doc_key group by r)) as double) as p_num,
  cast((select sum(c) from (select sum(n) - 1 as c from shared s where s.doc_key = x.doc_key group by r)) as double) as p_den
  from (select distinct doc_key from shared) x"""


@query("b_cubed", _metric_sql(B_CUBED_SQL))
def b_cubed(s, d):
    return _rounded(metrics.b_cubed(proxy.overlaps(s, d)))


@query("b_cubed_joined", _metric_sql(B_CUBED_SQL))
def b_cubed_joined(s, d):
    """The same from two separate clusterings: the general path."""
    return _rounded(metrics.b_cubed(metrics.overlaps(*proxy.both_sides(s, d))))


@query("muc", _metric_sql(MUC_SQL))
def muc(s, d):
    return _rounded(metrics.muc(proxy.overlaps(s, d)))


_SIDES = """, sides as (select doc_key, count(*) filter (where a_k = m_k and a_r = m_r) as both_c, count(*) filter (where a_k = m_k) as k_c, count(*) filter (where a_r = m_r) as r_c,
    count(*) filter (where a_k <> m_k and a_r <> m_r) as both_no, count(*) filter (where a_k <> m_k) as k_no, count(*) filter (where a_r <> m_r) as r_no
  from (select x.doc_key, x.k as m_k, y.k as a_k, x.r as m_r, y.r as a_r from labels x join labels y on x.doc_key = y.doc_key and y.ment_idx < x.ment_idx) group by 1)"""


@query("blanc", PR + _SIDES + " select doc_key, both_c::double as both_c, k_c::double as k_c, r_c::double as r_c, both_no::double as both_no, k_no::double as k_no, r_no::double as r_no from sides")
def blanc(s, d):
    counts = metrics.blanc(proxy.overlaps(s, d)).where("k_c + k_no > 0")
    return counts.select("doc_key", *(F.col(c).cast("double").alias(c) for c in ("both_c", "k_c", "r_c", "both_no", "k_no", "r_no")))


def _blanc_sql() -> str:
    """Of links and of no links recall, precision and F1; their means, or those of the one kind that the key has."""
    ratio = lambda a, b: f"(case when coalesce({b}, 0) = 0 then 0.0::double else coalesce({a}, 0) / {b}::double end)"
    f1 = lambda r, p: f"(case when {r} + {p} = 0 then 0.0::double else 2 * {r} * {p} / ({r} + {p}) end)"
    kinds = {k: (ratio(f"both_{k}", f"k_{k}"), ratio(f"both_{k}", f"r_{k}")) for k in ("c", "no")}
    each = ", ".join(f"{r} as r{k}, {p} as p{k}, {f1(r, p)} as f{k}" for k, (r, p) in kinds.items())
    picked = ", ".join(f"round(case when coalesce(k_c, 0) = 0 then {x}no when coalesce(k_no, 0) = 0 then {x}c else ({x}c + {x}no) / 2 end, 6) as {name}" for x, name in (("r", "recall"), ("p", "precision"), ("f", "f1")))
    return PR + _SIDES + f", every as (select distinct doc_key from labels), r as (select e.doc_key, k_c, k_no, {each} from every e left join sides s on s.doc_key = e.doc_key) select doc_key, {picked} from r"


@query("blanc_scores", _blanc_sql())
def blanc_scores(s, d):
    return metrics.blanc_scores(metrics.blanc(proxy.overlaps(s, d))).select("doc_key", *(six(c).alias(c) for c in ("recall", "precision", "f1")))


@query("ceaf_m")
def ceaf_m(s, d):
    return _rounded(metrics.ceaf(proxy.overlaps(s, d), entity=False))


@query("ceaf_e")
def ceaf_e(s, d):
    return _rounded(metrics.ceaf(proxy.overlaps(s, d), entity=True))


@query("conll_average")
def conll_average(s, d):
    found = metrics.conll_average(proxy.overlaps(s, d))
    return found.select(*(metrics.two_digits(F.col(c)).alias(c) for c in found.columns))


@query("pairwise_prf", PR + """, c as (select count(*) filter (where coreferent and response_link) as tp, count(*) filter (where not coreferent and response_link) as fp, count(*) filter (where coreferent and not response_link) as fn from strict),
r as (select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall from c) select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall), 6) as f1 from r""")
def pairwise_prf(s, d):
    found = P.pairwise_scores(proxy.scored_pairs(s, d), "coreferent", "response_link")
    return found.select("tp", "fp", "fn", *(six(c).alias(c) for c in ("precision", "recall", "f1")))


# -- vocabularies -------------------------------------------------------------------


@query("lex_counts_pruned", FU + """, open_class as (select * from mentions where ment_type not in ('PRONOMINAL', 'DEMONSTRATIVE'))
select template, key, count(*) as cnt from (
  select 'head' as template, lower(head) as key from open_class union all select 'preceding', lower(prev1) from mentions union all select 'following', lower(next1) from mentions
  union all select 'preceding2', lower(prev2) from mentions union all select 'following2', lower(next2) from mentions union all select 'governor', lower(governor) from mentions)
group by 1, 2 having count(*) >= 20""")
def lex_counts_pruned(s, d):
    return lexical.positional_counts(proxy.mentions(s, d))


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '[0-9]', 'd', 'g'), 'X{3,}', 'XXe', 'g'), 'x{3,}', 'xxe', 'g'), 'd{3,}', 'dde', 'g')"
_CLASS = r"(case when regexp_matches(word, '^\p{Lu}+$') then '-CAPS' when regexp_matches(word, '^\p{Lu}') then '-INITC' else '-LC' end) || (case " + " ".join(f"when length(word) > {len(x) + 2} and lower(word) like '%{x}' then '-{x}'" for x in strings.SUFFIXES) + " else '' end)"


@query("affix_counts", T + f""", parts as (
  select 'prefix' as template, left(lower(word), n) as key from tokens, (values (1), (2), (3)) t(n) where length(word) >= n
  union all select 'suffix', right(lower(word), n) from tokens, (values (1), (2), (3)) t(n) where length(word) >= n
  union all select 'shape', {_SHAPE} from tokens union all select 'class', {_CLASS} from tokens)
select template, key, count(*) as cnt from parts group by 1, 2 having count(*) >= 20""")
def affix_counts(s, d):
    return lexical.affix_counts(proxy.tokens(s, d))


@query("bilexical_counts", PR + "select m_head as current, a_head as antecedent, count(*) as cnt from strict group by 1, 2 having count(*) >= 2")
def bilexical_counts(s, d):
    return lexical.bilexical_counts(P.mention_pairs(proxy.plain_mentions(s, d).withColumnRenamed("word", "head"), ["head"]), cutoff=2)


@query("word_shape", T + f"select word, {_SHAPE} as shape, {_CLASS} as class from (select distinct word from tokens)")
def word_shape(s, d):
    words = proxy.tokens(s, d).select("word").distinct()
    return words.select("word", strings.word_shape(F.col("word")).alias("shape"), strings.word_class(F.col("word")).alias("class"))


_DOC_WORDS = r"(select lower(unnest(regexp_extract_all(text, '\p{L}+'))) as word from documents)"


def _document_words(s, d, name="documents"):
    return proxy.table(s, d, name).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word"))


@query("vocab_index", f"select row_number() over (order by word) as feat_idx, word as feat from (select distinct word from {_DOC_WORDS})")
def vocab_index(s, d):
    return lexical.feature_index(_document_words(s, d), "word")


@query("unk_lookup", rf"""with i as (select row_number() over (order by word) as feat_idx, word from (select distinct word from {_DOC_WORDS})),
b as (select item_id, lower(unnest(regexp_extract_all(text, '\p{{L}}+'))) as word from benchmark)
select item_id, count(*) as words, count(*) filter (where feat_idx is null) as unknown, cast(sum(coalesce(feat_idx, 0)) as bigint) as id_sum from b left join i using (word) group by 1""")
def unk_lookup(s, d):
    index = lexical.feature_index(_document_words(s, d), "word")
    items = proxy.table(s, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select("item_id", F.lower("w").alias("word"))
    return lexical.indexed(items, index, "word").groupBy("item_id").agg(F.count("*").alias("words"), F.count_if(F.expr("feat_idx = 0")).alias("unknown"), F.sum("feat_idx").alias("id_sum"))


@query("word_or_backoff", FU + f""", common as (select lower(word) as key from tokens group by 1 having count(*) >= 20)
select doc_key, ment_idx, coalesce(key, {_CLASS.replace("word", "head")}) as word from mentions left join common on lower(head) = key""")
def word_or_backoff(s, d):
    common = lexical.counted(proxy.tokens(s, d), "word", F.lower("word"))
    m = proxy.plain_mentions(s, d)
    return lexical.word_or_fallback(m, common, "word", strings.word_class(F.col("word")), "shown").select("doc_key", "ment_idx", F.col("shown").alias("word"))


@query("suffix_backoff", PL + """, known as (select key from (select right(lower(word), n) as key from tokens, (values (1), (2), (3)) t(n) where length(word) >= n) group by 1 having count(*) >= 200)
select doc_key, ment_idx, coalesce(c.key, b.key, a.key, '') as suffix from plain left join known a on length(word) >= 1 and right(lower(word), 1) = a.key left join known b on length(word) >= 2 and right(lower(word), 2) = b.key left join known c on length(word) >= 3 and right(lower(word), 3) = c.key""")
def suffix_backoff(s, d):
    known = lexical.affix_counts(proxy.tokens(s, d), cutoff=200)
    return lexical.affix_fallback(proxy.plain_mentions(s, d), known, "word", "suffix").select("doc_key", "ment_idx", "suffix")


# -- features -------------------------------------------------------------------------

_ANA = "['SNMentLen=' || (end_idx - start_idx), 'SNMentHead=' || lower(head), 'SNMentFirst=' || lower(head), 'SNMentLast=' || lower(head), 'SNMentPreceding=' || lower(prev1), 'SNMentFollowing=' || lower(next1), 'SNSynPos=' || syn_uni, 'SNSynPos2=' || syn_bi, 'SNGovernor=' || governor, 'SNSentMentIdx=' || least(sent_ment_idx, 10), 'SNNerStr=' || ner, 'SNAnimacy=' || animacy, 'SNGend=' || gender, 'SNNumber=' || number, 'SNPerson=' || person, 'CurrPronConjStr=' || conj, 'SNSpeaker=' || lower(translate(speaker, '-_.', '')), 'SNDocType=' || genre, 'SNMentHeadTrueCase=' || head, 'SNCurrContainedBySpeaker=' || contained_by_speaker, 'SNCurrContainsSpeaker=' || contains_speaker]"
# Persons and canonical forms of pronouns, apart from the engine's own tables.
_PERSON = "case when lower(head) in ('i','me','myself','mine','my','we','us','ourself','ourselves','ours','our') then '1st' when lower(head) in ('you','yourself','yours','your','yourselves') then '2nd' else 'OTHER' end"
_CONJ = """case when ment_type <> 'PRONOMINAL' then ment_type when lower(head) in ('me','my','myself','mine') then 'i' when lower(head) in ('your','yourself','yourselves','yours') then 'you'
  when lower(head) in ('him','his','himself') then 'he' when lower(head) in ('her','herself','hers') then 'she' when lower(head) in ('us','our','ourself','ourselves','ours') then 'we'
  when lower(head) in ('them','their','themself','themselves','theirs','''em') then 'they' when lower(head) in ('itself','its') then 'it' when lower(head) in ('oneself','one''s') then 'one' when lower(head) = 'whom' then 'who' else lower(head) end"""
RICH = FU + f", rich as (select *, {_PERSON} as person, {_CONJ} as conj from mentions)"


def _side_sql(side: str, p: str) -> str:
    return (f"['{side}MentLen=' || ({p}.end_idx - {p}.start_idx), '{side}MentHead=' || lower({p}.head), '{side}MentFirst=' || lower({p}.head), '{side}MentLast=' || lower({p}.head), '{side}MentPreceding=' || lower({p}.prev1), '{side}MentFollowing=' || lower({p}.next1), "
            f"'{side}SynPos=' || {p}.syn_uni, '{side}SynPos2=' || {p}.syn_bi, '{side}MentGovernor=' || {p}.governor, '{side}SentMentIdx=' || least({p}.sent_ment_idx, 10), '{side}NerStr=' || {p}.ner, '{side}Animacy=' || {p}.animacy, '{side}Gend=' || {p}.gender, '{side}Number=' || {p}.number, "
            f"'{side}Person=' || {p}.person, '{side}Speaker=' || lower(translate({p}.speaker, '-_.', '')), '{side}HeadTrueCase=' || {p}.head, '{side}ContainedBySpeaker=' || {p}.contained_by_speaker, '{side}ContainsSpeaker=' || {p}.contains_speaker]")  # fmt: skip


_PAIR = ("['Dist=' || least(m.ment_idx - a.ment_idx, 10), 'SentDist=' || least(m.sent_idx - a.sent_idx, 10), 'iWi=' || (m.sent_idx = a.sent_idx and ((m.start_idx <= a.start_idx and m.end_idx >= a.end_idx) or (a.start_idx <= m.start_idx and a.end_idx >= m.end_idx))), "
         "'SameSpeaker=' || (lower(translate(m.speaker, '-_.', '')) = lower(translate(a.speaker, '-_.', ''))), 'DocType=' || m.genre, 'ExactStrMatch=' || (lower(m.head) = lower(a.head)), 'ThisContained=' || contains(lower(a.head), lower(m.head)), 'AntContained=' || contains(lower(m.head), lower(a.head)), "
         "'ExactHeadMatch=' || (lower(m.head) = lower(a.head)), 'ThisHeadContained=' || contains(lower(a.head), lower(m.head)), 'AntHeadContained=' || contains(lower(m.head), lower(a.head)), 'CurrPronConjStr=' || m.conj, 'PrevPronConjStr=' || a.conj, "
         "'AntContainedByDifferentSpeaker=' || (a.contained_by_speaker and lower(translate(m.speaker, '-_.', '')) <> lower(translate(a.speaker, '-_.', ''))), 'AntContainsDifferentSpeaker=' || (a.contains_speaker and lower(translate(m.speaker, '-_.', '')) <> lower(translate(a.speaker, '-_.', '')))]")  # fmt: skip
VECTORS = RICH + f", vectors as (select m.doc_key, m.ment_idx as m, a.ment_idx as a, list_concat(list_concat({_side_sql('Prev', 'a')}, {_side_sql('Curr', 'm')}), {_PAIR}) as feats from rich m join rich a on m.doc_key = a.doc_key and a.ment_idx < m.ment_idx)"


@query("anaphoricity_features", RICH + f"select doc_key, ment_idx, array_to_string({_ANA}, '|') as feats from rich")
def anaphoricity_features(s, d):
    return proxy.mentions(s, d).select("doc_key", "ment_idx", F.array_join(features.anaphoricity_features(), "|").alias("feats"))


@query("pair_features_string", VECTORS + "select doc_key, m, a, array_to_string(feats, '|') as feats from vectors")
def pair_features_string(s, d):
    return features.featurized_pairs(proxy.mentions(s, d)).select("doc_key", "m", "a", F.array_join("feats", "|").alias("feats"))


@query("feature_arity", VECTORS + f"select min(len(feats)) as least_pair, max(len(feats)) as most_pair, (select max(len({_ANA})) from rich) as anaphoricity from vectors")
def feature_arity(s, d):
    m = proxy.mentions(s, d)
    own = m.agg(F.max(F.size(features.anaphoricity_features())).cast("bigint").alias("anaphoricity"))
    pairs = features.featurized_pairs(m).agg(F.min(F.size("feats")).cast("bigint").alias("least_pair"), F.max(F.size("feats")).cast("bigint").alias("most_pair"))
    return pairs.crossJoin(own)  # single rows


def indexed_mentions(s, d):
    """doc_key, ment_idx, feats: anaphoricity vectors as ids."""
    vectors = proxy.mentions(s, d).select("doc_key", "ment_idx", features.anaphoricity_features().alias("feats"))
    index = lexical.feature_index(vectors.select(F.explode("feats").alias("feat")))
    return features.with_ids(vectors, index, ["doc_key", "ment_idx"])


INDEXED = RICH + f", each as (select doc_key, ment_idx, unnest({_ANA}) as feat, unnest(range(21)) as k from rich), i as (select feat, row_number() over (order by feat) as id from (select distinct feat from each)), vec as (select doc_key, ment_idx, string_agg(cast(id as varchar), ' ' order by k) as feats, list(id order by k) as ids from each join i using (feat) group by 1, 2)"


@query("mention_features_indexed", INDEXED + "select doc_key, ment_idx, feats from vec")
def mention_features_indexed(s, d):
    return indexed_mentions(s, d).select("doc_key", "ment_idx", F.array_join(F.transform("feats", lambda x: x.cast("string")), " ").alias("feats"))


@query("csr_offsets", INDEXED + "select doc_key, n_ids, n_vectors, cast(coalesce(sum(n_ids) over w, 0) as bigint) as ids_before, cast(coalesce(sum(n_vectors) over w, 0) as bigint) as vectors_before from (select doc_key, cast(sum(len(ids)) as bigint) as n_ids, count(*) as n_vectors from vec group by 1) window w as (order by doc_key rows between unbounded preceding and 1 preceding)")
def csr_offsets(s, d):
    return features.offsets(proxy.mentions(s, d).select("doc_key", features.anaphoricity_features().alias("feats")), ["doc_key"])


@query("triangular_offset_check", PR + "select doc_key, count(*) as pairs, count(*) filter (where m * (m - 1) // 2 + a <> place) as wrong from (select *, row_number() over (partition by doc_key order by m, a) - 1 as place from strict) group by 1")
def triangular_offset_check(s, d):
    p = P.mention_pairs(proxy.plain_mentions(s, d), [])
    place = F.row_number().over(Window.partitionBy("doc_key").orderBy("m", "a")) - 1
    return p.withColumn("place", place).groupBy("doc_key").agg(F.count("*").alias("pairs"), F.count_if(features.triangular_place(F.col("m"), F.col("a")) != F.col("place")).alias("wrong"))


@query("template_counts", VECTORS + ", names as (select split_part(unnest(feats), '=', 1) as template from vectors) select template, count(*) as cnt from names group by 1 order by cnt desc, template limit 200")
def template_counts(s, d):
    return features.pair_templates(proxy.mentions(s, d)).orderBy(F.desc("cnt"), "template").limit(200)


# -- scores and choices -----------------------------------------------------------------

_SOFT = "marginals as (select *, exp(score - max(score) over w) / sum(exp(score - max_score)) over w as marginal from (select *, max(score) over (partition by doc_key, m) as max_score from pairs) window w as (partition by doc_key, m))"
_BEST = "best as (select doc_key, m, arg_max(a, {'s': score, 'x': -a}) as a from pairs group by 1, 2)"
_SOFT = "top as (select *, max(score) over (partition by doc_key, m) as t from pairs), marginals as (select *, exp(score - t) / sum(exp(score - t)) over (partition by doc_key, m) as marginal from top)"


@query("linear_score", INDEXED + ", w as (select doc_key, ment_idx, unnest(ids) as id from vec) select doc_key, ment_idx as m, round(sum((id % 7 - 3) * 0.25), 6)::double as score from w group by 1, 2")
def linear_score(s, d):
    vectors = Scratch(s, "vectors").store(indexed_mentions(s, d).select("doc_key", F.col("ment_idx").alias("m"), F.col("ment_idx").alias("a"), "feats"), "vectors")
    ids = vectors.select(F.explode("feats").alias("feat_idx")).distinct()
    weights = ids.withColumn("weight", (F.col("feat_idx") % 7 - 3) * 0.25)
    return scoring.linear_scores(vectors, weights).select("doc_key", "m", six(F.col("score")).alias("score"))


@query("softmax_antecedents", PR + f", {_SOFT} select doc_key, m, a, round(marginal, 6) as marginal from marginals")
def softmax_antecedents(s, d):
    return scoring.marginals(proxy.scored_pairs(s, d, diagonal=True)).select("doc_key", "m", "a", six(F.col("marginal")).alias("marginal"))


@query("log_likelihood", PR + f", {_SOFT}, each as (select doc_key, m, sum(case when coreferent then marginal else 0.0 end) as p from marginals group by 1, 2) select doc_key, round(sum(case when p > 0 then ln(p) else -30.0 end), 5) as log_likelihood from each group by 1")
def log_likelihood(s, d):
    return scoring.log_likelihood(scoring.marginals(proxy.scored_pairs(s, d, diagonal=True))).select("doc_key", F.round("log_likelihood", 5).alias("log_likelihood"))


@query("argmax_antecedent", PR + f", {_BEST} select doc_key, m, a from best")
def argmax_antecedent(s, d):
    return proxy.choices(s, d).select("doc_key", "m", "a")


@query("new_if_strictly_better", PR + ", b as (select doc_key, m, arg_max(a, {'s': score, 'x': -a}) filter (where a < m) as ante, max(score) filter (where a < m) as s from pairs group by 1, 2) select doc_key, m, case when ante is null or 0.5 > s then m else ante end as a from b")
def new_if_strictly_better(s, d):
    return scoring.best_or_new(proxy.scored_pairs(s, d, diagonal=True))


@query("latent_antecedent", PR + ", b as (select doc_key, m, arg_max(a, {'s': score, 'x': -a}) as a from pairs where coreferent and m - a <= 50 group by 1, 2) select * from b")
def latent_antecedent(s, d):
    return scoring.best_gold(proxy.scored_pairs(s, d), most_back=50).select("doc_key", "m", "a")


_LOSS = "case when not anaphoric and a < m then 0.1 when anaphoric and a = m then 3.0 when anaphoric and not coreferent then 1.0 else 0.0 end"
_WITH_LOSS = f"known as (select *, bool_or(coreferent) over (partition by doc_key, m) as anaphoric from pairs), costs as (select *, {_LOSS}::double as loss from known)"


def _with_loss(s, d) -> DataFrame:
    p = proxy.scored_pairs(s, d, diagonal=True, anaphoric=True)
    return p.withColumn("loss", numeric.false_link_loss("custom", F.col("anaphoric"), F.col("a") == F.col("m"), F.col("coreferent") | ((F.col("a") == F.col("m")) & ~F.col("anaphoric"))))


@query("custom_loss", PR + f", {_WITH_LOSS} select doc_key, loss, count(*) as pairs from costs group by 1, 2")
def custom_loss(s, d):
    return _with_loss(s, d).groupBy("doc_key", "loss").agg(F.count("*").alias("pairs"))


@query("loss_augmented", PR + f", {_WITH_LOSS}, late as (select doc_key, m, max(score) as late from costs where coreferent or (a = m and not anaphoric) group by 1, 2) select doc_key, m, arg_max(a, {{'v': loss * (1 + score - late), 'x': -a}}) as a from costs join late using (doc_key, m) group by 1, 2")
def loss_augmented(s, d):
    p = _with_loss(s, d)
    right = p.where(F.col("coreferent") | ((F.col("a") == F.col("m")) & ~F.col("anaphoric")))
    return scoring.loss_augmented(p, scoring.best_antecedent(right)).select("doc_key", "m", "a")


@query("closest_first", PR + "select doc_key, m, max(a) as a from strict where score > 0.5 group by 1, 2")
def closest_first(s, d):
    return scoring.closest_first(proxy.scored_pairs(s, d), 0.5)


@query("best_first", PR + "select doc_key, m, arg_max(a, {'s': score, 'x': a}) as a from strict where score > 0.5 group by 1, 2")
def best_first(s, d):
    return scoring.best_first(proxy.scored_pairs(s, d), 0.5)


@query("distance_prune", PR + "select doc_key, m, count(*) as kept, min(a) as first from strict where a >= m - 20 and (m_ment_type <> 'PRONOMINAL' or m_sent_idx - a_sent_idx <= 1) group by 1, 2")
def distance_prune(s, d):
    m = proxy.mentions(s, d)
    kept = P.mention_pairs(m, ["sent_idx", "ment_type"], keep=P.near_enough(20, 1), back=20)
    return kept.groupBy("doc_key", "m").agg(F.count("*").alias("kept"), F.min("a").alias("first"))


@query("log_ratio_prune", PR + "select doc_key, m, count(*) as kept from (select *, max(round(score, 9)) over (partition by doc_key, m) as best from pairs) where round(score, 9) + 1.0 >= best group by 1, 2")
def log_ratio_prune(s, d):
    return P.log_ratio_pruned(proxy.scored_pairs(s, d, diagonal=True), 1.0).groupBy("doc_key", "m").agg(F.count("*").alias("kept"))


_PRUNED = "marked as (select *, score + 1.0 < max(score) over (partition by doc_key, m) as pruned from pairs)"


def _marked(s, d) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("doc_key", "m"))
    return proxy.scored_pairs(s, d, diagonal=True).withColumn("pruned", F.col("score") + 1.0 < best)


@query("pruning_stats", PR + f""", {_PRUNED}, each as (select doc_key, m, bool_or(coreferent) as ana, bool_or(coreferent and not pruned) as kg, count(*) filter (where not pruned) as kept, count(*) filter (where pruned) as dropped, count(*) filter (where coreferent and pruned) as dg from marked group by 1, 2)
select count(*) as mentions, cast(sum(kept) as bigint) as kept, cast(sum(dropped) as bigint) as dropped, cast(sum(dg) as bigint) as dropped_gold, count(*) filter (where ana) as anaphoric, count(*) filter (where ana and not kg) as lost, count(*) filter (where kept = 0) as emptied, count(*) filter (where kept = 1) as decided from each""")
def pruning_stats(s, d):
    return P.pruning_stats(_marked(s, d))


@query("gold_antecedents", PR + f", {_PRUNED} select doc_key, m, coalesce(string_agg(cast(a as varchar), ' ' order by a) filter (where coreferent), string_agg(cast(a as varchar), ' ' order by a)) as antecedents from marked where not pruned group by 1, 2")
def gold_antecedents(s, d):
    found = P.gold_antecedents(_marked(s, d).where("not pruned"))
    return found.select("doc_key", "m", F.array_join(F.transform("antecedents", lambda x: x.cast("string")), " ").alias("antecedents"))


@query("score_chart", PR + f", {_PRUNED} select doc_key, count(*) as cells, count(*) filter (where pruned) as empty, round(sum(case when not pruned then score end), 5) as total from marked group by 1")
def score_chart(s, d):
    p = _marked(s, d)
    chart = P.chart(p, p.where("not pruned"))
    finite = F.col("score") > float("-inf")
    return chart.groupBy("doc_key").agg(F.count("*").alias("cells"), F.count_if(~finite).alias("empty"), F.round(F.sum(F.when(finite, F.col("score"))), 5).alias("total"))


@query("expected_counts", PR + f", {_SOFT}, each as (select 'dist=' || least(m - a, 10) as feat, (case when coreferent then 1.0 else 0.0 end) - marginal as d from marginals) select feat, round(sum(d), 4) as gradient from each group by 1")
def expected_counts(s, d):
    p = scoring.marginals(proxy.scored_pairs(s, d, diagonal=True))
    p = p.select(F.array(F.concat(F.lit("dist="), numeric.capped(F.col("m") - F.col("a")).cast("string"))).alias("feats"), "marginal", F.col("coreferent").cast("double").alias("gold_marginal"))
    return scoring.expected_counts(p).select(F.col("feat_idx").alias("feat"), F.round("gradient", 4).alias("gradient"))


@query("antecedent_accuracy", PR + f", {_BEST}, ana as (select doc_key, m, list(a) as gold from strict where coreferent group by 1, 2) select count(*) as anaphoric, count(*) filter (where list_contains(gold, b.a)) as correct, round(count(*) filter (where list_contains(gold, b.a)) / count(*)::double, 6) as accuracy from ana left join best b using (doc_key, m)")
def antecedent_accuracy(s, d):
    return scoring.antecedent_accuracy(proxy.choices(s, d), proxy.scored_pairs(s, d)).withColumn("accuracy", six(F.col("accuracy")))


@query("entity_features", FU + """, labelled as (select m.doc_key, m.ment_idx, m.number, m.gender, c.key_id from mentions m join clusters c using (doc_key, ment_idx)),
counts as (select x.doc_key, x.ment_idx as m, y.key_id as cluster_id, count(*) as size, count(*) filter (where x.number = y.number) as n, count(*) filter (where x.gender = y.gender) as g from labelled x join labelled y on x.doc_key = y.doc_key and y.ment_idx < x.ment_idx group by 1, 2, 3)
select doc_key, m, cluster_id, size, """ + ", ".join(f"'{name}=' || case when size <= 2 then {c} || '/' || size when {c} = 0 then 'NONE' when {c} = size then 'ALL' when 2 * {c} > size then 'MANY' else 'AL1' end as {name}" for name, c in (("number", "n"), ("gender", "g"))) + " from counts")
def entity_features(s, d):
    m = proxy.mentions(s, d)
    return inference.entity_features(m.select("doc_key", "ment_idx", "number", "gender"), proxy.key_clusters(m), ["number", "gender"])


# -- clusterings ----------------------------------------------------------------------------


@query("clusters_from_backptrs", PR + "select doc_key, ment_idx, response_id as cluster_id from clusters")
def clusters_from_backptrs(s, d):
    pointers = clusters.back_pointers(proxy.response_clusters(proxy.plain_mentions(s, d), "word"))
    return clusters.from_back_pointers(pointers).select("doc_key", "ment_idx", "cluster_id")


_CLOSURE = """, recursive_links as (select doc_key, m as x, a as y from strict where score > 0.5)"""


@query("transitive_closure_decode", "with recursive " + PR[5:].rstrip() + """, links as (select doc_key, m as x, a as y from strict where score > 0.5 union select doc_key, a, m from strict where score > 0.5),
reach as (select doc_key, x, x as y from links union select r.doc_key, r.x, l.y from reach r join links l on r.doc_key = l.doc_key and r.y = l.x)
select doc_key, x as m, coalesce(max(y) filter (where y < x), x) as a from reach group by 1, 2""")
def transitive_closure_decode(s, d):
    return scoring.transitive_closure(proxy.scored_pairs(s, d), 0.5)


@query("oracle_clustering", PR + """, pred as (select doc_key, ment_idx from typed where ment_idx % 5 <> 3), seen as (select p.doc_key, p.ment_idx, c.key_id from pred p left join clusters c on c.doc_key = p.doc_key and c.ment_idx = p.ment_idx and p.ment_idx % 7 <> 2),
named as (select *, case when key_id is null then 'm' || ment_idx else 'c' || key_id end as name from seen), f as (select *, min(ment_idx) over (partition by doc_key, name) as first from named)
select doc_key, ment_idx, cast(dense_rank() over (partition by doc_key order by first) - 1 as bigint) as cluster_id from f""")
def oracle_clustering(s, d):
    m = proxy.plain_mentions(s, d)
    predicted = m.where("ment_idx % 5 <> 3").select("doc_key", "ment_idx")
    matches = predicted.where("ment_idx % 7 <> 2").select("doc_key", F.col("ment_idx").alias("pred_idx"), F.col("ment_idx").alias("gold_idx"))
    return clusters.oracle(matches, proxy.key_clusters(m, "word"), predicted)


@query("drop_singletons", PR + """, s as (select doc_key, ment_idx, key_id from (select *, count(*) over (partition by doc_key, key_id) as n from clusters) where n > 1), f as (select *, min(ment_idx) over (partition by doc_key, key_id) as first from s)
select doc_key, ment_idx, cast(dense_rank() over (partition by doc_key order by first) - 1 as bigint) as cluster_id from f""")
def drop_singletons(s, d):
    return clusters.without_singletons(proxy.key_clusters(proxy.plain_mentions(s, d), "word")).select("doc_key", "ment_idx", "cluster_id")


@query("sub_clustering", PR + """, s as (select doc_key, key_id, row_number() over (partition by doc_key order by ment_idx) - 1 as ment_idx from clusters where ment_idx % 2 = 0), f as (select *, min(ment_idx) over (partition by doc_key, key_id) as first from s)
select doc_key, ment_idx, cast(dense_rank() over (partition by doc_key order by first) - 1 as bigint) as cluster_id from f""")
def sub_clustering(s, d):
    m = proxy.plain_mentions(s, d)
    return clusters.restricted(proxy.key_clusters(m, "word"), m.where("ment_idx % 2 = 0")).select("doc_key", "ment_idx", "cluster_id")


@query("size_batches", PR + "select doc_key, key_id as cluster_id, size, row_number() over (partition by doc_key, size order by key_id) - 1 as batch_row from (select doc_key, key_id, count(*) as size from clusters group by 1, 2)")
def size_batches(s, d):
    return clusters.size_batches(proxy.key_clusters(proxy.plain_mentions(s, d), "word"))


@query("opc_text", PR + ", each as (select doc_key, key_id, string_agg(cast(ment_idx as varchar), ' ' order by ment_idx) as members from clusters group by 1, 2) select doc_key, string_agg(members, '|' order by key_id) as value from each group by 1")
def opc_text(s, d):
    return text_formats.clusters_text(proxy.key_clusters(proxy.plain_mentions(s, d), "word"))


@query("opc_round_trip", PR + "select doc_key, ment_idx, key_id as cluster_id from clusters")
def opc_round_trip(s, d):
    lines = text_formats.clusters_text(proxy.key_clusters(proxy.plain_mentions(s, d), "word"))
    return text_formats.clusters_from_text(lines, line="value")


@query("back_pointer_text", PR + "select doc_key, string_agg(cast(coalesce(prev, ment_idx) as varchar), ' ' order by ment_idx) as value from (select doc_key, ment_idx, lag(ment_idx) over (partition by doc_key, response_id order by ment_idx) as prev from clusters) group by 1")
def back_pointer_text(s, d):
    return text_formats.pointers_text(clusters.back_pointers(proxy.response_clusters(proxy.plain_mentions(s, d), "word")))


@query("mention_heads_text", PL + "select doc_key, count(*) || '|' || string_agg(word, '|' order by ment_idx) as value from plain group by 1")
def mention_heads_text(s, d):
    return text_formats.heads_text(proxy.plain_mentions(s, d), "word")


@query("mention_context_text", T + r"select doc_key, sent_idx, tok_idx, trim(coalesce(string_agg(word, ' ') over (w rows between 3 preceding and 1 preceding), '') || ' [' || word || '] ' || coalesce(string_agg(word, ' ') over (w rows between 1 following and 3 following), '')) as shown from tokens window w as (partition by doc_key, sent_idx order by tok_idx)")
def mention_context_text(s, d):
    t = proxy.tokens(s, d)
    words = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "word"))), lambda x: x["word"])
    sentences = t.groupBy("doc_key", "sent_idx").agg(words.alias("words"))
    each = sentences.select("doc_key", "sent_idx", "words", F.posexplode("words").alias("tok_idx", "w"))
    at = F.col("tok_idx")
    return each.select("doc_key", "sent_idx", at.cast("bigint").alias("tok_idx"), strings.in_context(F.col("words"), at, at + 1).alias("shown"))


@query("coref_bits", PR + "select p.doc_key, p.sent_idx, p.tok_idx, '(' || key_id || ')' as coref_bit from plain p join clusters c using (doc_key, ment_idx)")
def coref_bits(s, d):
    m = proxy.plain_mentions(s, d)
    spans = m.withColumns({"start_idx": F.col("tok_idx"), "end_idx": F.col("tok_idx") + 1})
    chunks = clusters.chunks(proxy.key_clusters(m, "word"), spans)
    return conll.coref_bits(proxy.tokens(s, d), chunks).where("coref_bit <> '-'").select("doc_key", "sent_idx", "tok_idx", "coref_bit")


@query("coref_bits_roundtrip", PL + ", runs as (select doc_key, sent_idx, min(tok_idx) as start_idx, max(tok_idx) + 1 as end_idx from plain group by 1, 2), singles as (select doc_key, sent_idx, tok_idx, tok_idx + 1 from plain), spans as (select * from runs union select * from singles) select * from spans")
def coref_bits_roundtrip(s, d):
    """Encodes nested spans as bits and decodes them: the sentence's range of mentions, and each mention."""
    m = proxy.plain_mentions(s, d)
    keys = ["doc_key", "sent_idx"]
    runs = m.groupBy(*keys).agg(F.min("tok_idx").alias("start_idx"), (F.max("tok_idx") + 1).alias("end_idx"))
    spans = runs.union(m.select(*keys, "tok_idx", F.col("tok_idx") + 1)).distinct()
    chunks = spans.withColumn("label", F.pmod(F.hash("start_idx", "end_idx"), F.lit(3)).cast("bigint"))
    return conll.coref_chunks(conll.coref_bits(proxy.tokens(s, d), chunks)).drop("label")


# -- analyses ---------------------------------------------------------------------------------

JUDGED = PR + f""", {_BEST}, judged as (select b.doc_key, b.m, b.a, x.k_first <> b.m as anaphoric, b.a = b.m as new, case when b.a = b.m then x.k_first = b.m else x.k = y.k end as correct, x.k as m_cluster,
    mt.ment_type as m_ment_type, mt.word as m_head, mt.sent_idx as m_sent_idx, att.ment_type as a_ment_type, att.word as a_head
  from best b join firsts x on x.doc_key = b.doc_key and x.ment_idx = b.m join firsts y on y.doc_key = b.doc_key and y.ment_idx = b.a join typed mt on mt.doc_key = b.doc_key and mt.ment_idx = b.m join typed att on att.doc_key = b.doc_key and att.ment_idx = b.a),
errors as (select *, case when correct then 0 when new then 1 when not anaphoric then 2 else 3 end as error from judged)"""


def _judged(s, d) -> DataFrame:
    m = proxy.plain_mentions(s, d)
    named = m.withColumnRenamed("word", "head").withColumn("ment_type", linguistic.mention_type(F.lit(1), F.col("head"), F.when(F.char_length("head") >= 7, "X").otherwise("O")))
    return analysis.judged(proxy.choices(s, d).select("doc_key", "m", "a"), proxy.key_clusters(m, "word"), named)


@query("accuracy_rollup", JUDGED + "select anaphoric, m_ment_type, count(*) filter (where correct) as \"right\", count(*) as total from judged group by rollup (anaphoric, m_ment_type)")
def accuracy_rollup(s, d):
    return analysis.accuracy(_judged(s, d))


@query("subdivision_rollup", JUDGED + ", p as (select [m_ment_type, case when anaphoric then 'old' else 'first' end] as props, correct from judged), each as (select array_to_string(list_slice(props, 1, n), '/') as prefix, correct from p, (values (0), (1), (2)) t(n)) select prefix, count(*) filter (where correct) as \"right\", count(*) as total from each group by 1")
def subdivision_rollup(s, d):
    rows = _judged(s, d).withColumn("properties", F.array("m_ment_type", F.when(F.col("anaphoric"), "old").otherwise("first")))
    return analysis.by_prefixes(rows).withColumn("prefix", F.array_join("prefix", "/"))


@query("linkage_counts", JUDGED + "select (case when m_ment_type in ('PRONOMINAL', 'DEMONSTRATIVE') then 'P' else 'NP' end) || '->' || (case when a_ment_type in ('PRONOMINAL', 'DEMONSTRATIVE') then 'P' else 'NP' end) as kind, count(*) as links, count(*) filter (where correct) as \"right\", count(*) filter (where lower(m_head) <> lower(a_head)) as different_head from judged where not new group by 1")
def linkage_counts(s, d):
    return analysis.linkage(_judged(s, d))


@query("error_types", JUDGED + "select error, m_ment_type, count(*) as mentions from errors group by 1, 2")
def error_types(s, d):
    return _judged(s, d).groupBy("error", "m_ment_type").agg(F.count("*").alias("mentions"))


@query("errors_by_distance", JUDGED + """, e as (select *, coalesce(least(m_sent_idx - lag(m_sent_idx) over (partition by doc_key, m_cluster order by m), 10), -1) as distance from errors)
select distance, error, count(*) as mentions, count(*) filter (where m_ment_type <> 'PRONOMINAL') as referring, count(*) filter (where m_ment_type <> 'PRONOMINAL' and a_ment_type <> 'PRONOMINAL') as both_referring from e group by 1, 2""")
def errors_by_distance(s, d):
    return analysis.errors_by_distance(_judged(s, d))


@query("top_head_pairs", JUDGED + "select lower(m_head) as head, lower(a_head) as other, count(*) as cnt from judged where not correct and m_ment_type <> 'PRONOMINAL' group by 1, 2 order by cnt desc, head, other limit 100")
def top_head_pairs(s, d):
    return analysis.top_head_pairs(_judged(s, d))


@query("recall_errors", JUDGED + """, near as (select doc_key, m, bool_or(coreferent and m_ment_type <> 'PRONOMINAL' and a_ment_type <> 'PRONOMINAL') as ref, bool_or(coreferent and m_ment_type <> 'PRONOMINAL' and a_ment_type <> 'PRONOMINAL' and lower(m_head) = lower(a_head)) as hm from strict group by 1, 2)
select j.doc_key, j.m, j.a, coalesce(ref, false) as has_referring, coalesce(hm, false) as has_head_match from judged j left join near n using (doc_key, m) where not correct and m_ment_type <> 'PRONOMINAL'""")
def recall_errors(s, d):
    return analysis.recall_errors(proxy.scored_pairs(s, d), _judged(s, d))


@query("misleading_head_match", PR + ", e as (select doc_key, m, bool_or(response_link) as ana, bool_or(response_link and lower(m_head) = lower(a_head)) as mat, bool_or(not response_link and lower(m_head) = lower(a_head)) as mis from strict group by 1, 2) select count(*) as mentions, count(*) filter (where ana and not mat) as bridging, count(*) filter (where mis) as misleading, count(*) filter (where mis and not ana) as misleading_new from e")
def misleading_head_match(s, d):
    return analysis.head_matches(proxy.scored_pairs(s, d).withColumn("coreferent", F.col("response_link")))


@query("trivial_after_pruning", PR + f""", {_PRUNED}, known as (select *, bool_or(coreferent) over (partition by doc_key, m) as anaphoric from marked),
e as (select doc_key, m, anaphoric, m_ment_type, count(*) filter (where coreferent or (a = m and not anaphoric)) as r, count(*) as n from known where not pruned group by 1, 2, 3, 4)
select anaphoric, m_ment_type, case when r = n then 'trivially right' when r = 0 then 'trivially wrong' else 'open' end as state, count(*) as mentions from e group by 1, 2, 3""")
def trivial_after_pruning(s, d):
    w = Window.partitionBy("doc_key", "m")
    p = _marked(s, d).withColumn("anaphoric", F.bool_or("coreferent").over(w))
    return analysis.trivial(p.withColumn("correct", F.col("coreferent") | ((F.col("a") == F.col("m")) & ~F.col("anaphoric"))))


@query("entity_grid", PR + "select t.doc_key, c.key_id as cluster_id, t.sent_idx, string_agg(left(ment_type, 1), '' order by t.ment_idx) as cell from typed t join clusters c using (doc_key, ment_idx) group by 1, 2, 3")
def entity_grid(s, d):
    m = proxy.mentions(s, d)
    return analysis.entity_grid(proxy.key_clusters(m), m)


@query("error_grid", JUDGED + "select e.doc_key, c.key_id as cluster_id, e.m_sent_idx as sent_idx, string_agg(cast(error as varchar), '' order by m) as cell from errors e join clusters c on c.doc_key = e.doc_key and c.ment_idx = e.m group by 1, 2, 3")
def error_grid(s, d):
    m = proxy.mentions(s, d)
    return analysis.entity_grid(proxy.key_clusters(m), m, _judged(s, d))


@query("entities_per_sentence", PR + ", e as (select t.doc_key, t.sent_idx, count(distinct c.key_id) as n from typed t join clusters c using (doc_key, ment_idx) group by 1, 2) select least(n, 10) as entities, count(*) as sentences from e group by 1")
def entities_per_sentence(s, d):
    m = proxy.plain_mentions(s, d)
    return analysis.entities_per_sentence(proxy.key_clusters(m, "word"), m)


@query("mention_recall", PL + "select count(*) filter (where length(word) > 3) as found, count(*) as gold from plain")
def mention_recall(s, d):
    spans = proxy.plain_mentions(s, d).withColumns({"start_idx": F.col("tok_idx"), "end_idx": F.col("tok_idx") + 1})
    return M.recall(spans, spans.where(F.char_length("word") > 3))


@query("missed_mentions", PL + "select doc_key, sent_idx, tok_idx as start_idx, word from plain where length(word) <= 3")
def missed_mentions(s, d):
    spans = proxy.plain_mentions(s, d).withColumns({"start_idx": F.col("tok_idx"), "end_idx": F.col("tok_idx") + 1})
    return M.missed(spans, spans.where(F.char_length("word") > 3)).select("doc_key", "sent_idx", "start_idx", "word")


@query("confusion", "select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality = 0 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic = 0) as fn, count(*) filter (where quality = 0 and toxic = 0) as tn from labels")
def confusion(s, d):
    return analysis.confusion(proxy.table(s, d, "labels").select((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")), "q", "t")


@query("bio_chunks", T + r", marked as (select *, regexp_matches(word, '^\p{Lu}') as up from tokens), runs as (select *, tok_idx - row_number() over (partition by doc_key, sent_idx, up order by tok_idx) as g from marked) select doc_key, sent_idx, min(tok_idx) as start_idx, max(tok_idx) + 1 as end_idx, 'CAP' as label from runs where up group by doc_key, sent_idx, g")
def bio_chunks(s, d):
    t = proxy.tokens(s, d)
    up = F.rlike("word", F.lit(r"^\p{Lu}"))
    return analysis.bio_chunks(t.withColumn("bio", F.when(up, "I-CAP").otherwise("O")), "bio").select("doc_key", "sent_idx", "start_idx", "end_idx", "label")


# -- dictionaries, text, numbers -----------------------------------------------------------------


@query("copula_pattern_counts", T + ", g as (select doc_key, sent_idx, tok_idx, lower(word) as x, lower(lead(word, 1) over w) as v, lower(lead(word, 2) over w) as y from tokens window w as (partition by doc_key, sent_idx order by tok_idx)) select x, y, count(*) as cnt from g where v in ('is', 'ist', 'est', 'es') and y is not null group by 1, 2")
def copula_pattern_counts(s, d):
    w = Window.partitionBy("doc_key", "sent_idx").orderBy("tok_idx")
    t = proxy.tokens(s, d).withColumn("low", F.lower("word"))
    grams = t.select(F.array(F.col("low"), F.lead("low", 1).over(w), F.lead("low", 2).over(w)).alias("g")).where(F.col("g")[1].isin("is", "ist", "est", "es") & F.col("g")[2].isNotNull())
    grams = grams.select(F.array(F.col("g")[0], F.lit("is"), F.col("g")[2]).alias("words")).groupBy("words").agg(F.count("*").alias("cnt"))
    heads = grams.select(F.explode(F.array(F.col("words")[0], F.col("words")[2])).alias("head"))
    return lexical.copula_counts(grams, heads, grams.select(F.col("words")[0].alias("x"), F.col("words")[2].alias("y")))


@query("log_bins", T + ", c as (select word, count(*) as n from tokens group by 1) select cast(trunc(log10(n) + 0.5) as integer) as bin, cast(trunc(log10(n) * 4 + 0.5) as integer) as fine, count(*) as words from c group by 1, 2")
def log_bins(s, d):
    counts = proxy.tokens(s, d).groupBy("word").agg(F.count("*").alias("n"))
    return counts.groupBy(numeric.log_bin(F.col("n")).alias("bin"), numeric.log_bin(F.col("n"), 4).alias("fine")).agg(F.count("*").alias("words"))


@query("floor_quantile", T + ", c as (select doc_key, length(word) as n, row_number() over (partition by doc_key order by length(word)) as k, count(*) over (partition by doc_key) as t from tokens) select doc_key, max(n) filter (where k = least(cast(floor(t * 0.9) as bigint) + 1, t)) as quantile from c group by 1")
def floor_quantile(s, d):
    lengths = proxy.tokens(s, d).groupBy("doc_key").agg(F.collect_list(F.char_length("word").cast("bigint")).alias("n"))
    return lengths.select("doc_key", numeric.floor_quantile(F.col("n"), 0.9).alias("quantile"))


@query("speaker_containment", FU + "select speaker, contained_by_speaker, contains_speaker, count(*) as mentions from mentions group by 1, 2, 3")
def speaker_containment(s, d):
    return proxy.mentions(s, d).groupBy("speaker", "contained_by_speaker", "contains_speaker").agg(F.count("*").alias("mentions"))


@query("sentence_split", r"""select doc_id, len(regexp_extract_all(text, '[.?!](?:"|''''|``|''|\))? ')) as candidates, len(string_split(regexp_replace(text, '([.?!](?:"|''''|``|''|\))?) +(["''(`]*\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1))) as sentences from documents""")
def sentence_split(s, d):
    docs = proxy.table(s, d, "documents")
    return docs.select("doc_id", F.size(strings.sentence_candidates(F.col("text"))).cast("bigint").alias("candidates"), F.size(strings.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query("paragraphs", "select page_id, k - 1 as par_idx, length(p) as letters from (select page_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as k from (select page_id, string_split(html, '</p>') as ps from pages))")
def paragraphs(s, d):
    rows = proxy.table(s, d, "pages").select("page_id", F.replace("html", F.lit("</p>"), F.lit("\n\n")).alias("x"), F.posexplode(F.split("html", "</p>")).alias("par_idx", "p"))
    return rows.select("page_id", F.col("par_idx").cast("bigint").alias("par_idx"), F.char_length("p").cast("bigint").alias("letters"))


@query("document_paragraphs", r"select doc_id, k - 1 as par_idx, length(p) as letters from (select doc_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as k from (select doc_id, string_split_regex(text, '\r?\n') as ps from documents))")
def document_paragraphs(s, d):
    found = text_formats.paragraphs(proxy.table(s, d, "documents").select("doc_id", "text"), "line")
    return found.select("doc_id", F.col("par_idx").cast("bigint").alias("par_idx"), F.char_length("paragraph").cast("bigint").alias("letters"))


_GENDERS = (("the", 5, 1, 2, 0), ("and", 0, 9, 1, 2), ("is", 1, 1, 1, 9), ("on", 0, 0, 7, 1), ("der", 8, 1, 0, 3))


@query("numgen_lookup", PL + ", g(key, c1, c2, c3, c4) as (values " + ", ".join(map(str, _GENDERS)) + """), j as (select doc_key, ment_idx, coalesce(c1, 0) as c1, coalesce(c2, 0) as c2, coalesce(c3, 0) as c3, coalesce(c4, 0) as c4 from plain left join g on lower(word) = key)
select doc_key, ment_idx, case when c1 + c2 + c3 >= c4 then 'SINGULAR' else 'PLURAL' end as number, case when c1 >= 3 and c1 >= 2 * (c2 + c3) then 'MALE' when c2 >= 3 and c2 >= 2 * (c1 + c3) then 'FEMALE' when c3 >= 3 and c3 >= 2 * (c1 + c2) then 'NEUTRAL' else 'UNKNOWN' end as gender from j""")
def numgen_lookup(s, d):
    lines = s.createDataFrame([(" ".join(map(str, x)),) for x in _GENDERS], "value string")
    known = lexical.gender_counts(proxy.plain_mentions(s, d), text_formats.gender_dictionary(lines), "word", "word")
    return known.select("doc_key", "ment_idx", linguistic.number_of(F.col("counts")).alias("number"), linguistic.gender_of(F.col("counts")).alias("gender"))


@query("genre_filter", "select left(source, 2) as genre, count(*) as docs, count(*) filter (where source like 'src1%') as chosen from documents group by 1")
def genre_filter(s, d):
    docs = proxy.table(s, d, "documents")
    return docs.groupBy(strings.genre(F.col("source")).alias("genre")).agg(F.count("*").alias("docs"), F.count_if(F.startswith("source", F.lit("src1"))).alias("chosen"))


@query("embedding_ranks", "select a.label, count(*) as pairs, round(max(list_inner_product(a.embedding::double[], b.embedding::double[])), 4) as best from embeddings a join embeddings b on a.label = b.label and b.vec_id < a.vec_id group by 1")
def embedding_ranks(s, d):
    e = proxy.table(s, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return scoring.largest_products(e).withColumn("best", F.round("best", 4))


@query("event_windows", "select date_trunc('hour', ts)::timestamp as start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(s, d):
    from ..streaming.windows import event_windows as windows

    return windows(proxy.table(s, d, "events")).withColumn("total", F.round("total", 4))


# -- order and further templates ---------------------------------------------------------------------


@query("top_antecedents", PR + "select doc_key, m, a, cast(rank as integer) as rank from (select *, row_number() over (partition by doc_key, m order by score desc, a) as rank from strict) where rank <= 5")
def top_antecedents(s, d):
    from ..operators.ordering import top_antecedents as top

    return top(proxy.scored_pairs(s, d)).select("doc_key", "m", "a", "rank")


@query("maxima", PR + ", e as (select doc_key, count(*) as n, count(distinct key_id) as c from clusters group by 1), b as (select *, (row_number() over (order by doc_key) - 1) // 4 as b from e) select max(n) as most_mentions, max(c) as most_clusters, (select max(t) from (select cast(sum(n) as bigint) as t from b group by b)) as most_in_batch from b")
def maxima(s, d):
    from ..operators.ordering import maxima as largest

    return largest(proxy.key_clusters(proxy.plain_mentions(s, d), "word"), 4)


@query("first_documents", PL + "select doc_key, count(*) as mentions from plain where doc_key in (select distinct doc_key from plain order by 1 limit 7) group by 1")
def first_documents(s, d):
    from ..operators.ordering import first_documents as first

    return first(proxy.plain_mentions(s, d), 7).groupBy("doc_key").agg(F.count("*").alias("mentions"))


@query("top_words", T + "select lower(word) as key, count(*) as cnt from tokens group by 1 order by cnt desc, key limit 50")
def top_words(s, d):
    from ..operators.ordering import top_keys

    return top_keys(lexical.counted(proxy.tokens(s, d), "word", F.lower("word"), 1).select("key", "cnt"), 50)


@query("listed_words", T + "select lower(word) as key, count(*) as cnt from tokens where lower(word) in ('the', 'der', 'le', 'el') group by 1")
def listed_words(s, d):
    from ..operators.ordering import of_words

    words = s.createDataFrame([(w,) for w in ("the", "der", "le", "el")], "word string")
    return of_words(lexical.counted(proxy.tokens(s, d), "word", F.lower("word"), 1).select("key", "cnt"), words)


@query("larger_pair_features", RICH + f""", heads as (select lower(m.head) || '|' || lower(a.head) as pair from rich m join rich a on m.doc_key = a.doc_key and a.ment_idx < m.ment_idx group by 1 having count(*) >= 2)
select m.doc_key, count(*) as pairs, count(*) filter (where h.pair is null) as backed_off, count(distinct a.syn_uni || '-' || m.syn_uni) as positions, count(*) filter (where a.gender = m.gender and a.number = m.number and a.ner = m.ner and a.ment_type = m.ment_type) as agreeing
from rich m join rich a on m.doc_key = a.doc_key and a.ment_idx < m.ment_idx left join heads h on h.pair = lower(m.head) || '|' || lower(a.head) group by 1""")
def larger_pair_features(s, d):
    from ..operators.templates import larger_pair_features as larger

    p = P.mention_pairs(proxy.mentions(s, d), ["head", "syn_uni", "gender", "number", "ner", "ment_type"]).withColumn("pair", F.concat_ws("|", F.lower("m_head"), F.lower("a_head")))
    common = p.groupBy("pair").agg(F.count("*").alias("n")).where("n >= 2").select("pair", F.lit(True).alias("common"))
    rows = p.join(common, "pair", "left").withColumn("feats", larger(F.coalesce("common", F.lit(False))))
    value = lambda k: F.split(F.substring_index(F.col("feats")[k], "=", -1), "-")
    alike = F.expr("true")
    for k in (5, 6, 7, 8):
        alike = alike & (value(k)[0] == value(k)[1])
    return rows.groupBy("doc_key").agg(F.count("*").alias("pairs"), F.count_if(F.col("feats")[1] == "Heads=BACKOFF_INDICATOR").alias("backed_off"), F.count_distinct(F.col("feats")[0]).alias("positions"), F.count_if(alike).alias("agreeing"))


@query("split_examples", r"""with w as (select doc_id, string_split_regex(trim(text), '\s+') as w from documents), e as (select doc_id, unnest(range(1, len(w))) as k, w from w), x as (select doc_id, k, w[k] as l, w[k + 1] as r from e)
select doc_id, count(*) as candidates, count(*) filter (where regexp_matches(r, '^\p{Lu}')) as capitals, count(*) filter (where contains(regexp_replace(l, '[.?!]("|''''|``|''|\))?$', ''), '.')) as dotted from x where regexp_matches(l, '[.?!]("|''''|``|''|\))?$') group by 1""")
def split_examples(s, d):
    from ..operators.templates import split_examples as examples

    rows = examples(proxy.table(s, d, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.count_if(F.array_contains("feats", "RightCap=true")).alias("capitals"), F.count_if(F.array_contains("feats", "LeftDot=true")).alias("dotted"))


@query("entity_tag_features", T + ", c as (select *, coalesce(lower(lag(word, 1) over w), '<none>') as p, coalesce(lower(lead(word, 2) over w), '<none>') as n from tokens window w as (partition by doc_key, sent_idx order by tok_idx)) select doc_key, sent_idx, tok_idx, '-1W=' || p as before, '2W=' || n as after, cast(16 as integer) as arity from c")
def entity_tag_features(s, d):
    from ..operators.templates import entity_tag_features as tagged

    rows = tagged(proxy.tokens(s, d))
    return rows.select("doc_key", "sent_idx", "tok_idx", F.col("feats")[1].alias("before"), F.col("feats")[4].alias("after"), F.size("feats").alias("arity"))


@query("name_gender", FU + ", g(key, c1, c2, c3) as (values " + ", ".join(str(x[:4]) for x in _GENDERS) + """), j as (select m.doc_key, m.ment_idx, m.named, a.c1 as a1, a.c2 as a2, a.c3 as a3, b.c1 as b1, b.c2 as b2, b.c3 as b3 from (select *, ner = 'PERSON' and regexp_matches(prev1, '^\\p{Lu}') and regexp_matches(head, '^\\p{Lu}') as named from mentions) m left join g a on m.named and lower(m.prev1) = a.key left join g b on lower(m.head) = b.key),
k as (select *, case when a1 >= 3 and a1 >= 2 * (a2 + a3) then 'MALE' when a2 >= 3 and a2 >= 2 * (a1 + a3) then 'FEMALE' when a3 >= 3 and a3 >= 2 * (a1 + a2) then 'NEUTRAL' end as one, case when b1 >= 3 and b1 >= 2 * (b2 + b3) then 'MALE' when b2 >= 3 and b2 >= 2 * (b1 + b3) then 'FEMALE' when b3 >= 3 and b3 >= 2 * (b1 + b2) then 'NEUTRAL' else 'UNKNOWN' end as two from j)
select doc_key, ment_idx, case when named then coalesce(one, 'UNKNOWN') else two end as name_gender from k""")
def name_gender(s, d):
    from ..operators.templates import name_gender as named

    lines = s.createDataFrame([(" ".join(map(str, x)),) for x in _GENDERS], "value string")
    return named(proxy.mentions(s, d), text_formats.gender_dictionary(lines)).select("doc_key", "ment_idx", "name_gender")
