"""Queries of statistics, indexes through files, single-pair gradients, split decisions and small renderings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import linguistic, numeric, strings
from ..operators import features, learning, lexical, metrics, ordering
from ..operators.templates import split_decisions, split_examples
from ..sources import text_formats
from ..storage import Scratch, shared_folder
from . import joint_queries as J, proxy, queries as base
from .registry import query


@query("index_through_text", base.INDEXED + " select id as feat_idx, feat from i")
def index_through_text(s, d):
    """The index of features as lines of text in files, read back."""
    vectors = proxy.mentions(s, d).select(F.explode(features.anaphoricity_features()).alias("feat"))
    path = shared_folder(s, "index-text")
    lines = text_formats.index_text(lexical.feature_index(vectors)).withColumn("feat_idx", F.split("value", " ")[0].cast("bigint"))
    text_formats.write_lines(lines, path, ["feat_idx"])
    return text_formats.index_from_text(text_formats.read_numbered(s, path), "line")


@query("feature_stats", base.INDEXED + " select count(*) as vectors, avg(len(ids)) as mean_size, max(list_max(ids)) as largest_id from vec")
def feature_stats(s, d):
    return features.feature_stats(base.indexed_mentions(s, d))


@query("weight_stats", J.ROWS_SQL + " select count(*) filter (where weight <> 0) as nonzero, round(sum(weight * weight), 6) as squared_norm, round(sum(abs(weight)), 6) as l1_norm from weights")
def weight_stats(s, d):
    found = features.weight_stats(learning.train_log_linear(Scratch(s, "pairs").store(J._training_pairs(s, d), "pairs"), epochs=1))
    return found.select("nonzero", F.round("squared_norm", 6).alias("squared_norm"), F.round("l1_norm", 6).alias("l1_norm"))


@query("unknown_replaced", base.INDEXED + " select doc_key, ment_idx, list_sum(list_transform(ids, lambda x: case when x % 7 = 0 then 5000 else x end)) as total from vec")
def unknown_replaced(s, d):
    """Every seventh feature as unknown, its id 0 and then the dummy's."""
    known = base.indexed_mentions(s, d).withColumn("feats", F.transform("feats", lambda x: F.when(x % 7 == 0, 0).otherwise(x)))
    return features.unknown_replaced(known, 5000).select("doc_key", "ment_idx", F.aggregate("feats", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("binary_gradient", base.PR + f", p as (select {J.COARSE_SQL} as feats, coreferent, 1 / (1 + exp(-score)) as p from pairs where a < m) select cast(f as integer) as feat_idx, round(sum(case when coreferent then 1 - p else -0.5 * p end), 4) + 0.0 as gradient from (select unnest(feats) as f, p, coreferent from p) x group by 1")
def binary_gradient(s, d):
    p = proxy.scored_pairs(s, d).select(J.coarse().alias("feats"), "score", "coreferent")
    return learning.binary_gradient(p, 0.5).select("feat_idx", (F.round("gradient", 4) + 0.0).alias("gradient"))


@query("log_normaliser", base.PR + " select doc_key, m, round(any_value(top) + ln(sum(exp(score - top))), 6) as total from (select *, max(score) over (partition by doc_key, m) as top from pairs) x group by 1, 2")
def log_normaliser(s, d):
    w = Window.partitionBy("doc_key", "m")
    return proxy.scored_pairs(s, d, diagonal=True).select("doc_key", "m", F.round(numeric.log_sum_exp(F.col("score"), w), 6).alias("total")).distinct()


_SPLIT = r"""with w as (select doc_id, string_split_regex(trim(text), '\s+') as w from documents), e as (select doc_id, unnest(range(1, len(w))) as k, w from w), x as (select doc_id, k, w[k] as l, w[k + 1] as r from e),
c as (select doc_id, k, l, r, regexp_replace(l, '[.?!]("|''''|``|''|\))?$', '') as bare from x where regexp_matches(l, '[.?!]("|''''|``|''|\))?$'))
select doc_id, count(*) as candidates, count(*) filter (where (case when regexp_matches(r, '^\p{Lu}') then 1.0 else -1.5 end) - (case when contains(bare, '.') then 2.0 else 0.0 end) + (case when regexp_matches(bare, '[0-9]$') then 0.25 else 0.0 end) > 0) as splits from c group by 1"""


@query("split_decisions", _SPLIT)
def split_decided(s, d):
    weights = s.createDataFrame([("RightCap=true", 1.0), ("RightCap=false", -1.5), ("LeftDot=true", -2.0), ("LeftDigit=true", 0.25)], "feat string, weight double")
    found = split_decisions(split_examples(proxy.table(s, d, "documents").select("doc_id", "text")), weights, ["doc_id", "at"])
    return found.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.count_if("split").alias("splits"))


@query("grammatical_roles", base.FU + r", p as (select doc_key, ment_idx, case when tok_idx = 0 then '[ROOT]' when tok_idx % 4 = 1 then 'VBD(R)' when tok_idx % 4 = 2 then 'VB(L)' when tok_idx % 4 = 3 then 'IN(L)' else syn_uni end as p from mentions) select doc_key, ment_idx, case when p like 'V%(R)' then 'SUBJECT' when p like 'V%(L)' then 'DIROBJ' when p = 'IN(L)' or p = 'TO(L)' then 'INDIROBJ' else 'OTHER' end as role from p")
def grammatical_roles(s, d):
    """The proxy has no tags of verbs, so a governor's tag and side follow the place of the word."""
    k = F.col("start_idx")
    made = F.when(k == 0, "[ROOT]").when(k % 4 == 1, "VBD(R)").when(k % 4 == 2, "VB(L)").when(k % 4 == 3, "IN(L)").otherwise(F.col("syn_uni"))
    return proxy.mentions(s, d).select("doc_key", "ment_idx", linguistic.grammatical_role(made).alias("role"))


@query("prefix_backoff", base.PL + """, known as (select key from (select left(lower(word), n) as key from tokens, (values (1), (2), (3)) t(n) where length(word) >= n) group by 1 having count(*) >= 200)
select doc_key, ment_idx, coalesce(c.key, b.key, a.key, '') as prefix from plain left join known a on length(word) >= 1 and left(lower(word), 1) = a.key left join known b on length(word) >= 2 and left(lower(word), 2) = b.key left join known c on length(word) >= 3 and left(lower(word), 3) = c.key""")
def prefix_backoff(s, d):
    known = lexical.affix_counts(proxy.tokens(s, d), cutoff=200)
    return lexical.affix_fallback(proxy.plain_mentions(s, d), known, "word", "prefix", "prefix").select("doc_key", "ment_idx", "prefix")


@query("words_around_heads", base.T + r"select doc_key, sent_idx, tok_idx, trim(coalesce(string_agg(word, ' ') over (w rows between 2 preceding and 1 preceding), '') || ' _' || word || '_ ' || coalesce(string_agg(word, ' ') over (w rows between 1 following and 2 following), '')) as shown from tokens window w as (partition by doc_key, sent_idx order by tok_idx)")
def words_around_heads(s, d):
    """Sentences as mentions, each of their words as the head."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "word"))), lambda x: x["word"])
    sentences = proxy.tokens(s, d).groupBy("doc_key", "sent_idx").agg(words.alias("words"))
    each = sentences.select("doc_key", "sent_idx", "words", F.posexplode("words").alias("tok_idx", "w"))
    return each.select("doc_key", "sent_idx", F.col("tok_idx").cast("bigint").alias("tok_idx"), strings.around_head(F.col("words"), F.col("tok_idx")).alias("shown"))


@query("first_of_each_span", base.PL + ", s as (select doc_key, lower(word) as mention, ment_idx, left(lower(word), 2) as cluster_id from plain) select doc_key, mention, ment_idx, cluster_id from s qualify row_number() over (partition by doc_key, mention order by ment_idx) = 1")
def first_of_each_span(s, d):
    m = proxy.plain_mentions(s, d).select("doc_key", F.lower("word").alias("mention"), "ment_idx", F.left(F.lower("word"), F.lit(2)).alias("cluster_id"))
    return metrics.deduplicated(m, "ment_idx")


@query("training_pool_counts", base.T + "select lower(word) as key, count(*) as cnt from tokens where sent_idx < 4 or sent_idx >= 5 group by 1 having count(*) >= 3")
def training_pool_counts(s, d):
    """Words counted over the training turns and the held-out ones; the fifth turn is in neither."""
    t = proxy.tokens(s, d)
    pool = ordering.training_pool(t.where("sent_idx < 4"), t.where("sent_idx >= 5"))
    return lexical.counted(pool, "word", F.lower("word"), 3).select("key", "cnt")


@query("document_order", "select doc_id, row_number() over (order by lang nulls first, len([lang, source]), source nulls first, doc_id) as place from documents qualify place <= 100")
def document_order(s, d):
    """The first hundred documents by an array key."""
    docs = proxy.table(s, d, "documents").withColumn("key", F.array("lang", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    first = ordering.in_key_order(docs, "key").limit(100)
    return first.select("doc_id", F.row_number().over(Window.orderBy("key")).alias("place"))  # a hundred rows


LOSSES = ["noLoss", "precisionLoss", "recallLoss", "customLoss-0.1-3-1", "weightedCustomLoss-0.1-3-1-0.5"]
_CUSTOM = "case when not ana and a < m then 0.1 when ana and a = m then 3.0 when ana and not coreferent then 1.0 else 0.0 end"


@query("losses_by_name", base.PR + f""", known as (select p.doc_key, m, a, coreferent, bool_or(coreferent) over (partition by p.doc_key, m) as ana, s.size from pairs p join (select doc_key, ment_idx, count(*) over (partition by doc_key, key_id) as size from clusters) s on s.doc_key = p.doc_key and s.ment_idx = m)
select doc_key, 0.0::double as l0, sum(case when a < m and not coreferent then 1 else 0 end)::double as l1, sum(case when ana and (a = m or not coreferent) then 1 else 0 end)::double as l2, round(sum({_CUSTOM})::double, 6) as l3, round(sum({_CUSTOM} * (0.5 + 0.5 * size))::double, 6) as l4 from known group by 1""")
def losses_by_name(s, d):
    sizes = base.clusters.places(proxy.key_clusters(proxy.plain_mentions(s, d), "word")).select("doc_key", F.col("ment_idx").alias("m"), "size")
    w = Window.partitionBy("doc_key", "m")
    p = proxy.scored_pairs(s, d, diagonal=True).withColumn("anaphoric", F.bool_or("coreferent").over(w)).join(sizes, ["doc_key", "m"])
    new = F.col("a") == F.col("m")
    sums = [F.round(F.sum(numeric.named_loss(n, F.col("anaphoric"), new, F.col("coreferent"), F.col("size"))), 6).alias(f"l{k}") for k, n in enumerate(LOSSES)]
    return p.groupBy("doc_key").agg(*sums)


_X = "(case when doc_id % 3 = 0 then -1 else 1 end) * (n_chars + 0.37) * pow(10.0, doc_id % 31 - 27)"


@query("shown_numbers", f"""with v as (select doc_id, {_X} as x from documents where n_chars is not null), a as (select *, abs(x) as a from v)
select doc_id, case when x < 0 then '-' else '' end || case when a = 0 then '0' when a < 1e-20 then 'tiny' when a < 0.001 then printf('%.1f', a * pow(10.0, ceil(-log10(a)))) || 'e-' || cast(ceil(-log10(a)) as bigint)
  when a < 10000 then printf('%.3f', a) else printf('%.1f', a / pow(10.0, floor(log10(a)))) || 'e' || cast(floor(log10(a)) as bigint) end as shown from a""")
def shown_numbers(s, d):
    return proxy.table(s, d, "documents").where("n_chars is not null").select("doc_id", numeric.shown(F.expr(_X.replace("pow(10.0,", "pow(10.0D,").replace("0.37", "0.37D"))).alias("shown"))


@query("pair_list_places", base.PR + " select doc_key, m, a, row_number() over (partition by doc_key order by m, a) - 1 as place, cast((1 + sqrt(1 + 8 * count(*) over (partition by doc_key))) / 2 as bigint) as mentions from strict")
def pair_list_places(s, d):
    rows = features.document_rows(base.P.mention_pairs(proxy.plain_mentions(s, d), []), ["m", "a"], "place")
    return rows.select("doc_key", "m", "a", "place", features.mentions_of_pairs(F.col("rows")).alias("mentions"))


@query("topic_labels", base.FU + " select doc_key, ment_idx, case when ment_type = 'PRONOMINAL' then 'PRON' else cast(length(head) % 4 as varchar) end as masked, case when ment_type in ('NOMINAL', 'PROPER') then 'NOMPROP' else cast(length(head) % 4 as varchar) end as other from mentions")
def topic_labels(s, d):
    m = proxy.mentions(s, d).withColumn("cluster", F.pmod(F.char_length("head"), F.lit(4)))
    label = lambda flags: features.topic_label(F.col("ment_type"), F.col("cluster"), flags)
    return m.select("doc_key", "ment_idx", label("+latent+noprons").alias("masked"), label("+latent+nonomsprops").alias("other"))


@query("paragraph_modes", r"""with p as (select doc_id, 'line' as mode, string_split_regex(text, '\r?\n') as p from documents union all select doc_id, 'blank', string_split_regex(text, '\r?\n[ \t]*\r?\n') from documents union all select doc_id, 'whole', [text] from documents where text is not null)
select doc_id, mode, len(p) as paragraphs, cast(list_max(list_transform(p, lambda x: length(x))) as bigint) as longest from p where p is not null""")
def paragraph_modes(s, d):
    docs = proxy.table(s, d, "documents").where("text is not null").select("doc_id", "text")
    each = [text_formats.paragraphs(docs, mode).select("doc_id", F.lit(mode).alias("mode"), "paragraph") for mode in ("line", "blank", "whole")]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.groupBy("doc_id", "mode").agg(F.count("*").alias("paragraphs"), F.max(F.char_length("paragraph")).cast("bigint").alias("longest"))
