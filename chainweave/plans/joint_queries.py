"""Queries of the joint feature set, of training with it, and of the networks' scores, over the mention proxy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linguistic
from ..operators import joint, learning, lexical, pairs as P
from ..storage import Scratch
from . import proxy, queries as base
from .config import Options
from .registry import query

WORDS, CLASSES = 5, 20
GATES = "+bias+wordbackoff+lexprecedingby2word+lexfollowingby2word+lexgovernor+altsyn+sentmentidx+latent+def+mentdistfine+iwi+prongendnum+speaker+emcontained+lexhm+hmcontained+nomgendnum+bilexical+hearst"


def _tag(c: str):
    return F.when(F.rlike(c, F.lit(r"^\p{Lu}")), "CAP").otherwise("LOW")


def described(s, d):
    """The proxy's mentions with their words by position; a mention of one word has no last word but its head."""
    m = proxy.mentions(s, d)
    counts = lexical.positional_counts(m, WORDS).unionByName(lexical.affix_counts(proxy.tokens(s, d), CLASSES).where("template = 'class'"))
    tags = {p: _tag(c) for p, c in joint.POSITIONS} | {"governor": F.lit("GOV")}
    return joint.with_words(m.withColumn("last", F.lit(None).cast("string")), counts, tags).withColumn("topic0", F.pmod(F.char_length("head"), F.lit(3)))


def featurized(s, d, options: Options, fine: bool = False):
    """doc_key, m, a, feats: every pair and every mention with itself, by the options' feature set."""
    m, feature_set = described(s, d), options.fine_feature_sets if fine else options.feature_sets
    if "+hearst" in feature_set:
        m = m.join(m.groupBy("head").agg(F.count("*").cast("double").alias("count")), "head")
        p = P.mention_pairs(m, [*joint.COLUMNS, "topic0", "count"], diagonal=True, beside=P.head_pair_counts(m, 3, ordered=False))
        p = p.withColumn("pair_count", F.col("of_pair").cast("double"))
    else:
        p = P.mention_pairs(m, [*joint.COLUMNS, "topic0"], diagonal=True)
    return p.select("doc_key", "m", "a", joint.joint_features(feature_set, options.conjunction, topics=1).alias("feats"))


def _told(rows):
    return rows.select("doc_key", "m", "a", F.size("feats").alias("features"), F.md5(F.array_join("feats", " ").cast("binary")).alias("digest"))


# -- the same in SQL: for each feature its condition and its text -------------------------


def _texts(feature_set: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    old, m_open, a_open = "a.k < m.k", "m.ment_type not in ('PRONOMINAL', 'DEMONSTRATIVE')", "a.ment_type not in ('PRONOMINAL', 'DEMONSTRATIVE')"
    sn = "'-SN=' || (a.k = m.k)"
    put = lambda text, *when: out.append((" and ".join(when) or "true", text))
    gates, final = feature_set == GATES, "FINAL" in feature_set
    if gates:
        put("'SN=' || (a.k = m.k)")
    for prefix, x, is_open, end, when in (("SN", "m", m_open, " || " + sn, ()), ("Prev", "a", a_open, "", (old,))):
        put(f"'{prefix}MentLen=' || ({x}.end_idx - {x}.start_idx){end}", *when)
        for name, c, opened in (("Head", "head", True), ("First", "first", True), ("Last", "last", True), ("Preceding", "preceding", False), ("Following", "following", False)):
            own = (*when, is_open) if opened else when
            put(f"'{prefix}Ment{name}=' || {x}.{c}_or{end}", *own)
            if gates:
                put(f"'{prefix}Ment{name}Class=' || a.{c}_class{end}", *own)
        if gates:
            put(f"'{prefix}MentPrecedingBy2=' || {x}.preceding2_or{end}", *when)
            put(f"'{prefix}MentFollowingBy2=' || {x}.following2_or{end}", *when)
            put(f"'{'SNGovernor' if prefix == 'SN' else 'PrevMentGovernor'}=' || {x}.governor_or{end}", *when)
        if gates or final:
            put(f"'{prefix}SynPos=' || {x}.syn_uni", *when)
            put(f"'{prefix}SynPos=' || {x}.syn_bi", *when)
        if gates:
            put(f"'{prefix}SentMentIdx=' || {x}.sent_ment_idx{end}", *when)
            put(f"'{prefix}TopicC0=' || (length({x}.head) % 3){end}", *when)
            definite = f"case when lower({x}.head) = 'the' then 'DEF' when lower({x}.head) in ('a', 'an') then 'INDEF' else 'NONE' end"
            put(f"'{prefix}Def=' || {definite}{end}", *when, "a.ment_type <> 'PRONOMINAL'" if prefix == "SN" else a_open)
    put("'Dist=' || least(m.k - a.k, 10)", old)
    if gates:
        put("'Dist=' || (m.k - a.k)", old)
    put("'SentDist=' || least(m.sent_idx - a.sent_idx, 10)", old)
    if gates or final:
        put("'iWi=' || (m.sent_idx = a.sent_idx and (a.start_idx <= m.start_idx and m.end_idx <= a.end_idx or m.start_idx <= a.start_idx and a.end_idx <= m.end_idx))", old)
        put("'SynPoses=' || m.syn_uni || '-' || a.syn_uni", old)
        put("'SynPoses=' || m.syn_bi || '-' || a.syn_bi", old)
    if gates:
        put("'Topic=C0-' || (length(m.head) % 3)", old)
        put("'Topics=C0-' || (length(m.head) % 3) || '-' || (length(a.head) % 3)", old)
    pronoun, named = f"not ({m_open})", (m_open, old)
    if gates or final:
        put("'AntGend=' || a.gender", pronoun, old)
        put("'AntNumb=' || a.number", pronoun, old)
        put("'SameSpeaker=ARTICLE-' || (m.speaker = a.speaker)", pronoun, old, "a.ment_type = 'PRONOMINAL'")
    put("'ExactStrMatch=' || (lower(m.head) = lower(a.head))", *named)
    if gates or final:
        put("'ThisContained=' || contains(a.head, m.head)", *named)
        put("'AntContained=' || contains(m.head, a.head)", *named)
    put("'ExactHeadMatch=' || (lower(m.head) = lower(a.head))", *named)
    if gates:
        put("'LexHeadMatchCurr=' || (lower(m.head) = lower(a.head)) || '-' || m.head_or", *named)
        put("'LexHeadMatchPrev=' || (lower(m.head) = lower(a.head)) || '-' || a.head_or", *named)
    if gates or final:
        put("'ThisHeadContained=' || contains(a.head, m.head)", *named)
        put("'AntHeadContained=' || contains(m.head, a.head)", *named)
    if gates:
        put("'Gends=' || m.gender || ',' || a.gender", *named)
        put("'Numbs=' || m.number || ',' || a.number", *named)
        put("'Nerts=' || m.ner || ',' || a.ner", *named)
        put("'Heads=' || m.head_or || '-' || a.head_or", *named, a_open)
        there = (*named, "a.ment_type <> 'PRONOMINAL'", "lower(m.head) <> lower(a.head)")
        put("'HearstPresent=' || (h.n is not null)", *there)
        for name, x in (("Unnorm", "h.n"), ("Norm", "h.n / (m.heads * a.heads)")):
            for fine, width in (("", 1), ("Fine", 4)):
                put(f"'Hearst{name}{fine}Bin=' || cast(trunc(log10({x}) * {width} + 0.5) as integer)", *there, "h.n is not null")
    return out


_OPEN = "ment_type not in ('PRONOMINAL', 'DEMONSTRATIVE')"
_AROUND = {"preceding": "prev1", "following": "next1", "preceding2": "prev2", "following2": "next2", "governor": "governor"}
_TAG = lambda c: f"case when regexp_matches({c}, '^\\p{{Lu}}') then 'CAP' else 'LOW' end"
_COUNTED = {"head": f"select lower(head) as w from mentions where {_OPEN}"} | {p: f"select lower({c}) as w from mentions" for p, c in _AROUND.items()}
_CLS = lambda c: base._CLASS.replace("word", c)
RESOLVED = (
    base.RICH + ", " + ", ".join(f"c_{p} as (select w from ({q}) x group by 1 having count(*) >= {WORDS})" for p, q in _COUNTED.items())
    + f", c_class as (select {base._CLASS} as w from tokens group by 1 having count(*) >= {CLASSES}), "
    + "described as (select r.*, ment_idx as k, count(*) over (partition by head)::double as heads, "
    + ", ".join(f"coalesce((select w from c_{p} where w = lower(r.{c})), {_TAG('r.' + c) if p != 'governor' else repr('GOV')}) as {p}_or" for p, c in {"head": "head", **_AROUND}.items())
    + f", {_TAG('r.head')} as first_or, '' as last_or, "
    + ", ".join(f"coalesce((select w from c_class where w = {_CLS('r.' + c)}), '') as {p}_class" for p, c in (("head", "head"), ("first", "head"), ("preceding", "prev1"), ("following", "next1")))
    + ", '' as last_class from rich r)"
)


def _sql(feature_set: str, kind: str | None) -> str:
    items = []
    for when, text in _texts(feature_set):
        items.append(f"case when {when} then {text} end")
        if kind:
            items.append(f"case when {when} then {text} || '&Curr=' || m.{kind} end")
            items.append(f"case when {when} and a.k < m.k then {text} || '&Curr=' || m.{kind} || '&Prev=' || a.{kind} end")
    hearst = ", h as (select least(m.head, a.head) as x, greatest(m.head, a.head) as y, count(*)::double as n from described m join described a on m.doc_key = a.doc_key and a.k < m.k group by 1, 2 having count(*) > 2)" if "hearst" in feature_set else ""
    joined = "left join h on least(m.head, a.head) = h.x and greatest(m.head, a.head) = h.y" if hearst else ""
    return RESOLVED + hearst + f""", f as (select m.doc_key, m.k as m, a.k as a, list_filter([{', '.join(items)}], lambda x: x is not null) as feats from described m join described a on m.doc_key = a.doc_key and a.k <= m.k {joined})
select doc_key, m, a, cast(len(feats) as integer) as features, md5(array_to_string(feats, ' ')) as digest from f"""


@query("joint_surface", _sql("SURFACE", "ment_type"))
def joint_surface(s, d):
    return _told(featurized(s, d, Options.bound(["-feature_sets", "SURFACE", "-conjunction", "TYPE"])))


@query("joint_final", _sql("+FINAL", "conj"))
def joint_final(s, d):
    return _told(featurized(s, d, Options.bound(["conjunction=CANONICAL"]), fine=True))


@query("joint_gates", _sql(GATES, None))
def joint_gates(s, d):
    return _told(featurized(s, d, Options.bound([f"feature_sets={GATES}", "conjunction=NONE"])))


# -- the separate sets ------------------------------------------------------------------

_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_PRON = {
    "number": f"case when lower({{x}}head) in {_IN(linguistic.SINGULAR)} then 'SINGULAR' when lower({{x}}head) in {_IN(linguistic.PLURAL)} then 'PLURAL' else 'UNKNOWN' end",
    "gender": f"case when lower({{x}}head) in {_IN(linguistic.MALE)} then 'MALE' when lower({{x}}head) in {_IN(linguistic.FEMALE)} then 'FEMALE' when lower({{x}}head) in {_IN(linguistic.NEUTRAL)} then 'NEUTRAL' else 'UNKNOWN' end",
}


def _mention_sql(prefix: str, x: str, tail: str = "") -> list[str]:
    kind = {"SN": "SN", "Prev": "Ant", "Curr": "Curr"}[prefix]
    pron = lambda c: f"case when {x}ment_type = 'PRONOMINAL' then {_PRON[c].format(x=x)} else {x}{c} end"
    plain = [(f"{prefix}MentLen", f"({x}end_idx - {x}start_idx)")] + [(f"{prefix}Ment{n}", f"{x}{n.lower()}_or") for n in ("Head", "First", "Last", "Preceding", "Following")]
    syn = [f"'{prefix}SynPos=' || {x}syn_uni", f"'{prefix}SynPos=' || {x}syn_bi"]
    rest = [("SNGovernor" if prefix == "SN" else f"{prefix}MentGovernor", f"{x}governor_or"), (f"{prefix}SentMentIdx", f"{x}sent_ment_idx"), (f"{kind}NerStr", f"{x}ner"), (f"{kind}Animacy", f"{x}animacy"), (f"{kind}Gend", pron("gender")), (f"{kind}Number", pron("number")), (f"{kind}Person", f"{x}person")]
    shown = lambda items: [f"'{n}=' || {v} || '{tail}'" for n, v in items]
    return [*shown(plain), *syn, *shown(rest)]


_ALONE = [*_mention_sql("SN", "", "-SN=true"), "'CurrPronConjStr=' || conj || '-SN=true'", "'SNSpeaker=' || speaker || '-SN=true'", "'SNDocType=ARTICLE-SN=true'", "'SNMentHeadTrueCase=' || case when lower(head) = head_or then head else 'RARE' end || '-SN=true'"]
_CLOSED = "m.ment_type in ('PRONOMINAL', 'DEMONSTRATIVE')"
_when = lambda c, t: f"case when {c} then {t} end"
_BOTH = [
    *_mention_sql("Prev", "a."), *_mention_sql("Curr", "m."), "'Dist=' || least(m.k - a.k, 10)", "'SentDist=' || least(m.sent_idx - a.sent_idx, 10)",
    "'iWi=' || (m.sent_idx = a.sent_idx and (a.start_idx <= m.start_idx and m.end_idx <= a.end_idx or m.start_idx <= a.start_idx and a.end_idx <= m.end_idx))",
    "'SynPoses=' || m.syn_uni || '-' || a.syn_uni", "'SynPoses=' || m.syn_bi || '-' || a.syn_bi", "'SameSpeaker=' || (m.speaker = a.speaker)", "'DocType=ARTICLE'", "'ExactStrMatch=' || (lower(m.head) = lower(a.head))",
    "'Heads=' || case when h.x is not null then m.head || '-' || a.head else 'BACKOFF_INDICATOR' end",
    *(_when(f"{_CLOSED} and a.ment_type = 'PRONOMINAL'", f"'{n}=' || {u} || ',' || {v}") for n, u, v in (("Numbs", _PRON["number"].format(x="m."), _PRON["number"].format(x="a.")), ("Gends", _PRON["gender"].format(x="m."), _PRON["gender"].format(x="a.")), ("Persons", "m.person", "a.person"))),
    *(_when(f"not ({_CLOSED})", t) for t in ("'ThisContained=' || contains(a.head, m.head)", "'AntContained=' || contains(m.head, a.head)", "'ExactHeadMatch=' || (lower(m.head) = lower(a.head))", "'ThisHeadContained=' || contains(a.head, m.head)", "'AntHeadContained=' || contains(m.head, a.head)")),
    *(_when(f"not ({_CLOSED})", f"'{n}=' || m.{c} || ',' || a.{c}") for n, c in (("Gends", "gender"), ("Numbs", "number"), ("Nerts", "ner"), ("Persons", "person"))),
    "'CurrPronConjStr=' || m.conj", "'PrevPronConjStr=' || a.conj", "'TypeStrs=' || m.conj || '-' || a.conj",
]


@query("keep_first_features", RESOLVED + f", f as (select doc_key, k as ment_idx, [{', '.join(_ALONE)}] as feats from described) select doc_key, ment_idx, cast(len(feats) as integer) as features, array_to_string(feats, ' ') as feats from f")
def keep_first_features(s, d):
    rows = described(s, d).select("doc_key", "ment_idx", joint.separate_mention_features().alias("feats"))
    return rows.select("doc_key", "ment_idx", F.size("feats").alias("features"), F.array_join("feats", " ").alias("feats"))


@query("separate_pairs", RESOLVED + f""", h as (select m.head as x, a.head as y from described m join described a on m.doc_key = a.doc_key and a.k < m.k group by 1, 2 having count(*) >= 2),
f as (select m.doc_key, m.k as m, a.k as a, list_filter([{', '.join(_BOTH)}], lambda x: x is not null) as feats from described m join described a on m.doc_key = a.doc_key and a.k < m.k left join h on h.x = m.head and h.y = a.head)
select doc_key, m, a, cast(len(feats) as integer) as features, md5(array_to_string(feats, ' ')) as digest from f""")
def separate_pairs(s, d):
    m = described(s, d)
    rows = P.mention_pairs(m, joint.SEPARATE, beside=P.head_pair_counts(m, 2)).withColumn("common_heads", F.col("of_pair").isNotNull())
    return _told(rows.select("doc_key", "m", "a", joint.separate_pair_features("FINAL+MOARPW+bilexical").alias("feats")))


# -- training the log-linear model ---------------------------------------------------------



def coarse():
    """Distance, equal heads, and whether the mention starts a cluster, as ids."""
    return F.array(F.least(F.col("m") - F.col("a"), F.lit(10)).cast("int"), F.when(F.col("m_head") == F.col("a_head"), 20).otherwise(21), F.when(F.col("a") == F.col("m"), 30).otherwise(31))


COARSE_SQL = "[least(m - a, 10), case when m_head = a_head then 20 else 21 end, case when a = m then 30 else 31 end]"
_RIGHT = "coreferent or (a = m and not anaphoric)"


def _training_pairs(s, d):
    p = base._with_loss(s, d)
    return p.withColumn("coreferent", F.expr(_RIGHT)).select("doc_key", "m", "a", coarse().alias("feats"), "coreferent", "loss", "response_link", (F.col("m_sent_idx") - F.col("a_sent_idx")).alias("apart"))


def _step_sql(rows: str, out: str) -> str:
    """One epoch from weights of 0: scores are the losses; gradient, AdaGrad step, soft threshold."""
    return f"""{out}_e as (select *, exp(loss - max(loss) over (partition by doc_key, m)) as e from {rows}),
{out}_p as (select *, e / sum(e) over (partition by doc_key, m) as p, case when ok then e / sum(e) filter (where ok) over (partition by doc_key, m) else 0 end as g from {out}_e),
{out}_g as (select cast(f as integer) as feat_idx, sum(g - p) as g from (select unnest(feats) as f, g, p from {out}_p) x group by 1),
{out} as (select feat_idx, sign(g) * greatest(abs(g) / (1 + abs(g)) - 0.001 / (1 + abs(g)), 0) as weight from {out}_g)"""


ROWS_SQL = base.PR + f", {base._WITH_LOSS}, rows as (select doc_key, m, a, loss, {_RIGHT} as ok, {COARSE_SQL} as feats, response_link, m_sent_idx - a_sent_idx as apart from costs), " + _step_sql("rows", "weights")


@query("adagrad_epoch", ROWS_SQL + " select feat_idx, round(weight, 6) as weight from weights")
def adagrad_epoch(s, d):
    scratch = Scratch(s, "pairs")
    return learning.train_log_linear(scratch.store(_training_pairs(s, d), "pairs"), epochs=1).select("feat_idx", F.round("weight", 6).alias("weight"))


def _two_passes(s, d):
    scratch = Scratch(s, "pairs")
    every = scratch.store(_training_pairs(s, d), "pairs")
    more = F.array(F.least("apart", F.lit(5)).cast("int") + 40, F.when(F.col("response_link"), 50).otherwise(51))
    return learning.train_in_two_passes(every, lambda left: left.withColumn("feats", F.concat("feats", more)), "c2flogratio:0.5", epochs=1)


PASSES_SQL = ROWS_SQL + """, summed as (select doc_key, m, a, sum(w.weight) as score from (select doc_key, m, a, unnest(feats) as f from rows) x join weights w on w.feat_idx = x.f group by all),
marked as (select r.*, round(score, 9) + 0.5 < max(round(score, 9)) over (partition by r.doc_key, r.m) as pruned from rows r join summed s on s.doc_key = r.doc_key and s.m = r.m and s.a = r.a)"""


@query("two_pass_pruning", PASSES_SQL + """, each as (select doc_key, m, bool_or(ok) as ana, bool_or(ok and not pruned) as kg, count(*) filter (where not pruned) as kept, count(*) filter (where pruned) as dropped, count(*) filter (where ok and pruned) as dg from marked group by 1, 2)
select count(*) as mentions, cast(sum(kept) as bigint) as kept, cast(sum(dropped) as bigint) as dropped, cast(sum(dg) as bigint) as dropped_gold, count(*) filter (where ana) as anaphoric, count(*) filter (where ana and not kg) as lost, count(*) filter (where kept = 0) as emptied, count(*) filter (where kept = 1) as decided from each""")
def two_pass_pruning(s, d):
    return P.pruning_stats(_two_passes(s, d).pairs)


@query("two_pass_weights", PASSES_SQL + ", fine as (select doc_key, m, a, loss, ok, list_concat(feats, [least(apart, 5) + 40, case when response_link then 50 else 51 end]) as feats from marked where not pruned), " + _step_sql("fine", "again") + " select 'coarse' as pass, feat_idx, round(weight, 6) as weight from weights union all select 'fine', feat_idx, round(weight, 6) from again")
def two_pass_weights(s, d):
    found = _two_passes(s, d)
    side = lambda name, w: w.select(F.lit(name).alias("pass"), "feat_idx", F.round("weight", 6).alias("weight"))
    return side("coarse", found.coarse).unionByName(side("fine", found.fine))


# -- networks ----------------------------------------------------------------------------

NETWORK = learning.SparseMlp(5001, 16)


def _network_sql() -> str:
    """The network's rows that are not 0, and its second layer, as tables of values."""
    at = [(int(r), int(c), float(NETWORK.w[r, c])) for r, c in zip(*NETWORK.w.nonzero())]
    first = ", ".join(f"({r}, {c}, cast({w!r} as double))" for r, c, w in at)
    second = ", ".join(f"({c}, cast({float(u)!r} as double))" for c, u in enumerate(NETWORK.u))
    return base.INDEXED + f""", w(f, c, w) as (values {first}), u(c, u) as (values {second}),
x as (select doc_key, ment_idx, unnest(ids) % 5000 as f from vec), sums as (select x.doc_key, x.ment_idx, w.c, sum(w.w) as s from x join w on w.f = x.f group by all),
every as (select v.doc_key, v.ment_idx, u.c, u.u from vec v cross join u)
select e.doc_key, e.ment_idx, round(sum(e.u * tanh(coalesce(s.s, 0) + 0.5)) + 0.5, 6) as score from every e left join sums s on s.doc_key = e.doc_key and s.ment_idx = e.ment_idx and s.c = e.c group by 1, 2"""


@query("mlp_score", _network_sql())
def mlp_score(s, d):
    vectors = base.indexed_mentions(s, d).withColumn("feats", F.transform("feats", lambda x: x % 5000))
    return learning.scored_vectors(vectors, NETWORK).select("doc_key", "ment_idx", F.round("score", 6).alias("score"))
