"""The joint and the separate feature sets, compiled from an option string into native expressions (T-base, T-larger, T-keep, X28-X30, F16, G15, G16).

A feature set is a string such as ``SURFACE``, ``+FINAL+nomentlen`` or
``+bias+bilexical``: what is in it turns templates on or off. A pair of a mention
with itself stands for a new cluster. ``joint_features`` gives one array of
strings: the templates that hold, each with its conjunctions.

What belongs to one mention (words or their fallbacks, classes, conjunction
strings) is made once per mention by ``with_words``: its words by position are
looked up in one join, and come back to the mention in one grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.linguistic import conjunction, definiteness, person_compat, pronoun_gender, pronoun_number
from ..functions.strings import word_class

#: Position, its template among the counted words, the mention's column.
POSITIONS = [
    ("head", "head"), ("first", "first"), ("last", "last"), ("preceding", "prev1"), ("following", "next1"), ("penultimate", "penultimate"),
    ("second", "second"), ("preceding2", "prev2"), ("following2", "next2"), ("governor", "governor"),
]
CONJUNCTIONS = ("NONE", "TYPE", "TYPE_OR_RAW_PRON", "CANONICAL", "CANONICAL_NOPRONPRON", "CANONICAL_ONLY_PAIR_CONJ", "CANONICAL_OR_COMMON")
_KIND = {"TYPE": "type", "TYPE_OR_RAW_PRON": "raw", "CANONICAL_OR_COMMON": "common"}
#: Occurrences from which a head stands for itself in ``CANONICAL_OR_COMMON``.
COMMON_HEAD = 500


def with_words(mentions: DataFrame, counts: DataFrame, tags: dict[str, Column], fallback: bool = True, common_head: int = COMMON_HEAD) -> DataFrame:
    """The mentions with ``<position>_or`` (the lower-cased word if it is counted, else its tag), ``<position>_class``
    (the word's class if it is counted, else empty) and ``conj_<kind>``.

    ``counts``: template, key, cnt of the words by position and of the classes of all words. ``tags``: the tag of each
    position's word; without ``fallback`` what is not counted is empty. A position that a mention lacks is empty.
    """
    keys = ["doc_key", "ment_idx"]
    slots = F.array(*(F.struct(F.lit(p).alias("p"), F.lower(c).alias("word"), word_class(F.col(c)).alias("cls"), tags[p].alias("tag")) for p, c in POSITIONS))
    each = mentions.select(*keys, F.explode(slots).alias("s")).select(*keys, "s.*").where("word is not null")
    words = counts.where("template <> 'class'").select(F.col("template").alias("p"), F.col("key").alias("word"), F.col("cnt").alias("known"))
    classes = counts.where("template = 'class'").select(F.col("key").alias("cls"), F.lit(True).alias("known_class"))
    found = each.join(words, ["p", "word"], "left").join(classes, "cls", "left")
    value = F.when(F.col("known").isNotNull(), F.col("word")).otherwise(F.col("tag") if fallback else F.lit(""))
    own = lambda p, c: F.coalesce(F.max(F.when(F.col("p") == p, c)), F.lit(""))
    back = found.groupBy(keys).agg(
        *(own(p, value).alias(f"{p}_or") for p, _ in POSITIONS), *(own(p, F.when(F.col("known_class"), F.col("cls")).otherwise("")).alias(f"{p}_class") for p, _ in POSITIONS[:5]),
        F.coalesce(F.max(F.when(F.col("p") == "head", F.col("known"))), F.lit(0)).alias("head_count"),
    )
    common = (F.col("head_count") >= common_head) & ~F.col("ment_type").isin("PRONOMINAL", "DEMONSTRATIVE")
    kinds = {f"conj_{k}": conjunction(k, F.col("ment_type"), F.col("head"), common) for k in ("type", "raw", "canonical", "common")}
    return mentions.join(back, keys).withColumns(kinds).drop("head_count")


#: The columns that pairs need of both mentions.
COLUMNS = [
    *(f"{p}_or" for p, _ in POSITIONS), *(f"{p}_class" for p, _ in POSITIONS[:5]), "conj_type", "conj_raw", "conj_canonical", "conj_common", "ment_type", "head", "first", "text", "start_idx", "end_idx",
    "sent_idx", "syn_uni", "syn_bi", "sent_ment_idx", "gender", "number", "ner", "speaker",
]


def joint_features(feature_set: str, conjunctions: str = "CANONICAL", topics: int = 0, conversation: Column | None = None) -> Column:
    """The features of a pair of ``mention_pairs`` over ``COLUMNS``, with the diagonal (a = m: new).

    ``topics``: columns m_topic<k> and a_topic<k> of ``+latent``. ``+hearst`` reads pair_count, m_count and a_count; ``+synpos``
    m_role and a_role. ``conversation``: whether the document is one, for ``SameSpeaker``.
    """
    if conjunctions not in CONJUNCTIONS:
        raise ValueError(f"no conjunctions {conjunctions!r}")
    m, a = (lambda c, p=p: F.col(f"{p}_{c}") for p in "ma")
    on = lambda *words: any(w in feature_set for w in words)
    new = F.col("a") == F.col("m")
    said = F.concat(F.lit("-SN="), new.cast("string"))
    closed = lambda side: side("ment_type").isin("PRONOMINAL", "DEMONSTRATIVE")
    always = F.lit(True)
    length = lambda side: side("end_idx") - side("start_idx")
    out: list[Column] = []

    def add(name: str, value: Column | None = None, when: Column = always, tail: Column | None = None) -> None:
        text = F.concat(F.lit(f"{name}="), *([] if value is None else [F.coalesce(value.cast("string"), F.lit(""))]), *([] if tail is None else [tail]))
        whole = [text, *_conjoined(name, text, conjunctions, new, m, a, closed)]
        out.extend(F.coalesce(F.when(when, x), F.lit("")) for x in whole)

    def words(prefix: str, side: Callable, own: Column, tail: Column | None, when: Column) -> None:
        """Words in and around one mention; the classes of the new-cluster templates are the antecedent's."""
        for position, name, off, open_only in (("head", "Head", "+nolexanaph", True), ("first", "First", "+nolexfirstword", True), ("last", "Last", "+nolexlastword", True), ("preceding", "Preceding", "+nolexprecedingword", False), ("following", "Following", "+nolexfollowingword", False)):
            if not on(off):
                holds = when & ~closed(side) if open_only else when
                add(f"{prefix}Ment{name}", own(f"{position}_or"), holds, tail)
                if on("+wordbackoff"):
                    add(f"{prefix}Ment{name}Class", a(f"{position}_class"), holds, tail)
        for position, name, flag, open_only in (("penultimate", "MentPen", "+lexpenultimateword", True), ("second", "MentSecond", "+lexsecondword", True), ("preceding2", "MentPrecedingBy2", "+lexprecedingby2word", False), ("following2", "MentFollowingBy2", "+lexfollowingby2word", False), ("governor", "Governor" if prefix == "SN" else "MentGovernor", "+lexgovernor", False)):
            if on(flag):
                add(f"{prefix}{name}", own(f"{position}_or"), when & ~closed(side) if open_only else when, tail)

    # the mention itself
    if on("+bias"):
        add("SN", new)
    if not on("+nomentlen"):
        add("SNMentLen", length(m), tail=said)
    words("SN", m, m, said, always)
    if on("FINAL", "+altsyn"):
        add("SNSynPos", m("syn_uni"))
        add("SNSynPos", m("syn_bi"))
    if on("+sentmentidx"):
        add("SNSentMentIdx", m("sent_ment_idx"), tail=said)
    for k in range(topics if on("+latent") else 0):
        add(f"SNTopicC{k}", m(f"topic{k}"), tail=said)
    if on("+def"):
        add("SNDef", definiteness(m("first")), a("ment_type") != "PRONOMINAL", said)
    if on("+synpos"):
        add("SNSynPos", m("role"), tail=said)
    # the antecedent
    old = ~new
    if not on("+nomentlen"):
        add("PrevMentLen", length(a), old)
    words("Prev", a, a, None, old)
    if on("FINAL", "+altsyn"):
        add("PrevSynPos", a("syn_uni"), old)
        add("PrevSynPos", a("syn_bi"), old)
    if on("+sentmentidx"):
        add("PrevSentMentIdx", a("sent_ment_idx"), old)
    for k in range(topics if on("+latent") else 0):
        add(f"PrevTopicC{k}", a(f"topic{k}"), old)
    if on("+def"):
        add("PrevDef", definiteness(a("first")), old & ~closed(a))
    if on("+synpos"):
        add("PrevSynPos", a("role"), old)
    # both
    both = lambda x, y, mark="-": F.concat(x, F.lit(mark), y)
    if not on("+nomentdist"):
        add("Dist", F.least(F.col("m") - F.col("a"), F.lit(10)), old)
    if on("+mentdistfine"):
        add("Dist", F.col("m") - F.col("a"), old)
    if not on("+nosentdist"):
        add("SentDist", F.least(m("sent_idx") - a("sent_idx"), F.lit(10)), old)
    if on("FINAL", "+iwi"):
        within = lambda x, y: (y("start_idx") <= x("start_idx")) & (x("end_idx") <= y("end_idx"))
        add("iWi", (m("sent_idx") == a("sent_idx")) & (within(m, a) | within(a, m)), old)
    if on("FINAL", "+altsyn"):
        add("SynPoses", both(m("syn_uni"), a("syn_uni")), old)
        add("SynPoses", both(m("syn_bi"), a("syn_bi")), old)
    for k in range(topics if on("+latent") else 0):
        add("Topic", F.concat(F.lit(f"C{k}-"), m(f"topic{k}")), old)
        add("Topics", F.concat(F.lit(f"C{k}-"), both(m(f"topic{k}"), a(f"topic{k}"))), old)
    # pronouns
    if on("FINAL", "+prongendnum"):
        add("AntGend", a("gender"), closed(m) & old)
        add("AntNumb", a("number"), closed(m) & old)
    if on("FINAL", "+speaker"):
        place = F.when(F.lit(False) if conversation is None else conversation, "CONVERSATION").otherwise("ARTICLE")
        add("SameSpeaker", both(place, (m("speaker") == a("speaker")).cast("string")), closed(m) & old & (a("ment_type") == "PRONOMINAL"))
    # names and nominals
    named = ~closed(m) & old
    match = F.lower(m("head")) == F.lower(a("head"))
    if not on("+noexactmatch"):
        add("ExactStrMatch", F.lower(m("text")) == F.lower(a("text")), named)
    if on("FINAL", "+emcontained"):
        add("ThisContained", F.contains(a("text"), m("text")), named)
        add("AntContained", F.contains(m("text"), a("text")), named)
    if not on("+noheadmatch"):
        add("ExactHeadMatch", match, named)
    if on("+lexhm"):
        add("LexHeadMatchCurr", both(match.cast("string"), m("head_or")), named)
        add("LexHeadMatchPrev", both(match.cast("string"), a("head_or")), named)
    if on("FINAL", "+hmcontained"):
        add("ThisHeadContained", F.contains(a("text"), m("head")), named)
        add("AntHeadContained", F.contains(m("text"), a("head")), named)
    if on("+nomgendnum"):
        for name, c in (("Gends", "gender"), ("Numbs", "number"), ("Nerts", "ner")):
            add(name, both(m(c), a(c), ","), named)
    if on("+bilexical"):
        add("Heads", both(m("head_or"), a("head_or")), named & ~closed(a))
    if on("+hearst"):
        there = named & (a("ment_type") != "PRONOMINAL") & ~match
        present = F.coalesce(F.col("pair_count"), F.lit(0.0)) > 0.5
        add("HearstPresent", present, there)
        counts = [F.coalesce(f"{side}_count", F.lit(0.0)) for side in "ma"]
        lacking = (counts[0] == 0) | (counts[1] == 0)  # a head that is not counted counts as often as the pair at least
        heads = F.when(lacking, F.greatest(counts[0], "pair_count") * F.greatest(counts[1], "pair_count")).otherwise(counts[0] * counts[1])
        for name, x in (("Unnorm", F.col("pair_count")), ("Norm", F.col("pair_count") / heads)):
            for fine, width in (("", 1), ("Fine", 4)):
                add(f"Hearst{name}{fine}Bin", (F.log10(x) * width + 0.5).cast("int"), there & present)
    return F.array_remove(F.array(*out), "")  # no feature is empty; a lambda over the array would have all of it interpreted


def _conjoined(name: str, text: Column, kind: str, new: Column, m: Callable, a: Callable, closed: Callable) -> list[Column]:
    """The feature with the mention's string, and with both mentions' if they are two."""
    if kind == "NONE" or kind == "CANONICAL_ONLY_PAIR_CONJ" and name.startswith(("SN", "PrevMent")):
        return []
    column = f"conj_{_KIND.get(kind, 'canonical')}"
    of = lambda side: side(column)
    if kind == "CANONICAL_NOPRONPRON":  # of two pronouns only the types
        of = lambda side: F.when(~new & closed(m) & closed(a), side("conj_type")).otherwise(side(column))
    current = F.concat(text, F.lit("&Curr="), of(m))
    return [current, F.when(~new, F.concat(current, F.lit("&Prev="), of(a)))]


#: What the separate sets need of mentions beyond ``COLUMNS``.
SEPARATE = [*COLUMNS, "animacy"]


def _described(prefix: str, side: Callable, feature_set: str, more: str, tail: str) -> list[Column]:
    """What both separate sets tell of one mention; ``prefix`` SN, Prev or Curr."""
    on = lambda *words: any(w in feature_set for w in words)
    f = lambda name, value: F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(tail))
    out = []
    if not on("+nomentlen"):
        out.append(f(f"{prefix}MentLen", side("end_idx") - side("start_idx")))
    for name, c, off in (("Head", "head", "+nolexanaph"), ("First", "first", "+nolexfirstword"), ("Last", "last", "+nolexlastword"), ("Preceding", "preceding", "+nolexprecedingword"), ("Following", "following", "+nolexfollowingword")):
        if not on(off):
            out.append(f(f"{prefix}Ment{name}", side(f"{c}_or")))
    if on("FINAL"):
        out += [F.concat(F.lit(f"{prefix}SynPos="), side(c)) for c in ("syn_uni", "syn_bi")]
    if on(more):
        pronoun = side("ment_type") == "PRONOMINAL"
        kind = {"SN": "SN", "Prev": "Ant", "Curr": "Curr"}[prefix]
        out += [
            f("SNGovernor" if prefix == "SN" else f"{prefix}MentGovernor", side("governor_or")), f(f"{prefix}SentMentIdx", side("sent_ment_idx")), f(f"{kind}NerStr", side("ner")), f(f"{kind}Animacy", side("animacy")),
            f(f"{kind}Gend", F.when(pronoun, pronoun_gender(side("head"))).otherwise(side("gender"))), f(f"{kind}Number", F.when(pronoun, pronoun_number(side("head"))).otherwise(side("number"))),
            f(f"{kind}Person", person_compat(side("head"))),
        ]
    return out


def separate_mention_features(feature_set: str = "FINAL+MOARANAPH", first_too: bool = True, conversation: Column | None = None) -> Column:
    """The features of a mention alone, of the larger separate set (T-larger); with ``first_too`` the first mention of a
    document has them as well, though it never has an antecedent (T-keep). No conjunctions; unknown words are their tags."""
    out = _described("SN", F.col, feature_set, "MOARANAPH", "-SN=true")
    place = F.when(F.lit(False) if conversation is None else conversation, "CONVERSATION").otherwise("ARTICLE")
    cased = F.when(F.lower("head") == F.col("head_or"), F.col("head")).otherwise("RARE")
    for name, value in (("CurrPronConjStr", F.col("conj_canonical")), ("SNSpeaker", F.col("speaker")), ("SNDocType", place), ("SNMentHeadTrueCase", cased)):
        out.append(F.concat(F.lit(f"{name}="), value, F.lit("-SN=true")))
    every = F.array(*out)
    return every if first_too else F.when(F.col("ment_idx") == 0, F.slice(every, 1, 0)).otherwise(every)


def separate_pair_features(feature_set: str = "FINAL+MOARPW", conversation: Column | None = None) -> Column:
    """The features of a pair of two mentions, of the larger separate set; over pairs of ``SEPARATE``. ``+bilexical`` reads
    ``common_heads``, whether the pair of heads as written is counted often enough."""
    m, a = (lambda c, p=p: F.col(f"{p}_{c}") for p in "ma")
    on = lambda *words: any(w in feature_set for w in words)
    closed = m("ment_type").isin("PRONOMINAL", "DEMONSTRATIVE")
    f = lambda name, value, when=None: F.concat(F.lit(f"{name}="), value.cast("string")) if when is None else F.when(when, F.concat(F.lit(f"{name}="), value.cast("string")))
    both = lambda x, mark=",": F.concat(x(m), F.lit(mark), x(a))
    out = _described("Prev", a, feature_set, "MOARPW", "")
    if on("FINAL") and not on("MOARPW"):
        out += [f("AntGend", a("gender"), closed), f("AntNumber", a("number"), closed)]
    out += _described("Curr", m, feature_set, "MOARPW", "")
    if not on("+nomentdist"):
        out.append(f("Dist", F.least(F.col("m") - F.col("a"), F.lit(10))))
    if not on("+nosentdist"):
        out.append(f("SentDist", F.least(m("sent_idx") - a("sent_idx"), F.lit(10))))
    if on("FINAL", "+iwi"):
        within = lambda x, y: (y("start_idx") <= x("start_idx")) & (x("end_idx") <= y("end_idx"))
        out.append(f("iWi", (m("sent_idx") == a("sent_idx")) & (within(m, a) | within(a, m))))
    if on("FINAL", "+altsyn"):
        out += [f("SynPoses", both(lambda s, c=c: s(c), "-")) for c in ("syn_uni", "syn_bi")]
    if on("FINAL"):
        out += [f("SameSpeaker", m("speaker") == a("speaker")), f("DocType", F.when(F.lit(False) if conversation is None else conversation, "CONVERSATION").otherwise("ARTICLE"))]
    if not on("+noexactmatch"):
        out.append(f("ExactStrMatch", F.lower(m("text")) == F.lower(a("text"))))
    if on("+bilexical"):
        out.append(f("Heads", F.when(F.col("common_heads"), both(lambda s: s("head"), "-")).otherwise("BACKOFF_INDICATOR")))
    person = both(lambda s: person_compat(s("head")))
    if on("MOARPW"):
        pronouns = closed & (a("ment_type") == "PRONOMINAL")
        out += [f("Numbs", both(lambda s: pronoun_number(s("head"))), pronouns), f("Gends", both(lambda s: pronoun_gender(s("head"))), pronouns), f("Persons", person, pronouns)]
    if on("FINAL", "+emcontained"):
        out += [f("ThisContained", F.contains(a("text"), m("text")), ~closed), f("AntContained", F.contains(m("text"), a("text")), ~closed)]
    if not on("+noheadmatch"):
        out.append(f("ExactHeadMatch", F.lower(m("head")) == F.lower(a("head")), ~closed))
    if on("FINAL", "+hmcontained"):
        out += [f("ThisHeadContained", F.contains(a("text"), m("head")), ~closed), f("AntHeadContained", F.contains(m("text"), a("head")), ~closed)]
    if on("MOARPW"):
        out += [f("Gends", both(lambda s: s("gender")), ~closed), f("Numbs", both(lambda s: s("number")), ~closed), f("Nerts", both(lambda s: s("ner")), ~closed), f("Persons", person, ~closed)]
    out += [f("CurrPronConjStr", m("conj_canonical")), f("PrevPronConjStr", a("conj_canonical"))]
    if on("MOARPW"):
        out.append(f("TypeStrs", both(lambda s: s("conj_canonical"), "-")))
    return F.filter(F.array(*out), lambda x: x.isNotNull())
