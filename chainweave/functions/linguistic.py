"""Pronouns, number, gender, animacy, definiteness and governors, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Pronouns by person, number and gender.
FIRST_PERSON = ("i", "me", "myself", "mine", "my", "we", "us", "ourself", "ourselves", "ours", "our")
SECOND_PERSON = ("you", "yourself", "yours", "your", "yourselves")
THIRD_PERSON = ("he", "him", "himself", "his", "she", "her", "herself", "hers", "it", "itself", "its", "one", "oneself", "one's", "they", "them", "themself", "themselves", "theirs", "their", "'em")
OTHER = ("who", "whom", "whose", "where", "when", "which")
DEMONSTRATIVE = ("this", "that", "these", "those")
SINGULAR = ("i", "me", "myself", "mine", "my", "yourself", "he", "him", "himself", "his", "she", "her", "herself", "hers", "it", "itself", "its", "one", "oneself", "one's")
PLURAL = ("we", "us", "ourself", "ourselves", "ours", "our", "yourself", "yourselves", "they", "them", "themself", "themselves", "theirs", "their")
MALE = ("he", "him", "himself", "his")
FEMALE = ("her", "hers", "herself", "she")
NEUTRAL = ("it", "its", "itself", "where", "here", "there", "which")
PRONOUNS = FIRST_PERSON + SECOND_PERSON + THIRD_PERSON + OTHER
# The form that a pronoun is counted under.
CANONICAL = {
    "i": "i", "me": "i", "my": "i", "myself": "i", "mine": "i",
    "you": "you", "your": "you", "yourself": "you", "yourselves": "you", "yours": "you",
    "he": "he", "him": "he", "his": "he", "himself": "he",
    "she": "she", "her": "she", "herself": "she", "hers": "she",
    "we": "we", "us": "we", "our": "we", "ourself": "we", "ourselves": "we", "ours": "we",
    "they": "they", "them": "they", "their": "they", "themself": "they", "themselves": "they", "theirs": "they", "'em": "they",
    "it": "it", "itself": "it", "its": "it",
    "one": "one", "oneself": "one", "one's": "one",
    "this": "this", "that": "that", "these": "these", "those": "those",
    "which": "which", "who": "who", "whom": "who",
    "thy": "thy", "y'all": "you", "you're": "you", "you'll": "you", "'s": "'s",
}
# Entity labels that tell animacy (beside those that begin with PER or LOC).
ANIMATE_NER = ("PERSON",)
INANIMATE_NER = ("LOCATION", "MONEY", "NUMBER", "PERCENT", "DATE", "TIME", "FAC", "GPE", "WEA", "ORG")
# Entity labels that make no mention.
NON_MENTION_NER = ("O", "QUANTITY", "CARDINAL", "PERCENT")


def is_pronoun(w: Column) -> Column:
    return F.lower(w).isin(*PRONOUNS)


def is_demonstrative(w: Column) -> Column:
    return F.lower(w).isin(*DEMONSTRATIVE)


def canonical_pronoun(w: Column) -> Column:
    """The form that a pronoun is counted under, empty for no pronoun."""
    forms = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    return F.coalesce(F.try_element_at(forms, F.lower(w)), F.lit(""))


def pronoun_number(w: Column) -> Column:
    return F.when(F.lower(w).isin(*SINGULAR), "SINGULAR").when(F.lower(w).isin(*PLURAL), "PLURAL").otherwise("UNKNOWN")


def pronoun_gender(w: Column) -> Column:
    return F.when(F.lower(w).isin(*MALE), "MALE").when(F.lower(w).isin(*FEMALE), "FEMALE").when(F.lower(w).isin(*NEUTRAL), "NEUTRAL").otherwise("UNKNOWN")


def person(w: Column) -> Column:
    return F.when(F.lower(w).isin(*FIRST_PERSON), "1st").when(F.lower(w).isin(*SECOND_PERSON), "2nd").when(F.lower(w).isin(*THIRD_PERSON), "3rd").otherwise("OTHER")


def person_compat(w: Column) -> Column:
    """As the features must have it: never ``3rd``."""
    return F.when(person(w) == "3rd", "OTHER").otherwise(person(w))


def number_of(counts: Column) -> Column:
    """From counts (male, female, neutral, plural): SINGULAR unless plural prevails."""
    c = lambda k: F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0))
    return F.when(c(1) + c(2) + c(3) >= c(4), "SINGULAR").otherwise("PLURAL")


def gender_of(counts: Column) -> Column:
    """The gender counted at least three times and twice as often as the others together."""
    c = lambda k: F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0))
    out = F.lit("UNKNOWN")
    for k, name in ((3, "NEUTRAL"), (2, "FEMALE"), (1, "MALE")):
        others = sum((c(j) for j in (1, 2, 3) if j != k), F.lit(0))
        out = F.when((c(k) >= 3) & (c(k) >= 2 * others), name).otherwise(out)
    return out


def animacy(ner: Column, word: Column, animate: Column, inanimate: Column) -> Column:
    """By entity label, else by the word lists' verdicts."""
    listed = F.when(animate, "ANIMATE").when(inanimate, "INANIMATE").otherwise("UNKNOWN")
    return F.when(is_pronoun(word), listed).when(ner.isin(*ANIMATE_NER) | F.startswith(ner, F.lit("PER")), "ANIMATE").when(ner.isin(*INANIMATE_NER) | F.startswith(ner, F.lit("LOC")), "INANIMATE").otherwise(listed)


def definiteness(first: Column) -> Column:
    """DEF, INDEF or NONE, by the first word."""
    return F.when(F.lower(first) == "the", "DEF").when(F.lower(first).isin("a", "an"), "INDEF").otherwise("NONE")


def governor(head: Column, parent: Column, parent_word: Column) -> Column:
    """``L-`` or ``R-`` and the governing word; the head is on that side of it."""
    return F.when(parent.isNull() | (parent < 0), "[ROOT]").when(head < parent, F.concat(F.lit("L-"), parent_word)).otherwise(F.concat(F.lit("R-"), parent_word))


def syntactic_position(head: Column, parent: Column, parent_pos: Column, grand: Column | None = None, grand_pos: Column | None = None) -> Column:
    """``POS`` and side of the governor, of one or two steps up."""
    one = F.when(parent.isNull() | (parent < 0), "[ROOT]").otherwise(F.concat(parent_pos, F.when(head > parent, "(L)").otherwise("(R)")))
    if grand is None:
        return one
    two = F.when(grand.isNull() | (grand < 0), "[ROOT]").otherwise(F.concat(grand_pos, F.when(parent > grand, "(L)").otherwise("(R)")))
    return F.concat_ws("-", one, two)


def grammatical_role(position: Column) -> Column:
    return F.when(F.rlike(position, F.lit(r"^V[^(]*\(R\)")), "SUBJECT").when(F.rlike(position, F.lit(r"^V[^(]*\(L\)")), "DIROBJ").when(F.rlike(position, F.lit(r"^(IN|TO)\(L\)")), "INDIROBJ").otherwise("OTHER")


def mention_type(length: Column, word: Column, ner: Column, pos: Column | None = None) -> Column:
    """DEMONSTRATIVE, PRONOMINAL, PROPER or NOMINAL."""
    tagged = F.lit(False) if pos is None else pos.isin("PRP", "PRP$")
    proper = F.lit(False) if pos is None else pos.isin("NNP", "NNPS")
    return F.when((length == 1) & is_demonstrative(word), "DEMONSTRATIVE").when((length == 1) & (is_pronoun(word) | tagged), "PRONOMINAL").when((ner != "O") | proper, "PROPER").otherwise("NOMINAL")


def conjunction(kind: str, ment_type: Column, head: Column, common: Column | None = None) -> Column:
    """The string that features are conjoined with (X28): ``type``, ``raw``, ``canonical`` or ``common``."""
    pronominal = ment_type == "PRONOMINAL"
    if kind == "type":
        return ment_type
    if kind == "raw":
        return F.when(pronominal, F.lower(head)).otherwise(ment_type)
    own = F.when(canonical_pronoun(head) == "", F.lower(head)).otherwise(canonical_pronoun(head))
    canonical = F.when(pronominal, own)
    if kind == "canonical":
        return canonical.otherwise(ment_type)
    return canonical.when(common, F.lower(head)).otherwise(ment_type)
