"""Fixed tables: pronouns, animacy, heads, first names."""

import pytest
from pyspark.sql import functions as F

from chainweave.functions import linguistic
from chainweave.operators import templates, trees


@pytest.mark.parametrize(
    "word, canonical, number, gender, person",
    [
        ("Me", "i", "SINGULAR", "UNKNOWN", "1st"),
        ("ourself", "we", "PLURAL", "UNKNOWN", "1st"),
        ("yourself", "you", "SINGULAR", "UNKNOWN", "2nd"),
        ("yourselves", "you", "PLURAL", "UNKNOWN", "2nd"),
        ("her", "she", "SINGULAR", "FEMALE", "3rd"),
        ("themself", "they", "PLURAL", "UNKNOWN", "3rd"),
        ("'em", "they", "UNKNOWN", "UNKNOWN", "3rd"),
        ("one's", "one", "SINGULAR", "UNKNOWN", "3rd"),
        ("whom", "who", "UNKNOWN", "UNKNOWN", "OTHER"),
        ("where", "", "UNKNOWN", "NEUTRAL", "OTHER"),
        ("whose", "", "UNKNOWN", "UNKNOWN", "OTHER"),
        ("y'all", "you", "UNKNOWN", "UNKNOWN", "OTHER"),
        ("'s", "'s", "UNKNOWN", "UNKNOWN", "OTHER"),
        ("this", "this", "UNKNOWN", "UNKNOWN", "OTHER"),
        ("what", "", "UNKNOWN", "UNKNOWN", "OTHER"),
    ],
)
def test_pronouns(spark, word, canonical, number, gender, person):
    w = F.lit(word)
    row = spark.range(1).select(linguistic.canonical_pronoun(w), linguistic.pronoun_number(w), linguistic.pronoun_gender(w), linguistic.person(w)).first()
    assert tuple(row) == (canonical, number, gender, person)


def test_what_is_a_pronoun(spark):
    words = {"where": True, "When": True, "ourself": True, "themself": True, "this": False, "what": False, "thy": False}
    rows = spark.createDataFrame(list(words), "string").select("value", linguistic.is_pronoun(F.col("value")).alias("is")).collect()
    assert {r["value"]: r["is"] for r in rows} == words


def test_animacy(spark):
    labels = {"PERSON": "ANIMATE", "PER": "ANIMATE", "MONEY": "INANIMATE", "DATE": "INANIMATE", "WEA": "INANIMATE", "LOC": "INANIMATE", "NORP": "UNKNOWN", "PRODUCT": "UNKNOWN", "O": "UNKNOWN"}
    found = spark.createDataFrame(list(labels), "string").select("value", linguistic.animacy(F.col("value"), F.lit("word"), F.lit(False), F.lit(False)).alias("a")).collect()
    assert {r["value"]: r["a"] for r in found} == labels


@pytest.mark.parametrize(
    "bits, tags, head",
    [
        (["(NP*", "*)"], ["NNP", "POS"], 0),  # a possessive does not lead
        (["(NP*", "*", "*)"], ["DT", "JJ", "NN"], 2),
        (["(NP(NP*)", "(PP*", "(NP*)))"], ["NN", "IN", "NN"], 0),
        (["(VP*", "(VP*))"], ["AUX", "VBN"], 0),  # an auxiliary is preferred to a phrase
        (["(VP*", "*)"], ["AUX", "VBN"], 1),  # and a participle to an auxiliary
        (["(VP*", "*)"], ["AUX", "RB"], 0),
        (["(NOPARSE*", "*)"], ["XX", "YY"], 1),  # without a rule from the right
        (["(NX*", "*)"], ["NN", "NN"], 0),
        (["(NP*", "*", "*)"], ["NN", "CC", "NN"], 0),  # the conjunct before
    ],
)
def test_heads(bits, tags, head):
    top, at = trees.tree_of(bits, tags), []
    while top.children:
        top = trees.head_child(top)
        at.append(top.label)
    assert top.start == head, at


def test_first_names(spark):
    mentions = spark.createDataFrame([(1, "PERSON", "Smith", "Mary"), (2, "PERSON", "Mary", "Unseen"), (3, "PERSON", "Mary", "said"), (4, "ORG", "Mary", "John"), (5, "PERSON", "smith", "Mary")], "k int, ner string, head string, prev1 string")
    dictionary = spark.createDataFrame([("mary", [0, 9, 0, 0]), ("john", [9, 0, 0, 0]), ("smith", [0, 0, 9, 0])], "key string, counts array<int>")
    found = {r["k"]: r["name_gender"] for r in templates.name_gender(mentions, dictionary).collect()}
    assert found == {1: "FEMALE", 2: "UNKNOWN", 3: "FEMALE", 4: "FEMALE", 5: "NEUTRAL"}
