"""Tokens and their places against plain loops; documents annotated anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chainweave.sources import conll, tokens as K

RNG = random.Random(12)
PARTS = ["don't", "it's", "We'll", "n't", "'s", "U.S.", "e.g.", "3.14", "1,000", "50%", "10:30", "(", ")", "[x]", "{y}", '"', '"quoted"', "--", "...", "..", "–", "état", "naïve", "日本語", "🙂", "a_b", "x-y", "!", "?", ";", "\x0b", "\xa0", "’", "O’Neil", "rock'n'roll", "''", "``"]
TEXTS = ["", " ", None, *("".join(RNG.choice(PARTS) + RNG.choice(["", " ", "\n", "  "]) for _ in range(RNG.randrange(1, 40))) for _ in range(150)), "word " * 3000]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4).cache()


def test_raw_tokens_and_places_give_the_text_back(texts):
    found = {}
    for r in K.tokenized(texts).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(TEXTS):
        rows = sorted(found.get(k, []), key=lambda r: r["tok_idx"])
        assert [r["tok_idx"] for r in rows] == list(range(len(rows)))
        at, rest = 0, ""
        for r in rows:
            assert text[r["start"] : r["stop"]] == r["raw"] and r["start"] >= at
            rest += text[at : r["start"]]
            at = r["stop"]
        rest += (text or "")[at:]
        assert not rest.strip(" \t\n\r\f\x0b")


def test_tokens(spark):
    def of(text):
        return [r["token"] for r in K.tokenized(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("tok_idx").collect()]

    assert of('He said: "I don\'t (really) know..."') == ["He", "said", ":", "``", "I", "do", "n't", "-LRB-", "really", "-RRB-", "know", "...", "''"]
    assert of("U.S. GDP's 3.5% [1,000] -- it’s") == ["U.S", ".", "GDP", "'s", "3.5%", "-LSB-", "1,000", "-RSB-", "--", "it’s"]


def test_alignment_finds_the_places_again(texts):
    made = K.tokenized(texts).cache()
    found = K.aligned(texts, made.select("doc_id", "tok_idx", "token"))
    same = [tuple(r) for r in made.select("doc_id", F.col("tok_idx").cast("long"), F.col("start").cast("long"), F.col("stop").cast("long"), "token").collect()]
    assert sorted(map(tuple, found.collect())) == sorted(same)
    assert K.places("a (b) ``c''", ["a", "-LRB-", "b", "-RRB-", "``", "c", "''"]) == [(0, 1), (2, 3), (3, 4), (4, 5), (6, 8), (8, 9), (9, 11)]
    with pytest.raises(ValueError, match="not at 2"):
        K.places("a b", ["a", "c"])


def test_untokenized_next(spark):
    words = ["He", "left", ".", "''", "She", ",", ")"]
    df = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)], "doc_key int, tok_idx long, token string")
    found = [r["next"] for r in K.untokenized_next(df, ["doc_key"]).orderBy("tok_idx").collect()]
    # after a quote or bracket what is behind it, and a mark behind that
    assert found == ["left", ".", "''She,", "She", ",", ")", None]


def test_documents_annotated_anew(spark):
    rows = [("d (part 0)", "d", 0, s, t, w, "X", "*", "-", "*", "-") for s, sent in enumerate([["Mr", "A", "B", "left"], ["one", "two"], ["x"]]) for t, w in enumerate(sent)]
    tokens = spark.createDataFrame(rows, "doc_key string, doc_id string, part_no int, sent_idx long, tok_idx long, word string, pos string, parse_bit string, speaker string, ner_bit string, coref_bit string")
    tags = [(0, 0, "N", "O"), (0, 1, "N", "B-PER"), (0, 2, "N", "I-PER"), (0, 3, "V", "O"), (1, 0, "C", "B-CARD"), (2, 0, "Y", "B-Z")]
    found = K.reannotated(tokens, spark.createDataFrame([("d (part 0)", *r) for r in tags], "doc_key string, sent_idx long, tok_idx long, pos string, bio string"))
    got = {(r["sent_idx"], r["tok_idx"]): (r["pos"], r["ner_bit"]) for r in found.collect()}
    assert got == {(0, 0): ("N", "*"), (0, 1): ("N", "(PER*"), (0, 2): ("N", "*)"), (0, 3): ("V", "*"), (1, 0): ("X", "*"), (1, 1): ("X", "*"), (2, 0): ("Y", "*")}
    text = conll.composed(found).first()["value"]
    assert re.search(r"d\t0\t1\tA\tN\t\*\t-\t-\t-\t-\t\(PER\*\t-", text) and found.columns == tokens.columns
