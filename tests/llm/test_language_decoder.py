"""Language identification against n-grams hashed one by one and losses summed by loops, and on held-out documents."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweave.llm import language

M32 = 0xFFFFFFFF


def plain_grams(text: bytes) -> list[int]:
    """Both hashes of every place: of the last three letters, and of the last four."""
    letters = []
    for byte in b"   " + text + b" ":
        c = byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte > 127 else 32
        if c == 32 and letters and letters[-1] == 32:
            continue
        letters.append(c)
    out = []
    for k, c in enumerate(letters):
        before = [letters[k - j] if k >= j else 32 for j in range(4)]
        three = before[0] | before[1] << 8 | before[2] << 16
        four = three | before[3] << 24
        for h in (three * 2654435761 & M32, (four * 2246822519 + 374761393) & M32):
            out.append((h ^ h >> 15) >> (17 - (language.BUCKETS.bit_length() - 16)) & M32)
    return [h % language.BUCKETS for h in out]


@pytest.mark.parametrize("text", [b"a", b"The  cat,\nsat.", "Über größe ÉTÉ".encode(), b"x" * 50, "日本語 text".encode(), b"A b C d E"])
def test_grams_one_by_one(text):
    hashed, starts = language.grams([text])
    assert starts.tolist() == [0] and sorted(hashed.T.ravel().tolist()) == sorted(plain_grams(text))
    others, starts = language.grams([b"other", text, b"more words"])
    assert sorted(others[:, starts[1] : starts[2]].T.ravel().tolist()) == sorted(plain_grams(text))


def plain_scores(model: language.Model, text: bytes) -> list[float]:
    grams = plain_grams(text)
    margins = [sum(model.weights[g, bit] for g in grams) / len(grams) * language.SCALE + model.weights[-1, bit] for bit in range(model.code.shape[1])]
    losses = [sum(trust * math.log1p(math.exp(-m * c)) for m, c, trust in zip(margins, word, model.trust)) for word in model.code]
    e = [math.exp(min(losses) - x) for x in losses]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("n", [2, 3, 4, 7])
def test_decoding_by_loops(n):
    rng = np.random.default_rng(n)
    code = language.codewords(n)
    model = language.Model([f"l{k}" for k in range(n)], code, rng.normal(0, 0.3, (language.BUCKETS + 1, code.shape[1])), rng.uniform(0.2, 1.5, code.shape[1]))
    texts = [b"one two three", "été à la maison".encode(), b"q", b"ab " * 400]
    for text, row in zip(texts, model.scores(texts)):
        assert row == pytest.approx(plain_scores(model, text)) and row.sum() == pytest.approx(1)


@pytest.mark.parametrize("n", [4, 8])
def test_wrong_bits_are_corrected(n):
    """A language's codeword with fewer wrong bits than half the least distance is still nearest, unless the wrong ones weigh more."""
    code = language.codewords(n)
    least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert least >= 3
    for word in range(n):
        bits = code[word].copy()
        bits[: (least - 1) // 2] *= -1
        model = language.Model(list("abcdefgh"[:n]), code, np.vstack([np.zeros((language.BUCKETS, code.shape[1])), 4 * bits]), np.ones(code.shape[1]))
        assert model.scores([b"any"]).argmax() == word


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null").collect()
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows) and len(held) > 100
    told = [r for r in held if len(r["text"] or "") >= 40 and r["lang_pred"] != language.UNDETERMINED]
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)


def test_a_mixture_is_ambiguous(spark):
    rng = random.Random(2)
    words = {"aa": ["banana", "karma", "samba", "lava"], "bb": ["pixie", "nitid", "limpid", "civic"]}
    make = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(k, make("aa" if k % 2 else "bb", 30), "aa" if k % 2 else "bb") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    mixed = spark.createDataFrame([(1, make("aa", 40)), (2, " ".join(f"{make('aa', 1)} {make('bb', 1)}" for _ in range(40)))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.predict(mixed, model).collect()}
    assert found[1]["lang_pred"] == "aa" and not found[1]["ambiguous"] and found[2]["score"] < found[1]["score"]
