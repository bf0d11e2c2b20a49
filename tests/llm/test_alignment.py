"""The alignment of two tokenizers against whole texts, offset by offset."""

import collections
import hashlib
import random

import public_tokenizers
import pytest

from chainweave.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(5)
LETTERS = ["the", "Haus", "tion", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", ";\r", "\x0b", "\xa0", " ", "　", "\x1c", "\x85", "é", "é", "日本", "🙂", "don't", "'ll", "...", "-", "42", "1,000", "{", "}", "();", "====", "ſ", "<|endoftext|>", "</s>", "<0x0A>", "\x00"]


def made(n: int) -> str:
    return "".join(RNG.choice(LETTERS) + RNG.choice(["", " ", " "]) for _ in range(n))


FUZZ = [made(n) for n in range(1, 60) for _ in range(3)]
TEXTS = [None, "", " ", "\n", "a", "a", "a ▁ b", "x▁▁ y", "ﬁ ligature", "the\tend\t", *FUZZ, FUZZ[-1], made(6000), "a" * 5000, "日本語" * 700]


@pytest.fixture(scope="module")
def expected():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: k for k, c in alignment.BYTE_LETTERS.items()}

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(xb) == b"".join(yb) == (" " + text).encode():
            return []
        ends = []
        for parts in (xb, yb):
            at, own = 0, []
            for p in parts:
                at += len(p)
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        out, start = [], 0
        for end in common:
            out.append(tuple(tuple(i for i, e in zip(ids, own) if start < e <= end) for ids, own in zip((x, y), ends)))
            start = end
        return out

    found = [groups(t) for t in TEXTS]
    holds = collections.Counter(p for gs in found for p in {(i, j) for x, y in gs for i in x for j in y})
    best = {}
    for (i, _), n in holds.items():
        best[i] = max(best.get(i, 0), n)
    rows = []
    for gs in found:
        links = [(i, j) for x, y in gs for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        rows.append((sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return rows, holds


@pytest.mark.parametrize("segment, numbered", [(1 << 20, 1 << 20), (300, 500)])
def test_against_whole_texts(spark, expected, segment, numbered, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "NUMBERED", numbered)
    rows, holds = expected
    docs = spark.createDataFrame([(k if k % 9 else None, t, k, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, seg long, g string").repartition(3)
    found = alignment.align(docs, A, B)
    told = collections.Counter(tuple(r) for r in found.documents.collect())
    assert told == collections.Counter((k if k % 9 else None, *r) for k, r in enumerate(rows))
    assert sum(r[0] > 0 for r in rows) > 100 and sum(r[0] == 0 for r in rows) >= 4
    assert {(r["a"], r["b"]): r["documents"] for r in found.pairs.collect()} == dict(holds)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digest(docs, A, B).collect() == []
    assert [tuple(r) for r in alignment.digest(spark.createDataFrame([(1, None), (1, None)], docs.schema), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())


def test_marks_behind_letters_are_units_of_their_own(aligner):
    """So a word is met once, whatever marks follow it; the groups are those of the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    words = ["the", "Haus", "zuchpfkeitie", "ciónezarie", "ß", "ªa"]
    texts = [f"{w}{m}{m}{m} {w}{m}x\\n{w}{m}{m}\\n{m}{w}.{m}{w} {w}'s{m}".replace("\\n", "\n") for w in words for m in alignment.MARKS]
    for text, found in zip(texts, aligner.align(texts)):
        spelled = found[0]
        assert [int(x) for g in spelled.split(";") for x in g.split("|")[0].split(",")] == a.encode(" " + text, add_special_tokens=False).ids
        assert [int(x) for g in spelled.split(";") for x in g.split("|")[1].split(",")] == b.encode(text)
    assert set("$%&*#!.,") <= aligner.marks
    assert aligner.units(" zuchpfkeitie$$$ whenble%%%") == [" zuchpfkeitie", "$$$", " whenble", "%%%"]


def test_new_units_of_many_texts_are_met_in_one_call(aligner, monkeypatch):
    """Each call of B starts threads of its own, which took longer than its work for one text."""
    monkeypatch.setattr(alignment, "CACHED_UNITS", 20)
    calls, encode = [], aligner.b.encode
    monkeypatch.setattr(aligner.b, "encode", lambda units, **k: calls.append(len(units)) or encode(units, **k))
    rows = [(k, f"qword{'abcdefghij'[k % 10]} xzz{'abcdefghij'[k // 10]} " + "y" * 70 + "z" * k) for k in range(100)]
    for part in alignment.together(rows):
        assert None not in aligner.align([t for _, t in part])
    assert len(calls) == 1 and not aligner.cache and len(aligner.older) >= 20 and max(map(len, aligner.older)) <= alignment.LONGEST_UNIT
    monkeypatch.setattr(alignment, "TOGETHER", 300)
    parts = list(alignment.together([*rows, (None, None), (1, "x" * 1000)]))
    assert [r for p in parts for r in p] == [*rows, (None, None), (1, "x" * 1000)] and all(len(p) == 1 or sum(len(t or "") + 1 for _, t in p) <= 300 for p in parts)
