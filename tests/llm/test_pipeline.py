"""The corpus pipeline, stage by stage, against plain versions of what each should keep."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs.collect())
    return out


def test_languages_stay(stages):
    known = [r for r in stages[0] if any(map(str.isalpha, r["text"]))]
    assert len(stages[1]) >= 0.99 * len(known) and {r["doc_id"] for r in stages[1]} <= {r["doc_id"] for r in known}


def test_one_of_each_class_stays(stages):
    from test_operators import linked

    found = linked([(r["doc_id"], r["text"]) for r in stages[1]])
    assert {r["doc_id"] for r in stages[2]} == {c for c, _ in found.values()} and len(stages[2]) == len({r["doc_id"] for r in stages[2]})


def test_contaminated_go(spark, stages):
    from test_operators import contaminated

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {row[0] for row in contaminated([(r["doc_id"], r["text"]) for r in stages[2]], items) if row[4]}
    assert bad and {r["doc_id"] for r in stages[3]} == {r["doc_id"] for r in stages[2]} - bad


def test_personal_data_are_replaced(stages):
    from test_operators import base_spans

    assert {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]}
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    assert any(base_spans(t) for t in before.values())
    for r in stages[4]:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"]) and (base_spans(before[r["doc_id"]]) or "[" in r["text"] or r["text"] == before[r["doc_id"]])


def test_ids(stages):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert {r["doc_id"] for r in stages[5]} == set(texts)
    for r in stages[5]:
        ids = tk.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_odd_rows(spark):
    """Nulls, empty texts, copies, repeated and missing ids, an empty table and extra columns go through all stages."""
    passage = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the of and with " * 30, "en", "s", 1), (4, "the of and with " * 30, "en", None, 1), (None, "der die und das " * 20, "de", "s", 2), (5, "12 34 !!", None, None, 3), (6, "der die und " * 9 + "me@mail.de", "de", "s", 2)]
    rows += [(6, "les des avec pour " * 9, "fr", "s", 2), (None, passage, "en", "s", 1), (6, passage + " more", "en", "s", 1), (None, "los con para el " * 9, "es", "s", 1)]
    extra = {"spans": "keep me", "Score": 7.5, "lang_pred": "zz", "ambiguous": 3, "k1": "a", "maybe": None, "digest": "d", "n_tokens": 1, "ids": "i", "decoded": "t"}
    docs = spark.createDataFrame([(*r, *extra.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, Score double, lang_pred string, ambiguous int, k1 string, maybe string, digest string, n_tokens int, ids string, decoded string")
    for given, ids in ((docs, [3, 6, 6, None, None]), (docs.where("false"), [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            names = given.columns
            given = stage(spark, given, SF).cache()
            assert given.columns == names
            assert all(tuple(r)[5:] == tuple(extra.values()) for r in given.collect())
        assert sorted((r["doc_id"] for r in given.collect()), key=str) == sorted(ids, key=str)
        assert sorted((r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, given, SF).collect()), key=str) == sorted(ids, key=str)
