"""Long documents and long tables: the work is dealt over many keys, and nothing is lost at the seams."""

import itertools

import pytest
from pyspark.sql import functions as F

from chainweave.operators import features, ordering, pairs
from chainweave.sources import text_formats


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)


def expected(sizes, diagonal=False, back=None):
    return sorted((d, m, a) for d, n in sizes.items() for m in range(n) for a in range(m + diagonal) if back is None or a >= m - back)


@pytest.mark.parametrize("diagonal, back", list(itertools.product([False, True], [None, 0, 3, 4, 9, 100])))
def test_pairs_across_blocks(spark, small_blocks, diagonal, back):
    sizes = {"one": 1, "edge": 4, "over": 5, "long": 23}
    rows = spark.createDataFrame([(d, i, f"{d}{i}") for d, n in sizes.items() for i in range(n)] + [("none", None, "x"), (None, 0, "y"), (None, 1, "z")], "doc_key string, ment_idx long, head string")
    found = pairs.mention_pairs(rows, ["head"], diagonal, back=back)
    assert found.columns == ["doc_key", "m", "m_head", "a", "a_head"]
    got = found.collect()
    assert sorted((r["doc_key"], r["m"], r["a"]) for r in got) == expected(sizes, diagonal, back)
    assert all(r["m_head"] == f"{r['doc_key']}{r['m']}" and r["a_head"] == f"{r['doc_key']}{r['a']}" for r in got)
    assert pairs.mention_pairs(rows.where("false"), ["head"], diagonal, back=back).collect() == []


def test_a_long_document_is_many_keys(spark):
    n = 6_000
    rows = spark.range(n).select(F.lit("d").alias("doc_key"), F.col("id").alias("ment_idx"))
    blocks = pairs.mention_pairs(rows, []).groupBy(F.floor(F.col("a") / pairs.BLOCK).alias("block")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in blocks) == n * (n - 1) // 2
    assert len(blocks) == -(-n // pairs.BLOCK) and max(r["n"] for r in blocks) <= n * pairs.BLOCK


def test_totals_before(spark):
    rows = [(f"k{i * 37 % 101:03d}", i % 5, None if i % 7 == 0 else i) for i in range(101)]
    df = spark.createDataFrame(rows, "key string, small int, holes long")
    found = {r["key"]: (r["small"], r["place"], r["total"], r["known"]) for r in ordering.totals_before(df, ["key"], place=F.lit(1), total=F.col("small"), known=F.col("holes")).collect()}
    place = total = known = 0
    for key, small, holes in sorted(rows):
        assert found[key] == (small, place, total, known)
        place, total, known = place + 1, total + small, known + (holes or 0)
    assert len(found) == len(rows)
    assert ordering.totals_before(df.where("false"), ["key"], place=F.lit(1)).collect() == []


def test_offsets_maxima_and_pointers(spark):
    vectors = spark.createDataFrame([("b", [1, 2]), ("a", [3]), ("b", [4]), ("c", [])], "doc_key string, feats array<int>")
    assert sorted(map(tuple, features.offsets(vectors, ["doc_key"]).collect())) == [("a", 1, 1, 0, 0), ("b", 3, 2, 1, 1), ("c", 0, 1, 4, 3)]
    clusters = spark.createDataFrame([(f"d{k:02d}", i, i % 2) for k in range(9) for i in range(k)], "doc_key string, ment_idx long, cluster_id long")
    assert tuple(ordering.maxima(clusters, 3).first()) == (8, 2, 8 + 7)  # documents 1-3, 4-6, 7-8
    lines = spark.createDataFrame([(0, "0 0"), (1, "0 1 1")], "line_no int, line string")
    docs = spark.createDataFrame([("z",), ("y",), ("z",)], "doc_key string")
    assert sorted(map(tuple, text_formats.pointers_from_text(lines, docs).collect())) == [("y", 0, 0), ("y", 1, 0), ("z", 0, 0), ("z", 1, 1), ("z", 2, 1)]
