"""Plans whose memory and shuffles must not follow the number of tokens or pairs."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from chainweave.operators import pairs, scoring

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["span_word_counts", "chain_tags", "bp_factors"])
def test_what_is_exploded_is_not_broadcast_by_the_size_of_its_file(spark, name):
    """Such a table of tokens, of 8.9 MB of Parquet, did not fit a driver of 750 MB."""
    spark.conf.set(entry.STATIC, "9m")
    try:
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
        assert spark.conf.get(entry.MEASURED) == "9m"
        entry.queries()["op5_preferences"](spark, DATA)
        assert spark.conf.get(entry.STATIC) == "9m" and spark.conf.get(entry.FORMER, None) is None
    finally:
        entry.broadcast_as_measured(spark, False)
        spark.conf.unset(entry.STATIC)


def test_largest_products_of_chunks_are_those_of_all_pairs(spark, monkeypatch):
    """Each pair is met once, however a label is cut; no pair is a row."""
    monkeypatch.setattr(scoring, "CHUNK", 5)
    monkeypatch.setattr(scoring, "PRODUCT", 2)
    rng = random.Random(1)
    rows = [(f"l{k % 3}", k // 2 if k % 7 == 0 else k, None if k % 11 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for k in range(90)]
    rows += [("alone", 1, [1.0] * 4), (None, 1, [9.0] * 4), ("l0", None, [9.0] * 4), ("blank", 1, None), ("blank", 2, None)]
    expected = {}
    for label in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == label and r[1] is not None]
        pairs = [(x, y) for _, i, x in own for _, j, y in own if j < i]
        if pairs:
            expected[label] = len(pairs), max((round(sum(a * b for a, b in zip(x, y)), 9) for x, y in pairs if x and y), default=None)
    found = scoring.largest_products(spark.createDataFrame(rows, "label string, id long, v array<float>"))
    got = {r["label"]: (r["pairs"], r["best"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()} and got["blank"][1] is None
    assert all(got[k][1] == pytest.approx(v[1], abs=1e-5) for k, v in expected.items() if v[1] is not None)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("ordered", [True, False])
def test_counts_of_head_pairs_come_to_the_pairs_in_blocks(spark, monkeypatch, ordered):
    """Across blocks, and none for the diagonal or for what is counted too seldom."""
    monkeypatch.setattr(pairs, "BLOCK", 4)
    rng = random.Random(5)
    heads = {(d, i): rng.choice("abcd") for d, n in (("x", 1), ("y", 4), ("z", 14)) for i in range(n)}
    rows = spark.createDataFrame([(*k, h) for k, h in heads.items()], "doc_key string, ment_idx long, head string")
    of = lambda d, m, a: (heads[d, m], heads[d, a]) if ordered else tuple(sorted((heads[d, m], heads[d, a])))
    counts = Counter(of(d, m, a) for d, m in heads for a in range(m))
    expected = {(d, m, a): counts[of(d, m, a)] if a < m and counts[of(d, m, a)] >= 6 else None for d, m in heads for a in range(m + 1)}
    found = pairs.mention_pairs(rows, ["head"], diagonal=True, beside=pairs.head_pair_counts(rows, 6, ordered))
    assert {(r["doc_key"], r["m"], r["a"]): r["of_pair"] for r in found.collect()} == expected and None in expected.values()


@pytest.mark.parametrize("name", ["joint_gates", "separate_pairs"])
def test_wide_pairs_are_not_shuffled(spark, name):
    """The pairs with all columns of both mentions went through three shuffles, or one."""
    tree = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    entry.broadcast_as_measured(spark, False)
    depths = [len(x) - len(x.lstrip(" :+-")) for x in tree]
    joins = [d for d, x in zip(depths, tree) if x.lstrip(" :+-").startswith("Join")]
    top = next(x for d, x in zip(depths, tree) if d == joins[0] and x.lstrip(" :+-").startswith("Join"))
    assert "m_block" in top and "a_block" in top
