"""What a task holds, shuffles and computes must not follow the number of pairs, tokens or lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chainweave.operators import inference, pairs as P, scoring
from chainweave.sources import conll, tokens as K


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_scored_where_they_are(spark, monkeypatch):
    """Their features were exploded, shuffled and grouped: three rows a pair in the hash map of a task."""
    rng = random.Random(3)
    rows = [(f"d{k % 3}", k, k - 1, None if k % 17 == 0 else [rng.choice([None, -4, 0, 1, 5, 9, 400]) for _ in range(k % 4)], "x") for k in range(200)]
    pairs = spark.createDataFrame(rows, "doc_key string, m long, a long, feats array<int>, more string").repartition(3).cache()
    weights = {0: 0.5, 1: -2.0, 9: 3.0, 7: 1.0}
    table = spark.createDataFrame([*weights.items(), (None, 9.0), (1, 1.0), (5, None)], "feat_idx int, weight double")
    weights[1] += 1.0
    expected = {(d, m): sum(weights.get(f, 0.0) for f in feats or ()) for d, m, _, feats, _ in rows}
    found = scoring.with_scores(pairs, table)
    assert "Exchange" not in plan_of(found).split("InMemoryTableScan")[0] and found.columns == [*pairs.columns, "score"]
    assert {(r["doc_key"], r["m"]): r["score"] for r in found.collect()} == expected
    monkeypatch.setattr(scoring, "DENSE", 4)  # too many ids for one vector
    assert {(r["doc_key"], r["m"]): r["score"] for r in scoring.linear_scores(pairs, table).collect()} == expected


@pytest.mark.parametrize("strategy", ["c2flogratio:0.5", "distance:3:1"])
def test_pruned_pairs_are_marked_in_one_pass(spark, monkeypatch, strategy):
    monkeypatch.setattr(P, "SORTED", 10)
    rng = random.Random(4)
    rows = [(d, m, a, rng.random() * 2, "PRONOMINAL" if m % 2 else "NOMINAL", m // 2, a // 2) for d in "xy" for m in range(12) for a in range(m + 1)]
    pairs = spark.createDataFrame(rows, "doc_key string, m long, a long, score double, m_ment_type string, m_sent_idx long, a_sent_idx long")
    marked = P.marked(P.by_mention(pairs, len(rows)), strategy)
    assert plan_of(marked).count("Exchange hashpartitioning") <= 1 and marked.rdd.getNumPartitions() >= len(rows) // 10
    kept = {(r["doc_key"], r["m"], r["a"]) for r in P.by_strategy(pairs, strategy).collect()}
    assert kept == {(r["doc_key"], r["m"], r["a"]) for r in marked.where(~F.col("pruned")).collect()} and 0 < len(kept) < len(rows)
    best = {}
    for d, m, a, s, *_ in rows:
        best[d, m] = max(best.get((d, m), 0), round(s, 9))
    holds = lambda d, m, a, s, kind, i, j: round(s, 9) + 0.5 >= best[d, m] if strategy[0] == "c" else a >= m - 3 and (kind != "PRONOMINAL" or i - j <= 1)
    assert kept == {r[:3] for r in rows if holds(*r)}


@pytest.mark.parametrize("name", ["tokenized", "realigned_tokens"])
def test_tokens_of_a_text_are_not_shuffled(spark, name):
    """Each piece of a text was a row of three shuffles; a text is a row from beginning to end."""
    assert "Exchange" not in plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001"))


def test_places_of_tokens_do_not_follow_the_texts_of_a_batch(spark, monkeypatch):
    words = ["it's", '"', "don't", "(", "🙂", "\u017f", "x'\u017f", "'s", " ", "\x0b", "a'b's", "\"x\"", "", "état"]
    rng = random.Random(6)
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "  "]
    pieces = [re.findall(r"[ \x0b]+|[^\W_]+(?:['][^\W_]+)*|[\s\S]", t or "") for t in texts]
    shown = []
    for own in pieces:
        ended = [(re.match(r"(?i)(.+)(n't|'(?:s|re|ve|ll|d|m))$", p, re.A), p) for p in own]
        cut = [x for m, p in ended for x in (m.groups() if m else (p,))]
        at, out = 0, []
        for k, p in enumerate(cut):
            if p[0] not in " \x0b":
                opening = k == 0 or cut[k - 1][0] in " \x0b(["
                out.append((at, at + len(p), p, {"(": "-LRB-", '"': "``" if opening else "''"}.get(p, p)))
            at += len(p)
        shown.append(out)
    for size in (1, 7, 256):
        monkeypatch.setattr(K, "TEXTS", size)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: list(zip(r["starts"], r["stops"], r["raws"], r["tokens"])) for r in K.token_lists(df).collect()}
        assert [got[k] for k in range(len(texts))] == shown


def test_files_are_read_as_documents_without_a_shuffle(spark, tmp_path):
    """All lines of a file were sorted by several windows of one task."""
    rng = random.Random(8)
    field = lambda k: f"x 0 {k} w{k} - * - - - s * {rng.choice(['-', '(1)'])}"
    for n in range(3):
        lines = ["# before", field(0)] if n else []
        for part in range(4):
            lines += [f"#begin document (a({n})); part {part:03d}", *rng.choice([[], [""], ["# note"]])]
            for _ in range(rng.randrange(5)):
                lines += [*(" " * rng.randrange(2) + field(k) for k in range(rng.randrange(4))), *rng.choice([["# note"], []]), *[rng.choice(["", "  "])] * rng.randrange(3)]
            lines += rng.choice([["#end document"], ["", "#end document", "", field(9)], []])
        (tmp_path / f"f{n}_conll").write_bytes(["\n", "\r\n", "\n"][n].join(lines).encode() + b"\n" * n)
    expected, found = conll.documents(conll.read_lines(spark, str(tmp_path))), conll.read_documents(spark, str(tmp_path))
    assert "Exchange" not in plan_of(found) and found.dtypes == expected.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) and found.count() > 20


def test_names_of_templates_are_cut_once_a_mention(spark):
    """All 53 names of a pair were cut from its features, by an interpreted function."""
    plan = entry.queries()["template_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    entry.broadcast_as_measured(spark, False)
    above = plan.split("Join", 1)[0]
    assert "lambdafunction" not in above and "substring_index" in above and "lambdafunction" in plan


def test_members_meet_mentions_in_blocks(spark, monkeypatch):
    """A document was one key, and the partial counts of all its pairs in one task."""
    monkeypatch.setattr(inference, "BLOCK", 3)
    monkeypatch.setattr(inference, "SORTED", 20)
    rng = random.Random(9)
    value = {(d, m): rng.choice(["x", "y", None]) for d, n in (("a", 1), ("b", 17), ("c", 6)) for m in range(n)}
    cluster = {k: rng.randrange(3) for k in value if rng.random() < 0.8}
    mentions = spark.createDataFrame([(*k, v) for k, v in value.items()], "doc_key string, ment_idx long, p string")
    found = inference.entity_features(mentions, spark.createDataFrame([(*k, c) for k, c in cluster.items()], "doc_key string, ment_idx long, cluster_id int"), ["p"])
    expected = {}
    for (d, m), v in value.items():
        for (e, i), c in cluster.items():
            if e == d and i < m:
                size, same = expected.get((d, m, c), (0, 0))
                expected[d, m, c] = size + 1, same + (v is not None and v == value[e, i])
    got = {(r["doc_key"], r["m"], r["cluster_id"]): r["size"] for r in found.collect()}
    assert got == {k: v[0] for k, v in expected.items()} and len({k for k in got if k[0] == "b"}) > 20
    assert plan_of(found).split("Initial Plan")[0].count("REPARTITION_BY_NUM") == 2
    none = [k for k, (n, same) in expected.items() if same == 0 and n > 2]
    assert none and all(r["p"] == "p=NONE" for r in found.collect() if (r["doc_key"], r["m"], r["cluster_id"]) in none)
