"""Belief propagation against enumeration on trees, and against plain dense messages on graphs with loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweave.operators import factor_graph as G


def graph(rng, n, trees):
    """Choices and potentials of one document; in a tree no mention has two candidates and none is met twice."""
    choices = []
    for m in range(n):
        before = list(range(m))
        own = ([rng.choice(before)] if before and rng.random() < 0.8 else []) if trees else [a for a in before if rng.random() < 0.8]
        choices += [(m, a, rng.gauss(0, 1)) for a in own] + ([(m, m, rng.gauss(0, 1))] if rng.random() < 0.9 or not own else [])
    return choices


def tables(properties, choices, potentials):
    """Variables with their domains, and factors as dense tables: (variables, array)."""
    domains, factors = {}, []
    for m in {m for m, _, _ in choices}:
        own = [(a, s) for k, a, s in choices if k == m]
        domains["A", m] = [a for a, _ in own]
        factors.append(([("A", m)], np.exp([s for _, s in own])))
    for c, p in enumerate(properties):
        for m, phi in potentials[c].items():
            domains["L", m, c] = list(range(p.size))
            if p.projection is None:
                factors.append(([("L", m, c)], np.array(phi)))
            else:
                domains["O", m, c] = list(range(len(phi)))
                factors.append(([("O", m, c)], np.array(phi)))
                factors.append(([("O", m, c), ("L", m, c)], np.exp(np.array(p.projection))))
        for m, a, _ in choices:
            if a != m:
                grid = np.array(p.potentials())
                table = np.ones((p.size, len(domains["A", m]), p.size))
                table[:, domains["A", m].index(a), :] = grid
                factors.append(([("L", m, c), ("A", m), ("L", a, c)], table))
    return domains, factors


def enumerated(domains, factors):
    names = list(domains)
    sums = {v: np.zeros(len(d)) for v, d in domains.items()}
    for values in itertools.product(*(range(len(domains[v])) for v in names)):
        at = dict(zip(names, values))
        weight = math.prod(float(t[tuple(at[v] for v in vs)]) for vs, t in factors)
        for v in names:
            sums[v][at[v]] += weight
    return {v: s / s.sum() for v, s in sums.items()}


def messages(domains, factors, rounds):
    """All nodes send, then all factors; observed nodes and unary factors as the operator's docstring says."""
    to_node = {}
    for f, (vs, t) in enumerate(factors):
        for v in vs:
            to_node[f, v] = t / t.sum() if len(vs) == 1 else np.ones(len(domains[v])) / len(domains[v])
    for _ in range(rounds):
        to_factor = {}
        for f, v in to_node:
            x = np.ones(len(domains[v]))
            for g, w in to_node:
                if w == v and g != f:
                    x = x * to_node[g, w]
            to_factor[f, v] = x / x.sum()
        for f, (vs, t) in enumerate(factors):
            if len(vs) > 1:
                for k, v in enumerate(vs):
                    x = t
                    for j, w in enumerate(vs):
                        if j != k:
                            x = x * to_factor[f, w].reshape([-1 if i == j else 1 for i in range(len(vs))])
                    x = x.sum(tuple(j for j in range(len(vs)) if j != k))
                    to_node[f, v] = x / x.sum()
    out = {}
    for v, d in domains.items():
        x = np.ones(len(d))
        for (f, w), message in to_node.items():
            if w == v:
                x = x * message
        out[v] = x / x.sum()
    return out


KINDS = [
    [G.Property("p", 2, G.weighted_grid(G.names_of_grid("custom", 2, "x"), {"xAgree-0": 0.7, "xAgree-1": 0.2, "xDisagree": -0.9}, G.default_grid("zero", 2)))],
    [G.Property("p", 3)],
    [G.Property("p", 2, G.default_grid("agreement", 2, weight=1.5), G.default_grid("agreement", 2, weight=0.8)), G.Property("q", 3, None, G.weighted_grid(G.names_of_grid("full", 3, "y"), {"y-0-1": 0.4, "y-2-2": 1.1}, G.default_grid("epsilon", 3)))],
]


def run(spark, properties, documents, **options):
    choices = spark.createDataFrame([(d, *c) for d, (cs, _) in documents.items() for c in cs], "doc_key string, m long, a long, score double")
    rows = []
    for d, (_, potentials) in documents.items():
        rows += [(d, m, *(potentials[c][m] for c in range(len(properties)))) for m in potentials[0]]
    mentions = spark.createDataFrame(rows, "doc_key string, ment_idx long, " + ", ".join(f"{p.name} array<double>" for p in properties))
    return G.propagate(choices, mentions, properties, **options)


def close(found, documents, expected, properties, after=None):
    """``after``: the observed nodes' values; they are told with the messages of the last round, so a round later."""
    for r in found.marginals().collect():
        domains, values = expected[r["doc_key"]]
        assert r["marginal"] == pytest.approx(values["A", r["m"]][domains["A", r["m"]].index(r["a"])], abs=1e-9)
    for letter, rows in (("L", found.values()), ("O", found.observations())):
        seen = 0
        for r in rows.collect():
            c = [p.name for p in properties].index(r["property"])
            assert r["chances"] == pytest.approx((after if after and letter == "O" else expected)[r["doc_key"]][1][letter, r["ment_idx"], c].tolist(), abs=1e-9)
            seen += 1
        assert seen == sum(v[0] == letter for _, values in expected.values() for v in values)


def made(rng, properties, n, trees):
    potentials = [{m: [rng.uniform(0.05, 1) for _ in range(len(p.projection or range(p.size)))] for m in range(n)} for p in properties]
    return graph(rng, n, trees), potentials


@pytest.mark.parametrize("kind", [0, 1])
def test_trees_are_exact(spark, kind):
    rng, properties = random.Random(kind), KINDS[kind]
    documents = {f"d{k}": made(rng, properties, rng.randrange(1, 6), True) for k in range(25)}
    expected = {d: ((t := tables(properties, *x))[0], enumerated(*t)) for d, x in documents.items()}
    close(run(spark, properties, documents, rounds=12), documents, expected, properties)
    close(run(spark, properties, documents, rounds=30, tolerance=1e-12), documents, expected, properties)


@pytest.mark.parametrize("kind, rounds", [(0, 5), (1, 2), (2, 1), (2, 5)])
def test_loops_as_dense_messages(spark, kind, rounds):
    rng, properties = random.Random(10 + kind), KINDS[kind]
    documents = {f"d{k}": made(rng, properties, rng.randrange(1, 6), False) for k in range(12)}
    expected = {d: ((t := tables(properties, *x))[0], messages(*t, rounds)) for d, x in documents.items()}
    after = {d: ((t := tables(properties, *x))[0], messages(*t, rounds + 1)) for d, x in documents.items()}
    close(run(spark, properties, documents, rounds=rounds), documents, expected, properties, after)


def test_dirty_schedule_ends_where_the_full_one_does(spark):
    rng, properties = random.Random(77), KINDS[0]
    documents = {f"d{k}": made(rng, properties, rng.randrange(1, 6), False) for k in range(10)} | {"still": ([(0, 0, 1.0)], [{0: [0.5, 0.5]}])}
    full = {tuple(r)[:3]: r["marginal"] for r in run(spark, properties, documents, rounds=25).marginals().collect()}
    dirty = {tuple(r)[:3]: r["marginal"] for r in run(spark, properties, documents, rounds=25, tolerance=1e-8).marginals().collect()}
    assert full.keys() == dirty.keys() and all(dirty[k] == pytest.approx(v, abs=1e-6) for k, v in full.items())


def test_expected_counts_by_enumeration(spark):
    """On trees the counts are exact: the probability of each pair of values with its candidate chosen, summed."""
    rng, properties = random.Random(5), KINDS[0]
    names = G.names_of_grid("custom", 2, "x")
    documents = {f"d{k}": made(rng, properties, 4, True) for k in range(8)}
    found = {r["feature"]: r["expected"] for r in run(spark, properties, documents, rounds=12).expected_counts([names]).collect()}
    sums = dict.fromkeys(found, 0.0)
    for choices, potentials in documents.values():
        domains, factors = tables(properties, choices, potentials)
        order, total, own = list(domains), 0.0, dict.fromkeys(found, 0.0)
        for values in itertools.product(*(range(len(domains[v])) for v in order)):
            at = dict(zip(order, values))
            w = math.prod(float(t[tuple(at[v] for v in vs)]) for vs, t in factors)
            total += w
            for m, a, _ in choices:
                if a != m and domains["A", m][at["A", m]] == a:
                    for name in names[at["L", m, 0]][at["L", a, 0]]:
                        own[name] += w
        for name, w in own.items():
            sums[name] += w / total
    assert set(found) == {"xAgree-0", "xAgree-1", "xDisagree"}
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in sums.items())


def test_unary_factors_and_grids(spark):
    row = spark.createDataFrame([("b",), ("z",), (None,)], "v string").select(
        G.agreeing(F.col("v"), "abc", 1.0, -1.0).alias("agree"), G.featured(F.col("v"), "abc", {"ORIGCOMPATIBLE:a-p=b": 0.5}, 1.0).alias("general"), G.given(F.array(F.lit(1.0))).alias("given")
    ).collect()
    e = math.exp
    assert row[0]["agree"] == pytest.approx([e(-1), e(1), e(-1)]) and row[0]["general"] == pytest.approx([e(0.5), e(1.0), 1.0]) and row[0]["given"] == [1.0]
    assert row[1]["agree"] == pytest.approx([e(-1)] * 3) == row[2]["agree"] and row[2]["general"] == [1.0] * 3
    assert G.names_of_grid("half", 2, "p") == [[["p-0-0"], ["p-0-1"]], [["p-0-1"], ["p-1-1"]]]
    assert G.names_of_grid("source", 2, "p") == [[["pAgree-0"], ["pDisagree-0"]], [["pDisagree-1"], ["pAgree-1"]]]
    assert G.names_of_grid("fine", 1, "p", 2, ("T", "U"))[0][1] == ["p-0-1", "p-0-1&T", "p-0-1&T&U"] and G.names_of_grid("empty", 1, "p") == [[[]]]
    assert G.names_of_grid("agree", 2, "p")[0] == [["pAgree"], ["pDisagree"]]
    assert G.default_grid("forced", 2) == [[0.0, G.NEVER], [G.NEVER, 0.0]] and all(abs(x) <= 0.005 for x in G.default_grid("epsilon", 3)[0])
    with pytest.raises(ValueError):
        G.default_grid("forced", 2, 3)


def test_least_risk(spark):
    rng = random.Random(6)
    rows, expected, likeliest = [], {}, {}
    for m in range(60):
        candidates = [*rng.sample(range(m), min(m, rng.randrange(5))), *([m] if rng.random() < 0.9 or not m else [])] or [m]
        p = np.array([rng.choice([0.1, 0.2, 0.5, 1.0]) for _ in candidates])
        chance = dict(zip(candidates, (p / p.sum()).tolist()))
        rows += [("d", m, a, x) for a, x in chance.items()]

        def loss(a, truth, new=m):
            return 0 if a == truth else 3.0 if a == new else 0.1 if truth == new else 1.0

        expected[m] = min((round(sum(x * loss(a, b) for b, x in chance.items()), 9), a) for a in chance)
        likeliest[m] = min((-round(x, 9), a) for a, x in chance.items())[1]
    df = spark.createDataFrame(rows, "doc_key string, m long, a long, marginal double")
    found = {r["m"]: (round(r["risk"], 9), r["a"]) for r in G.least_risk(df).collect()}
    assert {m: a for m, (_, a) in found.items()} == {m: a for m, (_, a) in expected.items()} and all(found[m][0] == pytest.approx(expected[m][0], abs=1e-9) for m in found)
    assert {r["m"]: r["a"] for r in G.least_risk(df, 1.0, 1.0, 1.0).collect()} == likeliest


@pytest.mark.parametrize("kind, rounds", [(0, 5), (1, 2), (2, 1), (2, 4)])
def test_messages_made_again_are_those_of_dense_graphs(spark, kind, rounds):
    """No message is kept; what a pair's factors send follows from what each round told its mentions."""
    rng, properties = random.Random(20 + kind), KINDS[kind]
    documents = {f"d{k}": made(rng, properties, rng.randrange(1, 6), False) for k in range(12)}
    documents["far"] = ([(0, 0, 900.0), (1, 1, -900.0), (1, 0, -2000.0), (2, 0, 1500.0), (2, 1, 1499.0)], documents["d0"][1] if len(documents["d0"][1][0]) == 3 else made(rng, properties, 3, False)[1])
    expected = {d: ((t := tables(properties, *x))[0], messages(*t, rounds)) for d, x in documents.items() if d != "far"}
    after = {d: ((t := tables(properties, *x))[0], messages(*t, rounds + 1)) for d, x in documents.items() if d != "far"}
    choices = spark.createDataFrame([(d, *c) for d, (cs, _) in documents.items() for c in cs], "doc_key string, m long, a long, score double")
    rows = [(d, m, *(potentials[c][m] for c in range(len(properties)))) for d, (_, potentials) in documents.items() for m in potentials[0]]
    mentions = spark.createDataFrame(rows, "doc_key string, ment_idx long, " + ", ".join(f"{p.name} array<double>" for p in properties))

    def paired(nodes, columns):
        side = lambda x: nodes.select("doc_key", F.col("ment_idx").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
        return choices.join(side("m"), ["doc_key", "m"]).join(side("a"), ["doc_key", "a"])

    found, kept = G.propagate_made(paired, mentions, properties, rounds), G.propagate(choices, mentions, properties, rounds)
    near = lambda rows: rows.where("doc_key <> 'far'")
    for name in ("marginals", "values", "observations"):
        both = [{tuple(r)[:3]: r[3] for r in getattr(graph, name)().collect()} for graph in (found, kept)]
        assert both[0].keys() == both[1].keys() and all(x == pytest.approx(both[1][k], abs=1e-9) for k, x in both[0].items())
    plain = type("Near", (), {n: (lambda self, n=n: near(getattr(found, n)())) for n in ("marginals", "values", "observations")})()
    close(plain, documents, expected, properties, after)
    names = [G.names_of_grid("full", p.size, p.name) for p in properties]
    both = [{r["feature"]: r["expected"] for r in graph.expected_counts(names).collect()} for graph in (found, kept)]
    assert both[0].keys() == both[1].keys() and all(x == pytest.approx(both[1][k], abs=1e-9) for k, x in both[0].items())


@pytest.mark.parametrize("name", ["bp_expected_counts", "bp_factors", "bp_marginals", "bp_values"])
def test_no_pairs_are_stored(spark, monkeypatch, name):
    """The rounds stored every pair's messages, for each property."""
    import __spark_entry__ as entry
    from chainweave.storage import Scratch

    stored, plain = [], Scratch.store

    def store(self, df, *a, **b):
        stored.append(plain(self, df, *a, **b))
        return stored[-1]

    monkeypatch.setattr(Scratch, "store", store)
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: None)
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    rows = [x.count() for x in stored]
    mentions = rows[0]
    assert rows and max(rows) == mentions and (name in ("bp_values", "bp_expected_counts") or found.count() > 3 * mentions)
    entry.broadcast_as_measured(spark, False)
    entry.compiled_in_pieces(spark, False)
