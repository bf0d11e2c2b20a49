"""The golden metric cases, and invariants on random clusterings."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from chainweave.operators import metrics

# Clusters in letters (key, response), one case a line.
CASES = {
    "A1": ("a bc def", "a bc def"), "A2": ("a bc def", "a de"), "A3": ("a bc def", "a bcx defy z"), "A4": ("a bc def", "a bcx dy z"),
    "B1": ("ab cde", "bcx de"), "C1": ("ab cde fg", "bcx de fg"), "D1": ("12345 67 89ABC", "12345 6789ABC"), "E1": ("12345 67 89ABC", "1234589ABC 67"),
    "F1": ("ABCD", "AB CD"), "G1": ("AB CD", "ABCD"), "H1": ("ABCD", "ABCD"), "I1": ("ABCD", "AB CD"), "J1": ("ABC", "AC"), "K1": ("BCDEGHJ", "ABC DEF GHI"), "L1": ("ABC DEFG", "AB CD FGH"),
    "M1": ("abcdef", "abcdef"), "M2": ("abcdef", "a b c d e f"), "M3": ("abcdef", "ab cde f"), "M4": ("abcdef", "abcxyz"), "M5": ("abcdef", "a b c x y z"), "M6": ("abcdef", "ab cxy z"),
    "N1": ("a b c d e f", "a b c d e f"), "N2": ("a b c d e f", "abcdef"), "N3": ("a b c d e f", "ab cde f"), "N4": ("a b c d e f", "a b c x y z"), "N5": ("a b c d e f", "abcxyz"), "N6": ("a b c d e f", "ab cxy z"),
}
# Published recall and precision of some of them.
EXPECTED = {
    ("A2", "muc"): (1 / 3, 1), ("A2", "b_cubed"): ((1 + 4 / 3) / 6, 1), ("A2", "ceaf_m"): (0.5, 1), ("A2", "ceaf_e"): (1.8 / 3, 1.8 / 2),
    ("A3", "muc"): (1, 3 / 5), ("A4", "muc"): (1 / 3, 1 / 3), ("D1", "b_cubed"): (1, 16 / 21), ("E1", "b_cubed"): (1, 7 / 12),
    ("F1", "muc"): (2 / 3, 1), ("G1", "muc"): (1, 2 / 3), ("H1", "muc"): (1, 1), ("J1", "muc"): (1 / 2, 1), ("K1", "muc"): (3 / 6, 3 / 6), ("L1", "muc"): (2 / 5, 2 / 4),
}
# F of links and of no links, averaged; where the key has one kind only, of that kind.
BLANC = {"A1": 1, "A2": (0.4 + 4 / 13) / 2, "A3": (8 / 13 + 22 / 38) / 2, "A4": (1 / 4 + 10 / 28) / 2, "B1": 7 / 24, "C1": 0.5125, "M1": 1, "M2": 0, "M3": 8 / 19, "M4": 0.2, "M5": 0, "M6": 2 / 19, "N1": 1, "N2": 0, "N3": 22 / 26, "N4": 0.2, "N5": 0, "N6": 4 / 26}


def rows(text: str, doc: str) -> list:
    return [(doc, m, k) for k, cluster in enumerate(text.split()) for m in cluster]


def shared_of(spark, cases: dict):
    schema = "doc_key string, mention string, cluster_id int"
    key = spark.createDataFrame([r for n, (k, _) in cases.items() for r in rows(k, n)], schema)
    response = spark.createDataFrame([r for n, (_, r_) in cases.items() for r in rows(r_, n)], schema)
    return metrics.overlaps(key, response)


@pytest.fixture(scope="module")
def shared(spark):
    return shared_of(spark, CASES).cache()


@pytest.mark.parametrize("name", ["muc", "b_cubed", "ceaf_m", "ceaf_e"])
def test_golden_cases(shared, name):
    make = {"muc": metrics.muc, "b_cubed": metrics.b_cubed, "ceaf_m": lambda s: metrics.ceaf(s, False), "ceaf_e": lambda s: metrics.ceaf(s, True)}[name]
    found = {r["doc_key"]: r for r in metrics.scored(make(shared)).collect()}
    assert set(found) == set(CASES)
    for (case, metric), (recall, precision) in EXPECTED.items():
        if metric == name:
            assert abs(found[case]["recall"] - recall) + abs(found[case]["precision"] - precision) < 1e-4, case
    for case in ("A1", "H1") if name == "muc" else ("A1", "H1", "M1", "N1"):
        assert (found[case]["recall"], found[case]["precision"], found[case]["f1"]) == (1, 1, 1), case


def test_blanc(shared):
    found = {r["doc_key"]: r for r in metrics.blanc_scores(metrics.blanc(shared)).collect()}
    for case, f1 in BLANC.items():
        assert found[case]["f1"] == pytest.approx(f1, abs=1e-9), case


def brute(key: list, response: list) -> dict:
    k, r = {m: set(c) for c in key for m in c}, {m: set(c) for c in response for m in c}
    half = lambda a, b: sum(len(a[m] & b[m]) / len(a[m]) for m in a if m in b) / max(1, len(a))
    links = lambda own, other: (sum(len(c) - len({min(other[m]) if m in other else (m,) for m in map(str, c)}) for c in own), sum(len(c) - 1 for c in own))
    a, b = links(key, r), links(response, k)
    return {"b": (half(k, r), half(r, k)), "muc": (a[0] / a[1] if a[1] else 0, b[0] / b[1] if b[1] else 0)}


def test_random_clusterings(spark):
    rng = random.Random(3)
    cases, expected = {}, {}
    for n in range(40):
        def clustering(letters):
            groups = {}
            for c in letters:
                groups.setdefault(rng.randrange(4), []).append(c)
            return list(groups.values())

        key, response = clustering("abcdefgh"[: rng.randint(1, 8)]), clustering("cdefghij"[: rng.randint(1, 8)])
        cases[str(n)] = (" ".join("".join(c) for c in key), " ".join("".join(c) for c in response))
        expected[str(n)] = brute(key, response)
    shared = shared_of(spark, cases).cache()
    b = {r["doc_key"]: r for r in metrics.scored(metrics.b_cubed(shared)).collect()}
    m = {r["doc_key"]: r for r in metrics.scored(metrics.muc(shared)).collect()}
    for n, e in expected.items():
        assert b[n]["recall"] == pytest.approx(e["b"][0]) and b[n]["precision"] == pytest.approx(e["b"][1])
        assert m[n]["recall"] == pytest.approx(e["muc"][0]) and m[n]["precision"] == pytest.approx(e["muc"][1])


def permuted(gain):
    """The best one-to-one choice of a matrix, by trying all."""
    small, large = sorted(gain.shape)
    g = gain if gain.shape[0] == small else gain.T
    return max(sum(g[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        gain = rng.random(rng.integers(1, 6, 2)).round(rng.integers(1, 4)) * (rng.random() < 0.3 or rng.random() < 0.7)
        gain = gain * (rng.random(gain.shape) < 0.6)
        edges = [(int(i), int(j), gain[i, j]) for i, j in zip(*np.nonzero(gain))]
        assert metrics.best_assignment(edges) == pytest.approx(permuted(gain)), gain
    assert metrics.best_assignment([]) == 0


def test_alignments_against_all_permutations(spark):
    rng = random.Random(8)
    cases = {}
    for n in range(30):
        sides = []
        for letters in ("abcdefghij", "cdefghijkl"):
            groups = {}
            for c in letters[: rng.randint(1, 10)]:
                groups.setdefault(rng.randrange(5), []).append(c)
            sides.append(" ".join("".join(g) for g in groups.values()))
        cases[str(n)] = tuple(sides)
    shared = shared_of(spark, cases).cache()
    for entity in (False, True):
        found = {r["doc_key"]: r for r in metrics.ceaf(shared, entity).collect()}
        for n, (key, response) in cases.items():
            k, r = [set(c) for c in key.split()], [set(c) for c in response.split()]
            gain = np.array([[len(a & b) * (2 / (len(a) + len(b)) if entity else 1) for b in r] for a in k])
            row = found[n]
            assert row["r_num"] == row["p_num"] == pytest.approx(permuted(gain))
            assert (row["r_den"], row["p_den"]) == ((len(k), len(r)) if entity else (sum(map(len, k)), sum(map(len, r))))


def test_large_alignment_is_sparse():
    """Ten thousand clusters a side that hang together in one block, in memory that grows with the overlaps."""
    n = 10_000
    edges = [(k, k, 1.0) for k in range(n)] + [(k, (k + 1) % n, 1.0 + (k == n - 1)) for k in range(n)]
    tracemalloc.start()
    assert metrics.best_assignment(edges) == n + 1  # all shifted by one
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
