"""Inference and training on data small enough to know the answer."""

import numpy as np

from chainweave.operators import learning, sequential


def document(rng, n=8, groups=3):
    c = rng.integers(0, groups, n)
    same = lambda m, a: c[m] == c[a]
    first = [int((c[:m] == c[m]).any()) for m in range(n)]
    return learning.Document(np.array([[f, 2 + k % 3] for k, f in enumerate(first)]), np.array([[int(same(m, a)), 2] for m in range(n) for a in range(m)]), c)


def test_best_sequence_forbids_stray_inside():
    labels = ["O", "B-X", "I-X"]
    scores = np.array([[0.0, 0.1, 5.0], [0.0, 0.0, 5.0], [3.0, 0.0, 0.0]])
    assert sequential.best_sequence(scores, labels) == ["B-X", "I-X", "O"]


def test_lstm_gradient():
    cell = learning.Lstm(3, 2, 1)
    rng = np.random.default_rng(0)
    x, h, c, d = rng.random(2), rng.random(3), rng.random(3), rng.random(3)
    _, _, saved = cell.forward(x, h, c)
    dx, dh, dc, dw = cell.backward(d, np.zeros(3), saved)
    for at in ((0, 0), (3, 5), (5, 11)):
        e = 1e-6
        cell.w[at] += e
        up = cell.forward(x, h, c)[0] @ d
        cell.w[at] -= 2 * e
        down = cell.forward(x, h, c)[0] @ d
        cell.w[at] += e
        assert abs((up - down) / (2 * e) - dw[at]) < 1e-6


def test_networks_learn():
    rng = np.random.default_rng(5)
    docs = [document(rng) for _ in range(30)]
    ana = learning.SparseMlp(6, 8)
    opt = learning.AdaGrad(0.1)
    losses = [learning.anaphoricity_epoch(ana, docs, opt) for _ in range(6)]
    assert losses[-1] < losses[0] and not ana.w[-1].any()
    ante = learning.SparseMlp(4, 8)
    opt = learning.AdaGrad(0.1)
    losses = [learning.antecedent_epoch(ante, docs, opt) for _ in range(6)]
    assert losses[-1] < losses[0]
    for state in (0, 4):
        ranker = learning.Ranker(4, 6, 8, 8, state)
        opt = learning.AdaGrad(0.1)
        losses = [ranker.epoch(docs, opt) for _ in range(8)]
        assert losses[-1] < 0.5 * losses[0]
        right = sum(d.clusters[a] == d.clusters[m] if a < m else not len(d.gold(m)) for d in docs for m, a in enumerate(ranker.decode(d)))
        assert right > 0.9 * sum(len(d.clusters) for d in docs)


def test_log_linear_training(spark):
    rows = []
    for doc in range(6):
        for m in range(1, 6):
            for a in range(m + 1):
                good = a == m - 1
                rows.append((doc, m, a, [1 if good else 2, 3 if a == m else 4], good, 0.0 if good else 1.0))
    pairs = spark.createDataFrame(rows, "doc_key int, m long, a long, feats array<int>, coreferent boolean, loss double").cache()
    weights = {r["feat_idx"]: r["weight"] for r in learning.train_log_linear(pairs, epochs=4).collect()}
    assert weights[1] > 0 > weights[2]
