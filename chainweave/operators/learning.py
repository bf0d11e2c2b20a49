"""Training and scoring.

The log-linear model is trained with relational gradients: each pass scores all
pairs, normalises, sums expected feature counts and steps the weights, so the
data stay distributed and only the weights (a table) change. The neural models
are trained by numpy on the documents of one training set, given as an iterator
so that one document is held at a time; scoring with them is distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..storage import Scratch
from .pairs import by_mention, marked
from .scoring import expected_counts, marginals, with_scores

# -- the log-linear model, relational ----------------------------------------


def gold_marginals(pairs: DataFrame, gold: str = "coreferent") -> DataFrame:
    """``gold_marginal``: the model's probability renormalised over the gold antecedents, 0 for others."""
    from pyspark.sql import Window

    total = F.sum(F.when(F.col(gold), F.col("marginal")).otherwise(0.0)).over(Window.partitionBy("doc_key", "m"))
    return pairs.withColumn("gold_marginal", F.when(F.col(gold), F.coalesce(F.try_divide(F.col("marginal"), total), F.lit(0.0))).otherwise(F.lit(0.0)))


def adagrad_step(weights: DataFrame, gradient: DataFrame, rate: float = 1.0, l1: float = 0.001) -> DataFrame:
    """feat_idx, weight, squares after one step up the gradient with soft thresholding (L3).

    H = 1 + sqrt(sum of squared gradients); the step is rate / H, the threshold l1 * rate / H.
    """
    both = weights.join(gradient, "feat_idx", "full").select("feat_idx", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("weight", "squares", "gradient")))
    both = both.withColumn("squares", F.col("squares") + F.col("gradient") * F.col("gradient")).withColumn("h", 1 + F.sqrt("squares"))
    moved = both.withColumn("moved", F.col("weight") + rate * F.col("gradient") / F.col("h"))
    return moved.select("feat_idx", (F.signum("moved") * F.greatest(F.abs("moved") - l1 * rate / F.col("h"), F.lit(0.0))).alias("weight"), "squares")


def train_log_linear(pairs: DataFrame, epochs: int = 20, rate: float = 1.0, l1: float = 0.001) -> DataFrame:
    """feat_idx, weight, squares. ``pairs``: doc_key, m, a, feats array<int>, coreferent, loss.

    Scores are loss-augmented in training, as in the sequential trainer; each
    epoch's weights are stored, so the plan does not grow, and the ones before removed.
    """
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession, "log-linear")
    weights = spark.createDataFrame([], "feat_idx int, weight double, squares double")
    pairs = pairs.select("doc_key", "m", "feats", "coreferent", "loss")
    n = pairs.count()
    for k in range(epochs):
        augmented = with_scores(pairs, weights.select("feat_idx", "weight")).withColumn("score", F.col("score") + F.col("loss"))
        augmented = by_mention(augmented.drop("loss"), n)
        weights = scratch.store(adagrad_step(weights, expected_counts(gold_marginals(marginals(augmented))), rate, l1), f"weights-{k}")
        scratch.drop(f"weights-{k - 1}") if k else None
    return weights


@dataclass(frozen=True)
class TwoPasses:
    """Weights of both passes, and the pairs with what the first one thinks of them: score, pruned."""

    coarse: DataFrame
    fine: DataFrame
    pairs: DataFrame


def train_in_two_passes(coarse: DataFrame, fine: Callable[[DataFrame], DataFrame], strategy: str = "c2flogratio:2", epochs: int = 20, rate: float = 1.0, l1: float = 0.001) -> TwoPasses:
    """Coarse weights prune the pairs, ``fine`` featurizes what is left with its own index, fine weights are trained.

    ``coarse``: as ``train_log_linear`` takes it. ``fine`` gets the pairs that stay, with all columns of ``coarse``, and
    returns them with feats. Every mention keeps its best pair. What a pass reads is stored once and removed after it.
    """
    scratch = Scratch(coarse.sparkSession, "two-passes")
    coarse = scratch.store(coarse, "coarse")
    first = train_log_linear(coarse, epochs, rate, l1)
    pairs = scratch.store(marked(by_mention(with_scores(coarse, first.select("feat_idx", "weight")), coarse.count()), strategy), "marked")
    featurized = scratch.store(fine(pairs.where("not pruned").drop("score", "pruned")), "fine")
    second = train_log_linear(featurized, epochs, rate, l1)
    scratch.close("marked")
    return TwoPasses(first, second, pairs.select("doc_key", "m", "a", "coreferent", "loss", "score", "pruned"))


def binary_gradient(pairs: DataFrame, negative_weight: float = 1.0) -> DataFrame:
    """Gradient of the logistic likelihood of single pairs (L5). ``pairs``: feats, score, coreferent."""
    p = 1 / (1 + F.exp(-F.col("score")))
    d = F.when(F.col("coreferent"), 1 - p).otherwise(-negative_weight * p)
    return pairs.select(F.explode("feats").alias("feat_idx"), d.alias("d")).groupBy("feat_idx").agg(F.sum("d").alias("gradient"))


# -- networks ------------------------------------------------------------------


class AdaGrad:
    """x -= rate * g / (sqrt(sum g^2) + 1e-10)."""

    def __init__(self, rate: float):
        self.rate, self.squares = rate, {}

    def step(self, name: str, x: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        s = self.squares.setdefault(name, np.zeros_like(x))
        at = slice(None) if rows is None else rows
        s[at] += g * g
        x[at] -= self.rate * g / (np.sqrt(s[at]) + 1e-10)


def sparse_normal(rng: np.random.Generator, rows: int, columns: int, nonzero: int = 15, scale: float = 0.25) -> np.ndarray:
    """In each column so many entries of scaled normal draws, the others 0."""
    w = np.zeros((rows, columns))
    for c in range(columns):
        at = rng.choice(rows, min(nonzero, rows), replace=False)
        w[at, c] = scale * rng.standard_normal(len(at))
    return w


class SparseMlp:
    """tanh of the summed rows of a table, then a linear layer (L12, D23). The last row is the dummy's and stays 0."""

    def __init__(self, features: int, hidden: int, seed: int = 0, dense: int = 0):
        rng = np.random.default_rng(seed)
        self.w = sparse_normal(rng, features, hidden)
        self.w[-1] = 0
        self.b = np.full(hidden, 0.5)
        self.v = sparse_normal(rng, dense, hidden) if dense else np.zeros((0, hidden))
        self.u, self.c = sparse_normal(rng, hidden, 1)[:, 0], 0.5

    def hidden(self, feats: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
        h = self.w[feats].sum(1) + self.b
        return np.tanh(h if dense is None else h + dense @ self.v)

    def scores(self, feats: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
        return self.hidden(feats, dense) @ self.u + self.c

    def learn(self, opt: AdaGrad, name: str, feats: np.ndarray, h: np.ndarray, d_score: np.ndarray | None, d_hidden: np.ndarray | None = None, dropped: np.ndarray | None = None) -> None:
        """One step from the gradients of the scores or the hidden layer."""
        d_h = np.zeros_like(h) if d_hidden is None else d_hidden.copy()
        if d_score is not None:
            seen = h if dropped is None else h * dropped
            d_h += np.outer(d_score, self.u) * (1 if dropped is None else dropped)
            opt.step(f"{name}.u", self.u, seen.T @ d_score)
            c = np.array([self.c])
            opt.step(f"{name}.c", c, np.array([d_score.sum()]))
            self.c = float(c[0])
        d_in = d_h * (1 - h * h)
        opt.step(f"{name}.b", self.b, d_in.sum(0))
        rows, back = np.unique(feats, return_inverse=True)
        g = np.zeros((len(rows), self.w.shape[1]))
        np.add.at(g, back.reshape(feats.shape), d_in[:, None, :])
        opt.step(f"{name}.w", self.w, g, rows)
        self.w[-1] = 0


@dataclass
class Document:
    """A training document: one vector for each mention, the vectors of pairs (m, a), a < m, and gold clusters."""

    mentions: np.ndarray
    pairs: np.ndarray
    clusters: np.ndarray

    def pairs_of(self, m: int) -> np.ndarray:
        return self.pairs[m * (m - 1) // 2 : m * (m - 1) // 2 + m]

    def gold(self, m: int) -> np.ndarray:
        return np.flatnonzero(self.clusters[:m] == self.clusters[m])


def anaphoricity_epoch(model: SparseMlp, docs: Iterable[Document], opt: AdaGrad, false_anaphor: float = 1.0, false_new: float = 1.35) -> float:
    """Slack-rescaled hinge on whether a mention has an antecedent (L15, X34); the first never has. Returns the loss."""
    total = 0.0
    for d in docs:
        feats = d.mentions
        y = np.array([1.0 if len(d.gold(m)) else -1.0 for m in range(len(feats))])
        h = model.hidden(feats)
        cost = np.where(y > 0, false_new, false_anaphor)
        slack = 1 - y * (h @ model.u + model.c)
        total += float((cost * np.maximum(slack, 0)).sum())
        model.learn(opt, "ana", feats, h, np.where(slack > 0, -cost * y, 0.0))
    return total


def antecedent_epoch(model: SparseMlp, docs: Iterable[Document], opt: AdaGrad, keep: float = 0.5, seed: int = 0) -> float:
    """Margin between the best gold antecedent and the best other, of anaphoric mentions."""
    rng, total = np.random.default_rng(seed), 0.0
    for d in docs:
        for m in range(1, len(d.mentions)):
            gold = d.gold(m)
            if not len(gold):
                continue
            feats = d.pairs_of(m)
            h = model.hidden(feats)
            drop = (rng.random(h.shape) < keep) / keep
            s = (h * drop) @ model.u + model.c
            late = gold[s[gold].argmax()]
            wrong = np.ones(m)
            wrong[gold] = 0
            margin = wrong * (1 + s - s[late])
            worst = int(margin.argmax())
            if margin[worst] > 0:
                total += float(margin[worst])
                g = np.zeros(m)
                g[worst], g[late] = 1, -1
                model.learn(opt, "ante", feats, h, g, dropped=drop)
    return total


@dataclass
class Lstm:
    """One LSTM layer; gates in the order input, forget, output, candidate."""

    size: int
    inputs: int
    seed: int = 0
    w: np.ndarray = field(init=False)

    def __post_init__(self):
        self.w = np.random.default_rng(self.seed).uniform(-0.08, 0.08, (self.inputs + self.size + 1, 4 * self.size))

    def forward(self, x: np.ndarray, h: np.ndarray, c: np.ndarray):
        z = np.concatenate([x, h, [1.0]])
        i, f, o, g = np.split(z @ self.w, 4)
        i, f, o, g = 1 / (1 + np.exp(-i)), 1 / (1 + np.exp(-f)), 1 / (1 + np.exp(-o)), np.tanh(g)
        c2 = f * c + i * g
        return o * np.tanh(c2), c2, (z, i, f, o, g, c, c2)

    def backward(self, dh: np.ndarray, dc: np.ndarray, saved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the input, the state before, and the weights."""
        z, i, f, o, g, c, c2 = saved
        t = np.tanh(c2)
        dc = dc + dh * o * (1 - t * t)
        d = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)])
        dz = self.w @ d
        return dz[: self.inputs], dz[self.inputs : -1], dc * f, np.outer(z, d)


class Ranker:
    """Scores each antecedent and the new cluster (L17); with ``state`` > 0 also against cluster states."""

    def __init__(self, pair_features: int, mention_features: int, hidden_pair: int = 700, hidden_mention: int = 200, state: int = 0, seed: int = 0):
        self.pair = SparseMlp(pair_features, hidden_pair, seed)
        self.mention = SparseMlp(mention_features, hidden_mention, seed + 1)
        self.new = SparseMlp(mention_features, hidden_mention, seed + 2)
        self.lstm = Lstm(state, hidden_mention, seed + 3) if state else None
        rng = np.random.default_rng(seed + 4)
        self.match = 0.1 * rng.standard_normal((hidden_mention, state)) if state else None

    def scores(self, d: Document, m: int, states: list | None) -> np.ndarray:
        """Of antecedents 0..m-1, then of a new cluster."""
        s = self.pair.scores(d.pairs_of(m)) if m else np.zeros(0)
        new = self.new.scores(d.mentions[m : m + 1])[0]
        if states is not None and m:
            e = self.mention.hidden(d.mentions[m : m + 1])[0] @ self.match
            s = s + np.array([e @ states[a][0] for a in range(m)])
        return np.append(s, new)

    def cluster_states(self, d: Document, m: int, a: int, states: list) -> None:
        """Adds mention m to a's cluster: all its members get the new state."""
        e = self.mention.hidden(d.mentions[m : m + 1])[0]
        h, c = (np.zeros(self.lstm.size),) * 2 if a == m else states[a][:2]
        h, c, _ = self.lstm.forward(e, h, c)
        members = [m] if a == m else [*states[a][2], m]
        states.append((h, c, members))
        for k in members:
            states[k] = (h, c, members)

    def decode(self, d: Document) -> list[int]:
        """Back-pointers, greedily from left to right; new must be strictly better."""
        out, states = [], [] if self.lstm else None
        for m in range(len(d.mentions)):
            s = self.scores(d, m, states)
            a = m if m == 0 or s[m] > s[:m].max() else int(s[:m].argmax())
            out.append(a)
            if states is not None:
                self.cluster_states(d, m, a, states)
        return out

    def epoch(self, docs: Iterable[Document], opt: AdaGrad, false_link: float = 0.5, false_new: float = 1.2, wrong_link: float = 1.0, clip: float = 10.0) -> float:
        """Latent antecedents with mistake-specific costs (W10, W11); gold cluster states are given, and trained through time."""
        total = 0.0
        for d in docs:
            states, saved, d_state = ([], [], {}) if self.lstm else (None, None, None)
            for m in range(len(d.mentions)):
                gold = d.gold(m)
                if m:
                    s = self.scores(d, m, states)
                    right = gold if len(gold) else np.array([m])
                    late = right[s[right].argmax()]
                    cost = np.full(m + 1, wrong_link if len(gold) else false_link)
                    cost[m] = false_new if len(gold) else 0.0
                    cost[right] = 0
                    margin = cost * (1 + s - s[late])
                    worst = int(margin.argmax())
                    if margin[worst] > 0:
                        total += float(margin[worst])
                        g = np.zeros(m + 1)
                        g[worst] += cost[worst]
                        g[late] -= cost[worst]
                        g = np.clip(g, -clip, clip)
                        feats = d.pairs_of(m)
                        if g[:m].any():
                            used = np.flatnonzero(g[:m])
                            self.pair.learn(opt, "pair", feats[used], self.pair.hidden(feats[used]), g[used])
                        if g[m]:
                            own = d.mentions[m : m + 1]
                            self.new.learn(opt, "new", own, self.new.hidden(own), g[m : m + 1])
                        if states is not None and g[:m].any():
                            own = d.mentions[m : m + 1]
                            h = self.mention.hidden(own)
                            pull = sum((g[a] * states[a][0] for a in np.flatnonzero(g[:m])), np.zeros(self.lstm.size))
                            for a in np.flatnonzero(g[:m]):
                                last = states[a][2][-1]
                                d_state[last] = d_state.get(last, 0) + g[a] * (h[0] @ self.match)
                            d_h = (self.match @ pull)[None]
                            opt.step("match", self.match, np.outer(h[0], pull))
                            self.mention.learn(opt, "mention", own, h, None, d_h)
                if states is not None:
                    a = int(gold[-1]) if len(gold) else m
                    before = None if a == m else states[a][2][-1]
                    e = self.mention.hidden(d.mentions[m : m + 1])[0]
                    h0, c0 = (np.zeros(self.lstm.size),) * 2 if a == m else states[a][:2]
                    saved.append((before, self.lstm.forward(e, h0, c0)[2]))
                    self.cluster_states(d, m, a, states)
            if states is not None:
                self._through_time(d, saved, d_state, opt, clip)
        return total

    def _through_time(self, d: Document, saved: list, d_state: dict, opt: AdaGrad, clip: float) -> None:
        grad, d_cell = np.zeros_like(self.lstm.w), {}
        for m in range(len(saved) - 1, -1, -1):
            before, kept = saved[m]
            if m not in d_state and m not in d_cell:
                continue
            dx, dh, dc, dw = self.lstm.backward(d_state.get(m, np.zeros(self.lstm.size)), d_cell.get(m, np.zeros(self.lstm.size)), kept)
            grad += dw
            own = d.mentions[m : m + 1]
            self.mention.learn(opt, "mention", own, self.mention.hidden(own), None, dx[None])
            if before is not None:
                d_state[before] = d_state.get(before, 0) + dh
                d_cell[before] = d_cell.get(before, 0) + dc
        if grad.any():
            opt.step("lstm", self.lstm.w, np.clip(grad, -clip, clip))


def scored_vectors(vectors: DataFrame, model: SparseMlp, feats: str = "feats") -> DataFrame:
    """All columns and ``score``: the network's value of each vector (L12, G28). The model is of a fixed size and broadcast."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", score double"
    at = vectors.columns.index(feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            column, n = batch.column(at), batch.num_rows
            if column.null_count or len(pc.unique(pc.list_value_length(column))) > 1:
                raise ValueError("vectors of one length are needed")
            x = column.flatten().to_numpy(zero_copy_only=False)
            scores = net.scores(np.minimum(x.reshape(n, -1), len(net.w) - 1)) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return vectors.mapInArrow(run, schema)


def training_documents(mentions: DataFrame, pairs: DataFrame, clusters: DataFrame) -> Iterator[Document]:
    """The documents of a training set one by one, in order of their keys."""
    m = mentions.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("m", "feats"))).alias("ms"))
    p = pairs.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("m", "a", "feats"))).alias("ps"))
    c = clusters.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("ment_idx", "cluster_id"))).alias("cs"))
    for row in m.join(p, "doc_key", "left").join(c, "doc_key").orderBy("doc_key").toLocalIterator():
        own = np.array([x["feats"] for x in row["ms"]])
        both = np.array([x["feats"] for x in row["ps"]]) if row["ps"] else np.zeros((0, 1), int)
        yield Document(own, both, np.array([x["cluster_id"] for x in row["cs"]]))


def dirichlet(rng: np.random.Generator, alpha: np.ndarray, right: int, confidence: float = 4.0) -> np.ndarray:
    """A noisy distribution around a known value: gamma draws, the known place's weight raised."""
    draws = rng.gamma(np.asarray(alpha, float) + confidence * (np.arange(len(alpha)) == right))
    return draws / draws.sum()
