"""Loopy belief propagation over a typed factor graph, as joins and groupings.

Every mention has a node for its antecedent and, for each property, one for the
value that coreference makes agree; a property may be observed at a node of its
own that a projection ties to it. Factors are rows, messages their columns:

* unary factors: given potentials, agreement with a stated value, or features of
  each value (``given``, ``agreeing``, ``featured``);
* the agreement factor of two nodes: a grid of weights (``Property.projection``);
* the property factor of three nodes (the antecedent, the mention's property and
  that of one candidate): its grid counts if that candidate is chosen; and the
  hard one, which then allows equal values only (``Property.grid``).

A message to an antecedent node differs from a constant at one value only, so it
is one number on the row of that candidate; messages to properties are a column
for each value. A round groups messages by node and joins the nodes' beliefs back to the
factors: keys are mentions and pairs, so no document is held by a task, and each
round ends in a stored table. Which messages a round sends is the schedule's.

Where pairs can be made from their mentions (``propagate_made``), no message is kept: it
follows from the pair's score and what each round told the two mentions, so a round makes the
pairs with that again, and only mentions and their sums are shuffled and stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from math import exp, inf
from random import Random

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import Scratch

ROUNDS = 5
#: Log weight of what can't be.
NEVER = -1e9
Grid = list[list[float]]
Names = list[list[list[str]]]

# -- grids: names of features for each pair of values, and weights -----------------


def names_of_grid(kind: str, size: int, prefix: str, other: int | None = None, conjunctions: tuple[str, str] = ("", "")) -> Names:
    """The features of each pair of values.

    ``agree``: equal or not; ``custom``: equal, by value, or not; ``source``: equal or
    not, by the first value; ``half``: the unordered pair; ``full``: the pair; ``fine``: the pair,
    alone and with one and two conjunctions; ``empty``: none. ``other``: values of the second node.
    """
    current, previous = conjunctions
    rules = {
        "agree": lambda i, j: [f"{prefix}Agree" if i == j else f"{prefix}Disagree"],
        "custom": lambda i, j: [f"{prefix}Agree-{i}" if i == j else f"{prefix}Disagree"],
        "source": lambda i, j: [f"{prefix}{'Agree' if i == j else 'Disagree'}-{i}"],
        "half": lambda i, j: [f"{prefix}-{min(i, j)}-{max(i, j)}"],
        "full": lambda i, j: [f"{prefix}-{i}-{j}"],
        "fine": lambda i, j: [f"{prefix}-{i}-{j}", f"{prefix}-{i}-{j}&{current}", f"{prefix}-{i}-{j}&{current}&{previous}"],
        "empty": lambda i, j: [],
    }
    return [[rules[kind](i, j) for j in range(other or size)] for i in range(size)]


def default_grid(kind: str, size: int, other: int | None = None, weight: float = 1.0, seed: int = 0) -> Grid:
    """Weights before any feature's: ``zero``, ``forced`` agreement, ``agreement`` by a weight, or ``epsilon``, small random ones."""
    draw = Random(seed)
    rules = {"zero": lambda same: 0.0, "forced": lambda same: 0.0 if same else NEVER, "agreement": lambda same: weight if same else 0.0, "epsilon": lambda same: (draw.random() - 0.5) * 0.01}
    if kind in ("forced", "agreement") and other not in (None, size):
        raise ValueError("only values of one domain can agree")
    return [[rules[kind](i == j) for j in range(other or size)] for i in range(size)]


def weighted_grid(names: Names, weights: dict[str, float], defaults: Grid) -> Grid:
    """Log weights of all pairs of values."""
    return [[d + sum(weights.get(n, 0.0) for n in own) for own, d in zip(row, line)] for row, line in zip(names, defaults)]


@dataclass(frozen=True)
class Property:
    """A property: its column of potentials (array of ``size``), the grid of its link factors, and how it is observed."""

    name: str
    size: int
    #: Log weights of the values of mention and candidate; None: they must be equal (the hard factor).
    grid: tuple | list | None = None
    #: Log weights of the observed value (row) and the property; None: the potentials are the property's own.
    projection: tuple | list | None = None

    def potentials(self) -> Grid:
        if self.grid is None:
            return [[float(i == j) for j in range(self.size)] for i in range(self.size)]
        return [[exp(w) for w in row] for row in self.grid]


# -- unary factors -----------------------------------------------------------------


def given(potentials: Column) -> Column:
    """Potentials as they are."""
    return potentials


def agreeing(value: Column, domain: Iterable[str], agree: float, disagree: float) -> Column:
    """exp of one weight at the stated value, of another elsewhere."""
    return F.array(*(F.when(value == v, F.lit(exp(agree))).otherwise(F.lit(exp(disagree))) for v in domain))


def featured(prediction: Column, domain: Iterable[str], weights: dict[str, float], hit: float = 0.0) -> Column:
    """exp of the weight of ``value-p=prediction`` and, at the predicted value, of ``hit`` more."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map().cast("map<string,double>")
    own = lambda v: F.coalesce(F.try_element_at(table, F.concat(F.lit(f"ORIGCOMPATIBLE:{v}-p="), prediction)), F.lit(0.0))
    return F.array(*(F.exp(own(v) + F.when(prediction == v, F.lit(hit)).otherwise(F.lit(0.0))) for v in domain))


# -- rows of values -------------------------------------------------------------------
#
# A message to a property is one column for each value, so that all of a round's
# arithmetic is plain expressions on columns.


def _names(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(width)]


def _cols(prefix: str, width: int) -> list[Column]:
    return [F.col(n) for n in _names(prefix, width)]


def _sum(values: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _top(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def _with_chances(rows: DataFrame, **logs: list[Column]) -> DataFrame:
    """The softmax of rows of values, in steps, so that none is computed again for each of its values."""
    width = len(next(iter(logs.values())))
    rows = rows.withColumns({f"{n}{k}": x for n, xs in logs.items() for k, x in enumerate(xs)})
    rows = rows.withColumns({f"_top_{n}": _top(_cols(n, width)) for n in logs})
    rows = rows.withColumns({f"{n}{k}": F.exp(F.col(f"{n}{k}") - F.col(f"_top_{n}")) for n in logs for k in range(width)})
    rows = rows.withColumns({f"_sum_{n}": _sum(_cols(n, width)) for n in logs})
    return rows.withColumns({f"{n}{k}": F.col(f"{n}{k}") / F.col(f"_sum_{n}") for n in logs for k in range(width)}).drop(*(f"_{x}_{n}" for n in logs for x in ("top", "sum")))


def _by_property(values: list[float]) -> Column:
    """A number for each property, by the column c."""
    out = F.lit(float(values[-1]))
    for c in range(len(values) - 2, -1, -1):
        if values[c] != values[-1] or any(v != values[-1] for v in values[c:]):
            out = F.when(F.col("c") == c, F.lit(float(values[c]))).otherwise(out)
    return out


# -- the graph ----------------------------------------------------------------------

PAIR, NODE = ["doc_key", "m", "a"], ["doc_key", "node", "c"]


class Beliefs:
    """Messages of the last round, and what is read from them."""

    def __init__(self, choices: DataFrame, base: DataFrame, observed: DataFrame, messages: DataFrame, properties: list[Property]):
        self.choices, self.base, self.observed, self.messages, self.properties = choices, base, observed, messages, properties
        self.width = max(p.size for p in properties)
        self.grids = [_padded(p.potentials(), self.width, 1.0) for p in properties]

    def grid(self, i: int, j: int) -> Column:
        return _by_property([g[i][j] for g in self.grids])

    def nodes(self, messages: DataFrame, base: DataFrame) -> DataFrame:
        """doc_key, node, c, b0, b1, ... (log beliefs, not normalised), moved (the largest change among its messages)."""
        w = self.width
        side = lambda name, to: messages.select("doc_key", F.col(name).alias("node"), "c", *(F.col(f"{to}{k}").alias(f"t{k}") for k in range(w)), "change")
        sums = side("m", "to_m").unionByName(side("a", "to_a")).groupBy(NODE).agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(w)), F.max("change").alias("moved"))
        return base.join(sums, NODE, "left").select(*NODE, *((F.col(f"base{k}") + F.coalesce(f"t{k}", F.lit(0.0))).alias(f"b{k}") for k in range(w)), "moved")

    def chosen(self, messages: DataFrame) -> DataFrame:
        """doc_key, m, a, marginal, moved_m."""
        sent = messages.groupBy(PAIR).agg(F.sum("to_choice").alias("sent"), F.max("change").alias("change"))
        weighed = self.choices.join(sent, PAIR, "left").withColumn("w", F.col("score") + F.coalesce("sent", F.lit(0.0)))
        own = Window.partitionBy("doc_key", "m")
        weighed = weighed.withColumn("e", F.exp(F.col("w") - F.max("w").over(own)))
        return weighed.select(*PAIR, (F.col("e") / F.sum("e").over(own)).alias("marginal"), F.max("change").over(own).alias("moved_m"))

    def met(self, messages: DataFrame, base: DataFrame) -> DataFrame:
        """Every link factor with what its nodes send it: q_m0.., q_a0.. (chances of the values), chosen (that of the candidate), moved."""
        w, nodes, choice = self.width, self.nodes(messages, base), self.chosen(messages)
        at = lambda name: nodes.select("doc_key", F.col("node").alias(name), "c", *(F.col(f"b{k}").alias(f"b_{name}{k}") for k in range(w)), F.col("moved").alias(f"moved_of_{name}"))
        rows = messages.join(choice, PAIR).join(at("m"), ["doc_key", "m", "c"]).join(at("a"), ["doc_key", "a", "c"])
        rows = _with_chances(rows, **{f"q_{x}": [F.col(f"b_{x}{k}") - F.col(f"to_{x}{k}") for k in range(w)] for x in "ma"})
        without = F.col("marginal") * F.exp(-F.col("to_choice"))
        return rows.select(*messages.columns, *_names("q_m", w), *_names("q_a", w), (without / (without + 1 - F.col("marginal"))).alias("chosen"), F.greatest("moved_m", "moved_of_m", "moved_of_a").alias("moved"))

    def sent(self, messages: DataFrame, base: DataFrame, tolerance: float | None) -> DataFrame:
        """The messages of the next round. With a tolerance a factor none of whose nodes has moved by more sends nothing new."""
        n = range(self.width)
        rows = self.met(messages, base)
        rows = rows.withColumns({f"x{i}": _sum(self.grid(i, j) * F.col(f"q_a{j}") for j in n) for i in n} | {f"y{j}": _sum(self.grid(i, j) * F.col(f"q_m{i}") for i in n) for j in n})
        mixed = lambda x: _log(F.col("chosen") * F.col(x) + 1 - F.col("chosen"))
        new = {"to_choice": _log(_sum(F.col(f"q_m{i}") * F.col(f"x{i}") for i in n))} | {f"to_m{k}": mixed(f"x{k}") for k in n} | {f"to_a{k}": mixed(f"y{k}") for k in n}
        quiet = F.lit(False) if tolerance is None else F.col("moved") <= tolerance
        rows = rows.select("doc_key", "m", "a", "c", *(F.when(quiet, F.col(c)).otherwise(x).alias(f"new_{c}") for c, x in new.items()), *new)
        # messages to properties are the same up to a factor, so they are compared without it
        rows = rows.withColumns({f"d_{x}{k}": F.col(f"new_to_{x}{k}") - F.col(f"to_{x}{k}") for x in "ma" for k in n})
        spread = lambda x: _top(_cols(f"d_{x}", self.width)) - (F.least(*_names(f"d_{x}", self.width)) if self.width > 1 else F.col(f"d_{x}0"))
        change = F.greatest(F.abs(F.col("new_to_choice") - F.col("to_choice")), spread("m"), spread("a"))
        return rows.select("doc_key", "m", "a", "c", change.alias("change"), *(F.col(f"new_{c}").alias(c) for c in new))

    def marginals(self) -> DataFrame:
        """doc_key, m, a, marginal."""
        return self.chosen(self.messages).drop("moved_m")

    def values(self) -> DataFrame:
        """doc_key, ment_idx, property, chances of its values, the place of the largest (the first of equals)."""
        rows = _with_chances(self.nodes(self.messages, self.base), q=_cols("b", self.width))
        return self._named(rows).withColumn("best", F.array_position("chances", F.array_max("chances")) - 1)

    def observations(self) -> DataFrame:
        """As ``values`` of the nodes at which projected properties are observed: what coreference says about the observation, by the last round's messages."""
        n = range(self.width)
        rows = self.nodes(self.messages, self.base).join(self.observed, NODE).where("projected")
        possible = [[0.0 if k < p.size else NEVER for k in n] for p in self.properties]
        rows = _with_chances(rows, l=[F.col(f"b{k}") - F.col(f"base{k}") + _by_property([x[k] for x in possible]) for k in n])
        tables = [_padded([[exp(w) for w in row] for row in (p.projection or default_grid("zero", p.size))], self.width, 1.0) for p in self.properties]
        rows = rows.withColumns({f"back{o}": _sum(_by_property([t[o][k] for t in tables]) * F.col(f"l{k}") for k in n) for o in n})
        return self._named(_with_chances(rows, q=[_log(F.col(f"phi{k}") * F.col(f"back{k}")) for k in n]))

    def _named(self, rows: DataFrame) -> DataFrame:
        sizes, names = F.array(*(F.lit(p.size) for p in self.properties)), F.array(*(F.lit(p.name) for p in self.properties))
        return rows.select("doc_key", F.col("node").alias("ment_idx"), names[F.col("c")].alias("property"), F.slice(F.array(*_names("q", self.width)), F.lit(1), sizes[F.col("c")]).alias("chances"))

    def expected_counts(self, names: list[Names]) -> DataFrame:
        """feature, expected: how often each grid feature holds, over all link factors (G10). ``names``: for each property."""
        w = self.width
        cells = {i * w + j: F.col("chosen") * self.grid(i, j) * F.col(f"q_m{i}") * F.col(f"q_a{j}") for i in range(w) for j in range(w)}
        rows = self.met(self.messages, self.base).withColumns({f"e{k}": x for k, x in cells.items()})
        rows = rows.withColumn("z", _sum(_cols("e", w * w)) + 1 - F.col("chosen"))
        sums = rows.groupBy("c").agg(*(F.sum(F.col(f"e{k}") / F.col("z")).alias(f"e{k}") for k in cells))
        listed = [(c, i * w + j, name) for c, grid in enumerate(names) for i, row in enumerate(grid) for j, own in enumerate(row) for name in own]
        where = sums.sparkSession.createDataFrame(listed, "c int, k int, feature string")  # a grid's features
        counts = sums.select("c", F.posexplode(F.array(*_names("e", w * w))).alias("k", "expected"))
        return counts.join(F.broadcast(where), ["c", "k"]).groupBy("feature").agg(F.sum("expected").alias("expected"))


def _padded(grid: Grid, width: int, rest: float) -> Grid:
    return [[grid[i][j] if i < len(grid) and j < len(grid[0]) else rest for j in range(width)] for i in range(width)]


def _based(p: Property) -> tuple[list[Column], list[Column]]:
    """Of one property its potentials as observed, and the logs of what these make of the property itself."""
    own = [F.get(F.col(f"`{p.name}`"), k) for k in range(p.size)]
    tied = own if p.projection is None else [_sum(x * F.lit(exp(row[k])) for x, row in zip(own, p.projection)) for k in range(p.size)]
    return own, [_log(x) for x in tied]


def _observed(mentions: DataFrame, properties: list[Property]) -> DataFrame:
    """doc_key, node, c, base0.. (of the property itself), phi0.. (as observed), projected."""
    n = range(max(p.size for p in properties))

    def described(c: int, p: Property) -> Column:
        own, logs = _based(p)
        at = lambda values, k, rest: values[k] if k < p.size else F.lit(rest)
        return F.struct(F.lit(c).alias("c"), *(at(logs, k, NEVER).alias(f"base{k}") for k in n), *(at(own, k, 0.0).cast("double").alias(f"phi{k}") for k in n), F.lit(p.projection is not None).alias("projected"))

    rows = F.explode(F.array(*(described(c, p) for c, p in enumerate(properties))))
    return mentions.select("doc_key", F.col("ment_idx").alias("node"), rows.alias("x")).select("doc_key", "node", "x.*")


def propagate(choices: DataFrame, mentions: DataFrame, properties: list[Property], rounds: int = ROUNDS, tolerance: float | None = None) -> Beliefs:
    """Rounds of messages between all nodes and factors.

    ``choices``: doc_key, m, a (a = m: new), score. ``mentions``: doc_key, ment_idx and
    for each property a column of its name with an array of potentials. In a round
    all nodes send, then all factors. An observed node and its projection have one
    message that never changes, sent in the first round; it counts from the second on.

    With a tolerance only factors at nodes that moved by more send again, and a
    document in which none did leaves the rounds: the sets that remain are stored tables.
    """
    scratch = Scratch(choices.sparkSession, "factor-graph")
    width = max(p.size for p in properties)
    choices = scratch.store(choices.select(*PAIR, "score"), "choices")
    n = range(width)
    observed = scratch.store(_observed(mentions, properties), "observed")
    base = observed.select(*NODE, *_names("base", width))
    start = observed.select(*NODE, *(F.when(F.col("projected") & (F.col(f"base{k}") > NEVER), F.lit(0.0)).otherwise(F.col(f"base{k}")).alias(f"base{k}") for k in n))
    links = choices.where("a <> m").select(*PAIR, F.explode(F.array(*(F.lit(c) for c in range(len(properties))))).alias("c"))
    silent = [F.lit(0.0).alias(c) for c in ("to_choice", *_names("to_m", width), *_names("to_a", width))]
    live = scratch.store(links.select("*", F.lit(inf).alias("change"), *silent), "round-0")
    graph, done = Beliefs(choices, base, observed.select(*NODE, *_names("base", width), *_names("phi", width), "projected"), live, properties), []
    for k in range(rounds):
        after = scratch.store(graph.sent(live, base if k else start, tolerance if k else None), f"round-{k + 1}")
        scratch.drop(f"round-{k}") if k or not done else None
        live = after
        if tolerance is not None and k:
            still = scratch.store(live.where(F.col("change") > tolerance).select("doc_key").distinct(), f"moving-{k}")
            done.append(scratch.store(live.join(still, "doc_key", "left_anti"), f"done-{k}"))
            live = scratch.store(live.join(still, "doc_key", "left_semi"), f"live-{k}")
            if live.isEmpty():
                break
    for part in done:
        live = live.unionByName(part)
    graph.messages = live
    scratch.close(*(n for n in scratch.names if n in ("choices", "observed") or n.startswith(("done-", "live-", "round-"))))
    return graph


# -- messages made again -------------------------------------------------------------


#: Logs of weights are summed as so many bands, so that neither the largest nor the smallest sum leaves the range of doubles.
BAND = 512.0
TINY = 1e-300


class Remade(Beliefs):
    """Beliefs of ``propagate_made``. ``told`` of a mention: for each round the log of the sum of its choices' weights and, relative to the best, the beliefs in its values."""

    def __init__(self, paired: Callable[[DataFrame, list[str]], DataFrame], mentions: DataFrame, properties: list[Property], rounds: int):
        observed = _observed(mentions, properties)
        super().__init__(None, observed.select(*NODE, *_names("base", max(p.size for p in properties))), observed, None, properties)
        self.paired, self.mentions, self.rounds = paired, mentions, rounds
        self.starts = [sum(p.size for p in properties[:c]) for c in range(len(properties))]
        self.total = sum(p.size for p in properties)
        self.cells = [(c, k) for c, p in enumerate(properties) for k in range(p.size)]

    def pairs(self, rounds: int) -> DataFrame:
        """Every pair with its messages after so many rounds, as factors: tc0.. to the choice, tm0_0.. and ta0_0.. to the values of both mentions."""
        rows = self.paired(self.mentions, ["told"]).select(*PAIR, "score", "m_told", "a_told")
        rows = rows.withColumns({f"tc{c}": F.lit(1.0) for c in range(len(self.properties))} | {f"t{x}{c}_{k}": F.lit(1.0) for x in "ma" for c, k in self.cells})
        for j in range(rounds):
            rows = self.answered(self.asked(rows, j))
        return rows

    def marginal(self, j: int) -> Column:
        return F.least(_product([self.alone(j), *(F.col(f"tc{c}") for c in range(len(self.properties)))]), F.lit(1.0))

    def alone(self, j: int) -> Column:
        return F.exp(F.col("score") - F.get("m_told", F.lit(j * (self.total + 1))))

    def asked(self, rows: DataFrame, j: int) -> DataFrame:
        """With what the nodes of a pair send it in round ``j``: qm0_0.., qa0_0.. (chances of values), chosen0.. (that of the candidate)."""
        new = {}
        for c, p in enumerate(self.properties):
            for x in "ma":
                own = [F.get(f"{x}_told", F.lit(j * (self.total + 1) + 1 + self.starts[c] + k)) / F.col(f"t{x}{c}_{k}") for k in range(p.size)]
                new |= {f"q{x}{c}_{k}": q / _sum(own) for k, q in enumerate(own)}
            without = _product([self.alone(j), *(F.col(f"tc{i}") for i in range(len(self.properties)) if i != c)])
            new[f"chosen{c}"] = without / (without + 1 - self.marginal(j))
        return rows.select(*PAIR, "score", "m_told", "a_told", *(f"tc{c}" for c in range(len(self.properties))), *(x.alias(n) for n, x in new.items()))

    def answered(self, rows: DataFrame) -> DataFrame:
        """The messages that factors send after that; a new cluster has none."""
        new = {}
        for c, p in enumerate(self.properties):
            g, n, chosen = p.potentials(), range(p.size), F.col(f"chosen{c}")
            x = [_sum(g[i][k] * F.col(f"qa{c}_{k}") for k in n) for i in n]
            y = [_sum(g[i][k] * F.col(f"qm{c}_{i}") for i in n) for k in n]
            new[f"tc{c}"] = _sum(F.col(f"qm{c}_{i}") * x[i] for i in n)
            new |= {f"tm{c}_{k}": chosen * x[k] + 1 - chosen for k in n} | {f"ta{c}_{k}": chosen * y[k] + 1 - chosen for k in n}
        linked = lambda x: F.when(F.col("a") != F.col("m"), F.greatest(x, F.lit(TINY))).otherwise(F.lit(1.0))
        return rows.select(*PAIR, "score", "m_told", "a_told", *(linked(x).alias(n) for n, x in new.items()))

    def summed(self, rounds: int) -> DataFrame:
        """doc_key, ment_idx, choices (log of the sum of their weights), b0_0.. (logs of the messages to its values, summed)."""
        rows = self.pairs(rounds)
        rows = rows.withColumn("w", _sum([F.col("score"), *(F.log(f"tc{c}") for c in range(len(self.properties)))]))
        rows = rows.withColumn("as_m", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", F.when(F.col("as_m"), F.floor(F.col("w") / BAND)))
        own = {"ment_idx": F.when(F.col("as_m"), F.col("m")).otherwise(F.col("a")), "part": F.exp(F.col("w") - BAND * F.col("band"))}
        own |= {f"b{c}_{k}": F.log(F.when(F.col("as_m"), F.col(f"tm{c}_{k}")).otherwise(F.col(f"ta{c}_{k}"))) for c, k in self.cells}
        rows = rows.select("doc_key", "band", *(x.alias(n) for n, x in own.items()))
        sums = [F.sum(f"b{c}_{k}").alias(f"b{c}_{k}") for c, k in self.cells]
        bands = rows.groupBy("doc_key", "ment_idx", "band").agg(F.sum("part").alias("part"), *sums)
        both = bands.groupBy("doc_key", "ment_idx").agg(F.max("band").alias("top"), F.collect_list(F.when(F.col("band").isNotNull(), F.struct("band", "part"))).alias("parts"), *sums)
        whole = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"] * F.exp(BAND * (x["band"] - F.col("top"))))
        return both.select("doc_key", "ment_idx", (BAND * F.col("top") + F.log(whole)).alias("choices"), *(f"b{c}_{k}" for c, k in self.cells))

    def advanced(self, rounds: int) -> DataFrame:
        """The mentions with what so many rounds told them; ``beliefs``: the last one's log beliefs."""
        rows = self.mentions.drop("beliefs").join(self.summed(rounds), ["doc_key", "ment_idx"], "left")
        base = {(c, k): x for c, p in enumerate(self.properties) for k, x in enumerate(_based(p)[1]) if rounds or p.projection is None}
        rows = rows.withColumns({f"b{c}_{k}": base.get((c, k), F.lit(0.0)) + F.coalesce(f"b{c}_{k}", F.lit(0.0)) for c, k in self.cells})
        top = [_top([F.col(f"b{c}_{k}") for k in range(p.size)]) for c, p in enumerate(self.properties)]
        told = F.array(F.coalesce("choices", F.lit(0.0)), *(F.exp(F.col(f"b{c}_{k}") - top[c]) for c, k in self.cells))
        beliefs = F.array(*(F.col(f"b{c}_{k}") for c, k in self.cells))
        return rows.select(*(c for c in self.mentions.columns if c not in ("told", "beliefs")), F.concat("told", told).alias("told"), beliefs.alias("beliefs"))

    def by_property(self, rows: DataFrame, columns: list[str], each: Callable[[int, int], dict[str, Column]]) -> DataFrame:
        """A row for each property c: ``each`` gives the columns of a property's value."""
        rows = rows.withColumn("c", F.explode(F.array(*(F.lit(c) for c in range(len(self.properties))))))
        chosen = {}
        for c, k in self.cells:
            for name, x in each(c, k).items():
                chosen.setdefault(name, []).append((c, x))
        of = lambda own: reduce(lambda rest, x: F.when(F.col("c") == x[0], x[1]).otherwise(rest), own, F.lit(None).cast("double"))
        return rows.select(*columns, "c", *(of(own).alias(name) for name, own in chosen.items()))

    def nodes(self, messages: None, base: None) -> DataFrame:
        rows = self.by_property(self.mentions, ["doc_key", F.col("ment_idx").alias("node")], lambda c, k: {f"b{k}": F.get("beliefs", F.lit(self.starts[c] + k))})
        return rows.fillna(NEVER, _names("b", self.width))

    def chosen(self, messages: None) -> DataFrame:
        return self.pairs(self.rounds).select(*PAIR, self.marginal(self.rounds).alias("marginal"))

    def met(self, messages: None, base: None) -> DataFrame:
        rows = self.asked(self.pairs(self.rounds).where("a <> m"), self.rounds)
        rows = self.by_property(rows, PAIR, lambda c, k: {f"q_m{k}": F.col(f"qm{c}_{k}"), f"q_a{k}": F.col(f"qa{c}_{k}"), "chosen": F.col(f"chosen{c}")})
        return rows.fillna(0.0, [*_names("q_m", self.width), *_names("q_a", self.width)])

    def marginals(self) -> DataFrame:
        return self.chosen(None)


def _product(values: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a * b, values)


def propagate_made(paired: Callable[[DataFrame, list[str]], DataFrame], mentions: DataFrame, properties: list[Property], rounds: int = ROUNDS) -> Remade:
    """``propagate`` where choices are made from mentions: none is shuffled or stored, and none of its messages.

    ``paired`` gets the mentions (with all their columns) and names of columns that a pair needs of both, and returns
    doc_key, m, a (a = m: new), score and these as m_<name>, a_<name>. All messages are sent in all rounds; those of a pair are made again
    in every round, so arithmetic grows with the square of the rounds, and what is stored with mentions and rounds.
    """
    scratch = Scratch(mentions.sparkSession, "factor-graph", released=True)
    start = F.array().cast("array<double>")
    graph = Remade(paired, scratch.store(mentions.withColumns({"told": start, "beliefs": start}), "mentions"), properties, rounds)
    for k in range(rounds + 1):
        graph.mentions = scratch.store(graph.advanced(k), f"mentions-{k}")
        scratch.drop(f"mentions-{k - 1}") if k else None
    scratch.close(f"mentions-{rounds}", "mentions")
    return graph


def least_risk(marginals: DataFrame, false_link: float = 0.1, false_new: float = 3.0, wrong_link: float = 1.0) -> DataFrame:
    """doc_key, m, a, risk: the choice of the smallest expected loss, of equals the first antecedent.

    The truth is one of the choices, as likely as its marginal. With equal losses this is the likeliest choice.
    """
    own = Window.partitionBy("doc_key", "m")
    new = F.coalesce(F.sum(F.when(F.col("a") == F.col("m"), F.col("marginal"))).over(own), F.lit(0.0))
    total = F.sum("marginal").over(own)
    risk = F.when(F.col("a") == F.col("m"), false_new * (total - new)).otherwise(false_link * new + wrong_link * (total - new - F.col("marginal")))
    rows = marginals.select(*PAIR, risk.alias("risk"))
    return rows.groupBy("doc_key", "m").agg(F.min_by("a", F.struct(F.round("risk", 9), "a")).alias("a"), F.min("risk").alias("risk"))
