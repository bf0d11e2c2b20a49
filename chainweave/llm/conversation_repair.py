"""Repair of conversations: cheapest edits by a min-plus scan over 4 x 4 matrices.

Turns are to read, by the first letters of their roles, ``(s?(ua)+)?``. The
automaton of that expression has four states: nothing yet, after a system turn,
after a user's, after an assistant's. A turn is a matrix over elements (cost,
audit): entry i, j is the cheapest edit of that turn that leads from state i to j, of
equal costs the one of least letters. Its closure under insertions is part of it. Products take
the least of sums of costs and concatenated audits.

Two audits of equal cost over the same turns differ before either ends (the cost
follows from the letters), so taking the least first and appending later is
exact, and products may be bracketed in any way:

1. Turns are dealt by ranges of conversation and turn and sorted. A task turns
   each run of a conversation into blocks of bounded size with their product.
2. A conversation that lies within one task as one block is done there. For
   others the blocks' matrices are reduced as a tree over the partitions' numbers,
   each level a stored table, and the states between blocks are read back from the
   root down: no conversation is ever held by one task.
3. Every block then knows its edits. What is one value for a conversation, such
   as the hash of its text, is streamed over its blocks in order, one at a time.

Edits: K keeps a turn, R gives it the role user or assistant, D deletes it, I
inserts an empty one. Blank and duplicate turns must go; a truncated turn that stays costs more.

Defined results: turns are ordered by turn (null first), role, a hash of role and
text; null role and text count as one space; turns without a conversation's id
are one conversation; an empty role has no first letter, so such a turn is never
kept as it is; repeated rows are duplicates; other columns are ignored; empty tables give empty ones. The audit is one string, so a conversation is
bounded by what 16 strings of a letter a turn take in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, bounded_batches, held

#: Turns and code points of a block at most (a turn is never cut).
BLOCK_TURNS, BLOCK_CHARS = 512, 1 << 18
#: Nodes of one level of the tree that make one of the next.
FAN = 32
# The costs of edits.
REROLE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5

#: Where a kept turn leads, by state and first letter of the role.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Where a turn of a free role leads, and that role.
NEXT = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")]
#: Insertions after the last turn, by state.
TAIL = [0, 2, 1, 0]
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}

Element = tuple[int, str]
Matrix = list[list[Element | None]]


def turn_matrix(initial: str, fault: int) -> Matrix:
    """All edits of one turn, with insertions before it."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at = i
        for inserted in range(3):
            edits = [(DELETE, "D", at)]
            if fault not in (BLANK, DUPLICATE):
                more = KEEP_TRUNCATED * (fault == TRUNCATED)
                edits.append((REROLE + more, "R", NEXT[at][0]))
                if (at, initial) in STEP:
                    edits.append((more, "K", STEP[at, initial]))
            for cost, letter, j in edits:
                made = (INSERT * inserted + cost, "I" * inserted + letter)
                if out[i][j] is None or made < out[i][j]:
                    out[i][j] = made
            at = NEXT[at][0]
    return out


TURNS = {(c, f): turn_matrix(c, f) for c in ("s", "u", "a", "") for f in range(4)}
IDENTITY: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = []
    for row in x:
        made: list[Element | None] = [None] * 4
        for left, right in zip(row, y):
            if left is not None:
                cost, audit = left
                for j, e in enumerate(right):
                    if e is not None:
                        total, best = cost + e[0], made[j]
                        if best is None or total < best[0] or total == best[0] and audit + e[1] < best[1]:
                            made[j] = (total, audit + e[1])
        out.append(made)
    return out


def closed(row: list[Element | None]) -> tuple[Element, int]:
    """The best way to an end, with the insertions after the last turn, and the state before these."""
    ends = [((e[0] + INSERT * TAIL[j], e[1] + "I" * TAIL[j]), j) for j, e in enumerate(row) if e is not None]
    return min(ends)


def replayed(audit: str, state: int, roles: list[str]) -> Iterator[tuple[str, int, str]]:
    """For each letter of the audit: the letter, the turn that it is about (-1: inserted), the role that stands then ('' if none)."""
    k = 0
    for letter in audit:
        if letter == "I":
            state, role = NEXT[state]
            yield letter, -1, role
            continue
        role = ""
        if letter == "K":
            role, state = roles[k], STEP[state, roles[k][:1]]
        elif letter == "R":
            state, role = NEXT[state]
        yield letter, k, role
        k += 1


# -- blocks -------------------------------------------------------------------

_ELEMENTS = "costs array<bigint>, audits array<string>"
_BLOCK = f"conv_id bigint, part int, n int, whole boolean, roles array<string>, texts array<string>, faults array<int>, turns array<bigint>, {_ELEMENTS}"


def _flat(m: Matrix) -> tuple[list, list]:
    cells = [e for row in m for e in row]
    return [None if e is None else e[0] for e in cells], [None if e is None else e[1] for e in cells]


def _square(costs: list, audits: list) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return [cells[4 * i : 4 * i + 4] for i in range(4)]


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _digest() -> Column:
    return F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)


def blocks(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns (conv_id, turn, role, text) in blocks with their faults and matrices."""
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    # stored, which fixes the numbers that tell equal rows apart
    rows = scratch.store(rows.withColumns({"digest": _digest(), "row": F.monotonically_increasing_id()}), "turns")
    several = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    several = scratch.store(several.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.row").alias("first")), "repeated")
    later = rows.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where("row <> first").select("row", F.lit(True).alias("later"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    dealt = rows.join(scratch.store(later, "later"), "row", "left").repartitionByRange(*order).sortWithinPartitions(*order)
    most_turns, most_chars = BLOCK_TURNS, BLOCK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held(("conversation repair",), None)
        part, runs, n, out, size = TaskContext.get().partitionId(), 0, 0, [], 0
        at, roles, texts, faults, turns = None, [], [], [], []

        def block(whole: bool) -> tuple:
            m = IDENTITY
            for role, fault in zip(roles, faults):
                c = role[:1]
                m = product(m, TURNS[c if c in ("s", "u", "a") else "", fault])
            return (at[0], part, n, whole, roles, texts, faults, turns, *_flat(m))

        for batch in batches:
            for conv, turn, role, text, later in zip(*(c.to_pylist() for c in batch.columns)):
                changed = at != (conv,)
                if at and (changed or len(roles) >= most_turns or size >= most_chars):
                    # a run after the partition's first that ends within it as one block is the whole conversation
                    out.append(block(changed and runs > 1 and n == 0))
                    n, roles, texts, faults, turns, size = n + 1, [], [], [], [], 0
                if changed:
                    at, n, runs = (conv,), 0, runs + 1
                seen = text.strip(" \t\n\x0b\x0c\r")
                faults.append(BLANK if not seen else DUPLICATE if later else TRUNCATED if seen[-1] not in ".!?" else FINE)
                roles.append(role)
                texts.append(text)
                turns.append(turn)
                size += len(text)
            if out:
                yield _batch(out, _BLOCK)
                out = []
        if at:
            yield _batch([block(False)], _BLOCK)

    return scratch.store(dealt.select("conv_id", "turn", "role", "text", "later").mapInArrow(run, _BLOCK), "blocks")


# -- the tree ---------------------------------------------------------------------

_NODE = f"conv_id bigint, part int, children array<int>, paths array<string>, {_ELEMENTS}"


def _combined(rows: pa.Table) -> pa.Table:
    """The nodes of one parent: their product, and for each of its elements the states after each child."""
    conv, up, child, costs, audits = (c.to_pylist() for c in rows.sort_by("child").columns)
    m, paths = IDENTITY, [[""] * 4 for _ in range(4)]
    for c, a in zip(costs, audits):
        own = _square(c, a)
        after = product(m, own)
        walked = [[""] * 4 for _ in range(4)]
        for i in range(4):
            for j in range(4):
                if after[i][j] is not None:
                    # the state between is the only one that gives this cost and audit
                    k = next(k for k in range(4) if m[i][k] and own[k][j] and (m[i][k][0] + own[k][j][0], m[i][k][1] + own[k][j][1]) == after[i][j])
                    walked[i][j] = f"{paths[i][k]}{j}"
        m, paths = after, walked
    return pa.Table.from_batches([_batch([(conv[0], up[0], child, [p for row in paths for p in row], *_flat(m))], _NODE)])


_SPREAD = "conv_id bigint, part int, entry int, leaves int, last boolean"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From nodes with their entry and exit states to their children's."""
    for batch in batches:
        out = []
        for conv, children, paths, entry, leaves, last in zip(*(c.to_pylist() for c in batch.columns)):
            state = entry
            for k, (child, to) in enumerate(zip(children, map(int, paths[4 * entry + leaves]))):
                out.append((conv, child, state, to, last and k == len(children) - 1))
                state = to
        yield _batch(out, _SPREAD)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(conv, part, 0, closed(_square(c, a)[0])[1], True) for conv, part, c, a in zip(*(x.to_pylist() for x in batch.columns))], _SPREAD)


def states(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, part, n, entry, leaves, last: the states before and after each block of ``parts``, and whether it ends its conversation.

    Level 1 has a node for each conversation and partition, each next one a node
    for ``FAN`` of them, up to one for each conversation.
    """
    most = parts.agg(F.max("part")).first()[0] or 0
    schema = "conv_id bigint, part int, children array<int>, paths array<string>, costs array<bigint>, audits array<string>"

    def level(nodes: DataFrame, name: str) -> DataFrame:
        return scratch.store(nodes.select("conv_id", "up", "child", "costs", "audits").groupBy("conv_id", "up").applyInArrow(_combined, schema), name)

    levels, width = [level(parts.withColumns({"up": F.col("part"), "child": F.col("n")}), "level-1")], 1
    while width <= most:
        width *= FAN
        levels.append(level(levels[-1].withColumns({"up": F.floor(F.col("part") / FAN).cast("int"), "child": F.col("part")}), f"level-{len(levels) + 1}"))
    known = levels[-1].select("conv_id", "part", "costs", "audits").mapInArrow(_rooted, _SPREAD)
    for k in range(len(levels) - 1, -1, -1):
        above = known.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "entry", "leaves", "last")
        nodes = levels[k].join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        at = nodes.select("conv_id", "part", "children", "paths", "entry", "leaves", "last")
        if k:
            known = scratch.store(at.drop("part").mapInArrow(_spread, _SPREAD), f"known-{k}")
    # the children of level 1 are the blocks of a partition, so the partition goes with them
    found = F.explode(F.expr("transform(children, (n, i) -> struct(n, if(i = 0, entry, cast(substr(paths[4 * entry + leaves], i, 1) as int)) as entry, cast(substr(paths[4 * entry + leaves], i + 1, 1) as int) as leaves, last and i = size(children) - 1 as last))"))
    return scratch.store(at.select("conv_id", "part", found.alias("x")).select("conv_id", "part", "x.n", "x.entry", "x.leaves", "x.last"), "states")


# -- results -----------------------------------------------------------------------

_TOLD = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Telling:
    """What is told of a conversation, from its blocks in order."""

    def __init__(self, conv: int | None):
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, [0] * 4, 0, 0, []
        self.first = self.turn = self.before = None
        self.distinct, self.state, self.lines, self.hash = 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, roles: list, texts: list, faults: list, turns: list, cost: int, audit: str, leaves: int) -> None:
        for role, fault, turn in zip(roles, faults, turns):
            self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
            self.before = role[:1]
            if turn is not None and turn != self.turn:
                self.first, self.turn, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        for _, k, role in replayed(audit, self.state, roles):
            if role:
                self.line(role, texts[k] if k >= 0 else "")
        self.cost, self.state = self.cost + cost, leaves
        self.audit.append(audit)

    def row(self) -> tuple:
        for _, _, role in replayed("I" * TAIL[self.state], self.state, []):
            self.line(role, "")
        gaps = self.turn - self.first + 1 - self.distinct if self.distinct else 0
        tail = TAIL[self.state]
        return (self.conv, gaps, *(self.faults[f] for f in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, self.cost + INSERT * tail, "".join(self.audit) + "I" * tail, self.hash.hexdigest())


def _chosen(costs: list, audits: list, entry: int | None, leaves: int | None) -> tuple[int, str, int, int]:
    """cost, audit, entry and exit of a block; of a whole conversation the best."""
    m = _square(costs, audits)
    if entry is None:
        entry, leaves = 0, closed(m[0])[1]
    return (*m[entry][leaves], entry, leaves)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, conversation after conversation, to a row each."""
    telling, out = None, []
    for batch in batches:
        for conv, roles, texts, faults, turns, costs, audits, entry, leaves in zip(*(c.to_pylist() for c in batch.columns)):
            if telling is None or telling.conv != conv or entry is None:
                if telling:
                    out.append(telling.row())
                telling = _Telling(conv)
            cost, audit, _, to = _chosen(costs, audits, entry, leaves)
            telling.add(roles, texts, faults, turns, cost, audit, to)
        yield _batch(out, _TOLD)
        out = []
    if telling:
        yield _batch([telling.row()], _TOLD)


_EDIT = "conv_id bigint, part int, n int, place int, edit string, turn bigint, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, part, n, roles, texts, turns, costs, audits, entry, leaves, last in zip(*(c.to_pylist() for c in batch.columns)):
            whole = entry is None
            _, audit, entry, to = _chosen(costs, audits, entry, leaves)
            steps = [*replayed(audit, entry, roles), *(replayed("I" * TAIL[to], to, []) if whole or last else ())]
            for place, (letter, k, role) in enumerate(steps):
                kept = letter != "D"
                out.append((conv, part, n, place, letter, turns[k] if k >= 0 else None, (role if kept else roles[k]), texts[k] if k >= 0 else ""))
        yield _batch(out, _EDIT)


@dataclass(frozen=True)
class Repair:
    """Stored blocks and the states around those that are not a whole conversation."""

    blocks: DataFrame
    states: DataFrame
    scratch: Scratch

    def _parts(self) -> DataFrame:
        found = self.states.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("n").alias("k"), "entry", "leaves", "last")
        return self.blocks.where("not whole").join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("n") == F.col("k")))

    def _whole(self) -> DataFrame:
        none = F.lit(None).cast("int")
        return self.blocks.where("whole").withColumns({"entry": none, "leaves": none, "last": F.lit(None).cast("boolean")})

    def conversations(self) -> DataFrame:
        """A row for each conversation: faults, cost, audit, hash of the repaired text."""
        columns = ["conv_id", "roles", "texts", "faults", "turns", "costs", "audits", "entry", "leaves"]
        whole = self._whole().select(columns).mapInArrow(_told, _TOLD)
        dealt = self._parts().repartition("conv_id").sortWithinPartitions("conv_id", "part", "n")
        return whole.unionByName(dealt.select(columns).mapInArrow(_told, _TOLD))

    def edits(self) -> DataFrame:
        """A row for each edit: its letter and the turn that stands then (for D the turn that goes), in order of part, n, place."""
        columns = ["conv_id", "part", "n", "roles", "texts", "turns", "costs", "audits", "entry", "leaves", "last"]
        return self._whole().select(columns).unionByName(self._parts().select(columns)).mapInArrow(_edited, _EDIT)


def repair(turns: DataFrame) -> Repair:
    """The cheapest repair of the conversations of ``turns`` (conv_id, turn, role, text)."""
    bounded_batches(turns.sparkSession)
    scratch = Scratch(turns.sparkSession, "repair")
    made = blocks(turns, scratch)
    found = states(made.where("not whole"), scratch)
    return Repair(made, found, scratch)


def damaged(turns: DataFrame) -> DataFrame:
    """Of every 20 hashes of id and turn one drops the turn, one empties it, one takes its end marks, one repeats it, one makes it the user's."""
    space = F.lit(" ")
    named = lambda c: F.coalesce(F.col(c).cast("string"), space)
    code = F.pmod(F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "UTF-8")), F.lit(20))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))).drop("col")


def digest(turns: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, a row for every conversation there was."""
    found = repair(damaged(turns))
    told = found.conversations()
    found.scratch.close("blocks", "states")
    every = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero, numbers = F.lit(0).cast("bigint"), ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = every.join(told.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return rows.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _repair_sql() -> str:
    """The same by a recursive query that carries the four states' costs and audits from turn to turn, as strings that sort alike."""

    def plus(v: str, cost: str, letters: str) -> str:
        return f"lpad(cast(cast({v}[1:9] as bigint) + {cost} as varchar), 9, '0') || {v}[10:] || '{letters}'"

    inserted = f"least(v2, {plus('v0', '5', 'I')}, {plus('v1', '5', 'I')}, {plus('v3', '5', 'I')}) as w2, least(v3, {plus('v2', '5', 'I')}, {plus('v0', '10', 'II')}, {plus('v1', '10', 'II')}) as w3"
    stays, cost = "fault not in (1, 2)", "case when fault = 3 then 5 else 0 end"
    may = lambda when, v, c, letter: f"case when {stays} and {when} then {plus(v, c, letter)} end"
    step = ", ".join([
        f"{plus('w0', '2', 'D')} as v0",
        f"least({plus('w1', '2', 'D')}, {may('i = ' + repr('s'), 'w0', cost, 'K')}) as v1",
        f"least({plus('w2', '2', 'D')}, {may('true', 'u', '1 + ' + cost, 'R')}, {may('i = ' + repr('u'), 'u', cost, 'K')}) as v2",
        f"least({plus('w3', '2', 'D')}, {may('true', 'w2', '1 + ' + cost, 'R')}, {may('i = ' + repr('a'), 'w2', cost, 'K')}) as v3",
    ])
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, k: case when (r & 1) = 1 then xor(r >> 1, 3988292384) else r >> 1 end)"
    return f"""
with recursive keyed as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
coded as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(key, ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: {byte}), 4294967295) % 20 as code from keyed),
damaged as (select conv_id, turn, case when code = 4 then 'user' else role end as role,
  case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when code = 3 then 2 else 1 end)) as copy from coded where code <> 0),
ordered as (select *, role[1:1] as i, row_number() over w as k, lag(role[1:1]) over w as before,
  regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') as seen
  from damaged window w as (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text), copy)),
turns as (select *, case when seen = '' then 1 when row_number() over (partition by conv_id, role, text order by k) > 1 then 2 when seen[-1:] not in ('.', '!', '?') then 3 else 0 end as fault from ordered),
scan as (
  select distinct conv_id, cast(0 as bigint) as k, '000000000' as v0, cast(null as varchar) as v1, cast(null as varchar) as v2, cast(null as varchar) as v3 from turns
  union all
  select conv_id, k, {step} from (select *, least(w0, w1, w3) as u from (
    select t.conv_id, t.k, t.i, t.fault, v0 as w0, v1 as w1, {inserted} from scan s join turns t on t.conv_id is not distinct from s.conv_id and t.k = s.k + 1) x) y),
last as (select conv_id, max(k) as n, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
  count(*) filter (where k > 1 and before || i not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from turns group by conv_id),
best as (select l.*, least(v0, v3, {plus('v2', '5', 'I')}, {plus('v1', '10', 'II')}) as b from last l join scan s on s.conv_id is not distinct from l.conv_id and s.k = l.n),
letters as (select conv_id, spot, b[9 + spot : 9 + spot] as letter, sum(case when b[9 + spot : 9 + spot] <> 'I' then 1 else 0 end) over (partition by conv_id order by spot) as k
  from (select conv_id, b, unnest(range(1, length(b) - 8)) as spot from best) x),
standing as (select a.conv_id, a.letter, row_number() over (partition by a.conv_id order by spot) as place, t.role, t.text,
  first_value(a.letter = 'K' and t.i = 's') over (partition by a.conv_id order by spot) as system
  from letters a left join turns t on t.conv_id is not distinct from a.conv_id and t.k = a.k and a.letter <> 'I' where a.letter <> 'D'),
lines as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (place - case when system then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by place)) as h
  from standing group by conv_id),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cast(b[1:9] as bigint), 0) as cost, coalesce(b[10:], '') as audit, coalesce(h, sha256('')) as repaired_sha256
from every e left join best b on b.conv_id is not distinct from e.conv_id left join lines l on l.conv_id is not distinct from e.conv_id
"""


REPAIR_SQL = _repair_sql()
