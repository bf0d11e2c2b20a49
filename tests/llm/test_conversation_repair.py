"""Conversation repair against a search over all edits, with blocks and trees of several sizes, and against SQL."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from chainweave.llm import conversation_repair as C

GRAMMAR = re.compile("(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        out.append(C.BLANK if not bare else C.DUPLICATE if (role, text) in seen else C.FINE if bare[-1] in ".!?" else C.TRUNCATED)
        seen.add((role, text))
    return out


def searched(rows):
    """The least (cost, audit) of all edit sequences, cheapest first, and the repaired turns; nothing but hopeless beginnings is left out."""
    faults = faults_of(rows)
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, k, out = heapq.heappop(heap)
        spelled = "".join(r[:1] or "?" for r, _ in out)  # an empty role is none
        if not any(GRAMMAR.fullmatch(spelled + rest) for rest in ("", "a", "ua")) or cost > 2 * len(rows) + 1:
            continue
        if k == len(rows) and GRAMMAR.fullmatch(spelled):
            return cost, audit, out
        for role in ("user", "assistant"):
            if not audit.endswith("III"):
                heapq.heappush(heap, (cost + 5, audit + "I", k, (*out, (role, ""))))
        if k < len(rows):
            role, text = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, out))
            if faults[k] not in (C.BLANK, C.DUPLICATE):
                more = 5 * (faults[k] == C.TRUNCATED)
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, (*out, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, (*out, (other, text))))


def scanned(rows):
    """The same from left to right, for long conversations: the four best, one for each state."""
    best = {0: (0, "", ())}

    def inserted(best):
        found = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(found.items()):
                to, role = C.NEXT[state]
                made = (cost + 5, audit + "I", (out, (role, "")))
                if to not in found or made[:2] < found[to][:2]:
                    found[to] = made
        return found

    for (role, text), fault in zip(rows, faults_of(rows)):
        after = {}
        for state, (cost, audit, out) in inserted(best).items():
            ways = [(2, "D", state, None)]
            if fault in (C.FINE, C.TRUNCATED):
                more = 5 * (fault == C.TRUNCATED)
                ways.append((1 + more, "R", C.NEXT[state][0], (C.NEXT[state][1], text)))
                if (state, role[:1]) in C.STEP:
                    ways.append((more, "K", C.STEP[state, role[:1]], (role, text)))
            for c, letter, to, turn in ways:
                made = (cost + c, audit + letter, (out, turn) if turn else out)
                if to not in after or made[:2] < after[to][:2]:
                    after[to] = made
        best = after
    cost, audit, out = min((v for s, v in inserted(best).items() if s in (0, 3)), key=lambda v: v[:2])
    turns = []
    while out:
        out, turn = out
        turns.append(turn)
    return cost, audit, tuple(reversed(turns))


def expected(conversations, repairer):
    out = []
    for conv, rows in conversations.items():
        damaged = []
        for turn, role, text in rows:
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if code:
                text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
                damaged += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        if not damaged:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        faults = collections.Counter(faults_of([r[1:] for r in damaged]))
        turns = [r[0] for r in damaged if r[0] is not None]
        cost, audit, kept = repairer([r[1:] for r in damaged])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults[C.BLANK], faults[C.DUPLICATE], faults[C.TRUNCATED], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


ROLES = ["user", "assistant", "system", "user", "assistant", None, "", "u", "tool", "Ü"]
WORDS = ["yes.", "no", "why?", "so!\n", " ", "\t\n", "", None, "\xa0", "end. \x0b", "é"]


def made(rng, n):
    return [(rng.choice([None, *range(2 * n)]) if rng.random() < 0.3 else k, rng.choice(ROLES), rng.choice(WORDS)) for k in range(n)]


def rows_of(conversations):
    return [(c, *r, "x", 1) for c, rows in conversations.items() for r in rows]


SCHEMA = "conv_id long, turn long, role string, text string, digest string, part int"


def test_against_search(spark):
    rng = random.Random(1)
    conversations = {k if k else None: made(rng, rng.randrange(1, 6)) for k in range(250)}
    found = C.digest(spark.createDataFrame(rows_of(conversations), SCHEMA).repartition(5))
    assert collections.Counter(map(tuple, found.collect())) == expected(conversations, searched) == expected(conversations, scanned)


@pytest.mark.parametrize("turns, fan", [(1, 2), (3, 2), (512, 32)])
def test_long_conversations(spark, turns, fan, monkeypatch):
    """Conversations over many blocks and partitions, one of them with most of the rows, one of equal rows only."""
    monkeypatch.setattr(C, "BLOCK_TURNS", turns)
    monkeypatch.setattr(C, "FAN", fan)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many partitions as asked for
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rng = random.Random(turns)
    conversations = {k: made(rng, rng.randrange(1, 30)) for k in range(30)} | {40: made(rng, 900), None: made(rng, 200), 41: [(7, "user", "same.")] * 300, 42: [(k, "user", f"{k}.") for k in range(200)]}
    try:
        df = spark.createDataFrame(rows_of(conversations), SCHEMA).repartition(6)
        assert collections.Counter(map(tuple, C.digest(df).collect())) == expected(conversations, scanned)
        found = C.repair(df)
        told = {r["conv_id"]: r for r in found.conversations().collect()}
        edits = collections.defaultdict(list)
        for r in found.edits().collect():
            edits[r["conv_id"]].append(r)
        assert edits.keys() == told.keys() == conversations.keys()
        for conv, own in edits.items():
            own.sort(key=lambda r: (r["part"], r["n"], r["place"]))
            assert "".join(r["edit"] for r in own) == told[conv]["audit"]
            text = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
            assert hashlib.sha256(text.encode()).hexdigest() == told[conv]["repaired_sha256"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    assert C.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_may_be_bracketed_in_any_way():
    rng = random.Random(4)
    for _ in range(200):
        own = [C.TURNS[rng.choice(["s", "u", "a", ""]), rng.randrange(4)] for _ in range(6)]
        k = rng.randrange(1, 6)
        whole = left = right = C.IDENTITY
        for n, m in enumerate(own):
            whole = C.product(whole, m)
            left, right = (C.product(left, m), right) if n < k else (left, C.product(right, m))
        assert C.product(left, right) == whole


def test_sql(spark):
    duck = duckdb.connect()
    duck.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    found = C.digest(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    columns = sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(duck.sql(f"select {', '.join(columns)} from ({C.REPAIR_SQL})").fetchall())
    rng = random.Random(8)
    conversations = {k if k else None: made(rng, rng.randrange(1, 12)) for k in range(150)}
    rows = [(c, *r) for c, own in conversations.items() for r in own]
    duck.sql("create or replace table conversations_made (conv_id bigint, turn bigint, role varchar, text varchar)")
    duck.executemany("insert into conversations_made values (?, ?, ?, ?)", rows)
    duck.sql("create or replace view conversations as select * from conversations_made")
    assert collections.Counter(duck.sql(f"select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from ({C.REPAIR_SQL})").fetchall()) == expected(conversations, scanned)
