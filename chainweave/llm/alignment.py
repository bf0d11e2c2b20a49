"""Alignment of two tokenizers over a corpus, by a dictionary of groups.

Tokenizer A is a byte-level one (JSON file of the tokenizers library), B a
sentencepiece model that puts a space before the text; both see a space and the
text. Byte offsets at which a token of A and one of B end cut both sequences
into groups; every token of A in a group is linked to every token of B in it.

1. ``segments``: each text is cut before white space that neither tokenizer
   joins to what precedes it, distinct units are aligned once a worker, and a
   segment of documents is written as numbers into its own list of groups. With
   it go, for every group, the number of the segment's documents that hold it.
2. The segments' lists are interned: one row for each distinct group, written as
   ``a1,a2|b1``, with its number of documents. Its links are expanded once.
3. ``documents`` of an id pair: the sum of its groups' documents, less one for
   each further group of a document that holds the same pair; a segment knows
   these, so no pair of a document and a link is ever a row.
4. Each distinct group's links are valued once; the values go back to the
   segments by the group and from there to the documents.

A group that all documents hold is one row a segment, so it is no hot key. What
is broadcast is the two vocabularies and one count for each id of A.

Defined results: a text that is null, empty, or that B does not keep (its pieces
spell other bytes) has no tokens: zeros, and an empty string for its hash. The
special tokens' strings are plain text. Every row is a document, also repeated
ones and those without an id; texts are taken whole; other columns are ignored;
empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import BYTE_LETTERS, SPACES
from .common import Scratch, bounded_batches, held
from .token_files import Pieces

#: Group references after which a segment is closed, and groups that a worker numbers before it starts anew.
SEGMENT, NUMBERED = 1 << 20, 1 << 20
#: Entries of each generation of a worker's cache of units (beyond it by those of one text), and code points of a unit that is kept.
CACHED_UNITS, LONGEST_UNIT = 250_000, 64
#: Code points of the texts that are cut into units together.
TOGETHER = 1 << 18
#: Letters of a regular expression's class.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks that may follow a letter without a space. (An apostrophe begins contractions.)
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Aligner:
    """Both tokenizers, and the groups of the units that they have met."""

    def __init__(self, a_file: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = Pieces(a_file), SentencePieceProcessor(model_proto=b_model)
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        spelled = {i: bytes(letters[c] for c in t) for t, i in self.a.vocabulary.items() if all(c in letters for c in t)}
        self.a_bytes = [spelled.get(i, b"") for i in range(self.a.size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        # white space before which both always cut: no piece has it after another character, or after the space that B adds
        joined = {c for p in pieces for k, c in enumerate(p.replace("▁", " ")) if c in " \n\t" and k and (c != " " or p[k - 1] != "▁")}
        sure = "".join(c for c in " \n\t" if c not in joined)
        odd = "".join(c for c in SPACES if c not in sure)
        unit = f"[{SPACES}]*+[^{SPACES}]++(?:[{odd}][{SPACES}]*[^{SPACES}]+)*(?:[{odd}][{SPACES}]*$)?|[{SPACES}]+"
        # between a letter and a mark A always cuts; B does if no piece has both
        behind = set("".join(re.findall(f"(?<=[{LETTERS}])[^{LETTERS}]", "\n".join(pieces))))
        self.marks = frozenset(c for c in MARKS if c not in behind) if "\n" in sure else frozenset()
        if self.marks:
            unit = f"[{SPACES}]*+[{LETTERS}]++(?=[{re.escape(''.join(sorted(self.marks)))}])|{unit}"
        self.units = re.compile(unit).findall
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.line_feed = array(self.a.code, self.a.line_feed).tolist()
        self.restart()

    def restart(self) -> None:
        self.groups: list[str] = []
        #: The groups' numbers: by a << 32 | b for those of two tokens, by the ids with -1 between for others.
        self.numbers: dict[int | tuple[int, ...], int] = {}
        #: For each group its tokens of A and of B, and its distinct links as a << 32 | b.
        self.sizes = array("q")
        self.links: list[bytes] = []
        self.cache: dict[str, tuple[str, bytes] | None] = {}
        self.older: dict[str, tuple[str, bytes] | None] = {}

    def a_ids(self, unit: str) -> list[int]:
        rest, first = unit[1:], unit[0]
        if rest.isalpha() and (first == " " or first == "\n"):  # one word, or a line feed and one
            if not rest.isascii():
                rest = rest.encode().decode("latin-1").translate(BYTE_LETTERS)
            if first == " ":
                return [t.id for t in self.a.tokenize(self.a.space + rest)]
            return [*self.line_feed, *(t.id for t in self.a.tokenize(rest))]
        ids = array(self.a.code)
        ids.frombytes(b"".join(map(self.a._word, self.a.split(unit))))
        return ids.tolist()

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """B puts a space before what it gets, so that is left out, or cut off again behind a line feed."""
        marks = self.marks
        cut = [0 if u[0] == " " else 2 if u[0] in marks else 1 for u in units]
        ids = self.b.encode([u[1:] if c == 0 else "\n" + u if c == 2 else u for u, c in zip(units, cut)], num_threads=1)
        # to nothing B adds no space
        return [[self.space] if u == " " else i[c:] if c else i for u, i, c in zip(units, ids, cut)]

    def _added(self, key: int | tuple[int, ...], a: list[int], b: list[int]) -> int:
        self.numbers[key] = number = len(self.groups)
        self.groups.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        self.sizes.extend((len(a), len(b)))
        self.links.append(array("q", [x << 32 | y for x in set(a) for y in set(b)]).tobytes())
        return number

    def _unit(self, unit: str, b: list[int]) -> tuple[str, bytes] | None:
        """The unit's groups as text, and their numbers; None if B spells other bytes."""
        if b"".join(map(self.b_bytes.__getitem__, b)) != unit.encode():
            return None
        a = self.a_ids(unit)
        a_ends, b_ends = list(accumulate(map(self.a_sizes.__getitem__, a))), list(accumulate(map(self.b_sizes.__getitem__, b)))
        if a_ends != b_ends:
            found = self._cut(a, b, a_ends, b_ends)
        else:
            keys = [x << 32 | y for x, y in zip(a, b)]
            found = list(map(self.numbers.get, keys))
            if None in found:
                found = self._cut(a, b, a_ends, b_ends)
        return ";".join(map(self.groups.__getitem__, found)), array("i", found).tobytes()

    def _cut(self, a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> list[int]:
        """The numbers of the groups between the ends that both have."""
        known, found = self.numbers.get, []
        j = a_from = b_from = 0
        for i, end in enumerate(a_ends, 1):
            while b_ends[j] < end:
                j += 1
            if b_ends[j] == end:
                j += 1
                key = a[a_from] << 32 | b[b_from] if i - a_from == 1 == j - b_from else (*a[a_from:i], -1, *b[b_from:j])
                number = known(key)
                found.append(self._added(key, a[a_from:i], b[b_from:j]) if number is None else number)
                a_from, b_from = i, j
        return found

    def align(self, texts: list[str | None]) -> list[tuple[str, np.ndarray] | None]:
        """Each text's groups as text, and their numbers; None if it has no tokens. New units of all texts are met at once."""
        each, cache, older = [self.units(" " + t) if t else [] for t in texts], self.cache, self.older
        missing = set(chain.from_iterable(each)).difference(cache)
        new = [u for u in missing if u not in older]
        cache.update((u, older[u]) for u in missing.difference(new))
        cache.update((u, self._unit(u, b)) for u, b in zip(new, self.b_ids(new)))
        out = []
        for units in each:
            found = list(map(cache.__getitem__, units))
            if not found or None in found:  # a change of bytes in one unit is one of the whole
                out.append(None)
                continue
            spelled, numbers = zip(*found)
            out.append((";".join(spelled), np.frombuffer(b"".join(numbers), np.int32)))
        for u in new:
            if len(u) > LONGEST_UNIT:
                del cache[u]
        if len(cache) >= CACHED_UNITS:
            self.cache, self.older = {}, cache
        return out


def together(rows: Iterable[tuple[int | None, str | None]]) -> Iterator[list[tuple[int | None, str | None]]]:
    """Rows of an id and a text in lists of at most ``TOGETHER`` code points, or of one row."""
    part, size = [], 0
    for row in rows:
        n = len(row[1] or "") + 1
        if part and size + n > TOGETHER:
            yield part
            part, size = [], 0
        part.append(row)
        size += n
    if part:
        yield part


_SEGMENT = [
    ("seg", pa.int64(), "bigint"), ("doc_ids", pa.list_(pa.int64()), "array<bigint>"), ("hashes", pa.list_(pa.string()), "array<string>"),
    ("totals", pa.binary(), "binary"), ("refs", pa.binary(), "binary"), ("times", pa.binary(), "binary"),
    ("groups", pa.list_(pa.struct([("g", pa.string()), ("df", pa.int64())])), "array<struct<g:string,df:bigint>>"),
    ("again", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])), "array<struct<a:int,b:int,n:bigint>>"),
]


class _Open:
    """A segment that is being filled: per document its id, hash, totals (n_a, n_b, n_groups, n_links, references), and its groups."""

    def __init__(self):
        self.doc_ids, self.hashes, self.totals, self.refs, self.times, self.again, self.size = [], [], [], [], [], [], 0

    def add(self, doc_id: int | None, found: tuple[str, np.ndarray] | None, aligner: Aligner) -> None:
        self.doc_ids.append(doc_id)
        if found is None:
            self.hashes.append("")
            self.totals.append((0, 0, 0, 0, 0))
            return
        spelled, numbers = found
        own, times = np.unique(numbers, return_counts=True)
        listed = own.tolist()
        sizes = np.frombuffer(aligner.sizes, np.int64).reshape(-1, 2)[own]
        links = np.sort(np.frombuffer(b"".join(map(aligner.links.__getitem__, listed)), np.int64))
        self.again.append(links[1:][links[1:] == links[:-1]])  # once for each further group with the same link
        self.hashes.append(hashlib.sha256(spelled.encode()).hexdigest())
        self.totals.append((*(sizes * times[:, None]).sum(0).tolist(), len(numbers), int((sizes.prod(1) * times).sum()), len(own)))
        self.refs.append(own)
        self.times.append(times.astype(np.int32))
        self.size += len(own)

    def row(self, seg: int, aligner: Aligner) -> pa.RecordBatch:
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        numbers, places, df = np.unique(joined(self.refs, np.int32), return_inverse=True, return_counts=True)
        again, n = np.unique(joined(self.again, np.int64), return_counts=True)
        values = [
            seg, self.doc_ids, self.hashes, np.array(self.totals, "<i8").tobytes(), places.astype("<i4").tobytes(), joined(self.times, np.int32).tobytes(),
            [{"g": aligner.groups[g], "df": k} for g, k in zip(numbers.tolist(), df.tolist())],
            [{"a": x >> 32, "b": x & 0xFFFFFFFF, "n": k} for x, k in zip(again.tolist(), n.tolist())],
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t, _) in zip(values, _SEGMENT)], names=[x[0] for x in _SEGMENT])


def segments(docs: DataFrame, a_tokenizer: str, b_tokenizer: str) -> DataFrame:
    """Documents in segments, with each segment's distinct groups."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((open(a_tokenizer, encoding="utf-8").read(), open(b_tokenizer, "rb").read()))  # of the vocabularies' size
    segment, numbered = SEGMENT, NUMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = ("alignment", *(hashlib.sha256(f if isinstance(f, bytes) else f.encode()).hexdigest() for f in files.value))
        aligner, task, n, part = held(key, lambda: Aligner(*files.value)), TaskContext.get().partitionId(), 0, _Open()
        for batch in batches:
            for rows in together(zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)))):
                for (doc_id, _), found in zip(rows, aligner.align([text for _, text in rows])):
                    part.add(doc_id, found, aligner)
                    if part.size >= segment or len(part.doc_ids) >= segment:
                        yield part.row(task << 32 | n, aligner)
                        part, n = _Open(), n + 1
                if len(aligner.groups) >= numbered:  # what is numbered anew is in other segments
                    if part.doc_ids:
                        yield part.row(task << 32 | n, aligner)
                        part, n = _Open(), n + 1
                    aligner.restart()
        if part.doc_ids:
            yield part.row(task << 32 | n, aligner)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in _SEGMENT))


def expanded(groups: DataFrame) -> DataFrame:
    """g, df, a, b, times: each distinct group's distinct links, with the number of its token pairs that have these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("alignment links",), None)
        for batch in batches:
            out = [[] for _ in range(5)]
            for g, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left, right = (Counter(map(int, side.split(","))) for side in g.split("|"))
                for a, n in left.items():
                    for b, m in right.items():
                        for column, value in zip(out, (g, df, a, b, n * m)):
                            column.append(value)
                if len(out[0]) >= 100_000:
                    yield made(out)
                    out = [[] for _ in range(5)]
            yield made(out)

    def made(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["g", "df", "a", "b", "times"])

    return groups.mapInArrow(run, "g string, df bigint, a int, b int, times bigint")


@dataclass(frozen=True)
class Alignment:
    """Stored tables, and the documents' row for row description."""

    #: g (``a1,a2|b1``), df: every distinct group and the documents that hold it.
    groups: DataFrame
    #: g, df, a, b, times: the links of every distinct group.
    links: DataFrame
    #: a, b, documents, best (no other id of B has more documents with this id of A).
    pairs: DataFrame
    #: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    documents: DataFrame
    scratch: Scratch


_DOCUMENT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _described(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of one segment, from the values of its groups."""
    worth = np.zeros((values.num_rows, 2), np.int64)
    worth[values["pos"].to_numpy()] = np.stack([values["n_best"].to_numpy(), values["count_sum"].to_numpy()], 1)
    row = {name: rows[name][0].as_py() for name in ("doc_ids", "hashes", "totals", "refs", "times")}
    totals = np.frombuffer(row["totals"], "<i8").reshape(-1, 5)
    each = worth[np.frombuffer(row["refs"], "<i4")] * np.frombuffer(row["times"], "<i4").astype(np.int64)[:, None]
    upto = np.concatenate([np.zeros((1, 2), np.int64), each.cumsum(0)])
    ends = totals[:, 4].cumsum()
    sums = upto[ends] - upto[ends - totals[:, 4]]
    columns = [pa.array(row["doc_ids"], pa.int64()), *(pa.array(totals[:, k]) for k in range(4)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(row["hashes"], pa.string())]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _DOCUMENT.split(", ")])


def align(docs: DataFrame, a_tokenizer: str, b_tokenizer: str) -> Alignment:
    """Align both tokenizers over ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "alignment")
    cut = scratch.store(segments(docs, a_tokenizer, b_tokenizer), "segments", **{"parquet.block.size": str(16 << 20), "compression": "zstd"})
    entries = cut.select(F.col("seg").alias("of"), F.posexplode("groups").alias("pos", "e")).select("of", "pos", "e.g", "e.df")
    groups = scratch.store(entries.groupBy("g").agg(F.sum("df").alias("df")), "groups")
    links = scratch.store(expanded(groups), "links")
    less = cut.select(F.explode("again").alias("x")).select("x.a", "x.b", (-F.col("x.n")).alias("df"))
    counts = links.select("a", "b", "df").unionByName(less).groupBy("a", "b").agg(F.sum("df").alias("documents"))
    counts = scratch.store(counts, "counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # a row for each id of A, so it may be broadcast
    pairs = scratch.store(counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")), "pairs")
    valued = links.select("g", "a", "b", "times").join(pairs, ["a", "b"])
    values = scratch.store(valued.groupBy("g").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum")), "values")
    back = entries.select("of", "pos", "g").join(values, "g").select("of", "pos", "n_best", "count_sum")
    told = cut.select("seg", "doc_ids", "hashes", "totals", "refs", "times")
    documents = told.groupBy("seg").cogroup(back.groupBy("of")).applyInArrow(_described, _DOCUMENT)
    return Alignment(groups, links, pairs, documents, scratch)


def digest(docs: DataFrame, a_tokenizer: str, b_tokenizer: str) -> DataFrame:
    """Per document its tokens, groups, links and how usual the links are."""
    found = align(docs, a_tokenizer, b_tokenizer)
    found.scratch.close("segments", "values")
    return found.documents
