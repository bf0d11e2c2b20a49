"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns documents into index shards: each shard covers the whole
texts of some documents and holds, for every word of theirs, the sorted list of
its positions (postings). Shards are rows of a table in the shared folder, so
the index is built once, survives lost executors and serves any number of
searches. ``phrase_hits`` intersects offset-adjusted posting lists, the rarest
word of a phrase first; ``proximity_hits`` relaxes the offsets to a distance. The ids
of items are strings, or numbers written as strings.

No word or document is ever moved between executors: postings of a frequent
word are spread over all shards, so no key can be hot. The phrases are the
stated query set; they pass the driver in blocks of ``BLOCK_WORDS`` words. The index
is read once: a task opens a shard and searches it for one block after the other.

Defined results: a null or empty text has no words and is not contaminated; an
item without words has no window; repeated documents are each reported; null
ids are carried through; other columns of the input are ignored, whatever their
names (``clean`` hands them through); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Numbering, bounded_batches, flagged, fresh, held, stored, words_of

WINDOW = 13
#: Words after which a shard is closed. A longer document has a shard of its own.
SHARD_WORDS = 1 << 20
#: Words of the phrases that are sent to the executors at once (some 15 MB: a window for each, of 13 numbers of 4 bytes).
BLOCK_WORDS = 1 << 18
#: Candidate positions held at once while lists are intersected.
CANDIDATES = 1 << 21

#: The names of documents may be numbers or strings.
_NAMES = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def _shard_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(kind)), ("doc_words", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("starts", pa.binary()), ("postings", pa.binary())])


def _shard_row(schema: pa.Schema, name: str, ids: list, lengths: list[int], parts: list[np.ndarray], vocabulary: dict) -> pa.RecordBatch:
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    postings = np.argsort(words, kind="stable").astype("<i4")
    starts = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(vocabulary)))]).astype("<i4")
    row = {"shard": name, "doc_ids": ids, "doc_words": lengths, "vocabulary": b" ".join(vocabulary), "starts": starts.tobytes(), "postings": postings.tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=schema)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Index shards of every row of ``docs``, stored in the shared folder. The id is a string or becomes a bigint."""
    shard_words = SHARD_WORDS
    kind = T.StringType() if isinstance(docs.schema[doc_id].dataType, T.StringType) else T.LongType()
    schema = _shard_schema(_NAMES[kind])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held(("decontamination",), None)
        task, n = TaskContext.get().partitionId(), 0
        ids, lengths, parts, size, vocabulary = [], [], [], 0, Numbering()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(value.as_py())
                ids.append(key)
                lengths.append(len(words))
                parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= shard_words or len(ids) >= shard_words:
                    yield _shard_row(schema, f"{task}-{n}", ids, lengths, parts, vocabulary)
                    ids, lengths, parts, size, vocabulary, n = [], [], [], 0, Numbering(), n + 1
        if ids:
            yield _shard_row(schema, f"{task}-{n}", ids, lengths, parts, vocabulary)

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).alias("text"))
    index = source.mapInArrow(shards, f"shard string, doc_ids array<{kind.simpleString()}>, doc_words array<int>, vocabulary binary, starts binary, postings binary")
    return stored(index, "postings", **{"parquet.block.size": str(16 << 20), "compression": "zstd"})


class Shard:
    """One row of the index, opened for searching."""

    def __init__(self, doc_words: list[int], vocabulary: bytes, starts: bytes, postings: bytes):
        self.numbers = {w: i for i, w in enumerate(vocabulary.split(b" "))} if vocabulary else {}
        self.starts = np.frombuffer(starts, "<i4").astype(np.int64)
        self.postings = np.frombuffer(postings, "<i4").astype(np.int64)
        self.counts = np.diff(self.starts)
        self.size = len(self.postings)
        #: Sorted as the postings are: by word, then by position.
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * max(1, self.size) + self.postings
        self.bases = np.concatenate([[0], np.cumsum(doc_words)]).astype(np.int64)

    def numbered(self, terms: list[bytes]) -> np.ndarray:
        return np.fromiter((self.numbers.get(w, -1) for w in terms), np.int64, len(terms))

    def listed(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of each of ``words``: index into ``words``, position."""
        counts = self.counts[words]
        which = np.repeat(np.arange(len(words)), counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, self.postings[np.repeat(self.starts[words], counts) + within]

    def has(self, words: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the posting list of its word."""
        keys = words * max(1, self.size) + positions
        at = np.searchsorted(self.keys, keys)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] == keys)

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases (rows of word numbers, all of one length): row, start."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        length = phrases.shape[1]
        rows = np.flatnonzero((phrases >= 0).all(1)) if self.size else np.zeros(0, np.int64)
        if len(rows):
            order = np.argsort(self.counts[phrases[rows]], axis=1, kind="stable")
            most = np.cumsum(self.counts[phrases[rows, order[:, 0]]])
            cuts = np.searchsorted(most, np.arange(CANDIDATES, most[-1] + CANDIDATES, CANDIDATES), side="left")
            for lo, hi in zip([0, *(cuts[:-1] + 1)], cuts + 1):
                part, ranks = rows[lo:hi], order[lo:hi]
                if not len(part):
                    continue
                which, start = self.listed(phrases[part, ranks[:, 0]])
                start = start - ranks[which, 0]
                doc = np.searchsorted(self.bases, start, side="right") - 1
                ok = (start >= 0) & (start + length <= self.bases[np.clip(doc + 1, 0, len(self.bases) - 1)])
                which, start = which[ok], start[ok]
                for k in range(1, length):
                    at = ranks[which, k]
                    ok = self.has(phrases[part[which], at], start + at)
                    which, start = which[ok], start[ok]
                found.append((part[which], start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def near(self, phrases: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of a phrase's rarest word with all its others within ``reach`` words: row, position."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for row in np.flatnonzero((phrases >= 0).all(1)) if self.size else []:
            words = phrases[row][np.argsort(self.counts[phrases[row]], kind="stable")]
            at = self.postings[self.starts[words[0]] : self.starts[words[0] + 1]]
            for w in words[1:]:
                others = self.postings[self.starts[w] : self.starts[w + 1]]
                doc = np.searchsorted(self.bases, at, side="right")
                lo = np.searchsorted(others, np.maximum(at - reach, self.bases[doc - 1]), side="left")
                hi = np.searchsorted(others, np.minimum(at + reach, self.bases[doc] - 1), side="right")
                at = at[hi > lo]
            found.append((np.full(len(at), row), at))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _blocks(items: DataFrame, window: int) -> Iterator[tuple[list, list[bytes], dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """The items' windows in blocks of bounded size: item ids, words, and by length the windows' words and items."""
    ids, terms, by_length, held = [], Numbering(), {}, 0

    def block():
        return ids, list(terms), {n: (np.array(w, np.int32), np.array(i, np.int32)) for n, (w, i) in by_length.items()}

    for item, text in items.toLocalIterator():
        words = [terms[w] for w in words_of(text)]
        if words:
            n = min(window, len(words))
            rows, owners = by_length.setdefault(n, ([], []))
            rows += [words[k : k + n] for k in range(len(words) - n + 1)]
            owners += [len(ids)] * (len(words) - n + 1)
            ids.append(item)
            held += len(words)
        if held >= BLOCK_WORDS:
            yield block()
            ids, terms, by_length, held = [], Numbering(), {}, 0
    if ids:
        yield block()


def _hits(index: DataFrame, items: DataFrame, window: int, reach: int | None, item_id: str, text: str) -> DataFrame:
    """Per document of the index its hits and items, over all blocks."""
    bounded_batches(index.sparkSession)
    context = index.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in _blocks(items.select(F.col(item_id).cast("string"), F.col(text)), window)]
    kind = index.schema["doc_ids"].dataType.elementType
    schema = f"shard string, doc_no int, doc_id {kind.simpleString()}, n_words bigint, hits array<struct<start:bigint,stop:bigint>>, items array<string>"
    types = [pa.string(), pa.int32(), _NAMES[kind], pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]

    def search(shard: Shard, block, spans: dict[int, set], owners: dict[int, set]) -> None:
        ids, terms, by_length = block
        number = shard.numbered(terms)
        for length, (windows, owner) in by_length.items():
            which, start = shard.exact(number[windows]) if reach is None else shard.near(number[windows], reach)
            size = length if reach is None else 1
            docs = np.searchsorted(shard.bases, start, side="right") - 1
            for d, s, o in zip(docs.tolist(), (start - shard.bases[docs]).tolist(), owner[which].tolist()):
                spans.setdefault(d, set()).add((s, s + size))
                owners.setdefault(d, set()).add(ids[o])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("decontamination",), None)
        for batch in batches:
            for row in range(batch.num_rows):
                name, doc_ids, doc_words, vocabulary, starts, postings = (batch.column(k)[row].as_py() for k in range(6))
                shard = Shard(doc_words, vocabulary, starts, postings)
                spans: dict[int, set] = {}
                owners: dict[int, set] = {}
                for block in blocks:
                    search(shard, block.value, spans, owners)
                    if len(blocks) > 1:  # a worker holds one at a time; the next use reads it again from the executor's disk
                        vars(block).pop("_value", None)
                merged = [[] for _ in doc_ids]
                for d, pairs in spans.items():
                    for s, e in sorted(pairs):
                        if merged[d] and s <= merged[d][-1]["stop"]:
                            merged[d][-1]["stop"] = max(e, merged[d][-1]["stop"])
                        else:
                            merged[d].append({"start": s, "stop": e})
                found = [sorted(owners.get(d, ()), key=lambda o: (o is None, o or "")) for d in range(len(doc_ids))]
                columns = ([name] * len(doc_ids), range(len(doc_ids)), doc_ids, doc_words, merged, found)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["shard", "doc_no", "doc_id", "n_words", "hits", "items"])

    return index.mapInArrow(hits, schema)


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per document the word spans at which a window of an item occurs exactly, and these items."""
    return _hits(index, items, window, None, item_id, text)


def proximity_hits(index: DataFrame, items: DataFrame, window: int = WINDOW, reach: int = 2 * WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per document the places of a window's rarest word that have all its other words within ``reach`` words."""
    return _hits(index, items, window, reach, item_id, text)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: the words that benchmark windows hit, and whether that is a twentieth or more."""
    found = phrase_hits(build_index(docs, doc_id), items)
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["stop"]).alias("upto")),
    )["n"]
    names = F.array_sort(F.filter(F.array_distinct("items"), lambda x: x.isNotNull()))
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size(F.array_distinct("items")).cast("bigint").alias("n_items"), names.alias("item_names")
    ).select(
        "*", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns.

    A row is judged by its text, so documents are indexed under their text's hash:
    ids may be null or repeated. Only texts that a filter of bounded size lets
    through are moved for the last join.
    """
    maybe, digest = fresh(docs.columns, "maybe", "digest")
    judged = contamination(docs.select(F.sha1(F.col("text").cast("binary")).alias("digest"), "text"), items, "digest")
    bad = stored(judged.where("contaminated").select(F.col("doc_id").alias(digest)).distinct(), "contaminated")
    rows = flagged(docs.withColumn(digest, F.coalesce(F.sha1(F.col("text").cast("binary")), F.lit(""))), F.col(digest), bad, maybe)
    sure = rows.where(~F.col(maybe)).select(docs.columns)
    return sure.unionByName(rows.where(F.col(maybe)).join(bad, digest, "left_anti").select(docs.columns))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contamination`` with the items' ids as a hash."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.concat_ws(",", "item_names"), "UTF-8"), 256).alias("items_sha256"), "contaminated"
    )
