"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed 5-word shingles; two are linked if their Jaccard
similarity is 0.8 or more.

1. ``signatures`` gives each document a 128-bit key of its set (copies share it)
   and the hashes of its MinHash bands.
2. Documents that share a band hash have a common hub, and ``gathered`` makes
   blocks of what hangs together: no link crosses blocks. The 40 bands of 5 values
   miss a pair at the threshold with probability 1.3e-7.
3. Only one document of each key in a block of two keys or more is read again;
   a filter of bounded size keeps other texts from being moved. A large block is
   cut into chunks of bounded size, and every pair of chunks goes to a task: no
   group is held by one task and no pair of documents is a row.
4. In a task MinHash values are compared 20 at a time; a pair is dropped when the
   posterior probability (uniform prior) that its similarity reaches 0.8 is below
   ``TOLERANCE``. The survivors are verified on their whole shingle sets.
5. Tasks return per key its number of links and one link to its block's root;
   classes are the components of the links.

The work within one group of near copies of different texts grows with the
square of the number of these texts (each pair is compared in a few
nanoseconds); exact copies cost nothing, since only keys are compared.

Defined results: ``class_id`` is the smallest doc_id of the class, ``n_links``
the number of other documents whose similarity is 0.8 or more, copies included.
A text of fewer than five words is one shingle. A null or wordless text has no
shingles and no links: its class is itself. A document without an id is linked
like any other; a class none of whose documents has an id is null. Repeated rows
are copies of each other; rows of equal id and different text are compared each by
its own text, which is found again by id and hash. ``distinct_documents`` keeps of each class one row: the smallest id (a
missing one comes last), then the smallest key, any one of equal rows; it hands
all columns through whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import components
from .caching import Cache
from .common import Scratch, bounded_batches, flagged, fresh, held, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 40, 5
HASHES = BANDS * BAND_ROWS
#: MinHash values compared before the posterior is looked at again.
STEP = 20
TOLERANCE = 1e-9
#: Blocks of more keys than WHOLE_KEYS are cut. The number of chunks is the root of a
#: block's keys by CHUNK_ROOT (copies of a row and rows of a task then grow alike),
#: and more if a chunk would be beyond these keys and shingles, which bound a task.
WHOLE_KEYS, CHUNK_ROOT = 256, 20
CHUNK_KEYS, CHUNK_SHINGLES = 4096, 1 << 20
#: Keys that a task remembers, to write the bands of a key's copies once.
REMEMBERED = 1 << 17
CACHED_WORDS = 150_000

_random = np.random.default_rng(20)
_ODD = _random.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_XOR = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(1, 2**63, BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of the text's shingle hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    hash_of = held(("shingles",), lambda: Cache(xxhash.xxh64_intdigest, CACHED_WORDS))
    hashed = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    if len(hashed) < SHINGLE:
        return _mixed((hashed * _PLACE[: len(hashed)]).sum(keepdims=True) + np.uint64(len(hashed)))
    n = len(hashed) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += hashed[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8").tolist())


def minhash(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` values of 32 bits."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for lo in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[None, lo : lo + 512] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_hashes(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    total = _BAND.copy()
    for k in range(BAND_ROWS):
        total = _mixed(total + rows[:, k] * _PLACE[k])
    return total.view(np.int64)


@lru_cache
def least_matches(threshold: float, compared: int) -> int:
    """The fewest matches of so many values for which the similarity may still reach the threshold.

    With a uniform prior the posterior after m matches is Beta(m + 1, compared - m + 1).
    """
    total = 0.0
    for m in range(compared + 1):
        total += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= TOLERANCE:
            return m
    return compared


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), k1, k2 (the set's key), n (its shingles), bands (of copies that one task meets, the first one's only)."""
    none, most = np.zeros(0, np.int64), REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py())
                key = set_key(own)
                bands.append(band_hashes(minhash(own)) if len(own) and key not in seen else none)
                keys.append(key)
                sizes.append(len(own))
                if len(seen) >= most:
                    seen.clear()
                seen.add(key)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                names=["doc_id", "th", "k1", "k2", "n", "bands"],
            )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, k1 bigint, k2 bigint, n int, bands array<bigint>")


_BLOCK = "block bigint, chunk int, chunks int, k1 bigint, k2 bigint, rep bigint, copies bigint, sketch binary, hashes binary"


def _opened(wanted: DataFrame) -> DataFrame:
    """The MinHash values and shingles of the wanted documents, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sketches, hashes = [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for k, text in enumerate(columns[7]):
                own = shingles(text)
                if set_key(own) == (columns[3][k], columns[4][k]):  # not another text of the same id and hash
                    keep.append(k)
                    sketches.append(minhash(own).tobytes())
                    hashes.append(own.tobytes())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:7], pa.array(sketches, pa.binary()), pa.array(hashes, pa.binary())], names=[x.split()[0] for x in _BLOCK.split(", ")])

    return wanted.select("block", "chunk", "chunks", "k1", "k2", "rep", "copies", "text").mapInArrow(run, _BLOCK)


def linked_pairs(sketches: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left`` the rows of ``right`` after it (if they are the same rows) that it is linked to."""
    sizes = np.array([len(s) for s in sets])
    exact = round(threshold * 10_000)
    for i in left:
        j = right[right > i] if left is right else right
        # no smaller and no larger set can reach the threshold
        j = j[(sizes[j] * 10_000 >= exact * sizes[i]) & (sizes[i] * 10_000 >= exact * sizes[j])]
        matches = np.zeros(len(j), np.int64)
        for at in range(0, HASHES, STEP):
            if not len(j):
                break
            matches += (sketches[j, at : at + STEP] == sketches[i, at : at + STEP]).sum(1)
            stay = matches >= least_matches(threshold, at + STEP)
            if not stay.all():
                j, matches = j[stay], matches[stay]
        if len(j):
            own, others = sets[i], np.concatenate([sets[k] for k in j])
            place = np.minimum(np.searchsorted(own, others), len(own) - 1)
            starts = np.cumsum([0, *sizes[j][:-1]])
            common = np.add.reduceat((own[place] == others).astype(np.int64), starts)
            yield i, j[common * 10_000 >= exact * (sizes[i] + sizes[j] - common)]


_FOUND = "k1 bigint, k2 bigint, rep bigint, whole boolean, root bigint, r1 bigint, r2 bigint, links bigint"


def _block_links(rows: list[tuple]) -> list[tuple]:
    """For the rows of two chunks (or one): key, rep, whether this is the whole block, the first linked row's rep and key, links."""
    unique = {}
    for row in rows:
        unique.setdefault((row[5], row[6]), row)
    rows = sorted(unique.values(), key=lambda r: (r[7] is None, r[7] or 0, r[5], r[6]))
    whole = rows[0][4] == 1
    sketches = np.frombuffer(b"".join(r[9] for r in rows), np.uint32).reshape(len(rows), HASHES)
    sets = [np.frombuffer(r[10], np.uint64) for r in rows]
    copies = np.array([r[8] for r in rows], np.int64)
    first = np.array([r[3] == r[1] for r in rows])
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    if rows[0][1] == rows[0][2]:
        left = right = np.arange(len(rows))
    links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, linked in linked_pairs(sketches, sets, left, right):
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        for j in linked.tolist():
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    tops = [rows[top(k)] for k in range(len(rows))]
    return [(r[5], r[6], r[7], whole, t[7], t[5], t[6], n) for r, t, n in zip(rows, tops, links.tolist())]


def _verified(blocks: DataFrame) -> DataFrame:
    """Links within every pair of chunks; rows come sorted, so a pair of chunks is a run of rows."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        fields = [x.split() for x in _FOUND.split(", ")]
        types = [pa.bool_() if t == "boolean" else pa.int64() for _, t in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, out = [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    if len(group) > 1:
                        out += _block_links(group)
                    group, at = [], row[:3]
                group.append(row)
            if out:
                yield batch_of(out)
                out = []
        if len(group) > 1:
            yield batch_of(_block_links(group))

    return blocks.mapInArrow(run, _FOUND)


def gathered(stars: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """k1, block for every k1 of ``stars`` (k1, hub): blocks hang together by common hubs, directly or by others.

    A key joins the least of its hubs, and only hubs that meet in a key are edges
    of the graph: a group around one hub, however large, has none.
    """
    near = scratch.store(stars.groupBy("k1").agg(F.min("hub").alias("hub"), F.collect_set("hub").alias("hubs")), name)
    edges = near.select(F.col("hub").alias("a"), F.explode(F.array_remove("hubs", F.col("hub"))).alias("b"))
    tops = components(edges).select(F.col("node").alias("hub"), "component")
    return near.select("k1", "hub").join(tops, "hub", "left").select("k1", F.coalesce("component", "hub").alias("block"))


def _blocks(signed: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the keys that share a band hash with others: k1, k2, rep, th, copies, block, chunk, chunks."""
    band = signed.select("k1", F.explode("bands").alias("band"))
    shared = scratch.store(band.groupBy("band").agg(F.min("k1").alias("hub"), F.max("k1").alias("other")).where("hub <> other").select("band", "hub"), "bands")
    blocks = gathered(band.join(shared, "band").select("k1", "hub"), scratch, "hubs")
    members = scratch.store(keys.join(blocks, "k1"), "members")
    count = F.count("*")
    root = F.when(count > WHOLE_KEYS, F.ceil(F.sqrt(count / CHUNK_ROOT))).otherwise(1)
    chunks = F.greatest(root, F.ceil(count / CHUNK_KEYS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    large = scratch.store(members.groupBy("block").agg(chunks.alias("chunks")).where("chunks > 1"), "large")
    wanted = members.join(large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return wanted.withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int"))


def _described(source: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and for each key: k1, k2, copies, links (other keys' rows), head (rep, k1, k2 of its class's first key)."""
    signed = scratch.store(signatures(source), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("rep"), "th")).alias("first")
    keys = signed.where("n > 0").groupBy("k1", "k2").agg(first, F.count("*").alias("copies"), F.max("n").alias("n"))
    keys = scratch.store(keys.select("k1", "k2", "first.rep", "first.th", "copies", "n"), "keys")
    wanted = _blocks(signed, keys, scratch)
    # a text by its id and hash, once however often the row is repeated
    likely = flagged(source, F.col("th"), wanted.select("th"), "likely").where("likely")
    texts = likely.groupBy(F.col("doc_id").alias("own"), F.col("th").alias("hash")).agg(F.any_value("text").alias("text"))
    texts = wanted.join(texts, F.col("rep").eqNullSafe(F.col("own")) & (F.col("th") == F.col("hash")))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = _opened(texts).withColumn("other", other).select("block", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "chunks", "k1", "k2", "rep", "copies", "sketch", "hashes")
    # the pairs of a block's chunks go to tasks in turn, so no two meet before each task has one
    tasks = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("block") + F.col("lo") * F.col("chunks") + F.col("hi"), F.lit(tasks)).cast("int")
    dealt = pairs.repartitionById(tasks, turn).sortWithinPartitions("block", "lo", "hi")
    found = scratch.store(_verified(dealt), "found")

    # classes of blocks that were cut: what hangs together by the chunk pairs' first rows
    cut = found.where("not whole")
    linked = found.where("whole").select("k1", "k2", F.struct(F.col("root").alias("rep"), F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("head"), "links")
    if not cut.isEmpty():
        tops = gathered(cut.select("k1", F.col("r1").alias("hub")), scratch, "roots")
        sums = scratch.store(cut.groupBy("k1", "k2").agg(F.sum("links").alias("links"), F.min("rep").alias("rep")).join(tops, "k1"), "sums")
        least = F.min(F.struct(F.col("rep").isNull().alias("missing"), F.struct("rep", "k1", "k2").alias("head"))).alias("least")
        heads = scratch.store(sums.groupBy("block").agg(least).select("block", "least.head"), "heads")
        linked = linked.unionByName(sums.join(heads, "block").select("k1", "k2", "head", "links"))
    described = keys.join(linked, ["k1", "k2"], "left").select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("head", F.struct("rep", "k1", "k2")).alias("head"))
    return signed, scratch.store(described, "described")  # stored, so that a key of many copies can be split when it is joined


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    signed, described = _described(_source(docs), scratch)
    scratch.close("signatures", "described")
    described = described.select("k1", "k2", F.col("head.rep").alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return signed.where("n > 0").join(described, ["k1", "k2"]).select("doc_id", "class_id", "n_links").unionByName(alone)


def _keyed(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """``docs`` and the key of each row's shingle set."""
    names, at = [*docs.columns, k1, k2], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(shingles(text.as_py())) for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType())]))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns.

    Only rows whose text's hash is that of a row with copies or links are looked at again.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    signed, described = _described(_source(docs), scratch)
    several = scratch.store(described.where("copies > 1 or links > 0").select("k1", "k2", "head"), "several")
    hashes = signed.where("n > 0").join(several.select("k1", "k2"), ["k1", "k2"]).select("th")
    maybe, k1, k2, head, same = fresh(names, "maybe", "k1", "k2", "head", "same")
    rows = flagged(docs, F.xxhash64("text"), hashes, maybe)
    keyed = _keyed(rows.where(F.col(maybe)).drop(maybe), k1, k2)
    judged = keyed.join(several.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("head").alias(head)), [k1, k2], "left")
    first = F.col("doc_id").cast("bigint").eqNullSafe(F.col(f"{head}.rep")) & (F.col(k1) == F.col(f"{head}.k1")) & (F.col(k2) == F.col(f"{head}.k2"))
    kept = scratch.store(judged.where(F.col(head).isNull() | first), "kept")
    # equal rows of a class's first id: one of them
    one = kept.where(F.col(head).isNotNull()).groupBy(k1, k2).agg(F.any_value(F.struct(*(F.col(f"`{n}`") for n in names))).alias(same)).select(f"{same}.*")
    out = rows.where(~F.col(maybe)).select(names).unionByName(kept.where(F.col(head).isNull()).select(names)).unionByName(one)
    scratch.close("signatures", "several", "kept")
    return out
