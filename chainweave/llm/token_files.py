"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

``write_tokens`` tokenizes whole documents in ascending id order into raw
segments with their counts of ids, sums these over all documents, derives one canonical code with a
bounded code length (package-merge), and writes one file per segment. A file
holds its code lengths, document ids and lengths, the bit offset of every block
(checkpoints) and the bit stream. ``read_tokens`` decodes a file by table:
blocks are independent, so one step decodes the next id of every block at once.

Every stage ends in a table of the shared folder: a lost executor costs the
tasks that it ran. Only the counts per id (at most the vocabulary) and the sums
per partition reach the driver.

Defined results: null counts as an empty text, which is one end id; a null
document id sorts first; rows of equal id are ordered by a hash of their text,
so that many of them can be dealt to several tasks; very long texts make a long
segment of their own; other columns are ignored.

File: ``CWTOK1``, header length (u32), header (JSON), then the sections named
in the header with their sizes, then one zero byte. All little-endian but the
stream, which is of big-endian 32-bit words.
"""

from __future__ import annotations

import hashlib
import json
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import BYTE_LETTERS, SPACES
from .caching import TextCache
from .common import Scratch, bounded_batches, held, shared_folder

#: Entries of each generation of a worker's cache of words after a space; others are a tenth.
CACHED_WORDS = 400_000
LONGEST_CODE = 18
#: Ids of a block; each has a checkpoint.
BLOCK = 256
#: Ids packed at a time, whole blocks.
PACKED = 256 * BLOCK
#: Ids after which a segment (one file) is closed.
SEGMENT = 1 << 20
MAGIC = b"CWTOK1"
#: ASCII characters that are neither letters, digits nor white space.
MARKS = string.punctuation


class Pieces:
    """Encodes with the tokenizers library, asking it once for each distinct word.

    A single space or line feed between two other characters always ends a
    pre-token, so texts are cut there first. Where the cut is not certain (white
    space in a row, at either end) the whole text is split by the pattern.
    """

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(file)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a byte-level tokenizer file")
        self.model = Tokenizer.from_str(file).model
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.tokenize, self.space = self.model.tokenize, " ".translate(BYTE_LETTERS)
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.kind, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split
        # Fixed value: the byte-level pattern.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.word_ids = TextCache(self._word, CACHED_WORDS // 10)
        self.first_ids = TextCache(self._chunk, CACHED_WORDS // 10)
        self.next_ids = TextCache(self._next, CACHED_WORDS)
        self.line_feed = self.word_ids["\n"]

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _next(self, chunk: str) -> bytes | None:
        """The ids of a space and a chunk without spaces."""
        if chunk.isalpha():
            if chunk.isascii():  # each letter stands for its byte
                return array(self.code, [t.id for t in self.tokenize(self.space + chunk)]).tobytes()
            return self._word(" " + chunk)
        body = chunk.rstrip(MARKS)
        if body.isalpha():  # a pre-token of letters and one of marks, as marks alone are no contraction
            return self.next_ids[body] + self.word_ids[chunk[len(body) :]]
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes | None:
        if not chunk or chunk[-1] in SPACES or chunk.lstrip(" ")[:1] in SPACES or chunk[:2] == "  ":
            return None  # not certain: white space that could belong to what is beside it
        words = self.split(chunk)
        if len(words) == 1:
            return self._word(words[0])
        # a pre-token that begins with the space is the space and a chunk again, if that is certain
        found = (self.next_ids[w[1:]] if w[0] == " " and w != " " else self.word_ids[w] for w in words)
        return b"".join(self.word_ids[w] if ids is None else ids for w, ids in zip(words, found))

    def _plain(self, text: str) -> bytes:
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.first_ids[first])
            out += map(self.next_ids.__getitem__, rest)
            out.append(self.line_feed)
        out.pop()
        try:
            return b"".join(out)
        except TypeError:  # None: a cut that is not certain
            return b"".join(map(self.word_ids.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(t in text for t in self.special):
            return self._plain(text)
        parts = (np.array([self.special[x]], self.kind).tobytes() if x in self.special else self._plain(x) for x in self.cut(text) if x)
        return b"".join(parts)


def opened(file: str) -> Pieces:
    """The compiled tokenizer; once per worker."""
    return held(("pieces", hashlib.sha256(file.encode()).hexdigest()), lambda: Pieces(file))


# -- the code ---------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits; 0 for counts of 0 (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes, by length and then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = order[lengths[order] == n]
        code <<= n - last
        last = n
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code += len(own)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, and the bit offset of each block; ``PACKED`` ids are worked on at a time."""
    words = np.zeros((int(lengths[ids].sum(dtype=np.int64)) >> 5) + 2 if len(ids) else 0, np.uint64)
    offsets, bit = [np.zeros(0, "<u8")], 0
    for lo in range(0, len(ids), PACKED):
        some = ids[lo : lo + PACKED]
        n = lengths[some].astype(np.int64)
        ends = bit + np.cumsum(n)
        starts = ends - n
        shifted = codes[some] << (64 - n - (starts & 31)).astype(np.uint64)
        at = starts >> 5
        first = np.flatnonzero(np.diff(at, prepend=-1))
        both = np.bitwise_or.reduceat(shifted, first)
        words[at[first]] |= both >> np.uint64(32)
        words[at[first] + 1] |= both & np.uint64(0xFFFFFFFF)
        offsets.append(starts[::BLOCK].astype("<u8"))
        bit = int(ends[-1])
    return words.astype(">u4").tobytes(), np.concatenate(offsets)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every string of the longest code's bits: the code's length << 32 | id."""
    most = max(1, int(lengths.max(initial=0)))
    table = np.zeros(1 << most, np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    entries = (lengths[used].astype(np.uint64) << np.uint64(32)) | used.astype(np.uint64)
    filled = np.repeat(entries, 1 << (most - lengths[used].astype(np.int64)))
    table[: len(filled)] = filled
    return table, most


def unpack(stream: bytes, offsets: np.ndarray, count: int, table: np.ndarray, most: int, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of the blocks named; any blocks can be decoded without the others."""
    last = len(offsets) - 1
    at = offsets[blocks].astype(np.int64)
    which = np.arange(len(offsets))[blocks]
    words = np.frombuffer(stream, ">u4").astype(np.uint64)
    words = np.concatenate([words, np.zeros(2, np.uint64)])
    windows = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((BLOCK, len(at)), np.uint32)
    for k in range(BLOCK if count > BLOCK * last and (which != last).any() else count - BLOCK * last):
        near = windows[np.minimum(at >> 5, len(windows) - 1)] << (at & 31).astype(np.uint64)
        entry = table[near >> np.uint64(64 - most)]
        out[k] = entry  # its low half
        at += (entry >> np.uint64(32)).astype(np.int64)
    ids = out.T.reshape(-1)
    spare = BLOCK * (last + 1) - count
    return ids[: len(ids) - spare] if len(which) and which[-1] == last and spare else ids


def to_file(start: int, doc_ids: list, tokens: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    stream, offsets = pack(ids, lengths, codes)
    sections = {
        "lengths": zlib.compress(lengths.tobytes()),
        "doc_ids": zlib.compress(json.dumps(doc_ids).encode()),
        "tokens": zlib.compress(np.array(tokens, "<u8").tobytes()),
        "offsets": offsets.tobytes(),
        "stream": stream,
    }
    header = json.dumps({"start": start, "count": len(ids), "block": BLOCK, "sections": {k: len(v) for k, v in sections.items()}}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections.values()])


def from_file(content: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """Start of the first document, document ids, their numbers of ids, all ids."""
    if content[:6] != MAGIC or content[-1:] != b"\0":
        raise ValueError("not a token file, or a part of one")
    (n,) = struct.unpack_from("<I", content, 6)
    header = json.loads(content[10 : 10 + n])
    parts, at = {}, 10 + n
    for name, size in header["sections"].items():
        parts[name] = content[at : at + size]
        at += size
    if at + 1 != len(content) or header["block"] != BLOCK:
        raise ValueError("damaged token file")
    lengths = np.frombuffer(zlib.decompress(parts["lengths"]), np.uint8)
    tokens = np.frombuffer(zlib.decompress(parts["tokens"]), "<u8")
    ids = np.zeros(0, np.uint32)
    if header["count"]:
        ids = unpack(parts["stream"], np.frombuffer(parts["offsets"], "<u8"), header["count"], *decoding_table(lengths))
    return header["start"], json.loads(zlib.decompress(parts["doc_ids"])), tokens, ids


# -- the jobs ---------------------------------------------------------------

_RAW = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("count", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])


def tokenized(docs: DataFrame, tokenizer: str, end: int, scratch: Scratch) -> DataFrame:
    """Raw segments in ascending document order; ``before``: ids before it in its partition."""
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())  # of the vocabulary's size
    most = SEGMENT

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, pieces = TaskContext.get().partitionId(), 0, opened(file.value)
        size, tail = np.dtype(pieces.kind).itemsize, np.array([end], pieces.kind).tobytes()
        doc_ids, tokens, ids, count = [], [], [], 0

        def row():
            whole = b"".join(ids)
            counts = np.bincount(np.frombuffer(whole, pieces.kind)).astype("<i4").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "before": before, "count": count, "doc_ids": doc_ids, "tokens": tokens, "ids": whole, "counts": counts}], schema=_RAW)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = pieces.encode(text.as_py() or "") + tail
                doc_ids.append(key)
                tokens.append(len(own) // size)
                ids.append(own)
                count += len(own) // size
                if count >= most:
                    yield row()
                    before += count
                    doc_ids, tokens, ids, count = [], [], [], 0
        if doc_ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64(F.coalesce("text", F.lit("")))]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    raw = ordered.mapInArrow(segments, "part int, before bigint, count bigint, doc_ids array<bigint>, tokens array<bigint>, ids binary, counts binary")
    return scratch.store(raw, "segments", **{"parquet.block.size": str(16 << 20), "compression": "zstd"})


def counted(raw: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents, from the segments' counts. At most the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("token files",), None)  # the encoder's memory is not needed here
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                own = np.frombuffer(counts.as_buffer() or b"", "<i4")
                total = np.concatenate([total, np.zeros(max(0, len(own) - len(total)), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = raw.select("counts").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 + int(rows["id"].max()) if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str, longest: int = LONGEST_CODE) -> None:
    """Tokenize ``docs`` (doc_id, text), with ``end`` after each document, into the files of a new folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = opened(open(tokenizer, encoding="utf-8").read()).kind
    scratch = Scratch(spark, "token-segments")
    raw = tokenized(docs, tokenizer, end, scratch)
    lengths = code_lengths(counted(raw), longest)
    starts, at = {}, 0
    for part, n in sorted((r[0], r[1]) for r in raw.groupBy("part").agg(F.sum("count")).collect()):  # a row for each partition
        starts[part] = at
        at += n
    shared = spark.sparkContext.broadcast((lengths, starts))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("token files",), None)
        lengths, starts = shared.value
        codes = canonical(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, _, doc_ids, tokens, ids = (batch.column(c)[k].as_py() for c in range(6))
                made = to_file(starts[part] + before, doc_ids, tokens, np.frombuffer(ids, kind), lengths, codes)
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["value"])

    # Spark's text sink writes the bytes of a value as they are, and the closing zero byte after them.
    made = raw.drop("counts").mapInArrow(files, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    scratch.close()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document in the files."""
    bounded_batches(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("token files",), None)
        for batch in batches:
            for content in batch.column(0):
                start, doc_ids, tokens, ids = from_file(content.as_py())
                ends = np.cumsum(tokens.astype(np.int64))
                begins = ends - tokens.astype(np.int64)
                data = ids.astype("<u4").tobytes()
                for lo in range(0, len(doc_ids), 4096):
                    some = slice(lo, lo + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[some], pa.int64()), pa.array(start + begins[some]), pa.array(tokens[some].astype(np.int64)), pa.array([data[4 * b : 4 * e] for b, e in zip(begins[some], ends[some])], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 1").select("content")
    return found.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the documents' ids into files, read these back and describe what was read."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_tokens(docs, tokenizer, end, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
