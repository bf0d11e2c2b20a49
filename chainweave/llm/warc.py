"""WARC archives: writing with revisit records, and a sequential reader.

Writing: payloads that occur more than once and have ``REVISIT_BYTES`` or more
are stored once; the row with the largest key is the response, the others
revisit it. Only digests and keys are grouped; a digest that many rows share is
spread over ``SALTS`` groups first. Every archive is a value of bounded size.

Reading: an archive is a file of gzip members, one for each record (or several),
or a plain file; its name does not matter. The reader inflates in small steps of
bounded output (``zlib.decompressobj``), takes the header up to its empty line,
then exactly ``Content-Length`` bytes, and verifies the block and payload digests
(hexadecimal or Base32; the payload's only if it has no transfer coding). Damage
raises ``WarcError``. A file is one value of Spark's binary source, so it may have
2 GB at most and must fit an executor's memory; of what it inflates to, one record
is held at a time.

Defined results: null html is an empty payload; rows of equal key and payload are
all responses if theirs is the largest key; a null key never is the largest one
unless all are null; an empty table gives an empty archive folder and no rows;
other columns are ignored; long payloads make an archive of their own. HTTP
header lines may be folded and may end in a line feed alone; those without a
colon are passed over; without an empty line all is header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, shared_folder

REVISIT_BYTES = 1000
SALTS = 32
#: An archive is closed at so many compressed bytes.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes inflated in one step.
STEP = 1 << 16
#: Bytes that one step inflates to, at most.
INFLATED = 1 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive is damaged or breaks the format."""


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if kind == "revisit" else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Stream:
    """The bytes of an archive, inflated as they are asked for: gzip members one after another, or a plain file."""

    def __init__(self, content):
        self.data, self.at, self.held = memoryview(content), 0, b""
        self.inflate = None
        self.plain = bytes(self.data[:2]) != b"\x1f\x8b"

    def more(self) -> bool:
        """Hold some bytes more; false at the archive's end."""
        data = self.data
        if self.plain:
            step = data[self.at : self.at + STEP]
            self.at += len(step)
            self.held += step
            return len(step) > 0
        if self.inflate is None:
            while self.at < len(data) and data[self.at] == 0:  # zero bytes after a member are padding
                self.at += 1
            if self.at == len(data):
                return False
            self.inflate = zlib.decompressobj(31)
        step = self.inflate.unconsumed_tail
        if not step:
            step = data[self.at : self.at + STEP]
            self.at += len(step)
        try:
            self.held += self.inflate.decompress(step, INFLATED)
        except zlib.error as e:
            raise WarcError(f"a member is damaged: {e}") from e
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = None
        elif not len(step):
            raise WarcError("the archive ends within a member")
        return True

    def began(self) -> bool:
        """Pass over the line ends (and padding) before a record; false if there is none."""
        while True:
            self.held = self.held.lstrip(b"\r\n\0" if self.plain else b"\r\n")
            if self.held:
                return True
            if not self.more():
                return False

    def header(self) -> bytes:
        """What precedes the first empty line, which must come within ``LONGEST_HEADER`` bytes."""
        seen = 0
        while not (end := _EMPTY_LINE.search(self.held, max(0, seen - 3))):
            seen = len(self.held)
            if seen > LONGEST_HEADER or not self.more():
                raise WarcError("a header has no end")
        found, self.held = self.held[: end.start()], self.held[end.end() :]
        return found

    def exactly(self, n: int) -> bytes:
        parts, have = [], 0
        while True:
            take = self.held[: n - have]
            parts.append(take)
            have += len(take)
            self.held = self.held[len(take) :]
            if have == n:
                return b"".join(parts)
            if not self.more():
                raise WarcError("a block is shorter than its Content-Length")


#: Bytes of a header at most; more is no header, however much inflates.
LONGEST_HEADER = 8 << 20
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def _fields(head: bytes, strict: bool) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space continues the one before."""
    fields, last = {}, None
    for line in re.split(r"\r?\n", head.decode("utf-8", "surrogateescape"))[1:]:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last:
            fields[last] = f"{fields[last]} {line.strip()}"
        elif colon:
            last = name.strip().lower()
            fields[last] = value.strip()
        elif strict and line:
            raise WarcError(f"not a header line: {line[:80]!r}")
    return fields


def _digest(value: str) -> tuple[str, str]:
    """The algorithm, and the digest in lower-case hexadecimal where it can be read."""
    kind, _, digest = value.strip().partition(":")
    kind = kind.lower().replace("-", "")
    size = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}.get(kind)
    if size and len(digest) != 2 * size:
        try:
            digest = base64.b32decode(digest.upper() + "=" * (-len(digest) % 8)).hex()
        except ValueError:
            pass
    return kind if size else "", digest.lower()


def read_archive(content) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC fields, HTTP fields and payload of each record, in order. One record is held at a time."""
    stream = _Stream(content)
    while stream.began():
        head = stream.header()
        if not head.startswith(b"WARC/"):
            raise WarcError("not a WARC record")
        fields = _fields(head, strict=True)
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise WarcError("a record has no valid Content-Length")
        block = stream.exactly(int(length))
        http, payload = {}, block
        if fields.get("content-type", "").lower().startswith("application/http"):
            end = _EMPTY_LINE.search(block)
            http = _fields(block[: end.start()] if end else block, strict=False)
            payload = block[end.end() :] if end else b""
        whole = fields.get("warc-type") != "revisit" and "transfer-encoding" not in http and "warc-truncated" not in fields
        for name, data, sure in (("warc-block-digest", block, True), ("warc-payload-digest", payload, whole)):
            kind, value = _digest(fields.get(name, ""))
            if kind and sure and value != hashlib.new(kind, data).hexdigest():
                raise WarcError(f"wrong {name} in record {fields.get('warc-record-id')}")
        yield fields, http, payload


def originals(pages: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """digest, salt, original: for each group of equal payloads worth a revisit, by the salts that occur in it."""
    salted = pages.where(F.col(size) >= REVISIT_BYTES).groupBy(digest, "salt").agg(F.max(key).alias("top"), F.count("*").alias("n"))
    whole = salted.groupBy(digest).agg(F.max("top").alias("original"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    return whole.where("n > 1 and original is not null").select(digest, F.explode("salts").alias("salt"), "original")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A record for each row, in archives of a new folder."""
    bounded_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload"), "salt": F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")})
    joined = rows.join(originals(rows, "key", "digest", "size").withColumnRenamed("digest", "d").withColumnRenamed("salt", "s"), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("size") >= REVISIT_BYTES), "left")
    refers = F.when(F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original")), F.col("original"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def value():
            whole = b"".join(parts)
            whole = whole[:-1] if whole[-1] == 0 else whole  # the sink adds a zero byte
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.large_binary()).cast(pa.binary())], names=["value"])

        for batch in batches:
            for k, u, p, d, r in zip(*(c.to_pylist() for c in batch.columns)):
                member = gzip.compress(record("response" if r is None else "revisit", k, u, p, d, r), LEVEL, mtime=0)
                parts.append(member)
                held += len(member)
                if held >= ARCHIVE_BYTES or member[-1]:  # a record of 16 MB or more ends its archive
                    yield value()
                    parts, held = [], 0
        if parts:
            yield value()

    made = joined.select("key", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(archives, "value binary")
    # Spark's text sink writes a value's bytes as they are and then the separator, which is the
    # last byte of every gzip member of less than 16 MB: such archives are plain .warc.gz files.
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _shown(value: str | None) -> str | None:
    """A header value as valid text: bytes that are not UTF-8 are replaced."""
    return value and value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder (or of one file, or of a pattern).

    record_type, record_id, target_uri, refers_to, payload_digest (lower-case
    hexadecimal), payload_bytes (of the full payload, null where a revisit does not
    say), payload (null for revisits).
    """
    bounded_batches(spark)
    names = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, http, payload in read_archive(content.as_buffer()):
                    kind = fields.get("warc-type")
                    whole = kind != "revisit"
                    digest = _digest(fields.get("warc-payload-digest", ""))[1] or (hashlib.sha1(payload).hexdigest() if whole else None)
                    length = http.get("content-length", "")
                    size = len(payload) if whole else int(length) if length.isascii() and length.isdigit() else None
                    rows.append((kind, *(_shown(fields.get(n)) for n in ("warc-record-id", "warc-target-uri", "warc-refers-to")), digest, size, payload if whole else None))
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    found = spark.read.format("binaryFile").load(path).where("length > 1").select("content")  # one byte: a task without rows
    return found.mapInArrow(records, "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, read the archives back and describe what was read."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
