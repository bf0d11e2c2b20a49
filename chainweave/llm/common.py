"""What the operators of this subpackage share: tables, shared folders, word splitting."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import Scratch, removed, shared_folder, stored  # noqa: F401  the operators take them from here

#: Bytes of an Arrow batch handed to Python at once; with it a worker's memory
#: does not depend on how long the texts are (one text is never cut).
ARROW_BATCH_BYTES = 16 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with none of ``taken``."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return out


#: Words of a filter of keys: what is broadcast has at most so many rows, whatever the input.
FILTER_WORDS = 1 << 19
_BITS = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(h, {at}) & 63 as int))" for at in (58, 52, 46, 40))


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` and whether ``key`` may be among the one column of ``wanted``; rows with a null key may.

    A Bloom filter: each wanted key sets four bits of one of ``FILTER_WORDS``
    words, and the words are broadcast. A row that is not flagged is not wanted;
    one that is must still be joined. However many keys are wanted, no more is
    sent: the filter then lets more rows through, and the join stays exact.
    """
    slot, bits, word = fresh(rows.columns, "slot", "bits", "word")
    (own,) = wanted.columns
    hashed = wanted.select(F.xxhash64(F.col(own)).alias("h")).select(F.pmod("h", F.lit(FILTER_WORDS)).alias(slot), F.expr(_BITS).alias("m"))
    words = hashed.groupBy(slot).agg(F.bit_or("m").alias(word))
    (h,) = fresh(rows.columns, "h")
    probed = rows.withColumn(h, F.xxhash64(key)).withColumns({slot: F.pmod(F.col(h), F.lit(FILTER_WORDS)), bits: F.expr(_BITS.replace("(h,", f"(`{h}`,"))})
    there = probed.join(F.broadcast(words), slot, "left")
    found = F.coalesce(F.col(word).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False)) | key.isNull()
    return there.withColumn(flag, found).select(*rows.columns, flag)


def bounded_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Lower the bytes of an Arrow batch to ``most``, for the rest of the session; a lower setting stays.

    The plan that Arrow functions run with is made when the result is asked for, so it can't be set back here.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b")) if spark.conf.get(key).rstrip("b").isdigit() else 0
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


#: Lower-cases A-Z and turns every ASCII character but letters and digits into a
#: space; bytes of non-ASCII characters stay, so these count as word characters.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_held: dict = {}


def _trim() -> None:
    """Give freed memory back to the system where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held(key: tuple, make):
    """What a Python worker keeps from task to task, such as a compiled model and its caches.

    One thing at a time: another operator's task in the same worker lets the
    memory of the one before go, also if it keeps nothing itself (``make`` None).
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _trim()
        _held[key] = make and make()
    return _held[key]
