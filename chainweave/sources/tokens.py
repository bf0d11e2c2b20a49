"""Tokens with their places in the raw text, alignment of given tokens to it, and documents annotated anew."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

SPACE = r"[ \t\n\r\f\x0B]"
#: A text is a sequence of these pieces, white space among them; the first that fits is taken.
PIECE = rf"{SPACE}+|\.\.+|--+|[0-9]+(?:[.,:/][0-9]+)*%?|[\p{{L}}\p{{M}}\p{{N}}]+(?:[-'’.&_][\p{{L}}\p{{M}}\p{{N}}]+)*|[\s\S]"
#: What is cut off the end of a word.
ENDING = r"(?i)^(.+)(n't|'(?:s|re|ve|ll|d|m))$"
_ENDING = re.compile(ENDING, re.ASCII)
#: Texts whose tokens are placed at once.
TEXTS = 256
# How brackets are written in annotated text.
BRACKETS = {"(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", "{": "-LCB-", "}": "-RCB-"}
QUOTES = ("``", "''")
# Marks that end a word, and those that follow the end of a sentence.
ENDING_WORDS = (".", "?", "!", ",", ":", ";", "'", '"', "``", "''", ")")
AFTER_SENTENCES = ('"', "''", "``", "'", ")")


def token_lists(texts: DataFrame, key: str = "doc_id", text: str = "text", kept: Iterable[str] = ()) -> DataFrame:
    """``key``, the ``kept`` columns, and the tokens of each text as arrays: starts, stops, raws, tokens (``tokenized``).

    A text is one row from beginning to end, so nothing is shuffled. Pieces are found natively, their places are running sums
    over the pieces of some texts at a time.
    """
    names = [key, *kept]
    rows = texts.select(*names, F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)).alias("pieces"))
    head = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_placed(batch.column(len(names)))], names=[*names, "starts", "stops", "raws", "tokens"])

    return rows.mapInArrow(run, head + "starts array<bigint>, stops array<bigint>, raws array<string>, tokens array<string>")


def _placed(pieces: pa.ListArray) -> list[pa.Array]:
    """Of the pieces of some texts: starts, stops, raw and written tokens."""
    owner = np.repeat(np.arange(len(pieces)), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())
    raw = pieces.flatten()
    # words that lose an ending are two pieces
    marked = np.flatnonzero(pc.match_substring(raw, "'").to_numpy(zero_copy_only=False))
    cut = {k: m.groups() for k, x in zip(marked.tolist(), raw.take(pa.array(marked)).to_pylist()) if (m := _ENDING.match(x))}
    if cut:
        both = np.ones(len(raw), int)
        both[list(cut)] = 2
        places, values, at = np.cumsum(both) - both, [], 0
        for k, ends in cut.items():
            values += [raw.slice(at, k - at), pa.array(ends, raw.type)]
            at = k + 1
        raw, owner = pa.concat_arrays([*values, raw.slice(at)]), np.repeat(owner, both)
        assert len(raw) == len(owner) == places[-1] + both[-1]
    size = pc.utf8_length(raw).to_numpy().astype(np.int64)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    ends = np.cumsum(size)
    before = (ends - size)[first]
    starts = ends - size - (np.repeat(before, np.diff(np.r_[np.flatnonzero(first), len(owner)])) if len(owner) else 0)
    token = raw.to_numpy(zero_copy_only=False).copy()
    for mark, name in BRACKETS.items():
        token[pc.equal(raw, mark).to_numpy(zero_copy_only=False)] = name
    quoted = np.flatnonzero(pc.equal(raw, '"').to_numpy(zero_copy_only=False))
    opens = pc.match_substring_regex(raw, rf"^(?:{SPACE}|[(\[{{])").to_numpy(zero_copy_only=False)
    token[quoted] = np.where(first[quoted] | opens[quoted - 1], *QUOTES)
    shown = np.flatnonzero(~pc.match_substring_regex(raw, rf"^{SPACE}").to_numpy(zero_copy_only=False))
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(owner[shown], minlength=len(pieces)))].astype(np.int32))
    values = [pa.array(starts[shown]), pa.array((starts + size)[shown]), raw.take(pa.array(shown)), pa.array(token[shown], pa.string())]
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def tokenized(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, tok_idx, start, stop, raw, token: the tokens of each text, their places in code points, end exclusive.

    Words lose their endings ('s, n't), brackets get their names, straight double quotes become opening or closing ones. What
    is between two tokens is white space, so raw tokens and their places give the text back. A null text has no tokens; texts
    that share a key must not. The rows of a text are exploded from its lists (``token_lists``).
    """
    each = token_lists(texts, key, text).select(key, F.posexplode(F.arrays_zip("starts", "stops", "raws", "tokens")).alias("tok_idx", "x"))
    return each.select(key, F.col("tok_idx").cast("bigint").alias("tok_idx"), F.col("x.starts").alias("start"), F.col("x.stops").alias("stop"), F.col("x.raws").alias("raw"), F.col("x.tokens").alias("token"))


_RAW = {name: (mark,) for mark, name in BRACKETS.items()} | {"``": ('"', "``"), "''": ('"', "''")}


def places(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Where the tokens are in the text, by two pointers; a token that is not next (after white space) raises."""
    at, out, n = 0, [], len(text)
    for token in tokens:
        while at < n and text[at] in " \t\n\r\f\x0b":
            at += 1
        if token in _RAW:
            raw = next((r for r in (*_RAW[token], token) if text.startswith(r, at)), None)
        else:
            raw = token if text.startswith(token, at) else None
        if raw is None:
            raise ValueError(f"token {token!r} is not at {at}: {text[at : at + 20]!r}")
        out.append((at, at + len(raw)))
        at += len(raw)
    return out


def aligned(texts: DataFrame, tokens: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, tok_idx, start, stop, token of given tokens (key, tok_idx, token) in their raw texts. A text with its tokens is one row."""
    listed = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "token"))).alias("t"))
    rows = texts.select(key, F.col(text).alias("text")).join(listed, key).select(key, "text", F.col("t.token").alias("tokens"))
    each = aligned_lists(rows, key).select(key, F.posexplode(F.arrays_zip("starts", "stops", "tokens")).alias("tok_idx", "x"))
    return each.select(key, F.col("tok_idx").cast("bigint").alias("tok_idx"), F.col("x.starts").alias("start"), F.col("x.stops").alias("stop"), F.col("x.tokens").alias("token"))


def aligned_lists(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, tokens, starts, stops of texts that have their tokens beside them (key, text, tokens): nothing is shuffled."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                found = [places(text or "", own or []) for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                lists = [pa.array([[p[k] for p in own] for own in found], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=[key, "tokens", "starts", "stops"])

    return rows.select(key, "text", "tokens").mapInArrow(run, f"`{key}` {kind}, tokens array<string>, starts array<bigint>, stops array<bigint>")


def untokenized_next(tokens: DataFrame, by: list[str], order: str = "tok_idx") -> DataFrame:
    """``next``: what follows each token as running text has it: the next token; after a quote or bracket also the one behind it, and a
    mark that ends a word behind that. Null at the end (G23)."""
    w = Window.partitionBy(*by).orderBy(order)
    one, two, three = (F.lead("token", k).over(w) for k in (1, 2, 3))
    longer = F.when(three.isin(*ENDING_WORDS), F.concat(one, two, three)).otherwise(F.concat(one, two))
    return tokens.withColumn("next", F.when(one.isin(*AFTER_SENTENCES) & two.isNotNull(), longer).otherwise(one))


def reannotated(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """The tokens with the columns of ``tags`` (doc_key, sent_idx, tok_idx, and some of pos, parse_bit, bio) in the place of their own.

    A sentence of which ``tags`` has another number of tokens keeps what it has. ``bio`` becomes the entity bits: a chunk begins at
    B and ends before the next B or O; as the chunks are made so, one that reaches the end of a sentence is dropped.
    """
    keys = ["doc_key", "sent_idx", "tok_idx"]
    given = tags.select(*keys, *(F.col(c).alias(f"_{c}") for c in tags.columns if c not in keys))
    names = [c for c in tags.columns if c not in keys]
    if "bio" in names:
        w = Window.partitionBy("doc_key", "sent_idx").orderBy("tok_idx")
        starts = F.startswith(F.col("_bio"), F.lit("B"))
        run = F.sum((starts | F.startswith(F.col("_bio"), F.lit("O"))).cast("int")).over(w)
        given = given.withColumn("_run", run)
        chunk = Window.partitionBy("doc_key", "sent_idx", "_run")
        inside, last = F.max(starts.cast("int")).over(chunk) == 1, F.max("tok_idx").over(chunk)
        ended = inside & (last < F.max("tok_idx").over(Window.partitionBy("doc_key", "sent_idx")))
        first = F.min("tok_idx").over(chunk) == F.col("tok_idx")
        label = F.first(F.substring_index("_bio", "-", -1)).over(chunk.orderBy("tok_idx"))
        bit = F.when(~ended, "*").when(first & (last == F.col("tok_idx")), F.concat(F.lit("("), label, F.lit(")"))).when(first, F.concat(F.lit("("), label, F.lit("*"))).when(last == F.col("tok_idx"), "*)").otherwise("*")
        given = given.withColumn("_ner_bit", bit).drop("_run", "_bio")
        names = ["ner_bit" if n == "bio" else n for n in names]
    size = lambda df, name: df.groupBy("doc_key", "sent_idx").agg(F.count("*").alias(name))
    whole = size(tokens, "n").join(size(given, "g"), ["doc_key", "sent_idx"]).where("n = g").select("doc_key", "sent_idx", F.lit(True).alias("_whole"))
    rows = tokens.join(given, keys, "left").join(whole, ["doc_key", "sent_idx"], "left")
    return rows.withColumns({n: F.when(F.col("_whole"), F.col(f"_{n}")).otherwise(F.col(n)) for n in names}).select(tokens.columns)
