"""Byte-pair encoding and decoding with a deterministic tokenization automaton.

``Automaton`` compiles a list of merges by successive merge gadgets: it starts
with one state that loops on every base symbol, and for each merge (u, v), in
order of rank, redirects the arcs labelled u to a copy of their target without
the arc v, and adds arcs labelled uv. What remains accepts exactly one sequence
of tokens for every string: the one that the merges produce. A state is stored
as its difference from the state that it was copied from, so the compiled
tables grow with the number of merges and not with its square.

Text is split first; every distinct word is encoded once per worker by walking
its prefixes along the automaton's arcs (each prefix has one valid last token),
and words that share their first letters share that walk. Decoding emits the arcs' labels.

Defined results: null is encoded as null ids and decodes to null; an empty text
has no ids; texts are encoded whole whatever their length; repeated rows are
encoded each; other columns are kept, but those with the names that are added,
which can be chosen. A word of n letters takes memory in proportion to n.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .caching import Cache
from .common import bounded_batches, held

#: Entries of each generation of the word caches of a worker.
CACHED_WORDS = 180_000
#: Beginnings of words that are remembered; with smaller caches as many as these have words.
WALKED = 200_000
#: Beginnings of words up to this length are walked once for all words that share them.
SHARED_LETTERS = 24


class Automaton:
    """Tokens are numbered as in the vocabulary; state 0 is the start."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        n = 1 + max(vocabulary.values(), default=0)
        self.size = n
        self.parent, self.without, self.born = [0], [-1], [-1]
        #: The state that every arc of a token leads to.
        self.target = [0] * n
        #: For a merged token its left part and the merge's rank; rank -1: a base symbol.
        self.left, self.rank = [-1] * n, [-1] * n
        self.known: dict[int, bool] = {}
        for r, (a, b) in enumerate(merges):
            u, v, uv = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[uv] >= 0 or self.left[uv] == -2:
                raise ValueError(f"two merges make the token {a + b!r}")
            source, after = self.target[u], self.target[v]
            if self.left[u] == -2 or not self.arc(source, v):
                self.left[uv] = -2  # an earlier merge always takes u or v: no arcs
                continue
            self.left[uv], self.rank[uv], self.target[uv] = u, r, after
            self.parent.append(source)
            self.without.append(v)
            self.born.append(r)
            self.target[u] = len(self.parent) - 1
        self.known.clear()

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc labelled with the token."""
        key = state * self.size + token
        found = self.known.get(key)
        if found is not None:
            return found
        if len(self.known) > 1_000_000:
            self.known.clear()
        at, parent, without, born = token, self.parent, self.without, self.born
        found = self.left[token] != -2
        while found:
            r = self.rank[at]
            # states copied after the token was made: each may lack it
            while state and born[state] > r:
                if without[state] == at:
                    found = False
                    break
                state = parent[state]
            if not found or r < 0:
                break
            at = self.left[at]  # an older state has the token if it has its left part
        self.known[key] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()

# Fixed value: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class Labels:
    """What decoding needs of a tokenizer file: the label of each arc."""

    def __init__(self, file: str):
        spec = json.loads(file)
        self.labels = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class WordBpe(Labels):
    """The tokenizer of a JSON file: NFC, lower case, word split, byte letters, merges with word ends."""

    def __init__(self, file: str, cached: int = CACHED_WORDS):
        import regex

        super().__init__(file)
        spec = json.loads(file)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("not a tokenizer file of this kind")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.automaton = Automaton(self.vocabulary, [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
        self.split = regex.compile(pattern).findall
        self.pieces = regex.compile(f"[^{SPACES}]+").findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split
        self.longest = max(len(t) for t in self.vocabulary)
        self.word_ids = Cache(self._word, cached)
        self.chunk_ids = Cache(self._chunk, cached)
        #: What is known of a word's beginning: state, last token and its length, in one number.
        self.walks: dict[str, int] = {}
        self.walked = WALKED if cached >= CACHED_WORDS else min(WALKED, cached)

    def _step(self, word: str, upto: int, states: list[int], end: str) -> int:
        """The only arc into the place ``upto`` of the word from a place before it; -1 if a letter is no token."""
        a, find, known = self.automaton, self.vocabulary.get, self.automaton.known.get
        for i in range(upto - 1, max(0, upto - self.longest) - 1, -1):
            token = find(word[i:upto] + end)
            if token is not None and (state := states[i]) >= 0:
                arc = known(state * a.size + token)
                if arc or arc is None and a.arc(state, token):
                    return a.target[token] << 40 | token << 8 | upto - i
        return -1

    def _word(self, word: str) -> bytes:
        walks, n = self.walks, len(word)
        if len(walks) > self.walked:
            walks.clear()
        states, steps, find = [0], [], self._step
        for j in range(1, min(n, SHARED_LETTERS + 1)):
            step = walks.get(word[:j])
            if step is None:
                walks[word[:j]] = step = find(word, j, states, "")
            states.append(step >> 40)
            steps.append(step)
        for j in range(SHARED_LETTERS + 1, n):
            step = find(word, j, states, "")
            states.append(step >> 40)
            steps.append(step)
        steps.append(find(word, n, states, self.end))
        ids, at = [], n
        while at:
            step = steps[at - 1]
            if step >= 0:
                ids.append(step >> 8 & 0xFFFFFFFF)
                at -= step & 0xFF
            else:
                at -= 1
        return array("I", ids[::-1]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a text without white space."""
        if chunk.isascii() and chunk.isalpha():  # one word, its letters their own bytes
            return self.word_ids[chunk.lower()]
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        words = (w.encode().decode("latin-1").translate(BYTE_LETTERS) for w in self.split(text))
        return b"".join(map(self.word_ids.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # Python's split takes them for white space
        return b"".join(map(self.chunk_ids.__getitem__, self.pieces(text) if odd else text.split()))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<" not in text or not any(t in text for t in self.special):
            return self._plain(text)
        parts = (np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.cut(text))
        return b"".join(parts)


def opened(file: str, kind: type = WordBpe, *options):
    """The compiled tokenizer, or only its labels; once per worker."""
    return held(("bpe", kind.__name__, hashlib.sha256(file.encode()).hexdigest(), *options), lambda: kind(file, *options))


def _mapped(docs: DataFrame, tokenizer: str, text: str, added: dict[str, T.DataType], convert, kind: type, *options) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    file = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())  # of the vocabulary's size
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([f for f in docs.schema if f.name not in added] + [T.StructField(n, t) for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(file.value, kind, *options)
        for batch in batches:
            made = convert(model, batch.column(at))
            columns = {n: c for n, c in zip(names, batch.columns) if n not in made} | made
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids``: binary, little-endian unsigned 32-bit integers."""

    def convert(model: WordBpe, texts: pa.Array) -> dict:
        return {ids: pa.array([None if t is None else model.encode(t) for t in texts.to_pylist()], pa.binary())}

    return _mapped(docs, tokenizer, text, {ids: T.BinaryType()}, convert, WordBpe)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the text that the ids stand for."""

    def convert(model: Labels, values: pa.Array) -> dict:
        return {text: pa.array([None if v is None else model.decode(v) for v in values.to_pylist()], pa.string())}

    return _mapped(encoded, tokenizer, ids, {text: T.StringType()}, convert, Labels)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", cached: int = CACHED_WORDS) -> DataFrame:
    """``encode`` and then ``decode`` of the ids, in one pass and one Python worker for each task. ``cached``: entries of a worker's caches."""

    def convert(model: WordBpe, texts: pa.Array) -> dict:
        coded = [None if t is None else model.encode(t) for t in texts.to_pylist()]
        return {ids: pa.array(coded, pa.binary()), decoded: pa.array([None if c is None else model.decode(c) for c in coded], pa.string())}

    return _mapped(docs, tokenizer, text, {ids: T.BinaryType(), decoded: T.StringType()}, convert, WordBpe, cached)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document the number and the hashes of its ids and of the text decoded from them; null counts as empty."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return round_trip(source, tokenizer).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
