"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word; dynamic
programming over the word's places carries the best score and the number of
pieces on the best path. Ties follow the tokenizer exactly: among paths of equal
score the one whose last piece starts first wins, a character without a piece of
its own costs the lowest score less ten, and unknown characters in a row are one
token. Each distinct word is solved once per worker.

No unigram vocabulary is at hand, and tokenizers are not trained here: the query
takes the pieces of a byte-pair file with its scores, which are negated merge
ranks, as a unigram model. Its counts are exact for that model (the tokenizers
library's Unigram with the same pieces and ``Metaspace``), not those of the
byte-pair encoder that the file was made for.

Defined results: null or empty text has no tokens and score 0; white space other
than the space is part of words, as in the tokenizer; texts are counted whole
whatever their length; repeated rows are counted each; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .caching import Cache
from .common import bounded_batches, held

#: Entries of each generation of a worker's word cache.
CACHED_WORDS = 120_000
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def unigram_pieces(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, the unknown piece first; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(model.unk_id()), 0.0), *((model.id_to_piece(i), float(model.get_score(i))) for i in plain)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        for piece, score in pieces[1:]:
            self.matches.add_word(piece, (len(piece), score))
        if pieces[0][0]:
            self.matches.add_word(pieces[0][0], (len(pieces[0][0]), pieces[0][1]))
        self.matches.make_automaton()
        self.words = Cache(self.word, CACHED_WORDS)

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation of a word."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for end, piece in self.matches.iter(word):
            ends[end].append(piece)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top = None
            for length, score in sorted(ends[e - 1], reverse=True):
                total = best[e - length] + score
                if top is None or total > top:
                    top, count[e], unknown[e] = total, count[e - length] + 1, False
            if word[e - 1] not in self.single:
                total = best[e - 1] + self.unknown
                if top is None or total > top:
                    top, count[e], unknown[e] = total, count[e - 1] + (not unknown[e - 1]), True
            best[e] = top
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = text.replace(SPACE, " ").split(" ")
        if not parts[0]:
            del parts[0]
        found = [self.words[SPACE + p] for p in parts]
        return sum(n for n, _ in found), sum(s for _, s in found)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text", added: tuple[str, str] = ("n_tokens", "score")) -> DataFrame:
    """All columns, the number of tokens of the whole text and the score of its segmentation. Columns of these names are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(pieces)  # of the vocabulary's size
    key = hash(tuple(pieces))
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([f for f in docs.schema if f.name not in added] + [T.StructField(added[0], T.LongType()), T.StructField(added[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(("counts", key), lambda: Counter(shared.value))
        for batch in batches:
            found = [counter.text(t) for t in batch.column(at).to_pylist()]
            counts = (pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64()))
            columns = {n: c for n, c in zip(names, batch.columns) if n not in added} | dict(zip(added, counts))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)
