"""Language identification with error-correcting output codes.

Each language has a codeword of bits; for each bit a linear classifier over
hashed letter n-grams predicts it from the whole text. Decoding is loss
weighted: a language's loss is the sum over the bits of the logistic loss of the
classifier's margin against the language's bit, times how well that bit did in
training, and the language of least loss wins. ``score`` is the softmax of the
negated losses; a prediction is ambiguous if the best two scores are close.

The classifiers are fitted on the driver on at most ``SAMPLE`` rows per language
and ``SAMPLE_BYTES`` bytes of text each (documented bounds; rows are taken by a
hash of their id, texts whole until the bytes are used up). Everything else runs
over all rows. The model has a fixed size, so it can be sent to every executor.

Defined results: ``und`` with score 0 for null, empty or letterless texts, and
for all if there is nothing to learn from; with a single learned language all
else is that language; repeated rows get equal results; other columns are kept,
but those with the names that are added, which can be chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, held

#: Rows per language and bytes of text per language that are learned from.
SAMPLE, SAMPLE_BYTES = 400, 1 << 20
#: Hashed n-grams.
BUCKETS = 1 << 15
#: Bits of a codeword for each doubling of the number of languages.
BITS = 5
#: A prediction whose score leads the next by less is ambiguous.
MARGIN = 0.1
#: Texts of a gradient step.
BATCH = 64
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """By byte: ASCII letters lower-cased, bytes of other characters as they are, all else a space."""
    return np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint32)


LETTERS = _letters()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 1- to 4-grams of all texts, and where each text's begin.

    Bytes stand for letters; a space is put before and after each text.
    """
    joined = b"".join(b"   " + t + b" " for t in texts)
    letters = LETTERS[np.frombuffer(joined, np.uint8)]
    keep = (letters != 32) | (np.concatenate([[0], letters[:-1]]) != 32)  # spaces in a row count once
    sizes = np.array([len(t) + 4 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    keep[starts] = True
    starts = (np.cumsum(keep) - 1)[starts]
    a = letters[keep]
    b, c, d = (np.concatenate([np.full(min(k, len(a)), 32, np.uint32), a[:-k]]) for k in (1, 2, 3))
    for k, before in enumerate((b, c, d)):  # nothing of the text before
        for j in range(k + 1):
            places = starts + j
            before[places[places < len(a)]] = 32
    pair = a | b << np.uint32(8)
    triple = pair | c << np.uint32(16)
    many = np.stack([triple * np.uint32(2654435761), (triple | d << np.uint32(24)) * np.uint32(2246822519) + np.uint32(374761393)])
    return ((many ^ many >> np.uint32(15)) >> np.uint32(17 - (BUCKETS.bit_length() - 16))).astype(np.int64) % BUCKETS, starts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    #: languages x bits, each 1 or -1.
    code: np.ndarray
    #: buckets x bits, intercepts last.
    weights: np.ndarray
    #: How well each bit did in training.
    trust: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Texts x languages; each row sums to 1."""
        if not texts:
            return np.zeros((0, len(self.languages)))
        hashed, starts = grams(texts)
        count = np.diff(np.append(starts, hashed.shape[1]))
        margins = np.zeros((len(texts), self.code.shape[1]))
        for bit in range(self.code.shape[1]):
            own = self.weights[:-1, bit]
            margins[:, bit] = np.add.reduceat(own[hashed[0]] + own[hashed[1]], starts) / (2 * count) * SCALE + self.weights[-1, bit]
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        least = np.exp(loss.min(1, keepdims=True) - loss)
        return least / least.sum(1, keepdims=True)


#: Margins are of mean weights; this brings them to the size of a text's evidence.
SCALE = 32.0


def codewords(n: int) -> np.ndarray:
    """A codeword of 1 and -1 for each of n languages: all distinct splits if they are few, else random dense rows."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        splits = [[1 if k == 0 or (s >> (k - 1)) & 1 else -1 for k in range(n)] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T.reshape(n, -1)
    bits = int(np.ceil(BITS * np.log2(n)))
    random = np.random.default_rng(7)
    tries = [random.choice([-1.0, 1.0], (n, bits)) for _ in range(200)]
    apart = [min(np.abs(c[i] - c[j]).sum() for i in range(n) for j in range(i)) + (np.abs(c.sum(0)) < n).all() for c in tries]
    return tries[int(np.argmax(apart))]


class _Rows:
    """Texts as sparse rows of n-gram shares; ``dense`` opens some of them."""

    def __init__(self, texts: list[bytes]):
        self.at, self.share = [], []
        for text in texts:  # one at a time: only the n-grams that a text has are held
            hashed, _ = grams([text])
            at, count = np.unique(hashed, return_counts=True)
            self.at.append(at.astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32))
            self.share.append((count * (SCALE / hashed.size)).astype(np.float32))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, row in enumerate(rows):
            x[k, self.at[row]] = self.share[row]
        return x


def fit_texts(texts: list[bytes], labels: list[str], rounds: int = 12) -> Model:
    """Logistic classifiers of the codewords' bits, by gradient steps on batches of texts with a scale per feature.

    Memory is the texts' n-grams and one dense batch, however many the languages.
    """
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if code.shape[1] == 0 or not texts:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((BUCKETS + 1, 1)), np.ones(1))
    rows = _Rows(texts)
    numbers = {v: k for k, v in enumerate(languages)}
    which = np.array([numbers[v] for v in labels])
    y = code[which].astype(np.float32)
    share = (len(texts) / np.bincount(which)[which] / len(languages)).astype(np.float32)[:, None]  # languages weigh alike
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    squares, squares_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(rounds):
        shuffled = order.permutation(len(texts))
        for lo in range(0, len(texts), BATCH):
            some = shuffled[lo : lo + BATCH]
            x, own = rows.dense(some), y[some]
            slope = -own * share[some] / (1 + np.exp(np.clip(own * (x @ w + b), -30, 30))) / len(some)
            g, gb = x.T @ slope + 1e-5 * w, slope.sum(0)
            squares += g * g
            squares_b += gb * gb
            w -= 0.5 * g / np.sqrt(squares)
            b -= 0.5 * gb / np.sqrt(squares_b)
    right = np.zeros(y.shape[1])
    for lo in range(0, len(texts), BATCH):
        some = np.arange(lo, min(lo + BATCH, len(texts)))
        right += ((y[some] * (rows.dense(some) @ w + b)) > 0).sum(0)
    trust = np.clip(2 * right / len(texts) - 1, 0.05, 1)
    return Model(languages, code, np.vstack([w, b]).astype(float), trust / trust.mean())


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from rows where ``usable`` holds and text and language are known."""
    rows = docs.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return fit_texts([], [])
    order = F.xxhash64(F.col(key).cast("string"), F.lit(11))
    # keep about twice the sample by the hash, then exactly the sample of the few that are left
    share = F.create_map(*(F.lit(x) for kv in counts.items() for x in (kv[0], 2.0 * SAMPLE / kv[1])))
    few = rows.where(F.pmod(order, F.lit(1_000_000)) < 1_000_000 * F.element_at(share, F.col(lang)) + 20).select(F.col(text).alias("text"), F.col(lang).alias("lang"), order.alias("at"))
    texts, labels, held = [], [], {}
    from pyspark.sql import Window

    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(f"n <= {SAMPLE}")
    for row in ranked.orderBy("lang", "n").toLocalIterator():
        t = row["text"].encode("utf-8", "surrogatepass")
        if has_letter(row["text"]) and held.setdefault(row["lang"], 0) < SAMPLE_BYTES:
            held[row["lang"]] += len(t)
            texts.append(t)
            labels.append(row["lang"])
    return fit_texts(texts, labels)


def predict(docs: DataFrame, model: Model, text: str = "text", added: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """All columns and three more: the language, its score, whether the next one is close. Columns of these names are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size for each language
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([f for f in docs.schema if f.name not in added] + [T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("language",), None)
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
            labels, score, lead = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            some, size = [], 0
            for k in [*known, None]:
                if k is not None:
                    some.append((k, t := texts[k].encode("utf-8", "surrogatepass")))
                    size += len(t)
                if some and (k is None or size > 1 << 20):
                    rows = model.scores([t for _, t in some])
                    best = rows.argmax(1)
                    for (j, _), row, b in zip(some, rows, best):
                        labels[j], score[j] = model.languages[b], float(row[b])
                        lead[j] = float(row[b] - max([0.0, *np.delete(row, b)]))
                    some, size = [], 0
            found = (pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array([x < MARGIN for x in lead], pa.bool_()))
            columns = {n: c for n, c in zip(names, batch.columns) if n not in added} | dict(zip(added, found))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Rows that are never learned from. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
