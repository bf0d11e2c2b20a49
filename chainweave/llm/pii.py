"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Four base kinds (email, ip, card, phone) are reported wherever their pattern and
check hold, whatever the context says. The method adds spans of further kinds:
``iban`` (mod-97), ``routing`` (weighted mod-10), ``ssn`` (needs a context word),
``key`` (access keys and tokens of a known form, JSON web tokens, private keys in
PEM) and ``secret`` (the value set after a word such as password or token, or after
``Bearer``, if its characters are as mixed as those of a random string; values of
any length, in quotes that close or not). Every span has a score: the kind's prior, raised by a checksum and by
context words within ``CONTEXT`` code points.

Defined results: a null or empty text has no spans; spans are in code points,
the end exclusive; copies of a row are each reported; very long texts are
scanned whole; other columns are kept by ``detect``, but those with the names
that it adds, which can be chosen.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, held

#: Code points before and after a span in which context words count.
CONTEXT = 48
#: Score from which an added span is reported.
REPORTED = 0.6

# The base patterns of the contract. The look-behind of IP changes no match
# (a run of digits that fails from its start fails from within) but keeps long runs linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# access keys and tokens by their beginnings; JSON web tokens
KEY = re.compile(
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
    r"|(?<![A-Za-z0-9_-])(?:gh[opsur]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
KEY_BEGINNINGS = ("AKIA", "ASIA", "gh", "glpat-", "xox", "k_", "sk-", "AIza", "eyJ")
# a private key, also one that is cut off: whole lines of Base64, then the end if it is there
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----(?:\s+[A-Za-z-]{1,40}: [^\n]*)*(?:\s+[A-Za-z0-9+/=]{16,}(?![^\s-]))*(?:(?:\s+[A-Za-z0-9+/=]{1,15})?\s*-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----)?")
# a word that names a secret, a sign that sets it, the value; or Bearer and a value
SECRET = re.compile(r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?[ \t]{0,4}(?::=|=>|[=:])[ \t]{0,4}(?:[\"'`]([^\s\"'`]{8,})|([A-Za-z0-9_./+=~-]{8,}))|\b(?i:bearer)[ \t]{1,4}([A-Za-z0-9_./+=~-]{16,})")
KINDS = ("email", "ip", "card", "phone", "iban", "routing", "ssn", "key", "secret")
#: Bits a character that a secret's value must have at least.
MIXED = 2.5

# Words that make a kind likelier (lower case).
WORDS = {
    "email": ("mail", "email", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "routing": ("routing", "aba", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "key": ("aws", "key", "access", "credential", "credentials"),
    "secret": ("login", "user", "credential", "credentials", "auth", "bearer"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "routing": 0.35, "ssn": 0.55, "key": 0.8, "secret": 0.65}
_CONTEXT_WORDS = {kind: re.compile(r"\b(?:" + "|".join(words) + r")\b", re.IGNORECASE) for kind, words in WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of international bank account numbers, spaces removed."""
    turned = iban[4:] + iban[:4]
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def routing_sum(digits: str) -> bool:
    return sum(w * int(c) for w, c in zip((3, 7, 1) * 3, digits)) % 10 == 0 and digits != "000000000"


def mixture(value: str) -> float:
    """Bits a character of the value's own letters."""
    counts = Counter(value)
    return -sum(n / len(value) * log2(n / len(value)) for n in counts.values())


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer would find them, but looking only around each ``@``."""
    at, upto = text.find("@"), 0
    while at >= 0:
        start = at
        while start > upto:
            part = text[max(upto, start - 256) : start]
            kept = len(part.rstrip(_LOCAL))
            start -= len(part) - kept
            if kept:
                break
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, (upto := m.end())
        at = text.find("@", max(at + 1, upto))


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_BEARER = re.compile(r"[Bb](?:earer|EARER)[ \t]")
_UPPER2 = re.compile(r"[A-Z]{2}[0-9]{2}")


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in ``KINDS``, then start."""
    if not text:
        return []
    found: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        found += [("email", s, e, False) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append(("ip", *m.span(), False))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span(), True))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span(), False))
        for m in IBAN.finditer(text) if _UPPER2.search(text) else ():
            if mod97(m[0].replace(" ", "")):
                found.append(("iban", *m.span(), True))
        for m in ROUTING.finditer(text):
            if routing_sum(m[0]):
                found.append(("routing", *m.span(), True))
        for m in SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                found.append(("ssn", *m.span(), False))
        for m in KEY.finditer(text) if any(b in text for b in KEY_BEGINNINGS) else ():
            found.append(("key", *m.span(), False))
    for m in PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        found.append(("key", *m.span(), False))
    for m in SECRET.finditer(text) if "=" in text or ":" in text or _BEARER.search(text) else ():
        own = m.lastindex
        if mixture(m[own]) >= MIXED and _DIGIT.search(m[own]):
            found.append(("secret", *m.span(own), False))
    out = []
    for kind, s, e, checked in found:
        near = f"{text[max(0, s - CONTEXT) : s]} {text[e : e + CONTEXT]}"
        score = min(1.0, PRIOR[kind] + 0.15 * checked + 0.2 * bool(_CONTEXT_WORDS[kind].search(near)))
        if kind in KINDS[:4] or score >= REPORTED:
            out.append((kind, s, e, round(score, 2)))
    return out


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the spans found in the whole text.

    With ``redacted`` a column of that name holds the text in which each span is
    replaced by its kind in brackets (spans that overlap become one); it may
    replace the text itself. Null stays null.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text)
    added = {spans: SPAN_TYPE} | ({redacted: T.StringType()} if redacted else {})
    schema = T.StructType([T.StructField(f.name, added.pop(f.name)) if f.name in added else f for f in docs.schema] + [T.StructField(n, t) for n, t in added.items()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("pii",), None)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [spans_of(t) for t in texts]
            columns = dict(zip(names, batch.columns))
            columns[spans] = pa.array([[{"kind": k, "start": s, "stop": e, "score": x} for k, s, e, x in row] for row in found], _SPANS)
            if redacted:
                columns[redacted] = pa.array([redact(t, row) for t, row in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(find, schema)


def redact(text: str | None, found: list[tuple[str, int, int, float]]) -> str | None:
    if not found or text is None:
        return text
    out, upto, last = [], 0, None
    for kind, s, e, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if last is not None and s < upto:
            upto = max(upto, e)
            continue
        out += [text[upto:s], f"[{kind.upper()}]"]
        upto, last = e, kind
    return "".join([*out, text[upto:]])


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds and of all others, and the spans as text."""
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for found in batch.column(1).to_pylist():
                base = [f"{x['kind']}:{x['start']}:{x['stop']}" for x in found if x["kind"] in KINDS[:4]]
                for k, kind in enumerate(KINDS[:4]):
                    out[k].append(sum(x["kind"] == kind for x in found))
                out[4].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                out[5].append(",".join(f"{x['kind']}:{x['start']}:{x['stop']}" for x in found))
                out[6].append(len(found) - len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    found = detect(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "spans")
    return found.mapInArrow(rows, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
