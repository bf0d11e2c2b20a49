"""String functions of the lexical features, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(b)


def contained(a: Column, b: Column) -> Column:
    """Whether a occurs in b, but for case."""
    return F.contains(F.lower(b), F.lower(a))


def speaker_name(s: Column) -> Column:
    """A speaker's name without dashes, underscores and dots, lower-cased."""
    return F.lower(F.translate(s, "-_.", ""))


def digits_masked(s: Column) -> Column:
    """Each run of digits as one ``#``."""
    return F.regexp_replace(s, "[0-9]+", "#")


def word_shape(s: Column) -> Column:
    """Letters as X and x, digits as d; a run of three or more of one becomes two and ``e``."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\p{Lu}", "X"), r"[\p{Ll}]", "x"), "[0-9]", "d")
    for c in "Xxd":
        shape = F.regexp_replace(shape, c + "{3,}", c * 2 + "e")
    return shape


# Suffixes that make a class of their own, tried in this order.
SUFFIXES = ("ed", "ing", "ion", "er", "est", "ly", "ity", "y", "al")


def word_class(s: Column) -> Column:
    """Case, then ``-NUM`` if there is a digit, ``-DASH`` if there is a dash, and a lower-case suffix class."""
    case = F.when(F.rlike(s, F.lit(r"^\p{Lu}+$")), "-CAPS").when(F.rlike(s, F.lit(r"^\p{Lu}")), "-INITC").otherwise("-LC")
    suffix = F.lit("")
    lower = F.lower(s)
    for end in reversed(SUFFIXES):
        suffix = F.when((F.char_length(s) > len(end) + 2) & lower.endswith(end), f"-{end}").otherwise(suffix)
    return F.concat(case, F.when(F.rlike(s, F.lit("[0-9]")), "-NUM").otherwise(""), F.when(F.contains(s, F.lit("-")), "-DASH").otherwise(""), suffix)


def prefixes(s: Column, most: int = 3) -> Column:
    """The prefixes of 1 to ``most`` characters, of words that have them (A3)."""
    return F.filter(F.array(*(F.when(F.char_length(s) >= n, F.left(s, F.lit(n))) for n in range(1, most + 1))), lambda x: x.isNotNull())


def suffixes(s: Column, most: int = 3) -> Column:
    return F.filter(F.array(*(F.when(F.char_length(s) >= n, F.right(s, F.lit(n))) for n in range(1, most + 1))), lambda x: x.isNotNull())


def plain_quotes(s: Column) -> Column:
    """Curly quotes as straight ones, white space runs as one space."""
    return F.regexp_replace(F.translate(s, "“”‘’«»", "\"\"''\"\""), r"\s+", " ")


def brackets_back(s: Column) -> Column:
    """Treebank escapes as the characters that they stand for."""
    # The treebank's escapes.
    for escaped, plain in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-LCB-", "{"), ("-RCB-", "}"), (r"\/", "/"), (r"\*", "*")):
        s = F.replace(s, F.lit(escaped), F.lit(plain))
    return s


#: A sentence may end after one of these, with at most one closing mark, before a space.
SENTENCE_END = r"[.?!](?:\"|''|``|'|\))? "


def sentence_candidates(s: Column) -> Column:
    """The places of all sentence-end candidates as matched strings."""
    return F.regexp_extract_all(s, F.lit(SENTENCE_END), F.lit(0))


def sentences(s: Column) -> Column:
    """The parts of a text between sentence ends that a capital follows."""
    marked = F.regexp_replace(s, r"([.?!](?:\"|''|``|'|\))?) +(?=[\"'(`]*\p{Lu})", "$1\u0001")
    return F.split(marked, "\u0001")


def genre(doc_id: Column) -> Column:
    """The first two characters of a document's id."""
    return F.left(doc_id, F.lit(2))


def is_newswire(doc_id: Column) -> Column:
    return F.startswith(doc_id, F.lit("nw"))  # F14


def is_conversation(doc_id: Column) -> Column:
    return F.startswith(doc_id, F.lit("bc")) | F.startswith(doc_id, F.lit("wb"))  # F15


def field(s: Column, k: int, delimiter: str = " ") -> Column:
    """The k-th field, from 1, or from the end if negative; null if there is none."""
    return F.try_element_at(F.split(s, f"\\Q{delimiter}\\E"), F.lit(k))


def in_context(words: Column, start: Column, stop: Column, around: int = 3) -> Column:
    """``before [span] after`` for a half-open span of an array of words."""
    lo = F.greatest(start - around, F.lit(0))
    part = lambda a, b: F.array_join(F.slice(words, a + 1, F.greatest(b - a, F.lit(0))), " ")
    return F.trim(F.concat(part(lo, start), F.lit(" ["), part(start, stop), F.lit("] "), part(stop, F.least(stop + around, F.size(words)))))


def around_head(words: Column, head: Column, around: int = 2) -> Column:
    """The words of a mention near its head, the head as ``_head_``; ``head`` is its place in them, from 0."""
    lo, n = F.greatest(head - around, F.lit(0)), F.size(words)
    part = lambda a, b: F.slice(words, a + 1, F.greatest(b - a, F.lit(0)))
    shown = F.array(F.concat(F.lit("_"), F.get(words, head), F.lit("_")))
    return F.array_join(F.concat(part(lo, head), shown, part(head + 1, F.least(head + around + 1, n))), " ")


def feature(name: str, value: Column) -> Column:
    """``name=value``."""
    return F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("")))
