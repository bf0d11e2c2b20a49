"""Parse bits, heads and dependencies (S4, K12, X24-X26, G3), a sentence at a time in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The side from which each phrase looks for its head, and the labels in order of preference.
HEAD_RULES = {
    "ADJP": ("left", ("NNS", "QP", "NN", "$", "ADVP", "JJ", "VBN", "VBG", "ADJP", "JJR", "NP", "JJS", "DT", "FW", "RBR", "RBS", "SBAR", "RB")),
    "ADVP": ("right", ("RB", "RBR", "RBS", "FW", "ADVP", "TO", "CD", "JJR", "JJ", "IN", "NP", "JJS", "NN")),
    "CONJP": ("right", ("CC", "RB", "IN")),
    "FRAG": ("right", ()),
    "INTJ": ("left", ()),
    "LST": ("right", ("LS", ":")),
    "NAC": ("left", ("NN", "NNS", "NNP", "NNPS", "NP", "NAC", "EX", "$", "CD", "QP", "PRP", "VBG", "JJ", "JJS", "JJR", "ADJP", "FW")),
    "NX": ("left", ()),
    "PP": ("right", ("IN", "TO", "VBG", "VBN", "RP", "FW")),
    "PRN": ("left", ()),
    "PRT": ("right", ("RP",)),
    "QP": ("left", ("$", "IN", "NNS", "NN", "JJ", "RB", "DT", "CD", "NCD", "QP", "JJR", "JJS")),
    "RRC": ("right", ("VP", "NP", "ADVP", "ADJP", "PP")),
    "S": ("left", ("TO", "IN", "VP", "S", "SBAR", "ADJP", "UCP", "NP")),
    "SBAR": ("left", ("WHNP", "WHPP", "WHADVP", "WHADJP", "IN", "DT", "S", "SQ", "SINV", "SBAR", "FRAG")),
    "SBARQ": ("left", ("SQ", "S", "SINV", "SBARQ", "FRAG")),
    "SINV": ("left", ("VBZ", "VBD", "VBP", "VB", "MD", "VP", "S", "SINV", "ADJP", "NP")),
    "SQ": ("left", ("VBZ", "VBD", "VBP", "VB", "MD", "VP", "SQ")),
    "UCP": ("right", ()),
    "VP": ("left", ("TO", "VBD", "VBN", "MD", "VBZ", "VB", "VBG", "VBP", "AUX", "AUXG", "VP", "ADJP", "NN", "NNS", "NP")),
    "WHADJP": ("left", ("CC", "WRB", "JJ", "ADJP")),
    "WHADVP": ("right", ("CC", "WRB")),
    "WHNP": ("left", ("WDT", "WP", "WP$", "WHADJP", "WHPP", "WHNP")),
    "WHPP": ("right", ("IN", "TO", "FW")),
    "X": ("right", ()),
    "TYPO": ("left", ()),
    "TOP": ("left", ()),
}
# A noun phrase looks for any of these labels at once where the side says so, else for one after another.
NOUN_RULES = (
    ("right, any", ("NN", "NNP", "NNPS", "NNS", "NX", "JJR")),
    ("left", ("NP",)),
    ("right, any", ("$", "ADJP", "PRN")),
    ("right", ("CD",)),
    ("right, any", ("JJ", "JJS", "RB", "QP")),
)
# The same for Arabic; each phrase has several such searches, one after another.
ARABIC_RULES = {
    "ADJP": (("right, any", ("JJ",)), ("right", ("ADJP", "NN", "NNP", "NOFUNC", "NNPS", "NNS")), ("right", ("RB", "CD")), ("right", ("DT",))),
    "ADVP": (("left", ("WRB", "RB", "ADVP", "WHADVP")), ("left", ("CD", "RP", "NN", "CC", "ADJ", "IN", "NP", "NNP", "NOFUNC"))),
    "CONJP": (("right", ("IN", "RB", "NN", "NNS", "NNP", "NNPS")),),
    "FRAG": (("left", ("NN", "NNPS", "NNP", "NNS")), ("left", ("VBP",))),
    "INTJ": (("left", ("RP", "UH")),),
    "LST": (("left", ()),),
    "NAC": (("left", ("NP", "SBAR", "PP", "ADJP", "S", "PRT", "UCP")), ("left", ("ADVP",))),
    "NP": (("left", ("NN", "NNS", "NNP", "NNPS", "NP", "PRP", "WHNP", "QP", "WP", "NOFUNC")), ("left", ("JJ",)), ("right", ("CD",)), ("left", ("PRP$",)), ("right", ("DT",))),
    "PP": (("left", ("IN", "PP", "PRT", "X")), ("left", ("NNP", "RP", "NN")), ("left", ("NP",))),
    "PRN": (("left", ("NP",)),),
    "PRT": (("left", ("RP", "PRT", "IN")),),
    "S": (("left", ("VP", "S")), ("right", ("PP", "ADVP", "SBAR", "UCP", "ADJP"))),
    "SBAR": (("left", ("WHNP", "WHADVP", "WRB", "RP", "IN", "SBAR", "CC", "WP", "WHPP", "ADVP", "PRT", "RB", "X")), ("left", ("NN", "NNP", "NNS", "NNPS")), ("left", ("S",))),
    "SBARQ": (("left", ("WHNP", "WHADVP", "RP", "IN", "SBAR", "CC", "WP", "WHPP", "ADVP", "PRT", "RB", "X")), ("left", ("NN", "NNP", "NNS", "NNPS")), ("left", ("S",))),
    "SQ": (("left", ("VP", "PP")),),
    "UCP": (("left", ()),),
    "VP": (("left", ("VBD", "VBN", "VBP", "VBG", "VP", "RB", "X", "VB")), ("left", ("IN",)), ("left", ("NNP", "NOFUNC", "NN"))),
    "WHADVP": (("left", ("WRB", "WP")), ("right", ("CC",)), ("left", ("IN",))),
    "WHNP": (("right", ("WP",)),),
    "WHPP": (("left", ("IN", "RB")),),
    "X": (("left", ()),),
    "TOP": (("left", ()),),
}
#: Where a phrase without a rule looks.
DEFAULT_SIDE = "right"


def searches(name: str, language: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Where a phrase looks for its head: side (and whether for any label at once) and labels, one search after another."""
    name = "TOP" if name == "ROOT" else name
    if language == "arabic":
        return ARABIC_RULES.get(name, ((DEFAULT_SIDE, ()),))
    return NOUN_RULES if name in ("NP", "NML") else (HEAD_RULES.get(name, (DEFAULT_SIDE, ())),)


class Node:
    """A constituent: label, half-open span, children."""

    def __init__(self, label: str, start: int):
        self.label, self.start, self.end, self.children = label, start, start, []


def tree_of(bits: list[str], tags: list[str]) -> Node:
    """The tree of a sentence's parse bits, ``*`` standing for the token (S4). An empty root label is ROOT."""
    top, at = None, []
    for k, (bit, tag) in enumerate(zip(bits, tags)):
        for part in re.findall(r"\([^()*]*|\*|\)", bit):
            if part == "*":
                leaf = Node(tag, k)
                leaf.end = k + 1
                if at:
                    at[-1].children.append(leaf)
                else:
                    top = top or leaf
            elif part == ")":
                if not at:
                    raise ValueError("a bracket too many is closed")
                at.pop().end = k + 1
            else:
                node = Node(part[1:].strip() or "ROOT", k)
                if at:
                    at[-1].children.append(node)
                elif top is None:
                    top = node
                else:
                    raise ValueError("two trees in a sentence")
                at.append(node)
    if at or top is None:
        raise ValueError("a bracket is not closed")
    return top


def head_child(node: Node, language: str = "english") -> Node:
    """The child that the head rules choose."""
    labels = [c.label.split("-")[0] if c.label[:1].isalpha() else c.label for c in node.children]

    def first(side: str, wanted: set[str]) -> int | None:
        order = range(len(labels)) if side == "left" else range(len(labels) - 1, -1, -1)
        return next((k for k in order if labels[k] in wanted), None)

    tries = [(side.split(",")[0], wanted, "any" in side) for side, wanted in searches(node.label.split("-")[0] or node.label, language)]
    found = None
    for side, wanted, at_once in tries:
        for group in [set(wanted)] if at_once else [{w} for w in wanted]:
            if found is None:
                found = first(side, group)
    if found is None:  # the last rule's side
        found = 0 if tries[-1][0] == "left" else len(labels) - 1
    # in English a conjunct before a conjunction leads
    if language == "english" and found >= 2 and labels[found - 1] == "CC":
        before = [k for k in range(found - 1) if not re.fullmatch(r"[,:.]|``|''", labels[k])]
        found = before[-1] if before else found
    return node.children[found]


def parents(top: Node, n: int, language: str = "english") -> tuple[list[int], list[tuple[str, int, int, int]]]:
    """Each token's governor, -1 for the root, and all constituents with their heads."""
    out, spans = [-1] * n, []

    def visit(node: Node) -> int:
        if not node.children:
            return node.start
        chosen = head_child(node, language)
        heads = [(c, visit(c)) for c in node.children]
        head = next(h for c, h in heads if c is chosen)
        for c, h in heads:
            if c is not chosen:
                out[h] = head
        spans.append((node.label, node.start, node.end, head))
        return head

    visit(top)
    return out, spans


def _per_sentence(tokens: DataFrame, make, schema: str, language: str) -> DataFrame:
    """One task's sentences in one call each; a sentence's tokens are put in one row first."""
    rows = tokens.groupBy("doc_key", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "parse_bit", "pos"))).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, sent, t in batch.itertuples(index=False):
                top = tree_of([x["parse_bit"] for x in t], [x["pos"] for x in t])
                out += [(doc, sent, *row) for row in make(*parents(top, len(t), language), t)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def dependencies(tokens: DataFrame, language: str = "english") -> DataFrame:
    """tok_idx and parent_idx of every token of doc_key, sent_idx, tok_idx, pos, parse_bit."""
    kind = tokens.schema["doc_key"].dataType.simpleString()
    return _per_sentence(tokens, lambda up, _, t: [(int(x["tok_idx"]), p) for x, p in zip(t, up)], f"doc_key {kind}, sent_idx bigint, tok_idx bigint, parent_idx bigint", language)


def constituents(tokens: DataFrame, language: str = "english") -> DataFrame:
    """label, half-open span and head of every constituent."""
    kind = tokens.schema["doc_key"].dataType.simpleString()
    return _per_sentence(tokens, lambda _, spans, t: spans, f"doc_key {kind}, sent_idx bigint, label string, start_idx bigint, end_idx bigint, head_idx bigint", language)


def parse_bits(top: Node) -> list[str]:
    """The parse bits of a tree (K12); ROOT is written as TOP."""
    bits = ["*"] * (top.end - top.start)

    def visit(node: Node) -> None:
        if node.children:
            at = node.start - top.start
            bits[at] = bits[at][: bits[at].index("*")] + f"({'TOP' if node.label == 'ROOT' else node.label}" + bits[at][bits[at].index("*") :]
            for c in node.children:
                visit(c)
            bits[node.end - 1 - top.start] += ")"

    visit(top)
    return bits
