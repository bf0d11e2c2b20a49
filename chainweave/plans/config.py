"""Options of the extraction, scoring and training runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Options:
    """Cutoffs, pruning, losses and rates; the defaults are those of the published runs."""

    lexical_cutoff: int = 20
    bilexical_cutoff: int = 10
    pruning: str = "distance:10000:5000"
    second_pruning: str = "c2flogratio:2"
    feature_sets: str = "SURFACE"
    fine_feature_sets: str = "+FINAL"
    conjunction: str = "CANONICAL"
    epochs: int = 20
    rate: float = 1.0
    l1: float = 0.001
    belief_rounds: int = 5
    false_link: float = 0.1
    false_new: float = 3.0
    wrong_link: float = 1.0
    language: str = "english"

    @classmethod
    def bound(cls, arguments: Iterable[str]) -> Options:
        """From ``-name value`` pairs and ``name=value`` strings (S18); a later one wins, an unknown name is an error."""
        kinds, found, waiting = {f.name: type(f.default) for f in fields(cls)}, {}, None
        for word in arguments:
            if waiting is None and "=" in word:
                name, _, value = word.lstrip("-").partition("=")
            elif waiting is None and word.startswith("-"):
                waiting = word.lstrip("-")
                continue
            else:
                name, value, waiting = waiting, word, None
            if name not in kinds:
                raise ValueError(f"no option {name!r}; there are {', '.join(kinds)}")
            found[name] = kinds[name](value)
        if waiting is not None:
            raise ValueError(f"no value for {waiting!r}")
        return cls(**found)

    @property
    def pack(self) -> LanguagePack:
        return LANGUAGES[self.language]


@dataclass(frozen=True)
class LanguagePack:
    """Labels that differ by language."""

    mention_phrases: tuple[str, ...]
    pronoun_tags: tuple[str, ...]
    proper_tags: tuple[str, ...]
    punctuation_tags: tuple[str, ...] = field(default=(".", ",", ":", "``", "''"))
    start_symbols: tuple[str, ...] = ("ROOT", "TOP")


# Phrase labels and tags by language.
LANGUAGES = {
    "english": LanguagePack(("NP", "NML"), ("PRP", "PRP$"), ("NNP", "NNPS")),
    "chinese": LanguagePack(("NP",), ("PN",), ("NR",), ("PU",)),
    "arabic": LanguagePack(("NP",), ("PRP", "PRP$"), ("NNP", "DTNNP", "NNPS", "DTNNPS"), ("PUNC", ".", ",", ":")),
}
