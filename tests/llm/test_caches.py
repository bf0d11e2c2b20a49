"""A tokenizer with smaller caches holds less and encodes alike."""

import random

import public_tokenizers

from chainweave.llm import bpe


def test_smaller_caches_hold_fewer_words_and_beginnings():
    rng = random.Random(3)
    file = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    small, large = bpe.WordBpe(file, 50), bpe.WordBpe(file)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12))) for _ in range(30))
        assert small.encode(text) == large.encode(text)
    assert len(small.walks) <= 50 + bpe.SHARED_LETTERS and len(large.walks) > 200
    assert all(len(x) + len(x.older) <= 100 for x in (small.word_ids, small.chunk_ids))
