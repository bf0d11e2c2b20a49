"""Packing in slices and the caches of texts."""

import numpy as np
import pytest

from chainweave.llm import token_files
from chainweave.llm.caching import LARGEST, TextCache


@pytest.mark.parametrize("count", [0, 1, 255, 256, 257, 511, 512, 513, 5000])
def test_slices_give_the_same_stream(count, monkeypatch):
    ids = (np.random.default_rng(count).zipf(1.3, count) % 700).astype("<u2")
    lengths = token_files.code_lengths(np.bincount(ids, minlength=700))
    codes = token_files.canonical(lengths)
    whole = "".join(f"{int(codes[i]):0{lengths[i]}b}" for i in ids)
    monkeypatch.setattr(token_files, "PACKED", 2 * token_files.BLOCK)
    stream, offsets = token_files.pack(ids, lengths, codes)
    assert "".join(f"{b:08b}" for b in stream)[: len(whole)] == whole
    assert offsets.tolist() == [int(lengths[ids[:k]].sum()) for k in range(0, count, token_files.BLOCK)]
    if count:
        assert token_files.unpack(stream, offsets, count, *token_files.decoding_table(lengths)).tolist() == ids.tolist()


def test_text_cache_is_bounded_and_right():
    made = []

    def make(text):
        made.append(text)
        return None if text == "none" else text.encode()

    cache = TextCache(make, 3)
    for text in ["a", "b", "a", "none", "none", "c", "d", "a", "x" * LARGEST, "x" * LARGEST]:
        assert cache[text] == (None if text == "none" else text.encode())
        assert len(cache) <= 3 and len(cache.older) <= 3
    assert made.count("a") == 1 and made.count("x" * LARGEST) == 2
    roomy = TextCache(make, 10**6, room=10_000)
    for k in range(1000):
        assert roomy[f"w{k}"] == f"w{k}".encode()
    assert len(roomy) + len(roomy.older) < 200
