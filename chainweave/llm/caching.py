"""Bounded caches for what is computed again and again per word."""

from __future__ import annotations

import sys
from collections.abc import Callable

#: Bytes of keys and values of one generation, and of one entry, at most.
ROOM, LARGEST = 48 << 20, 1 << 12


class Cache(dict):
    """``cache[key]`` is ``make(key)``; frequent keys stay, memory is bounded in entries and in bytes.

    At ``most`` entries or ``room`` bytes the newer half of a pair of generations
    becomes the older one, so at most twice that is held and none is ever wrong.
    Entries of over ``LARGEST`` bytes are made each time.
    """

    def __init__(self, make: Callable, most: int, room: int = ROOM):
        super().__init__()
        self.make, self.most, self.room, self.older, self.bytes = make, most, room, {}, 0

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        size = sys.getsizeof(key) + sys.getsizeof(value)
        if size > LARGEST:
            return value
        if len(self) >= self.most or self.bytes >= self.room:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = value
        self.bytes += size
        return value


class TextCache(Cache):
    """A ``Cache`` of bytes, or None, by text. An entry is weighed by its lengths, which is never too little and quicker."""

    #: Bytes of the two objects without their contents, at most.
    OVERHEAD = 112

    def __init__(self, make: Callable, most: int, room: int = ROOM * 3 // 2):
        super().__init__(make, most, room)

    def __missing__(self, key: str) -> bytes | None:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = 4 * len(key) + self.OVERHEAD + (len(value) if value else 0)
        if size > LARGEST:
            return value
        if len(self) >= self.most or self.bytes >= self.room:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = value
        self.bytes += size
        return value
