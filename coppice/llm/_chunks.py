"""Splits texts at single spaces into chunks that a byte-level BPE encodes independently, with a bounded cache.

The pre-token pattern attaches a single space to what follows it, so no pre-token crosses a lone space between two
non-blank characters.  Texts where a space touches other white space (or ends the text) are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

CACHE = 400_000  # entries of a generation; the one before it is kept too, so what is frequent stays
LONGEST = 64  # characters of an entry: with CACHE it bounds the cache's bytes


class _Irregular(Exception):
    """A space touches other white space."""


class Generations(dict):
    """key -> value of `make(key)`, kept in two generations of at most CACHE short keys each."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ChunkCache:
    """Ids of texts as little-endian 32-bit bytes; `encode` gives those of one string."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode
        self.words = Generations(self._word)  # words that follow a space, without it

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        return self.encode(" " + word)

    def batch(self, texts: list[str]) -> list[bytes]:
        get, out = self.words.__getitem__, []
        for t in texts:
            head, *tail = t.split(" ")
            try:
                if tail and head[-1:].isspace():
                    raise _Irregular
                out.append(b"".join([self.encode(head), *map(get, tail)]))
            except _Irregular:
                out.append(self.encode(t))
        return out
