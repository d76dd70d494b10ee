"""Ids of words that are met again and again, for tokenizers that encode words apart."""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress, count, repeat
from operator import is_


class WordTable:
    """Looks up the ids of words; what a batch has that is not known is encoded once.

    The table keeps words until there are ``kept``: those met first, which the frequent ones are
    among. ``encode`` gives each word's ids as bytes of little-endian unsigned 32-bit integers.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int) -> None:
        self.encode, self.kept = encode, kept
        self.known: dict[str, bytes] = {}

    def ids(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of each text's words, as one run of bytes."""
        found = [list(map(self.known.get, p)) for p in parts]
        gaps = [list(compress(count(), map(is_, f, repeat(None)))) for f in found]
        new = list({p[i] for p, g in zip(parts, gaps) for i in g})
        if new:
            got = dict(zip(new, self.encode(new)))
            for p, f, g in zip(parts, found, gaps):
                for i in g:
                    f[i] = got[p[i]]
            if len(self.known) + len(got) <= self.kept:
                self.known |= got
        return [b"".join(f) for f in found]
