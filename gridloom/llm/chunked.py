"""Encoding of whole texts chunk by chunk, each distinct chunk encoded once.

A tokenizer that never joins symbols across the start of a white-space run encodes a text
to the concatenation of its chunks' codes. Codes of chunks are kept in a cache of bounded
size (two generations), so a worker holds at most ``2 * limit`` entries however large the
input is, and chunks longer than ``LONGEST`` are not kept. Texts are cut into pieces of
about ``PIECE`` characters at chunk starts, so a very long text is never a list of all its
chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import compress
from operator import not_

PIECE = 1 << 19
LONGEST = 64


class ChunkEncoder:
    """``pattern`` splits a text into chunks; ``encode`` gives the code bytes of a list of distinct chunks."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], limit: int = 700_000):
        self._split = re.compile(pattern).findall
        self._encode, self._limit = encode, limit
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Puts codes of ``chunks`` into the young generation, those not known encoded now."""
        old, young = self._old, self._young
        # by the dict's keys: a set's own intersection with a dict walks the whole dict
        known = old.keys() & chunks
        young.update((c, old[c]) for c in known)
        missing = list(chunks.difference(known))
        young.update(zip(missing, self._encode(missing), strict=True))

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Code bytes of each text, in order."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > PIECE:
                yield from self._flush(group)
                group, size = [], 0
                yield b"".join(code for part in pieces(text) for code in self._flush([self._split(part)]))
                continue
            group.append(self._split(text))
            size += len(text)
            if size > PIECE:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[str]]) -> Iterator[bytes]:
        young = self._young
        known = [list(map(young.get, chunks)) for chunks in group]
        # codes are never empty, so what is false is not known yet
        gaps = [list(compress(range(len(codes)), map(not_, codes))) for codes in known]
        fresh = {chunks[i] for chunks, gap in zip(group, gaps, strict=True) for i in gap}
        if fresh:
            self._learn(fresh)
            for chunks, codes, gap in zip(group, known, gaps, strict=True):
                for i in gap:
                    codes[i] = young[chunks[i]]
        for chunk in fresh:
            if len(chunk) > LONGEST:
                del young[chunk]
        if len(young) >= self._limit:
            self._old, self._young = young, {}
        return map(b"".join, known)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut before spaces that follow something else than white space."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end >= 0 and (text[end - 1].isspace() or text[end - 1] == "▁"):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]
