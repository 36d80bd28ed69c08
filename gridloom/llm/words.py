"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased
before hashing. UTF-8 continuation bytes never fall in that class, so splitting bytes
equals splitting characters. Words become 64-bit hashes (a random byte code times a
power of an odd base, summed and mixed), all in NumPy, one pass over the bytes.
Texts are processed in pieces of about ``PIECE`` bytes cut at white space, so memory
does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser; ``h`` is uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    codes[_SPACE] = 0
    return codes


_CODES = _byte_codes()
_BASE = np.uint64(0xD6E8FEB86659FD93)


def hash_bytes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in ``data`` and, for each text, the number of words before it.

    ``cuts`` (length n + 1) delimits the texts; a text boundary ends a word.
    """
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, cuts)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    powers = np.full(int(lengths.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    parts = _CODES[data[starts[0] :]] * powers[place]
    return mix64(np.add.reduceat(parts, starts - starts[0])), counts


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def hashed_texts(column: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) for each text of the column, in order; nulls and blank texts give none."""
    data, offsets = _buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = row + 1
        while end < n and offsets[end + 1] - offsets[row] <= piece:
            end += 1
        if offsets[end] - offsets[row] <= 2 * piece:
            hashes, counts = hash_bytes(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            for i in range(end - row):
                yield row + i, hashes[counts[i] : counts[i + 1]]
        else:
            yield row, np.concatenate(list(_long(data[offsets[row] : offsets[end]], piece)))
        row = end


def _long(data: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Word hashes of one long text, piece by piece, cut at white space."""
    at = 0
    while at < len(data):
        end = min(at + piece, len(data))
        step = piece
        while end < len(data) and not _SPACE[data[end]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + step]])
            end = end + int(ahead[0]) if len(ahead) else min(end + step, len(data))
        part = data[at:end]
        yield hash_bytes(part, np.array([0, len(part)]))[0]
        at = end


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    data, offsets = _buffers(column)
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for row in range(len(out)):
        text = data[offsets[row] : offsets[row + 1]]
        last = False
        for at in range(0, len(text), PIECE):
            word = ~_SPACE[text[at : at + PIECE]]
            out[row] += int(word[0] and not last) + int(np.count_nonzero(word[1:] & ~word[:-1]))
            last = bool(word[-1])
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of ``n`` consecutive words, sorted; all words as one shingle if fewer; none if no word."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = total * _BASE + words[i : i + len(total)]
    return np.unique(mix64(total + np.uint64(width)))
