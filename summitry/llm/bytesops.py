"""Vectorised byte work on blocks of texts: words, word hashes, shingle hashes.

A block is a run of whole texts joined by newlines.  Words are hashed with a
prefix-sum polynomial modulo 2**64, so a block costs a few numpy passes and no
Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import remembered

BLOCK_BYTES = 1 << 18
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def _separators(alnum_only: bool) -> np.ndarray:
    sep = np.zeros(256, bool)
    if alnum_only:
        sep[:128] = True
        for a, b in ((48, 57), (65, 90), (97, 122)):
            sep[a : b + 1] = False
    else:
        sep[[0x20, 9, 10, 11, 12, 13]] = True
    return sep


#: words are [^\x20\x09-\x0D]+ ...
SPACES = _separators(False)
#: ... or runs of ASCII letters, digits and any non-ASCII bytes
SYMBOLS = _separators(True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = _table(1)[LOWER]
_powers = remembered({})


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", 0) < n:
        size = max(n, BLOCK_BYTES + (1 << 17))
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, _INVERSE, np.uint64)
        down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a block of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of a block: ``start``/``end`` byte places, ``doc`` index, ``hash``."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[1:] = ~separators[self.data]
        turn = np.diff(inside)
        self.start = np.flatnonzero(turn == 1)
        self.end = np.flatnonzero(turn == -1)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.start, self.offsets)))
        #: of text i, the words first[i] .. first[i + 1]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * up[: len(self.data)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_ROLL = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one run, none make none."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        total += words[j : j + n] * _ROLL[j]
    return mix(total)
