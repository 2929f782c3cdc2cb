"""Words and shingles of Arrow string columns as 64-bit hashes, by numpy over the UTF-8 bytes.

Both word classes that the operators use are unions of byte values, so words can be cut in the bytes:
every byte of a multi-byte character is 0x80 or more and belongs to a word in both classes.
A null text counts as an empty one. Words never cross from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes, which bounds the memory of a task; a longer text is a run of its own.
RUN_BYTES = (1 << 20) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the SplitMix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, (n - 1).bit_length() if n else 0)
    if size not in _powers:
        p, q = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        p[0] = q[0] = 1
        pair = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if size > 1 << 22:
            return pair
        _powers[size] = pair
    return _powers[size]


@dataclass
class Words:
    """Words of a run of texts: text i has words ``first[i]`` up to ``first[i + 1]``; starts and ends are bytes in ``data``."""

    row: int
    data: np.ndarray
    bytes_at: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    total: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(which words are longer than ``size`` bytes, a hash of the first ``size`` bytes of each of those)."""
        at = np.flatnonzero(self.ends - self.starts > size)
        start = self.starts[at]
        return at, mix((self.total[start + size] - self.total[start]) * _power(len(self.data) + 1)[1][start] + np.uint64(size << 32))


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of consecutive rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + run_bytes, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(texts: pa.Array, kind: np.ndarray, lower: bool = True, run_bytes: int = RUN_BYTES) -> Iterator[Words]:
    """The words of each run of rows; ``kind`` says which bytes are of words."""
    for row, data, at in runs(texts, run_bytes):
        if lower:
            data = LOWER[data]
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(row, data, at, none.astype(np.uint64), none, none, np.zeros(len(at), np.int64), np.zeros(1, np.uint64))
            continue
        inside = kind[data]
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        before[at[:-1][at[:-1] < n]] = False
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        after[at[1:][at[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[data] * power[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        yield Words(row, data, at, hashes, starts, ends, np.searchsorted(starts, at), total)


_STEPS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Lookup:
    """Where hashes stand among sorted distinct ones; a table of their low bits first sets most of the others aside."""

    def __init__(self, values: np.ndarray):
        self.values, self.low = values, np.zeros(1 << 20, bool)
        self.low[values & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``hashes`` are there, the place of each of those among the values)."""
        some = np.flatnonzero(self.low[hashes & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.values, hashes[some]), max(len(self.values) - 1, 0))
        there = self.values[at] == hashes[some] if len(self.values) else np.zeros(len(some), bool)
        return some[there], at[there]


def sequence(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive hashes, whatever text they are of; equal sizes and words give equal values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, dtype=np.uint64) * _STEPS[2]
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _STEPS[i % 2]
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_sets(run: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of a run: the whole sequence where it has fewer than ``size`` words, none without words."""
    full = sequence(run.hashes, size)
    for a, b in zip(run.first[:-1].tolist(), run.first[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(full[a : b - size + 1])
            fresh = np.empty(len(found), dtype=bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            yield found[fresh]
        else:
            yield sequence(run.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
