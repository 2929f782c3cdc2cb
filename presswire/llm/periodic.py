"""Runs of repeated words: stretches that repeat with a period, three times or more.

A run of period q is found at the scale B, a power of two, with B <= q < 2 B; periods under 8 belong to the scale of 8. Texts are cut into
blocks of B words. A run is so long that it holds a block whole and, q words on, the block's next occurrence. Where a block occurs in the
window of words that follow it shows in the sums of squared differences of word numbers at all distances at once: they come from one
convolution of block and window, done exactly by number-theoretic transforms modulo a prime; a sum of zero is an occurrence. (A sum that is
a multiple of the prime would be one too many; every seed is compared word by word as it is extended, so none gets through, and none is
missed.) The distance of an occurrence is a seed: the stretch around it in which words that far apart are equal is followed to both ends.

Periods of a scale are taken from small to large, and seeds inside a run that is known already whose period divides theirs are passed over,
so a run is followed once. Blocks with a word that doesn't come again within the window can't occur in it and need no transform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.llm.scratch import trimmed
from presswire.llm.wordhash import NOT_SPACE, Words, words

#: 15 * 2 ** 27 + 1, with 31 as a primitive root: transforms of up to 2 ** 27 numbers, more than a text can have words.
PRIME, ROOT = 2_013_265_921, 31
FIRST_SCALE = 8
#: Numbers transformed at once.
TOGETHER = 1 << 19
RUN_BYTES = (1 << 19) - 1
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n // 2 powers of a root of unity of order n, or of its inverse."""
    if (n, inverse) not in _roots:
        root = pow(ROOT, (PRIME - 1) // n, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        found = np.ones(max(n // 2, 1), np.int64)
        k = 1
        while k < len(found):
            found[k : 2 * k] = found[: min(k, len(found) - k)] * pow(root, k, PRIME) % PRIME
            k *= 2
        if n > 1 << 16:
            return found
        _roots[n, inverse] = found
    return _roots[n, inverse]


def transform(rows: np.ndarray) -> np.ndarray:
    """The transforms of rows of 2 ** k numbers, each in bit-reversed order."""
    m, n = rows.shape
    a, size = rows, n
    while size > 1:
        half = size // 2
        a = a.reshape(m, n // size, size)
        low, high = a[:, :, :half], a[:, :, half:]
        out = np.empty_like(a)
        np.remainder(low + high, PRIME, out=out[:, :, :half])
        np.remainder((low - high + PRIME) * _powers(size, False), PRIME, out=out[:, :, half:])
        a, size = out, half
    return a.reshape(m, n)


def transformed_back(rows: np.ndarray) -> np.ndarray:
    """The rows that ``transform`` had."""
    m, n = rows.shape
    a, size = rows, 2
    while size <= n:
        half = size // 2
        a = a.reshape(m, n // size, size)
        low, high = a[:, :, :half], a[:, :, half:] * _powers(size, True) % PRIME
        out = np.empty_like(a)
        np.remainder(low + high, PRIME, out=out[:, :, :half])
        np.remainder(low - high + PRIME, PRIME, out=out[:, :, half:])
        a, size = out, size * 2
    return a.reshape(m, n) * pow(n, -1, PRIME) % PRIME


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which of the first B shifts of each window, of 2 B numbers, the block of B numbers may occur at: all at which it does."""
    b = blocks.shape[1]
    padded = np.zeros_like(windows)
    padded[:, :b] = blocks[:, ::-1]
    both = transformed_back(transform(padded) * transform(windows) % PRIME)[:, b - 1 : 2 * b - 1]
    squares = np.zeros((len(windows), 2 * b + 1), np.int64)
    np.cumsum(windows * windows % PRIME, axis=1, out=squares[:, 1:])
    over = squares[:, b : 2 * b] - squares[:, :b]
    return (((blocks * blocks % PRIME).sum(axis=1)[:, None] + over - 2 * both) % PRIME) == 0


def _reach(x: np.ndarray, at: int, d: int, end: int) -> int:
    """How many words from ``at`` on equal the word d later, before ``end``."""
    done, step = 0, 32
    while at + done + d < end:
        k = min(step, end - d - at - done)
        odd = x[at + done : at + done + k] != x[at + done + d : at + done + d + k]
        if odd.any():
            return done + int(odd.argmax())
        done += k
        step *= 2
    return done


def _reach_back(x: np.ndarray, at: int, d: int, begin: int) -> int:
    """How many words before ``at`` equal the word d later, not before ``begin``."""
    done, step = 0, 32
    while at - done > begin:
        k = min(step, at - done - begin)
        odd = x[at - done - k : at - done] != x[at - done - k + d : at - done + d]
        if odd.any():
            return done + int(odd[::-1].argmax())
        done += k
        step *= 2
    return done


def find(hashes: np.ndarray, first: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of texts, text i being words ``first[i]`` up to ``first[i + 1]``, by start, then period.

    A run has ``least`` words, and ``times`` times its period, at least. Blocks hold if both are no less than 24 and 3.
    """
    total = len(hashes)
    longest = int(np.diff(first).max(initial=0))
    _, x = np.unique(hashes, return_inverse=True)
    x = np.append(x.astype(np.int64), 0)
    sentinel = int(x.max(initial=0)) + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins, ends = first[:-1][text], first[1:][text]
    # how far on each word comes again in its text
    order = np.argsort(x[:total], kind="stable")
    gap = np.full(total, total + 1, np.int64)
    again = (x[order[1:]] == x[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    inside_end, inside_period = np.zeros(total + 1, np.int64), np.ones(total + 1, np.int64)
    found: list[tuple[int, int, int]] = []
    b = FIRST_SCALE
    while longest >= max(least, times * b if b > FIRST_SCALE else 0):
        rare = np.append(0, np.cumsum(gap >= 2 * b))
        at = np.arange(total)
        at = at[((at - begins) % b == 0) & (at + b < ends)]
        at = at[rare[at + b] == rare[at]]
        for low in (0, b) if b == FIRST_SCALE else (b,):
            seeds = [_seeds(x, part, b, low, ends, sentinel) for part in np.array_split(at, max(1, -(-len(at) * 2 * b // TOGETHER)))] if len(at) else []
            if not seeds:
                continue
            where, d = (np.concatenate(z) for z in zip(*seeds, strict=True))
            known = (inside_end[where] >= where + b + d) & (d % inside_period[where] == 0)
            where, d = where[~known], d[~known]
            by = np.lexsort((where, d))
            last = (0, 0)
            for p, q in zip(where[by].tolist(), d[by].tolist(), strict=True):
                if last[0] == q and p < last[1] or inside_end[p] >= p + b + q and q % inside_period[p] == 0:
                    continue
                right = _reach(x, p, q, int(ends[p]))
                last = (q, p + right)
                if right < b:
                    continue
                s, e = p - _reach_back(x, p, q, int(begins[p])), p + right + q
                if e - s >= max(least, times * q):
                    found.append((s, e, q))
                    further = inside_end[s:e] < e
                    inside_end[s:e][further], inside_period[s:e][further] = e, q
        b *= 2
    found.sort(key=lambda r: (r[0], r[2]))
    s, e, q = np.array(found, np.int64).reshape(-1, 3).T
    return s, e, q


def _seeds(x: np.ndarray, at: np.ndarray, b: int, low: int, ends: np.ndarray, sentinel: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the occurrences of the blocks at ``at``, ``low`` to ``low + b - 1`` words on."""
    place = at[:, None] + low + np.arange(2 * b)
    inside = place < ends[at][:, None]
    windows = np.where(inside, x[np.minimum(place, len(x) - 1)], sentinel)
    hit = occurrences(x[at[:, None] + np.arange(b)], windows)
    row, shift = np.nonzero(hit)
    d = low + shift
    fits = (d > 0) & (at[row] + b + d <= ends[at[row]])
    return at[row[fits]], d[fits]


def _collapsed(run: Words, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[str]:
    """Each text's words, joined by one space, without those that runs repeat."""
    n = len(run.starts)
    dropped = np.zeros(n + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    keep = np.cumsum(dropped)[:n] == 0
    a, size = run.starts[keep], (run.ends - run.starts)[keep] + 1
    stop = np.append(0, np.cumsum(size))
    body = np.append(run.data, np.uint8(32))[np.repeat(a - stop[:-1], size) + np.arange(stop[-1])]
    body[stop[1:] - 1] = 32
    raw, at = body.tobytes(), stop[np.append(0, np.cumsum(keep))[run.first]]
    return [raw[i : max(i, j - 1)].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def with_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, runs, collapsed) per row of ``docs``, words being ``[^\\x20\\x09-\\x0D]+``.

    ``row``: the columns named by ``keep``, or all, as a struct, so that no name can clash. ``runs``: (start, length, period) of every
    stretch of at least 24 words and three times its smallest period that no neighbouring word extends, by start, then period; words count
    from 0. ``collapsed``: the words joined by one space, each run down to its first period. A null or empty text has no words and no runs
    and collapses to the empty text; equal rows have equal results, a row each; an empty table has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column("text"), NOT_SPACE, lower=False, run_bytes=RUN_BYTES):
                s, e, q = find(part.hashes, part.first)
                at = np.searchsorted(s, part.first)
                base = part.first[np.searchsorted(part.first, s, side="right") - 1]
                made = pa.StructArray.from_arrays([pa.array(s - base, pa.int64()), pa.array(e - s, pa.int64()), pa.array(q, pa.int64())], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), made)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(part.row, len(part)), pa.array(np.diff(part.first), pa.int64()), runs, pa.array(_collapsed(part, s, e, q), pa.string())], [f.name for f in schema])

    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([plain.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return plain.mapInArrow(trimmed(run), schema)
