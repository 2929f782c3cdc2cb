"""Benchmark decontamination: exact containment of benchmark windows in whole texts, by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words; an item of fewer words, but not none, is one window. Each window is
a set of ``grain``-word shingles (whole, where it is shorter), and to hold the window a text must hold all of them, so one
shingle is prefix enough. It is the rarest: shingles of the benchmark are counted over all texts first. A text's shingles meet the
prefixes; the window's place follows from the shingle's, and must lie inside the text (position and length); the window's whole
word sequence there is then compared by its 64-bit hash.

The benchmark is dealt into blocks of at most ``BLOCK_WORDS`` words, so that what a task holds of it is bounded, and each block
is matched with all texts, one block after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.llm.scratch import trimmed, written
from presswire.llm.wordhash import ALNUM, Lookup, Words, sequence, words

#: Words of a benchmark block: about 150 bytes each on the driver and in each task. A longer item is a block of its own.
BLOCK_WORDS = 500_000
GRAIN = 3


class Block:
    """The distinct windows of some items: by window its words' number and hash and, per item, which windows it has."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        found: dict[tuple[int, int], list[int]] = {}
        shingles: dict[tuple[int, int], np.ndarray] = {}
        for run in words(pa.array(texts, pa.string()), ALNUM):
            for k in range(len(run)):
                h = run.hashes[run.first[k] : run.first[k + 1]]
                size = min(window, len(h))
                if not size:
                    continue
                grain = min(GRAIN, size)
                fine, whole = sequence(h, grain), sequence(h, size)
                for i, w in enumerate(whole.tolist()):
                    found.setdefault((size, w), []).append(run.row + k)
                    shingles[size, w] = fine[i : i + size - grain + 1]
        self.ids = ids
        self.keys = list(found)
        self.items = [sorted(set(found[k])) for k in self.keys]
        self.shingles = [shingles[k] for k in self.keys]

    def grains(self) -> dict[int, np.ndarray]:
        """The sorted distinct shingles by their number of words."""
        by: dict[int, list[np.ndarray]] = {}
        for (size, _), s in zip(self.keys, self.shingles, strict=True):
            by.setdefault(min(GRAIN, size), []).append(s)
        return {g: np.unique(np.concatenate(s)) for g, s in by.items()}

    def prefixes(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
        """By number of words: sorted prefix shingles and, for each, the shingle's place in the window, the window's size, hash and index."""
        by: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for i, ((size, whole), s) in enumerate(zip(self.keys, self.shingles, strict=True)):
            values, n = counts[min(GRAIN, size)]
            at = int(np.argmin(n[np.searchsorted(values, s)]))
            by.setdefault(min(GRAIN, size), []).append((int(s[at]), at, size, whole, i))
        out = {}
        for g, rows in by.items():
            rows.sort()
            p, at, size, whole, i = zip(*rows, strict=True)
            out[g] = np.array(p, np.uint64), np.array(at), np.array(size), np.array(whole, np.uint64), np.array(i)
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    """``items`` in blocks; rows arrive one partition at a time."""
    ids, texts, n = [], [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        size = len(row[1] or "") // 2
        if ids and n + size > BLOCK_WORDS:
            yield Block(ids, texts, window)
            ids, texts, n = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        n += size
    if ids:
        yield Block(ids, texts, window)


def shingle_counts(docs: DataFrame, text_col: str, grains: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each of the given shingles stands in all texts, one run of words after another; that orders them by rarity."""
    known = docs.sparkSession.sparkContext.broadcast(grains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {g: np.zeros(len(v), np.int64) for g, v in known.value.items()}
        lookups = {g: Lookup(v) for g, v in known.value.items()}
        for batch in batches:
            for part in words(batch.column(0), ALNUM):
                for g, lookup in lookups.items():
                    np.add.at(total[g], lookup.find(sequence(part.hashes, g))[1], 1)
        for g, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at), pa.array(n[at])], ["g", "i", "n"])

    counted = docs.select(text_col).mapInArrow(trimmed(run), "g int, i long, n long").groupBy("g", "i").agg(F.sum("n").alias("n"))
    total = {g: np.zeros(len(v), np.int64) for g, v in grains.items()}
    for r in counted.collect():  # at most one row for each shingle of a block
        total[r["g"]][r["i"]] = r["n"]
    known.unpersist()
    return {g: (v, total[g]) for g, v in grains.items()}


def _hits(part: Words, prefixes: dict[int, tuple[np.ndarray, ...]], lookups: dict[int, Lookup]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first word in the run, number of words, window) of the occurrences of windows."""
    for g, (p, offset, size, whole, index) in prefixes.items():
        at, _ = lookups[g].find(s := sequence(part.hashes, g))
        low, high = np.searchsorted(p, s[at]), np.searchsorted(p, s[at], side="right")
        each = np.repeat(np.arange(len(at)), high - low)
        which = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - high, high - low)
        start = at[each] - offset[which]
        doc = np.searchsorted(part.first, at[each], side="right") - 1
        room = (start >= part.first[doc]) & (start + size[which] <= part.first[doc + 1])
        doc, start, which = doc[room], start[room], which[room]
        for n in np.unique(size[which]).tolist():
            sel = np.flatnonzero(size[which] == n)
            sel = sel[sequence(part.hashes, n)[start[sel]] == whole[which[sel]]]
            yield doc[sel], start[sel], np.full(len(sel), n), index[which[sel]]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words as disjoint runs in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[first], reach[np.concatenate([first[1:] - 1, [len(start) - 1]])]


def _match(block: Block, prefixes: dict[int, tuple[np.ndarray, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row what it has of the block's windows."""
    lookups = {g: Lookup(np.unique(p[0])) for g, p in prefixes.items()}
    for batch in batches:
        n_words, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        for part in words(batch.column("text"), ALNUM):
            n_words += np.diff(part.first).tolist()
            found = [np.concatenate(x) for x in zip(*_hits(part, prefixes, lookups), strict=True)]
            for k in np.unique(found[0]).tolist() if found else []:
                sel, zero, row = found[0] == k, part.first[k], part.row + k
                old = np.array([[h["a"], h["b"]] for h in hits[row]], np.int64).reshape(-1, 2)
                new = np.stack([found[1][sel] - zero, found[1][sel] + found[2][sel] - zero], axis=1)
                both = np.concatenate([old, new])
                hits[row] = [{"a": a, "b": b} for a, b in zip(*(x.tolist() for x in _merged(both[:, 0], both[:, 1])), strict=True)]
                own = {block.ids[i] for w in np.unique(found[3][sel]).tolist() for i in block.items[w]}
                items[row] = sorted({*items[row], *(str(i) for i in own if i is not None)})
        out = {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, batch.schema.field("hits").type), "items": pa.array(items, batch.schema.field("items").type)}
        yield pa.RecordBatch.from_arrays([out.get(f.name, batch.column(f.name)) for f in batch.schema], batch.schema.names)


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(row, n_words, hits, items) per row of ``docs``.

    ``row``: the columns named by ``keep``, or all, as a struct, so that no name can clash. ``hits``: the runs of words (a, b: first,
    and after last, from 0) that lie inside occurrences of windows, disjoint and in order. ``items``: the distinct ids, as
    strings in their order, of items with an occurring window; an item without id is not named. Null and empty texts have no
    words and no hits; without items nothing is hit.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row")
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:long,b:long>>").alias("hits"), F.array().cast("array<string>").alias("items")]
    out = docs.select(kept, F.col(f"`{text_col}`").alias("text"), *none)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])

    def matched(rows: DataFrame, block: Block, schema: T.StructType) -> DataFrame:
        known = docs.sparkSession.sparkContext.broadcast((block, block.prefixes(shingle_counts(docs, text_col, block.grains()))))
        return rows.mapInArrow(trimmed(lambda batches: _match(*known.value, batches)), schema)

    dealt = blocks(items, item_id, item_text, window)
    out, block = matched(out, next(dealt, None) or Block([], [], window), schema), next(dealt, None)
    if block is None:
        return out.select("row", "n_words", "hits", "items")
    # one more pass over the written texts for each further block, of which only texts with hits are kept
    out = written(out.withColumn("rid", F.monotonically_increasing_id()), "matched")
    bare = out.select("rid", "text", *none)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in bare.schema])
    found = out.select("rid", "hits", "items")
    while block is not None:
        more = matched(bare, block, schema).where(F.size("hits") > 0).select("rid", "hits", "items")
        found, block = found.unionByName(written(more, "matched")), next(dealt, None)
    found = found.where(F.size("hits") > 0).groupBy("rid").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # a text's runs of hits are no more than its words
    return out.drop("hits", "items").join(found, "rid", "left").select("row", "n_words", F.coalesce(joined(F.array_sort("hits")), none[1]).alias("hits"), F.coalesce("items", none[2]).alias("items"))


def joined(runs: Column) -> Column:
    """Sorted runs (a, b) as disjoint ones in order."""
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, r: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], r["b"]).alias("b"))))
    return F.aggregate(runs, F.slice(runs, F.lit(1), F.lit(1)), lambda done, r: F.when(r["a"] <= last(done)["b"], longer(done, r)).otherwise(F.array_append(done, r)))


def n_hit() -> Column:
    """The number of hit words, of the column ``hits``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["b"] - h["a"])


def without_contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Those of ``docs`` that hold no window of an item."""
    return contamination(docs, items, **how).where(F.size("hits") == 0).select("row.*")
