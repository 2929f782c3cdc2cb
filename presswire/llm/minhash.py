"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on whole shingle sets.

The sketch (Dahlgaard, Knudsen and Thorup, 2017) throws every element of a set into one of ``t`` bins, round after round
with a new hash each; a bin keeps the least (round, value) that it got. A set of n elements fills all bins after about
``t log(t) / n`` rounds; after ``t`` rounds, round ``t + i`` throws everything into bin i, so that every coordinate fills.
Two sets agree in a coordinate with a probability of their Jaccard similarity, concentrated as with independent hashes.

How links are found without all pairs of a group:

1. Documents with equal sets are one class, under the smallest id.
2. Classes that share a band (a hash of ``rows`` coordinates) are a bucket. Each is verified against the smallest and the
   largest id of its bucket, which is linear in the bucket.
3. Components of those links are formed. Only in a bucket that still has several components may a link be missing: those members
   outside a main component that meet another component in their rarest shingles (an exact filter) are verified too.

The number of bands is set from the threshold so that a pair at the threshold shares none with a probability under ``miss``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswire.operators.graph import components
from presswire.llm.scratch import trimmed, written
from presswire.llm.wordhash import NOT_SPACE, mix, shingle_sets, words

#: Ids of candidates go to every executor up to this number (16 bytes each); beyond it, texts are shuffled to them.
MAX_BROADCAST_IDS = 1_000_000


def bands_for(threshold: float, rows: int, miss: float = 1e-9) -> int:
    """How many bands of ``rows`` coordinates miss a pair at ``threshold`` with a probability under ``miss``."""
    return 1 if threshold >= 1 else math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def sketch(values: np.ndarray, owner: np.ndarray, n_sets: int, t: int) -> np.ndarray:
    """The ``n_sets`` x ``t`` sketches of sets given as hashed elements and, ascending, the set each is of. Empty sets: the largest value."""
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_sets * t, unset, dtype=np.uint64)
    for i in range(2 * t):
        if not len(values):
            break
        y = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        place = ((y >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + place, np.uint64(i << 52) | (mix(y) >> np.uint64(12)))
        short = (out.reshape(n_sets, t) == unset).any(axis=1)
        keep = short[owner]
        values, owner = values[keep], owner[keep]
    return out.reshape(n_sets, t)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int, bands: int) -> DataFrame:
    """(id, n, fp, bands) per document: the size of its set, a 128-bit digest of the whole set, and its hashed bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column(1), NOT_SPACE):
                sets = list(shingle_sets(part, size))
                n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                s = sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets), rows * bands)
                keys = _band_keys(s, rows, bands)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                fp = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, len(sets)), pa.array(n), fp, listed], ["id", "n", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, n long, fp binary, bands array<long>")


def _band_keys(s: np.ndarray, rows: int, bands: int) -> np.ndarray:
    cut = s.reshape(len(s), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(s), bands)).copy()
    for r in range(rows):
        key = mix(key ^ cut[:, :, r]) + np.uint64(r)
    return key


def shingle_table(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, set): the sorted distinct shingles of each whole text as little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column(1), NOT_SPACE):
                sets = list(shingle_sets(part, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "n", "set"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, n long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets have ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    a, b = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    joined = pairs.join(a, "a").join(b, "b").where(close).select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(trimmed(run), f"a {kind}, b {kind}")


def _sets_of(docs: DataFrame, id_col: str, text_col: str, size: int, ids: DataFrame) -> DataFrame:
    ids = written(ids.select(F.col("id").alias(id_col)).distinct(), "candidates")
    return written(shingle_table(docs.select(id_col, text_col).join(_side(ids), id_col, "left_semi"), id_col, text_col, size), "sets")


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components, one of them ``apart``, that may be linked: their rarest shingles meet.

    Sets with 100 * intersection >= percent * union share one of the rarest n - ceil(percent * n / 100) + 1 shingles of each,
    at a place that leaves room for the rest of the intersection. In a group of edited copies those are what the edits made,
    so that copies too far apart hardly meet, however many they are.
    """
    rank = Window.partitionBy("id").orderBy("df", "shingle")
    spread = _listed(sets).select("id", "component", "apart", "n", F.explode("set").alias("shingle"))
    df = spread.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = spread.join(df, "shingle").withColumn("at", F.row_number().over(rank))
    kept = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1")
    kept = written(kept.select("id", "component", "apart", "n", "shingle", "at"), "prefixes")
    x, y = kept.where("apart").alias("x"), kept.alias("y")
    room = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    close = (100 + percent) * room >= percent * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & close)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _listed(sets: DataFrame) -> DataFrame:
    """``sets`` with each packed set as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("set").to_pylist()
            ends = np.cumsum([0, *(len(x) // 8 for x in packed)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int64)))
            yield batch.set_column(batch.schema.get_field_index("set"), "set", lists)

    return sets.mapInArrow(trimmed(run), ", ".join(f"{k} {'array<long>' if k == 'set' else t}" for k, t in sets.dtypes))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rows: int = 7, miss: float = 1e-9) -> DataFrame:
    """(id, n_shingles, component) per row of ``docs``: components of the links between near duplicates.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct ``size``-word shingles, or its
    whole sequence where it has fewer words. Two documents are linked when 100 * intersection >= ``percent`` * union.
    ``component`` is the smallest id reachable. Texts without words, empty or null, are linked with nothing: their component is
    their own id. Rows that share an id are one document, linked wherever one of its rows is. A row without id gets the
    smallest id of its copies, or null. Other columns are ignored, so their names can't clash.
    """
    bands = bands_for(percent / 100, rows, miss)
    table = written(sketches(docs, id_col, text_col, size, rows, bands), "sketches")
    classes = table.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"))
    leaders = table.join(classes.select(F.col("rep").alias("id")).where("id is not null").distinct(), "id", "left_semi").where("n > 0")
    rows_of = leaders.select("id", "n", F.explode("bands").alias("band"))
    ends = rows_of.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    buckets = written(rows_of.join(ends, "band"), "buckets")

    star = buckets.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("id").alias("b")).where("a <> b")
    star = written(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    sets = _sets_of(docs, id_col, text_col, size, star.select(F.explode(F.array("a", "b")).alias("id")))
    links = written(verified(star, sets, percent), "links")

    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = buckets.join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("members"))
    mains = parts.groupBy("band").agg(F.max_by("component", "members").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main")
    unsettled = placed.join(mains, "band").groupBy("id", "component").agg(F.max(F.col("component") != F.col("main")).alias("apart"))
    unsettled = written(unsettled, "unsettled")
    sets = _sets_of(docs, id_col, text_col, size, unsettled.select("id"))
    cross = written(_prefix_pairs(sets.join(unsettled, "id"), percent).join(star, ["a", "b"], "left_anti"), "cross")
    more = written(verified(cross, sets, percent), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = classes.join(found, classes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    full = table.where("n > 0").select("id", "n", "fp").join(named, "fp", "left").select("id", F.col("n").alias("n_shingles"), "component")
    return full.unionByName(table.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the smallest id.

    Of rows that repeat an id and a text one stays. Rows without id stay if no copy has one.
    """
    marked = near_duplicates(docs, id_col, text_col, **how)
    gone = written(marked.where("id <> component").select(F.col("id").alias(id_col)).distinct(), "gone")
    again = written(marked.groupBy(F.col("id").alias(id_col)).agg(F.count("*").alias("rows")).where(f"rows > 1 and {id_col} is not null").select(id_col), "again")
    left = docs.join(_side(gone), id_col, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(_side(again), id_col, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(_side(again), id_col, "left_anti").unionByName(once)


def _side(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
