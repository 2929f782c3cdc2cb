"""Vectors: exact and approximate search, hashed embeddings, memory recall, density clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswire.operators.graph import components
from presswire.sources.scratch import written

#: Queries, and items, of a block; every two blocks meet.
QUERY_BLOCK = 10_000
ITEM_BLOCK = 50_000
#: Products that a task holds at once.
CELLS = 2_000_000
#: Items, and queries, of a list that are worked on at once.
LIST_PART = 20_000
_FAR = np.iinfo(np.int64).max
_NOTHING = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that have ``dim`` values, those rows as a matrix of unit length)."""
    good = np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == dim
    if column.flatten().null_count:
        owner = np.repeat(np.arange(len(column)), np.maximum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)), 0))
        good[owner[np.asarray(column.flatten().is_null())]] = False
    values = np.asarray(column.filter(pa.array(good)).flatten(), dtype=np.float64)
    return np.flatnonzero(good), unit(values.reshape(int(good.sum()), dim))


def _local_best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, fit: Callable[[int], np.ndarray] | None = None) -> pa.Table:
    """(query, id, similarity): of each query the k items of the highest product, ties by id; ``fit``: which items query i may have."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, min(256, CELLS // max(1, len(m))))
    for a in range(0, len(q) if len(m) else 0, step):
        for i, row in enumerate(np.round(q[a : a + step].astype(np.float64) @ m.T, 9), a):
            some = np.arange(len(row)) if fit is None else np.flatnonzero(fit(i) & (row >= -1.5))
            if len(some) > k:
                some = some[row[some] >= np.partition(row[some], -k)[-k]]
            some = some[np.lexsort((ids[some], -row[some]))[:k]]
            out.append((np.full(len(some), names[i]), ids[some], row[some]))
    return pa.table(dict(zip(("query", "id", "similarity"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_topk(items: DataFrame, queries: DataFrame, id_col: str, query_col: str, k: int = 10, threshold: float = -1.0, vector: str = "embedding", same: tuple[str, ...] = ()) -> DataFrame:
    """(query, id, similarity, rank): the k items of the highest cosine similarity; zero vectors have 0, rows of other lengths none.

    ``same``: columns in which an item must be as the query, where the query has a value. Items and queries are dealt into blocks, and every
    two blocks meet in one product of matrices, of which k items a query go on. Nothing passes through the driver but the two counts.
    """
    side = lambda df, key, name, value: written(df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias(value), *(F.col(c).cast("string").alias(f"{value}{i}") for i, c in enumerate(same))), "vectors")
    left, right = side(items, id_col, "id", "v"), side(queries, query_col, "query", "q")
    n, cores = left.count(), items.sparkSession.sparkContext.defaultParallelism
    parts, asked = max(1, -(-n // ITEM_BLOCK), min(cores, n // 1_000)), max(1, -(-right.count() // QUERY_BLOCK))
    deal = lambda df, key, own, many, other, others: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(many)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        values, wanted = ([x[f"{side}{i}"].to_numpy() for i in range(len(same))] for x, side in ((a, "v"), (b, "q")))
        for dim in sorted(set(pc.list_value_length(b["q"]).to_pylist())) if len(a) and len(b) else []:
            (at, m), (bt, q) = _matrix(a["v"].combine_chunks(), dim), _matrix(b["q"].combine_chunks(), dim)

            def fit(i: int, at: np.ndarray = at, bt: np.ndarray = bt) -> np.ndarray:
                good = np.ones(len(at), bool)
                for have, want in zip(values, wanted, strict=True):
                    if want[bt[i]] is not None:
                        good &= have[at] == want[bt[i]]
                return good

            out.append(_local_best(b["query"].to_numpy()[bt], q, a["id"].to_numpy()[at], m, k, fit if same else None))
        return pa.concat_tables(out) if out else _NOTHING

    met = deal(left, "id", "p", parts, "r", asked).groupBy("p", "r").cogroup(deal(right, "query", "r", asked, "p", parts).groupBy("p", "r"))
    return _ranked(met.applyInArrow(best, "query long, id long, similarity double").where(F.col("similarity") >= threshold), k)


@dataclass
class Quantiser:
    """The centres of the lists, and for each stretch of a vector's values the values that stand for it in a code."""

    centres: np.ndarray
    books: list[np.ndarray]
    at: list[int]

    def codes(self, m: np.ndarray) -> np.ndarray:
        """A byte for each stretch: the nearest of the values that stand for it."""
        near = [np.argmax(m[:, a : a + b.shape[1]] @ b.T - (b * b).sum(axis=1) / 2, axis=1) for a, b in zip(self.at, self.books, strict=True)]
        return np.array(near, np.uint8).T.reshape(len(m), len(self.books))

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([b[codes[:, i]] for i, b in enumerate(self.books)]).astype(np.float32)


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int, unit_length: bool) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        half = 0 if unit_length else (centres * centres).sum(axis=1) / 2
        near = np.argmax(points @ centres.T - half, axis=1)
        centres = np.array([points[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))]).reshape(len(centres), points.shape[1])
        centres = unit(centres) if unit_length else centres
    return centres


def ann_build(items: DataFrame, id_col: str, lists: int | None = None, sample: int = 20_000, vector: str = "embedding", seed: int = 7) -> tuple[DataFrame, Quantiser]:
    """(index, its quantiser): (id, code, list_id, v), each item in its two nearest lists, as an item at the edge of a list is often near
    queries on the other side. A code has a byte for every two values; the vector itself stands in an item's first list alone. Centres and
    the values that codes stand for come by k-means from a bounded sample of unit vectors (5,000 of it for codes); lists grow with the root
    of the items, from 16 to 1,024. Every item of the sample's length is indexed."""
    n = items.count()
    lists = lists or int(min(1_024, max(16, np.ceil(np.sqrt(n)))))
    rows = items.where(F.col(vector).isNotNull()).where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(min(1.0, sample / max(n, 1)) * 1_000_000)).select(F.col(vector).cast("array<double>").alias("v")).toArrow()["v"].combine_chunks()
    dim = int(np.bincount(np.asarray(pc.list_value_length(rows))).argmax()) if len(rows) else 0
    points = _matrix(rows, dim)[1]
    rng = np.random.default_rng(seed)
    centres = _means(points, lists, rng, 15, True) if len(points) else np.zeros((0, dim))
    stretches = np.array_split(np.arange(dim), max(1, dim // 2)) if dim else []
    some = points[rng.permutation(len(points))[:5_000]]
    model = Quantiser(centres, [_means(some[:, x], min(256, max(1, len(some) // 2)), rng, 8, False) for x in stretches if len(some)], [int(x[0]) for x in stretches if len(some)])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = _matrix(batch.column(1), dim)
            if len(at) and len(model.centres):
                order = np.argsort(-(m @ model.centres.T), axis=1, kind="stable")
                code = pa.array([x.tobytes() for x in model.codes(m)], pa.binary())
                own = batch.take(pa.array(at))
                for k in range(min(2, len(model.centres))):
                    v = own.column(1) if k == 0 else pa.nulls(len(at), own.column(1).type)
                    yield pa.RecordBatch.from_arrays([own.column(0), code, pa.array(order[:, k].astype(np.int32)), v], ["id", "code", "list_id", "v"])

    return items.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(put, "id long, code binary, list_id int, v array<double>"), model


def ann_search(index: DataFrame, model: Quantiser, queries: DataFrame, query_col: str, k: int = 10, probes: int | None = None, vector: str = "embedding", compared: int | None = None) -> DataFrame:
    """(query, id, similarity, rank) by way of the ``probes`` lists nearest to each query, by default half of them.

    The codes in those lists tell which ``compared`` items may be nearest, by default five times k; their vectors alone are fetched and
    compared. Lists of over ``LIST_PART`` items are dealt into parts, and so are the queries of a list; each pair of parts is one product of
    matrices, of which ``compared`` items a query remain.
    """
    lists, dim = model.centres.shape
    probes, compared = probes or -(-lists // 2), max(k, compared or 5 * k)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = _matrix(batch.column(1), dim)
            if len(at):
                near = np.argsort(-(m @ model.centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                rows = batch.take(pa.array(np.repeat(at, near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel())], ["query", "q", "list_id"])

    def best(items: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(items) or not len(asked):
            return _NOTHING
        codes = np.frombuffer(b"".join(items["code"].to_pylist()), np.uint8).reshape(len(items), len(model.books))
        _, q = _matrix(asked["q"].combine_chunks(), dim)
        return _local_best(asked["query"].to_numpy(), q.astype(np.float32), items["id"].to_numpy(), model.values(codes), compared)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (_, q), (_, m) = _matrix(batch.column(2), dim), _matrix(batch.column(3), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.einsum("ij,ij->i", q, m), 9))], ["query", "id", "similarity"])

    index = written(index, "lists")
    wanted = written(queries.where(F.col(vector).isNotNull()).select(F.col(query_col).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("q")), "queries")
    asked = written(wanted.mapInArrow(probed, "query long, q array<double>, list_id int"), "probes")
    parts = lambda rows, of: rows.groupBy("list_id").agg(F.ceil(F.count("*") / LIST_PART).cast("int").alias(of))
    plan = F.broadcast(parts(index, "item_parts").join(parts(asked, "query_parts"), "list_id"))  # a row for each list
    dealt = lambda rows, key, own, own_n, other, other_n: rows.join(plan, "list_id").withColumn(own, F.pmod(F.xxhash64(key), own_n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
    left = dealt(index, "id", "item_part", F.col("item_parts"), "query_part", "query_parts").select("list_id", "item_part", "query_part", "id", "code")
    right = dealt(asked, "query", "query_part", F.col("query_parts"), "item_part", "item_parts").select("list_id", "item_part", "query_part", "query", "q")
    by = ["list_id", "item_part", "query_part"]
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "query long, id long, similarity double")
    once = scored.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))  # an item may come from both of its lists
    near = _ranked(once, compared).select("query", "id")
    full = near.join(wanted, "query").join(index.where("v IS NOT NULL").select("id", "v"), "id").select("query", "id", "q", "v")
    return _ranked(full.mapInArrow(exact, "query long, id long, similarity double"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): one row, the share of the exact pairs (query, id) that were found."""
    met = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return met.agg(F.countDistinct("query").alias("queries"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def hash_embedding(text: str, dim: int) -> list[float]:
    """A deterministic stand-in for a model: the bytes of sha256 repeated to ``dim`` values, of unit length."""
    raw = np.frombuffer(hashlib.sha256(text.encode()).digest(), dtype=np.uint8).astype(np.float64)
    v = np.resize(raw, dim) / 255.0
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def hash_embeddings(texts: list[str], dim: int) -> np.ndarray:
    """``hash_embedding`` of many texts, a row for each."""
    raw = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), np.uint8).reshape(len(texts), 32)
    return unit(np.take(raw, np.arange(dim) % 32, axis=1) / 255.0)


def embed_chunks(chunks: DataFrame, text: str, dim: int = 64, embed: Callable[[str, int], list[float]] = hash_embedding, vector: str = "embedding") -> DataFrame:
    """``chunks`` with vectors where they lack them; one of a wrong length stays null."""

    def run(texts: pa.Array, lack: pa.Array) -> pa.Array:
        asked = [t or "" for t in texts.filter(lack).to_pylist()]
        if embed is hash_embedding:
            flat = pa.array(hash_embeddings(asked, dim).astype(np.float32).ravel())
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * dim), flat)
        else:
            made = pa.array([v if len(v) == dim else None for v in (embed(t, dim) for t in asked)], pa.list_(pa.float32()))
        at = np.where(lack, np.cumsum(lack) - 1, 0)
        return made.take(pa.array(at, mask=~np.asarray(lack)))

    made = F.arrow_udf(run, "array<float>")
    return chunks.withColumn(vector, F.coalesce(vector, made(F.when(F.col(vector).isNull(), F.col(text)), F.col(vector).isNull())))


def dbscan_cosine(points: DataFrame, id_col: str, eps: float = 0.30, min_samples: int = 5, vector: str = "embedding", block: int = 20_000, tile: int = 2_000) -> DataFrame:
    """(id, cluster): density clusters by cosine distance, each named after its smallest core point, noise -1.

    Equal vectors are worked on as one that counts as often. Every two blocks of points meet, tile by tile, in products of matrices, of which only a
    row for each point and tile goes on: first how many points are near, then to which core of the two blocks a core is tied, then the smallest cluster near a
    point that is no core. A point has ``min_samples`` neighbours with itself to be a core. Rows whose length isn't the commonest are noise.
    """
    keyed = points.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.sha2(F.to_json(F.struct(vector)), 256).alias("key"))
    reps = written(keyed.groupBy("key").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "distinct")
    common = reps.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    n, cores = reps.count(), points.sparkSession.sparkContext.defaultParallelism
    dim, parts = (common["dim"] if common else 0), max(1, -(-n // block), min(int(cores**0.5), n // 1_000))  # points are copied to as many blocks

    def met(rows: DataFrame, others: DataFrame, near: Callable[[pa.Table, pa.Table, np.ndarray], tuple], schema: str) -> DataFrame:
        """What ``near`` makes of (rep, x, v) of two blocks and of which are near each other."""
        spans = F.sequence(F.lit(0), F.lit(parts - 1))
        deal = lambda side, own, other: side.select("rep", "x", "v", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias(own)).withColumn(other, F.explode(spans))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            (at, m), (bt, k) = (_matrix(x["v"].combine_chunks(), dim) if len(x) else (np.zeros(0, np.int64), np.zeros((0, dim))) for x in (a, b))
            (a, p), (b, q) = ((x["rep"].to_numpy()[t], x["x"].to_numpy()[t]) if len(t) else (np.zeros(0, np.int64),) * 2 for x, t in ((a, at), (b, bt)))
            out = [(np.zeros(0, np.int64),) * 2]
            for i in range(0, len(a), tile):
                for j in range(0, len(b), tile):
                    out.append(near(a[i : i + tile], p[i : i + tile], b[j : j + tile], q[j : j + tile], 1 - m[i : i + tile] @ k[j : j + tile].T <= eps + 1e-12))
            return pa.table(dict(zip(("rep", "y"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        return deal(rows, "p", "q").groupBy("p", "q").cogroup(deal(others, "q", "p").groupBy("p", "q")).applyInArrow(run, schema)

    def count(a, _, b, n, close):
        return a, (close * n).sum(axis=1).astype(np.int64)

    def tie(a, _, b, __, close):
        left, right = a.copy(), b.copy()
        while True:
            down = np.minimum(right, np.where(close, left[:, None], _FAR).min(axis=0))
            up = np.minimum(left, np.where(close, down[None, :], _FAR).min(axis=1))
            if (down == right).all() and (up == left).all():
                return np.concatenate([a, b]), np.concatenate([left, right])
            left, right = up, down

    def least(a, _, b, cluster, close):
        found = np.where(close, cluster[None, :], _FAR).min(axis=1)
        return a[found < _FAR], found[found < _FAR]

    schema = "rep long, y long"
    every = reps.select("rep", F.col("n").alias("x"), "v")
    degree = met(every, every, count, schema).groupBy("rep").agg(F.sum("y").alias("n"))
    core = written(every.join(degree.where(F.col("n") >= min_samples).select("rep"), "rep"), "cores")
    ties = met(core, core, tie, schema).where("rep <> y").distinct()
    found = components(ties.select(F.col("rep").alias("u"), F.col("y").alias("v")))
    core = written(core.join(found, core["rep"] == found["id"], "left").select("rep", F.coalesce("component", "rep").alias("x"), "v"), "cores")
    border = met(every.join(core.select("rep"), "rep", "left_anti"), core, least, schema).groupBy("rep").agg(F.min("y").alias("x"))
    placed = keyed.join(reps.select("key", "rep"), "key").join(core.select("rep", "x").unionByName(border), "rep").select("id", F.col("x").alias("cluster"))
    return points.select(F.col(id_col).alias("id")).join(placed, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def recall_memory(memory: DataFrame, queries: DataFrame, as_of, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(query, id, similarity, rank) among the active memories; of a user and a type where the queries have such columns and a value there."""
    active = memory.where(F.col("deleted_at").isNull() & (F.col("created_at") + F.make_dt_interval(F.col("ttl_days")) > as_of))
    return vector_topk(active, queries, "memory_id", "query_id", k, threshold, same=tuple(n for n in ("user_id", "type") if n in queries.columns))


def access_log(recalled: DataFrame, as_of) -> DataFrame:
    """(memory_id, query_id, similarity, accessed_at): rows to append for what ``recall_memory`` found."""
    return recalled.select(F.col("id").alias("memory_id"), F.col("query").alias("query_id"), "similarity", as_of.alias("accessed_at"))


def counted_access(memory: DataFrame, log: DataFrame) -> DataFrame:
    """The new snapshot of ``memory``: ``access_count`` raised by the rows of ``log``, and ``last_accessed_at``."""
    seen = log.groupBy("memory_id").agg(F.count("*").alias("__n"), F.max("accessed_at").alias("__at"))
    before = F.col("last_accessed_at") if "last_accessed_at" in memory.columns else F.lit(None).cast("timestamp")
    found = memory.join(seen, "memory_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("__n", F.lit(0)))
    return found.withColumn("last_accessed_at", F.coalesce(F.greatest(before, F.col("__at")), before, F.col("__at"))).drop("__n", "__at")
