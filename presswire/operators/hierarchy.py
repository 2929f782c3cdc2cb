"""Density clusters without a fixed radius: a spanning tree by mutual reachability, its condensed tree, and the clusters that last longest.

The tree comes by rounds in which every component takes its shortest edge to another; the merges that the edges stand for, in order of
length, are worked out in parts: edges are halved by length until a part fits into a task, the lighter half's components being the nodes of the
heavier half. Chains of the condensed tree are followed by doubling, and clusters are chosen level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.operators.graph import components
from presswire.operators.vectors import CELLS, _matrix
from presswire.sources.scratch import written

#: Edges whose merges are worked out in one task; more are halved. As many clusters are chosen among in one task.
PART_EDGES = 200_000
#: Nearest points of each that are kept.
NEAR = 16
_LEAST = 1e-12


def _met(left: DataFrame, right: DataFrame, parts: int, run: Callable[[pa.Table, pa.Table], dict], schema: str, asked: int | None = None) -> DataFrame:
    """What ``run`` makes of every two blocks of the rows of ``left``, in ``asked`` parts (by default as many), and ``right``."""
    deal = lambda side, own, n, other, m: side.withColumn(own, F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    asked = asked or parts
    return deal(left, "p", asked, "q", parts).groupBy("p", "q").cogroup(deal(right, "q", parts, "p", asked).groupBy("p", "q")).applyInArrow(lambda a, b: pa.table(run(a, b)), schema)


def _tiles(a: pa.Table, b: pa.Table, dim: int, tile: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all of ``b``) of a few rows of ``a`` at a time, not rounded yet."""
    if len(a) and len(b):
        m, k = (_matrix(x["v"].combine_chunks(), dim)[1] for x in (a, b))
        step = max(1, min(tile, CELLS // len(k)))
        for i in range(0, len(m), step):
            d = m[i : i + step] @ k.T
            yield i, np.maximum(np.subtract(1, d, out=d), 0, out=d)


def nearest(reps: DataFrame, dim: int, samples: int, parts: int, tile: int = 2_000) -> DataFrame:
    """(rep, core, bound, near): how far the ``samples``-th nearest point is from each, itself the first, or the farthest where there are fewer;
    the nearest others (d, other), and how far all that aren't among them are at least."""
    k = max(samples, NEAR) + 1

    def some(a: pa.Table, b: pa.Table) -> dict:
        out, names = [], b["rep"].to_numpy() if len(b) else None
        for i, d in _tiles(a, b, dim, tile):
            at = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            out.append((a["rep"].to_numpy()[i : i + len(d)], np.full(len(d), at.shape[1]), np.round(np.take_along_axis(d, at, axis=1), 12).ravel(), names[at].ravel()))
        rep, n, d, other = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        rows = pa.StructArray.from_arrays([pa.array(d), pa.array(other)], ["d", "other"])
        return {"rep": rep, "near": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), rows)}

    met = _met(reps, reps, parts, some, "rep long, near array<struct<d:double,other:long>>").groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    far = F.when(F.size("near") == k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
    return met.select("rep", F.element_at("near", F.least(F.size("near"), F.lit(samples)))["d"].alias("core"), far.alias("bound"), F.filter("near", lambda x: x["other"] != F.col("rep")).alias("near"))


def _joined(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (u, v) of longs: by a union of sets in one task where they are few, else by ``components``."""
    if edges.count() > PART_EDGES:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], ["id", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "id long, component long")


def spanning_tree(reps: DataFrame, dim: int, samples: int, parts: int, tile: int = 2_000) -> DataFrame:
    """(w, lo, hi): the edges of the minimum spanning tree by mutual reachability, ties by ends.

    Rounds take the shortest edge out of components. Edges to the nearest points are known; all others of a point are at least as long as its
    ``bound``, so that a component's shortest known edge is its shortest if it is below the bounds of its points. Where fewer than half of the
    components are sure of theirs, points whose bounds leave a shorter one open are held against all points, but those of the largest
    component, which others join. The shortest edge found so is the point's bound from then on, as edges out of a component only get longer.
    """
    near = written(nearest(reps, dim, samples, parts, tile), "nearest")
    points = written(reps.join(near.select("rep", "core"), "rep"), "points")
    other_core = near.select(F.col("rep").alias("other"), F.col("core").alias("__core"))
    listed = near.select("rep", "core", F.explode("near").alias("e")).select("rep", "core", "e.*").join(other_core, "other")
    edges = listed.select("rep", "other", F.greatest("core", "__core", "d").alias("w"), F.lit(False).alias("sure"))
    label = written(near.select("rep", F.col("rep").alias("comp"), F.greatest("core", "bound").alias("bound")), "labels")
    left, found = label.count(), None

    def shortest(a: pa.Table, b: pa.Table) -> dict:
        b = b.sort_by("rep") if len(b) else b  # of equal edges that to the smallest id is first
        out = []
        for i, w in _tiles(a, b, dim, tile):
            part = a.slice(i, len(w))
            np.maximum(w, part["core"].to_numpy()[:, None], out=w)
            np.maximum(w, b["core"].to_numpy()[None, :], out=w)
            w[part["comp"].to_numpy()[:, None] == b["comp"].to_numpy()[None, :]] = np.inf
            least = w.min(axis=1)
            row, at = np.nonzero(w <= np.where(least < np.inf, least + 1e-11, -1)[:, None])
            d = np.round(w[row, at], 12)
            first = np.lexsort((at, d, row))
            first = first[np.diff(row[first], prepend=-1) > 0]
            out.append((part["rep"].to_numpy()[row[first]], b["rep"].to_numpy()[at[first]], d[first]))
        columns = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return dict(zip(("rep", "other", "w"), columns, strict=True))

    while left > 1:
        known = label.select("rep", "comp")
        ends = edges.join(known, "rep").join(known.select(F.col("rep").alias("other"), F.col("comp").alias("into")), "other").where("comp <> into")
        edges = written(ends.select("rep", "other", "w", "sure", "comp", "into"), "edges")
        best = written(edges.groupBy("comp").agg(F.min(F.struct("w", F.least("rep", "other").alias("lo"), F.greatest("rep", "other").alias("hi"), "into")).alias("e")).select("comp", "e.*"), "best")
        open_ = label.join(best.select("comp", "w"), "comp", "left").where((F.col("bound") < float("inf")) & (F.col("bound") <= F.coalesce("w", F.lit(float("inf")))))
        open_ = written(open_.select("rep", "comp").join(edges.where("sure").select("rep"), "rep", "left_anti"), "open")
        sure = written(best.join(open_.select("comp").distinct(), "comp", "left_anti"), "sure")
        edges = edges.select("rep", "other", "w", "sure")
        if 2 * sure.count() < left:
            largest = label.groupBy("comp").count().orderBy(F.col("count").desc(), "comp").first()["comp"]
            asked = written(points.join(open_.where(F.col("comp") != largest), "rep"), "asked")
            many = max(1, min(parts, asked.count() // 1_000))
            scanned = _met(asked, points.join(known, "rep"), parts, shortest, "rep long, other long, w double", many)
            scanned = written(scanned.groupBy("rep").agg(F.min(F.struct("w", "other")).alias("e")).select("rep", "e.other", "e.w", F.lit(True).alias("sure")), "scanned")
            edges = edges.join(scanned.select("rep"), "rep", "left_anti").unionByName(scanned)
            label = written(label.join(scanned.select("rep", "w"), "rep", "left").select("rep", "comp", F.coalesce("w", "bound").alias("bound")), "labels")
            continue
        found = sure.select("w", "lo", "hi") if found is None else found.unionByName(sure.select("w", "lo", "hi"))
        joined = written(_joined(sure.select(F.col("comp").alias("u"), F.col("into").alias("v"))).select(F.col("id").alias("comp"), "component"), "joined")
        label = written(label.join(joined, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"), "bound"), "labels")
        left = label.select("comp").distinct().count()
    return found.groupBy("lo", "hi").agg(F.min("w").alias("w")).select("w", "lo", "hi") if found is not None else reps.sparkSession.createDataFrame([], "w double, lo long, hi long")


#: A node of the tree of merges: an edge, or a point (of length -1, with its id twice).
_NODE = "struct<w:double,lo:long,hi:long>"


def merges(tree: DataFrame, points: DataFrame) -> DataFrame:
    """(e, na, nb, a, b): for each edge of the tree the two nodes that it merges and how many points they have."""
    leaf = F.struct(F.lit(-1.0).alias("w"), F.col("rep").alias("lo"), F.col("rep").alias("hi"))
    edges = tree.select(F.struct("w", "lo", "hi").alias("e"), F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit("").alias("part"))
    nodes = points.select(F.lit("").alias("part"), F.col("rep").alias("node"), F.lit(1).cast("long").alias("n"), leaf.alias("top"))
    while True:
        edges, nodes = written(edges, "edges"), written(nodes, "nodes")
        large = edges.groupBy("part").agg(F.count("*").alias("m"), *(f(c).alias(f"{k}{c[2:]}") for c in ("e.w", "e.lo") for k, f in (("min", F.min), ("max", F.max)))).where(F.col("m") > PART_EDGES)
        if large.isEmpty():
            break
        key = F.when(F.col("minw") < F.col("maxw"), F.col("e.w")).when(F.col("minlo") < F.col("maxlo"), F.col("e.lo").cast("double")).otherwise(F.col("e.hi").cast("double"))
        cut = edges.join(F.broadcast(large), "part").withColumn("key", key)
        ends = cut.groupBy("part").agg(F.percentile_approx("key", 0.5, 10_000).alias("pivot"), F.max("key").alias("most"))
        halved = cut.join(F.broadcast(ends), "part").select("e", "u", "v", "part", (F.when(F.col("pivot") < F.col("most"), F.col("key") <= F.col("pivot")).otherwise(F.col("key") < F.col("pivot"))).alias("light"))
        rest = edges.join(large.select("part"), "part", "left_anti")
        light = halved.where("light")
        name = lambda c: F.struct("part", c)
        joined = written(components(light.select(name(F.col("u").alias("k")).alias("u"), name(F.col("v").alias("k")).alias("v"))).select(F.col("id.part").alias("part"), F.col("id.k").alias("node"), F.col("component.k").alias("comp")), "joined")
        tops = light.join(joined.withColumnRenamed("node", "u"), ["part", "u"]).groupBy("part", F.col("comp").alias("node")).agg(F.max("e").alias("last"))
        own = nodes.join(large.select("part"), "part", "left_semi").join(joined, ["part", "node"], "left").withColumn("comp", F.coalesce("comp", "node"))
        heavy_nodes = own.groupBy("part", F.col("comp").alias("node")).agg(F.sum("n").alias("n"), F.min_by("top", "node").alias("top")).join(tops, ["part", "node"], "left").select(F.concat("part", F.lit("h")).alias("part"), "node", "n", F.coalesce("last", "top").alias("top"))
        at = lambda end: joined.select("part", F.col("node").alias(end), F.col("comp").alias(f"{end}c"))
        heavy = halved.where("not light").join(at("u"), ["part", "u"], "left").join(at("v"), ["part", "v"], "left").select("e", F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"), F.concat("part", F.lit("h")).alias("part"))
        edges = rest.select("e", "u", "v", "part").unionByName(light.select("e", "u", "v", F.concat("part", F.lit("l")).alias("part"))).unionByName(heavy)
        nodes = nodes.join(large.select("part"), "part", "left_anti").unionByName(own.select(F.concat("part", F.lit("l")).alias("part"), "node", "n", "top")).unionByName(heavy_nodes)

    def solve(es: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        """The merges of a part in order of length, by a union of sets."""
        up = dict(zip(ns["node"], ns["node"], strict=True))
        size, top = dict(zip(ns["node"], ns["n"], strict=True)), dict(zip(ns["node"], zip(ns["tw"], ns["tlo"], ns["thi"], strict=True), strict=True))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for r in es.sort_values(["w", "lo", "hi"]).itertuples(index=False):
            a, b = root(r.u), root(r.v)
            if a == b:
                continue
            out.append((r.w, r.lo, r.hi, size[a], size[b], *top[a], *top[b]))
            up[b], size[a], top[a] = a, size[a] + size[b], (r.w, r.lo, r.hi)
        return pd.DataFrame(out, columns=["w", "lo", "hi", "na", "nb", "aw", "alo", "ahi", "bw", "blo", "bhi"])

    flat_e = edges.select("part", "e.w", "e.lo", "e.hi", "u", "v")
    flat_n = nodes.select("part", "node", "n", F.col("top.w").alias("tw"), F.col("top.lo").alias("tlo"), F.col("top.hi").alias("thi"))
    schema = "w double, lo long, hi long, na long, nb long, aw double, alo long, ahi long, bw double, blo long, bhi long"
    done = flat_e.groupBy("part").cogroup(flat_n.groupBy("part")).applyInPandas(solve, schema)
    node = lambda k: F.struct(F.col(f"{k}w").alias("w"), F.col(f"{k}lo").alias("lo"), F.col(f"{k}hi").alias("hi"))
    return written(done.select(node("").alias("e"), "na", "nb", node("a").alias("a"), node("b").alias("b")), "merges")


def _followed(links: DataFrame) -> DataFrame:
    """(node, end): where chains of links (node, next) end; a node that is its own next ends there. By doubling."""
    links = written(links.select("node", F.col("next").alias("end")), "chains")
    while True:
        step = links.select(F.col("node").alias("end"), F.col("end").alias("further"))
        on = written(links.join(step, "end", "left").select("node", F.coalesce("further", "end").alias("end"), (F.coalesce("further", "end") != F.col("end")).alias("moved")), "chains")
        links = on.select("node", "end")
        if on.where("moved").isEmpty():
            return links


def hdbscan_cosine(points: DataFrame, id_col: str, min_cluster_size: int = 5, min_samples: int | None = None, vector: str = "embedding", block: int = 20_000, tile: int = 2_000) -> DataFrame:
    """(id, cluster): hierarchical density clusters by cosine distance, each named after its smallest id, noise -1.

    Of the condensed tree's clusters, those of at least ``min_cluster_size`` points, the ones are chosen whose points stay longest, as
    lengths shrink, against their parts; never all points as one. Equal vectors count as one point, and copies share its cluster. Rows whose
    length isn't the commonest are noise.
    """
    keyed = points.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.sha2(F.to_json(F.struct(vector)), 256).alias("key"))
    common = keyed.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    dim = common["dim"] if common else 0
    named = written(keyed.where(F.size("v") == dim).groupBy("key").agg(F.min("id").cast("long").alias("rep"), F.first("v").alias("v")), "distinct")
    n, cores = named.count(), points.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // block), min(int(cores**0.5), n // 1_000))
    reps = named.select("rep", "v")
    found = merges(spanning_tree(reps, dim, min_samples or min_cluster_size, parts, tile), reps.select("rep"))

    big = lambda c: F.col(c) >= min_cluster_size
    rate = 1 / F.greatest(F.col("e.w"), F.lit(_LEAST))
    marked = written(found.withColumns({"true": big("na") & big("nb"), "n": F.col("na") + F.col("nb"), "rate": rate}), "marked")
    over = marked.select("e", "true", "n", F.explode(F.array("a", "b")).alias("node")).withColumnRenamed("e", "up")
    large = marked.where(F.col("n") >= min_cluster_size)
    # a cluster is a chain of merges of enough points, up to where two such chains meet
    chain = large.select(F.col("e").alias("node")).join(over.select("node", "up", F.col("true").alias("meets")), "node", "left")
    ends = written(_followed(chain.select("node", F.when(F.col("up").isNull() | F.col("meets"), F.col("node")).otherwise(F.col("up")).alias("next"))), "clusters")
    top = ends.select(F.col("end").alias("c")).distinct().join(over.select(F.col("node").alias("c"), F.col("up").alias("at")), "c", "left")
    parent = top.join(ends.select(F.col("node").alias("at"), F.col("end").alias("parent")), "at", "left")
    clusters = written(parent.select("c", "parent", F.coalesce(1 / F.greatest(F.col("at.w"), F.lit(_LEAST)), F.lit(0.0)).alias("birth")), "clusters")
    # points leave a cluster at each of its merges: those of a small side, and both sides where two clusters part
    leaves = large.select("e", "rate", (F.when(F.col("true") | ~big("na"), F.col("na")).otherwise(0) + F.when(F.col("true") | ~big("nb"), F.col("nb")).otherwise(0)).alias("gone"))
    lasting = leaves.join(ends.select(F.col("node").alias("e"), F.col("end").alias("c")), "e").join(clusters.select("c", "birth"), "c").groupBy("c").agg(F.sum(F.col("gone") * (F.col("rate") - F.col("birth"))).alias("s"))
    chosen = _chosen(written(clusters.join(lasting, "c"), "lasting"))
    # a point belongs to the first merge of enough points over it
    small = marked.where(F.col("n") < min_cluster_size).select(F.col("e").alias("node"))
    first = reps.select(F.struct(F.lit(-1.0).alias("w"), F.col("rep").alias("lo"), F.col("rep").alias("hi")).alias("node")).unionByName(small)
    way = first.join(over.select("node", F.col("up").alias("next")), "node").unionByName(large.select(F.col("e").alias("node"), F.col("e").alias("next")))
    placed = _followed(way).where(F.col("node.w") < 0).select(F.col("node.lo").alias("rep"), F.col("end").alias("node")).join(ends.select("node", F.col("end").alias("c")), "node").join(chosen, "c")
    names = placed.groupBy("chosen").agg(F.min("rep").alias("cluster"))
    labelled = keyed.join(named.select("key", "rep"), "key").join(placed.join(names, "chosen").select("rep", "cluster"), "rep").select("id", "cluster")
    return points.select(F.col(id_col).alias("id")).join(labelled, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _chosen(clusters: DataFrame) -> DataFrame:
    """(c, chosen): for each cluster (c, parent, s) that is in a chosen one, which; from the leaves up, then from the root down.

    Up to ``PART_EDGES`` clusters are few and go to one task, as a tree of them may be as deep as it is large; more are worked out level by level.
    """
    if clusters.count() <= PART_EDGES:
        return _chosen_at_once(clusters)
    best = None
    left = clusters
    while not left.isEmpty():
        ready = left.join(left.select(F.col("parent").alias("c")).where("c IS NOT NULL").distinct(), "c", "left_anti")
        if best is None:
            new = ready.select("c", "parent", "s", F.col("s").alias("most"), F.lit(True).alias("own"))
        else:
            under = best.groupBy(F.col("parent").alias("c")).agg(F.sum("most").alias("below"))
            own: Column = (F.col("s") >= F.coalesce("below", F.lit(0.0))) & F.col("parent").isNotNull()
            new = ready.join(under, "c", "left").select("c", "parent", "s", F.when(own, F.col("s")).otherwise(F.coalesce("below", F.lit(0.0))).alias("most"), own.alias("own"))
        best = written(new if best is None else best.unionByName(new), "best")
        left = written(left.join(best.select("c"), "c", "left_anti"), "left")
    if best is None:
        return clusters.select("c", F.col("c").alias("chosen"))
    best = best.withColumn("own", F.col("own") & F.col("parent").isNotNull())
    level = best.where("parent IS NULL").select("c", F.lit(None).cast(_NODE).alias("chosen"))
    out = None
    while not level.isEmpty():
        level = written(level, "level")
        out = level if out is None else out.unionByName(level)
        level = best.join(level.select(F.col("c").alias("parent"), F.col("chosen").alias("above")), "parent").select("c", F.coalesce("above", F.when(F.col("own"), F.col("c"))).alias("chosen"))
    return out.where("chosen IS NOT NULL")


def _chosen_at_once(clusters: DataFrame) -> DataFrame:
    """The same in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        names = list(zip(*(rows[k].to_pylist() for k in ("w", "lo", "hi")), strict=True))
        at = {c: i for i, c in enumerate(names)}
        up = [at.get(p, -1) for p in zip(*(rows[k].to_pylist() for k in ("pw", "plo", "phi")), strict=True)]
        under: list[list[int]] = [[] for _ in names]
        for i, p in enumerate(up):
            if p >= 0:
                under[p].append(i)
        order = [i for i, p in enumerate(up) if p < 0]
        for i in order:  # grows as it goes
            order += under[i]
        lasts = rows["s"].to_pylist()
        most, own = list(lasts), [False] * len(names)
        for i in reversed(order):
            below = sum(most[k] for k in under[i])
            own[i] = up[i] >= 0 and lasts[i] >= below
            most[i] = lasts[i] if own[i] or not under[i] else below
        chosen = [-1] * len(names)
        for i in order:
            above = chosen[up[i]] if up[i] >= 0 else -1
            chosen[i] = above if above >= 0 else i if own[i] else -1
        kept = [i for i, k in enumerate(chosen) if k >= 0]
        of = [[names[i][k] for i in kept] for k in range(3)] + [[names[chosen[i]][k] for i in kept] for k in range(3)]
        kinds = [pa.float64(), pa.int64(), pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(of, kinds, strict=True)], ["w", "lo", "hi", "cw", "clo", "chi"])

    flat = clusters.select("c.w", "c.lo", "c.hi", F.col("parent.w").alias("pw"), F.col("parent.lo").alias("plo"), F.col("parent.hi").alias("phi"), "s")
    done = written(flat.coalesce(1).mapInArrow(run, "w double, lo long, hi long, cw double, clo long, chi long"), "chosen")
    return done.select(F.struct("w", "lo", "hi").alias("c"), F.struct(F.col("cw").alias("w"), F.col("clo").alias("lo"), F.col("chi").alias("hi")).alias("chosen"))
