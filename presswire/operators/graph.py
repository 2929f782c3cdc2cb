"""Graphs as edge tables: components, hops, paths, induced parts, communities, gaps. No node's neighbours are gathered but in ``communities`` of up to ``MAX_BROADCAST_NODES`` nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswire.sources.scratch import written


#: Nodes whose minima go to every executor, about 20 bytes each; beyond that they are a table of their own, so that a hub's rows can be split.
MAX_BROADCAST_NODES = 1_000_000
#: Edges that are packed at once, and that meet in a task of a round of ``communities``, or as many as one node has.
PACKED_EDGES = 1_000_000

def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v): the smallest id that is reachable.

    Both rounds are a minimum per node and a join, so no node's neighbours are gathered; each round's edges are written to
    the shared folder, and the loop ends when a round changes nothing. Null ends and loops are left out. No edges: no rows.
    """

    def minima(of: DataFrame, most: int) -> DataFrame:
        least = of.groupBy("u").agg(F.min("v").alias("m"))
        return F.broadcast(least) if most <= MAX_BROADCAST_NODES else written(least, "minima")

    own = F.col("u") != F.col("v")
    edges = written(edges.where(own).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while (state := edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()) != seen and state[0]:
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # each larger neighbour of u is tied to the smallest of u's neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(minima(both, 2 * state[0]), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # each node and its smaller neighbours are tied to the smallest of them
        small = large.join(minima(large, 2 * state[0]), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where(own).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _nodes(df: DataFrame, node: str = "node") -> DataFrame:
    """The distinct nodes of ``df``, on every executor where they are few enough."""
    found = written(df.select(node).distinct(), "nodes")
    return F.broadcast(found) if found.count() <= MAX_BROADCAST_NODES else found


def _together(a: pa.Table, b: pa.Table, same: bool, least: int, cells: int = 4_000_000) -> pa.Table:
    """(a, b, weight) of every node of ``a`` (g, nodes) with every one of ``b``: in how many groups g both are, ``least`` at the fewest. ``same``: one block.

    Counts of ``cells`` pairs are held at once, and as many meetings are added at once.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    if len(a) and len(b):
        b = b.sort_by("g")
        (ga, la, va), (gb, lb, vb) = ((x["g"].to_numpy(), x["nodes"].combine_chunks().value_lengths().to_numpy(), x["nodes"].combine_chunks().flatten().to_numpy()) for x in (a, b))
        (names, ia), (others, ib) = (np.unique(v, return_inverse=True) for v in (va, vb))
        at = np.minimum(np.searchsorted(gb, ga), len(gb) - 1)
        size, first = np.repeat(np.where(gb[at] == ga, lb[at], 0), la), np.repeat((np.cumsum(lb) - lb)[at], la)
        order = np.argsort(ia, kind="stable")
        ia, size, first = ia[order], size[order], first[order]
        total, rows = np.concatenate([[0], np.cumsum(size)]), max(1, cells // len(others))
        for low in range(0, len(names), rows):
            met = np.zeros(min(rows, len(names) - low) * len(others), np.int64)
            i, end = np.searchsorted(ia, [low, low + rows])
            while i < end:
                j = min(end, max(i + 1, np.searchsorted(total, total[i] + cells, "right") - 1))
                k = size[i:j]
                place = np.arange(k.sum()) + np.repeat(first[i:j] - (np.cumsum(k) - k), k)
                met += np.bincount(np.repeat((ia[i:j] - low) * len(others), k) + ib[place], minlength=len(met))
                i = j
            found = np.flatnonzero(met >= least)
            x, y = names[low + found // len(others)], others[found % len(others)]
            once = x < y if same else x != y
            out.append((np.minimum(x, y)[once], np.maximum(x, y)[once], met[found][once]))
    return pa.table(dict(zip(("a", "b", "weight"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def together(members: DataFrame, by: list[str], node: str, least: int = 1, block: int = 5_000) -> DataFrame:
    """(a, b, weight), each pair once, a < b: nodes that are in ``least`` groups ``by`` or more together, and in how many. Nulls are in no group.

    Nodes are dealt into blocks, and every two blocks meet in one task, which counts; so pairs below ``least`` never leave it, and what is
    shuffled are the members, once for each block.
    """
    own = members.dropna(subset=[node, *by]).select(F.col(node).cast("long").alias("node"), *by).distinct()
    n, cores = own.agg(F.approx_count_distinct("node")).first()[0], members.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // block), min(int((2 * cores) ** 0.5), n // 500))
    packed = written(own.groupBy(F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("p"), F.xxhash64(*by).alias("g")).agg(F.collect_list("node").alias("nodes")), "members")
    left = packed.select("g", "nodes", "p", F.explode(F.sequence("p", F.lit(parts - 1))).alias("q"))
    right = packed.select(F.col("g").alias("g"), F.col("nodes").alias("nodes"), F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), "p")).alias("p"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _together(a, b, bool(len(a)) and a["p"][0] == a["q"][0], least)

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, "a long, b long, weight long")


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight) of edges (a, b, weight) in either direction, without loops."""
    e = edges.where("a <> b")
    return e.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def degrees(edges: DataFrame, once: bool = False) -> DataFrame:
    """(node, degree) of edges (a, b): how many others each node has. ``once``: each pair is there once, so none are compared."""
    own = edges.where("a <> b")
    pairs = own.select("a", "b") if once else own.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(node, hops): nodes within k hops of a seed, by the least number; one frontier join each."""
    ways = both_ways(written(edges, "edges")).select("node", "other")
    front = _nodes(seeds)
    seen = front.withColumn("hops", F.lit(0))
    for hop in range(1, k + 1):
        step = ways.join(front, "node", "left_semi").select(F.col("other").alias("node")).distinct()
        front = _nodes(step.join(seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(front.withColumn("hops", F.lit(hop)))
    return seen


#: Edges that meet the ends of paths in one task, or as many as one node has, and the ends that do.
PATH_EDGES, PATH_ENDS = 2_000_000, 1_000_000


def find_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, max_paths: int = 10, kept: bool = False) -> DataFrame:
    """(src, dst, path, score): simple paths of each pair (src, dst), the best by mean weight / (1 + 0.1 nodes), shorter first among equals.

    An edge without weight has 0.5. Paths grow by joins until two edges are left; those are tried in blocks of nodes and ends, where only a pair's best
    paths leave a task (``_two_more``). Where an end is no further off than a path is long, the path only goes on through nodes from which it can still
    be reached. ``kept``: the edges are read from a table, so they aren't written again.
    """
    ways = both_ways((edges if kept else written(edges, "edges")).withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.5))))
    pairs = written(pairs.where("src <> dst").select("src", "dst"), "pairs")
    near = ways.join(_nodes(pairs, "dst").withColumnRenamed("dst", "other"), "other").select(F.col("other").alias("dst"), "node", F.col("weight").alias("last"))
    near = written(near, "near")
    reach = layer = near.select("dst", "node").distinct().withColumn("left", F.lit(1))
    for left in range(2, max_hops // 2 + 1):
        step = layer.select("dst", F.col("node").alias("other")).join(ways, "other").select("dst", "node").where("node <> dst").distinct()
        layer = written(step.join(reach.select("dst", "node"), ["dst", "node"], "left_anti").withColumn("left", F.lit(left)), "reach")
        reach = reach.unionByName(layer)
    front = pairs.select("src", "dst", F.col("src").alias("node"), F.array("src").alias("path"), F.lit(0.0).alias("total"))

    def ended(front: DataFrame) -> DataFrame:
        return front.join(near, ["dst", "node"]).select("src", "dst", F.array_append("path", F.col("dst")).alias("path"), (F.col("total") + F.col("last")).alias("total"))

    found = ended(front)
    for hop in range(1, max_hops - 1):
        step = front.join(ways, "node").where(~F.array_contains("path", F.col("other")) & (F.col("other") != F.col("dst")))
        if max_hops - hop <= hop:
            step = step.join(reach.where(F.col("left") <= max_hops - hop).select("dst", F.col("node").alias("other")), ["dst", "other"], "left_semi")
        front = written(step.select("src", "dst", F.col("other").alias("node"), F.array_append("path", F.col("other")).alias("path"), (F.col("total") + F.col("weight")).alias("total")), "paths")
        found = found.unionByName(ended(front))
    if max_hops > 1:
        found = found.unionByName(_through(front, ways, near, max_paths))
    n = F.size("path")
    scored = found.withColumn("score", F.round(F.least(F.lit(1.0), F.col("total") / (n - 1) / (1 + 0.1 * n)), 9))
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.col("score").desc(), n, F.array_join("path", ",")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= max_paths).select("src", "dst", "path", "score", "rank")


def _through(front: DataFrame, ways: DataFrame, near: DataFrame, most: int) -> DataFrame:
    """(src, dst, path, total): paths of ``front`` by one edge of ``ways`` and one of ``near`` (dst, node, last), the ``most`` best of each pair at least.

    Edges are dealt as lists by groups of their first nodes, once for each block of ends; paths go to the group of their last node, and a block's
    ends to every group. What neither a path nor an end touches isn't dealt.
    """
    ways = ways.join(_nodes(front), "node", "left_semi").join(_nodes(near).withColumnRenamed("node", "other"), "other", "left_semi")
    many, cores = ways.count(), ways.sparkSession.sparkContext.defaultParallelism
    groups, blocks = max(1, -(-many // PATH_EDGES), min(2 * cores, many // 50_000)), max(1, -(-near.count() // PATH_ENDS))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = front.schema["src"].dataType.simpleString()
    listed = ways.select(part("node", groups).alias("k"), "node", "other", "weight").mapInArrow(_listed, f"k int, node array<{kind}>, other array<{kind}>, weight array<double>")
    none = F.lit(None)
    paths = front.select(part("dst", blocks).alias("q"), part("node", groups).alias("k"), "src", "dst", "path", "total", none.cast(f"array<{kind}>").alias("nodes"), none.cast("array<double>").alias("last"))
    # an end's list is in parts, as it may have many neighbours
    ends = near.groupBy("dst", part("node", groups).alias("p")).agg(F.collect_list(F.struct("node", "last")).alias("l"))
    ends = ends.select(part("dst", blocks).alias("q"), every(groups).alias("k"), none.cast(kind).alias("src"), "dst", none.cast(f"array<{kind}>").alias("path"), none.cast("double").alias("total"), F.col("l.node").alias("nodes"), F.col("l.last").alias("last"))

    def run(edges: pa.Table, rest: pa.Table) -> pa.Table:
        return _two_more(edges, rest, most)

    left = listed.withColumn("q", every(blocks))
    return left.groupBy("q", "k").cogroup(paths.unionByName(ends).groupBy("q", "k")).applyInArrow(run, f"src {kind}, dst {kind}, path array<{kind}>, total double")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, node, other, weight) as lists, one for each k of about ``PACKED_EDGES`` rows."""
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("k", "ascending"), ("node", "ascending")])).combine_chunks()
        own = t["k"].to_numpy()
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = pa.array(np.r_[first, len(own)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(own[first]), *(pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("node", "other", "weight"))], t.column_names)

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= PACKED_EDGES:
            yield made()
            held.clear()
    if held:
        yield made()


def _two_more(ways: pa.Table, rest: pa.Table, most: int, cells: int = 1_000_000) -> pa.Table:
    """(src, dst, path, total) of one block: ``ways`` (node, other, weight), lists; ``rest``: paths (src, dst, path, total) and ends (dst, nodes, last), lists.

    ``cells`` edges are tried at once. A pair keeps what may be among its ``most`` best once scores are rounded; among paths of one score the first as text.
    """
    flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    plain = lambda t, c: t[c].to_numpy(zero_copy_only=False)
    at = lambda names, of: np.minimum(np.searchsorted(names, of), len(names) - 1)
    kind = rest.schema.field("dst").type if len(rest) else pa.int64()
    front, near = (rest.filter(f(rest["path"])) for f in (pc.is_valid, pc.is_null)) if len(rest) else (rest, rest)
    if not (len(ways) and len(front) and len(near)):
        return pa.table({"src": pa.array([], kind), "dst": pa.array([], kind), "path": pa.array([], pa.list_(kind)), "total": pa.array([], pa.float64())})
    path, total = flat(front, "path").reshape(len(front), -1), plain(front, "total")
    n = path.shape[1] + 2
    # edges to what has an edge to an end, by their first nodes
    names, code = np.unique(flat(near, "nodes"), return_inverse=True)
    node, to, weight = flat(ways, "node"), flat(ways, "other"), flat(ways, "weight")
    own = at(names, to)
    own, node, weight = (x[names[own] == to] for x in (own, node, weight))
    order = np.argsort(node, kind="stable")
    nodes, first, many = np.unique(node[order], return_index=True, return_counts=True)
    to, weight = own[order], weight[order]
    # ends, by end and neighbour
    targets, end = np.unique(np.repeat(plain(near, "dst"), near["nodes"].combine_chunks().value_lengths().to_numpy()), return_inverse=True)
    order = np.lexsort((code, end))
    code, end, last = code[order], end[order], flat(near, "last")[order]
    # paths, by end
    pair = np.unique(path[:, 0], return_inverse=True)[1] * len(targets) + at(targets, plain(front, "dst"))
    rows = np.flatnonzero(targets[pair % len(targets)] == plain(front, "dst"))
    if len(nodes):
        place = at(nodes, path[:, -1])
        rows = rows[nodes[place[rows]] == path[rows, -1]]
    rows = rows[np.argsort(pair[rows] % len(targets), kind="stable")] if len(nodes) else rows[:0]
    held = [(np.zeros(0, np.int64), np.zeros(0, names.dtype), np.zeros(0))]

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, via, t = map(np.concatenate, zip(*held, strict=True))
        score = np.fmin(1.0, t / (n - 1) / (1 + 0.1 * n))
        order = np.lexsort((-score, pair[i]))
        p = pair[i[order]]
        low = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
        size = np.diff(np.r_[low, len(p)])
        order = order[score[order] >= np.repeat(score[order[low + np.minimum(size, most) - 1]], size) - 2e-9] if len(p) else order
        i, via, t, score = i[order], via[order], t[order], score[order]
        words = [pa.array(x, kind).cast(pa.string()) for x in (*path[i].T, via, targets[pair[i] % len(targets)])]
        text = pc.binary_join_element_wise(*words, ",")
        order = pc.sort_indices(pa.table({"p": pair[i], "s": score, "t": text}), sort_keys=[("p", "ascending"), ("s", "descending"), ("t", "ascending")]).to_numpy()
        p, s = pair[i[order]], score[order]
        low = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])][: len(p)])
        order = order[np.arange(len(p)) - np.repeat(low, np.diff(np.r_[low, len(p)])) < most]
        return i[order], via[order], t[order]

    start, met = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    tried = 0
    for d in np.unique(pair[rows] % len(targets)):
        low, high = np.searchsorted(end, [d, d + 1])
        mine, begin, times = np.unique(code[low:high], return_index=True, return_counts=True)
        start[mine], met[mine] = begin + low, times
        i, stop = np.searchsorted(pair[rows] % len(targets), [d, d + 1])
        sizes = np.cumsum(many[place[rows[i:stop]]])
        done = 0
        while i + done < stop:
            go = max(done + 1, np.searchsorted(sizes, (sizes[done - 1] if done else 0) + cells, "right"))
            r = rows[i + done : i + go]
            m = many[place[r]]
            x = np.arange(m.sum()) + np.repeat(first[place[r]] - (np.cumsum(m) - m), m)
            r = np.repeat(r, m)
            hit = np.flatnonzero(met[to[x]])
            x, r = x[hit], r[hit]
            hit = np.flatnonzero((path[r] != names[to[x]][:, None]).all(axis=1))
            x, r = x[hit], r[hit]
            m = met[to[x]]
            e = np.arange(m.sum()) + np.repeat(start[to[x]] - (np.cumsum(m) - m), m)
            x, r = np.repeat(x, m), np.repeat(r, m)
            held.append((r, names[to[x]], total[r] + weight[x] + last[e]))
            tried += len(r)
            if tried > cells:
                held[:] = [best()]
                tried = 0
            done = go
        met[mine] = 0
    i, via, t = best()
    dst = targets[pair[i] % len(targets)]
    whole = np.concatenate([path[i], via[:, None], dst[:, None]], axis=1)
    return pa.table({"src": pa.array(path[i, 0], kind), "dst": pa.array(dst, kind), "path": pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * n), pa.array(whole.ravel(), kind)), "total": pa.array(t)})


def induced_subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (node)."""
    nodes = _nodes(ids)
    one = edges.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi")
    return one.join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").select(*edges.columns)


def _packed(edges: DataFrame, names: np.ndarray, groups: int) -> DataFrame:
    """(k, node, other, weight) of edges (a, b, weight) in either direction, without loops: lists for each group k of nodes, nodes as places in ``names``."""
    kind = edges.schema["weight"].dataType.simpleString()
    shared = edges.sparkSession.sparkContext.broadcast(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = shared.value, [], 0

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            a, b = (np.searchsorted(at, t[c].to_numpy()).astype(np.int32) for c in ("a", "b"))
            node, other, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([t["weight"].to_numpy()] * 2)
            order = np.lexsort((other, node, node % groups))
            own = node[order] % groups
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            ends = pa.array(np.r_[first, len(own)].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(own[first]), *(pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (node, other, weight))], ["k", "node", "other", "weight"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= PACKED_EDGES:
                yield made()
                held, n = [], 0
        if held:
            yield made()

    return edges.where("a <> b").select("a", "b", "weight").mapInArrow(pack, f"k int, node array<int>, other array<int>, weight array<{kind}>")


def _voted(node: np.ndarray, other: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the label with the most weight around each): the least of equal ones; a node's own label has the weight of its heaviest edge."""
    order = np.argsort(node, kind="stable")
    nodes, first = np.unique(node[order], return_index=True)
    node, label = np.r_[node, nodes], labels[np.r_[other, nodes]]
    weight = np.r_[weight, np.maximum.reduceat(weight[order], first)]
    order = np.lexsort((label, node))
    node, label, weight = node[order], label[order], weight[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (label[1:] != label[:-1])])
    node, label, total = node[first], label[first], np.add.reduceat(weight, first)
    best = np.lexsort((label, -total, node))
    best = best[np.unique(node[best], return_index=True)[1]]
    return node[best], label[best]


def communities(edges: DataFrame, rounds: int = 5, once: bool = False) -> DataFrame:
    """(node, community): each round a node takes the label with the most weight around it, ties to the smallest; a fixed number of rounds, all at once.

    Where the labels go to every executor, edges are packed and dealt by groups of nodes once, and kept; a round reads them where they are. Else votes are shuffled.
    ``once``: each pair is there once, so that there, in the first round, where every node is a label of its own, no weights are added up.
    """
    edges = written(edges, "edges")
    ways = both_ways(edges)
    own = written(ways.groupBy("node").agg(F.max("weight").alias("w"), F.count("*").alias("n"), F.count_if(F.col("weight").isNull()).alias("nulls")), "own")
    nodes, ends, nulls = own.agg(F.count("*"), F.sum("n"), F.sum("nulls")).first()
    if nodes and nodes <= MAX_BROADCAST_NODES and not nulls and all(edges.schema[c].dataType.simpleString() in ("bigint", "int") for c in "ab"):
        return _packed_communities(edges, np.sort(own.select(F.col("node").cast("long")).toArrow()["node"].to_numpy()), -(-ends // PACKED_EDGES), rounds)
    own = own.select("node", "w")
    labels = own.select("node", F.col("node").alias("community"))
    for n in range(rounds):
        if n == 0 and once:
            votes = ways.select("node", F.col("other").alias("community"), F.col("weight").alias("w")).unionByName(own.withColumn("community", F.col("node")))
        else:
            around = ways.join(labels.select(F.col("node").alias("other"), "community"), "other").select("node", "community", F.col("weight").alias("w"))
            votes = around.unionByName(labels.join(own, "node")).groupBy("node", "community").agg(F.sum("w").alias("w"))
        labels = written(votes.groupBy("node").agg(F.max_by("community", F.struct("w", (-F.col("community")).alias("k"))).alias("community")), "labels")
    return labels


def _packed_communities(edges: DataFrame, names: np.ndarray, groups: int, rounds: int) -> DataFrame:
    """``communities`` of edges whose nodes are ``names``, in order; a round's labels, 12 bytes a node, pass through the driver to every executor."""
    spark = edges.sparkSession
    groups = max(groups, min(spark.sparkContext.defaultParallelism, len(names)))
    kept = _packed(edges, names, groups).repartition(groups, "k").persist()
    labels = np.arange(len(names), dtype=np.int32)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(labels)

        def vote(rows: pa.Table) -> pa.Table:
            columns = (rows[c].combine_chunks().flatten().to_numpy() for c in ("node", "other", "weight"))
            return pa.table(dict(zip(("node", "community"), _voted(*columns, shared.value), strict=True)))  # noqa: B023

        voted = kept.groupBy("k").applyInArrow(vote, "node int, community int").toArrow()
        labels = labels.copy()
        labels[voted["node"].to_numpy()] = voted["community"].to_numpy()
        shared.unpersist()
    kept.unpersist()
    return spark.createDataFrame(pa.table({"node": names, "community": names[labels]}))


def structural_gaps(edges: DataFrame, groups: DataFrame, top: int = 20, most: int = 5, once: bool = False) -> DataFrame:
    """(a, b, score): of the ``top`` nodes by degree, pairs in different communities without an edge; score: their degrees. ``once``: as of ``degrees``."""
    central = F.broadcast(written(degrees(edges, once).orderBy(F.col("degree").desc(), "node").limit(top), "central"))
    central = written(groups.join(central, "node").select("node", "degree", "community"), "central")
    x, y = central.select(F.col("node").alias("a"), F.col("degree").alias("da"), F.col("community").alias("ca")), central.select(F.col("node").alias("b"), F.col("degree").alias("db"), F.col("community").alias("cb"))
    pairs = F.broadcast(x.join(F.broadcast(y), (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))))  # at most top * top / 2
    known = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(pairs, ["a", "b"], "left_semi").distinct()
    return pairs.join(known, ["a", "b"], "left_anti").select("a", "b", (F.col("da") + F.col("db")).alias("score")).orderBy(F.col("score").desc(), "a", "b").limit(most)


def build_graph(mentions: DataFrame, max_nodes: int = 200, max_edges: int = 500, doc_nodes: int = 20, per_entity: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of mentions (doc_id, entity).

    Nodes (node, kind, docs): the first ``doc_nodes`` documents, and the entities that most documents mention in the places that are left of
    ``max_nodes``. Edges (a, b, kind, docs, weight), at most ``max_edges``, heaviest first: entities by shared documents with weight min(1, n / 5),
    and each entity with its first ``per_entity`` of the document nodes, at 0.8.
    """
    m = mentions.distinct()
    first = m.select("doc_id").distinct().orderBy("doc_id").limit(doc_nodes)
    entities = m.groupBy("entity").agg(F.count("*").alias("docs")).orderBy(F.col("docs").desc(), "entity").limit(max_nodes - doc_nodes)
    kept = m.join(F.broadcast(entities.select("entity")), "entity", "left_semi")  # max_nodes rows
    own = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("entity")).alias("e"))
    later = lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = own.select(F.explode(F.flatten(F.transform("e", later))).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("docs"))
    shared = pairs.select("a", "b", F.lit("shared").alias("kind"), "docs", F.least(F.lit(1.0), F.col("docs") / 5).alias("weight"))
    n = F.row_number().over(Window.partitionBy("entity").orderBy("doc_id"))
    named = kept.join(F.broadcast(first), "doc_id", "left_semi").withColumn("n", n).where(F.col("n") <= per_entity)
    mention = named.select(F.col("entity").alias("a"), F.concat(F.lit("doc:"), "doc_id").alias("b"), F.lit("mention").alias("kind"), F.lit(1).cast("long").alias("docs"), F.lit(0.8).alias("weight"))
    nodes = entities.select(F.col("entity").alias("node"), F.lit("entity").alias("kind"), "docs").unionByName(first.select(F.concat(F.lit("doc:"), "doc_id").alias("node"), F.lit("document").alias("kind"), F.lit(1).cast("long").alias("docs")))
    return nodes, shared.unionByName(mention).orderBy(F.col("weight").desc(), F.col("docs").desc(), "a", "b").limit(max_edges)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of about ``PACKED_EDGES`` rows at once as the fewest that link the same nodes: each to the first of its part."""
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        names, code = np.unique(np.concatenate([t[c].to_numpy() for c in ("u", "v")]), return_inverse=True)
        a, b = code[: len(t)], code[len(t) :]
        first = np.arange(len(names))
        while len(a):
            np.minimum.at(first, np.maximum(first[a], first[b]), np.minimum(first[a], first[b]))
            while (first[first] != first).any():
                first = first[first]
            apart = first[a] != first[b]
            a, b = a[apart], b[apart]
        own = np.flatnonzero(first != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[own], t.schema.field("u").type), pa.array(names[first[own]], t.schema.field("u").type)], ["u", "v"])

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= PACKED_EDGES:
            yield made()
            held.clear()
    if held:
        yield made()


def duplicate_groups(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, group): each of ``ids`` (id) with the smallest id that it is linked to over pairs (a, b).

    Where pairs are made, a task leaves out those that others make needless (``_stars``), so of large groups few are dealt.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    links = pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").cast(kind).alias("v")).mapInArrow(_stars, f"u {kind}, v {kind}")
    found = components(links)
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
