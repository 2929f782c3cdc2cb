"""Edges from blocks of members, and what is made of them, against plain versions; no pair is dealt out before it is counted."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from presswire.operators import aggregates, graph


@pytest.fixture(scope="module")
def members():
    r = random.Random(5)
    return [(r.randrange(12), r.choice("xy"), r.randrange(40)) for _ in range(600)] + [(None, "x", 1), (1, None, 2), (1, "x", None)]


def plain(members, least):
    groups, n = {}, Counter()
    for h, k, u in members:
        if None not in (h, k, u):
            groups.setdefault((h, k), set()).add(u)
    for g in groups.values():
        n.update(combinations(sorted(g), 2))
    return {k: w for k, w in n.items() if w >= least}


@pytest.mark.parametrize(("least", "block"), [(1, 5_000), (4, 7), (9, 3)])
def test_together(spark, members, least, block):
    found = graph.together(spark.createDataFrame(members, "h int, k string, u long"), ["h", "k"], "u", least, block).collect()
    assert {(r.a, r.b): r.weight for r in found} == plain(members, least)
    assert len(found) == len(plain(members, least))


def test_together_in_small_steps(members):
    import pyarrow as pa

    groups = {}
    for h, k, u in members:
        if None not in (h, k, u):
            groups.setdefault((h, k), set()).add(u)
    t = pa.table({"g": pa.array(range(len(groups)), pa.int64()), "nodes": pa.array([list(g) for g in groups.values()], pa.list_(pa.int64()))})
    for cells in (1, 50, 1_000):
        found = graph._together(t, t, True, 3, cells).to_pylist()
        assert {(r["a"], r["b"]): r["weight"] for r in found} == plain(members, 3)


def test_edges_shuffle_no_pairs(spark):
    from presswire.plans.q_aggregates import user_edges

    plan = user_edges(spark, "/root/testdata/sf0.001", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_degrees_compare_no_pairs_that_are_there_once(spark, members):
    edges = spark.createDataFrame([(a, b) for a, b in plain(members, 4)], "a long, b long")
    assert sorted(graph.degrees(edges, True).collect()) == sorted(graph.degrees(edges).collect())
    twice = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert sorted(aggregates.degree_centrality(twice).collect()) == sorted(aggregates.degree_centrality(edges, True).collect())


@pytest.fixture()
def names(monkeypatch):
    kept, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.append(name) or real(df, name))
    return kept


def test_hops_work_edges_out_once(spark, members, names):
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in plain(members, 4).items()], "a long, b long, weight long")
    found = {r.node: r.hops for r in graph.k_hop(edges, spark.createDataFrame([(3,)], "node long"), 2).collect()}
    near = {}
    for a, b in plain(members, 4):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {3: 0}
    for hop in (1, 2):
        for n in [n for n, h in want.items() if h == hop - 1]:
            for m in near.get(n, ()):
                want.setdefault(m, hop)
    assert found == want and names.count("edges") == 1


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_communities(spark, members, monkeypatch, most):
    monkeypatch.setattr(graph, "MAX_BROADCAST_NODES", most)
    weights = plain(members, 4)
    around = {}
    for (a, b), w in weights.items():
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    label = {n: n for n in around}
    for _ in range(3):
        new = {}
        for n, others in around.items():
            votes = Counter({label[n]: max(w for _, w in others)})
            for m, w in others:
                votes[label[m]] += w
            new[n] = min(votes, key=lambda k: (-votes[k], k))
        label = new
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "a long, b long, weight long")
    for once in (True, False):
        assert {r.node: r.community for r in graph.communities(edges, 3, once).collect()} == label


def test_gaps_and_induced_parts_shuffle_no_edges(spark, members):
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in plain(members, 4).items()], "a long, b long, weight long")
    ids = spark.range(0, 40, 3).withColumnRenamed("id", "node")
    kept = graph.induced_subgraph(edges, ids)
    assert {(r.a, r.b) for r in kept.collect()} == {p for p in plain(members, 4) if not p[0] % 3 and not p[1] % 3}
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    groups = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node") % 5)
    assert graph.structural_gaps(edges, groups, once=True).collect() == graph.structural_gaps(edges, groups).collect()


def test_paths_work_edges_out_once_and_end_by_key(spark, members, names):
    weights = plain(members, 4)
    edges = spark.createDataFrame([(a, b, w / 100) for (a, b), w in weights.items()], "a long, b long, weight double")
    near = {}
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w / 100
    src = min(near)
    dst = max(near)
    paths = [(src,)]
    want = set()
    for _ in range(3):
        paths = [(*p, m) for p in paths for m in near[p[-1]] if m not in p]
        want |= {p for p in paths if p[-1] == dst}
        paths = [p for p in paths if p[-1] != dst]
    found = graph.find_paths(edges, spark.createDataFrame([(src, dst)], "src long, dst long"), 3, 1_000_000)
    assert {tuple(r.path) for r in found.collect()} == want and names.count("edges") == 1


def test_communities_pack_edges_once(spark, members, monkeypatch):
    weights = plain(members, 4)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()] + [(3, 3, 9)], "a long, b long, weight long")
    made, real = [], graph._packed
    monkeypatch.setattr(graph, "_packed", lambda *args: made.append((args[1], args[2], real(*args))) or made[-1][2])
    graph.communities(edges, 3).collect()
    ((names, groups, packed),) = made
    rows = packed.collect()
    found = {(int(names[i]), int(names[j]), w) for r in rows for i, j, w in zip(r.node, r.other, r.weight, strict=True)}
    assert found == {x for (a, b), w in weights.items() for x in ((a, b, w), (b, a, w))}
    assert all(i % groups == r.k for r in rows for i in r.node) and len(rows) <= groups * packed.rdd.getNumPartitions()


@pytest.mark.parametrize(("hops", "most"), [(1, 3), (2, 3), (3, 4), (3, 1_000), (4, 5), (5, 2)])
def test_best_paths_come_from_blocks(spark, monkeypatch, names, hops, most):
    r = random.Random(hops)
    edges = [(a, b, r.choice([None, 0.05, 0.06, 0.5, 3.0])) for a, b in combinations(range(13), 2) if r.random() < 0.55] + [(3, 2, 0.06), (4, 4, 1.0)]
    near = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, []).append((b, 0.5 if w is None else w))
            near.setdefault(b, []).append((a, 0.5 if w is None else w))
    ends = [(0, 12), (1, 12), (5, 7), (5, 12), (3, 3), (2, 99), (None, 1)]
    want = []
    for src, dst in ends:
        found, front = [], [((src,), 0.0)]
        for _ in range(hops):
            front = [((*p, o), t + w) for p, t in front if p[-1] != dst for o, w in near.get(p[-1], []) if o not in p]
            found += [(-round(min(1.0, t / (len(p) - 1) / (1 + 0.1 * len(p))), 9), len(p), ",".join(map(str, p))) for p, t in front if p[-1] == dst]
        want += [(src, dst, text, -s, n) for n, (s, _, text) in enumerate(sorted(found)[:most], 1)]
    monkeypatch.setattr(graph, "PATH_EDGES", 9)
    monkeypatch.setattr(graph, "PATH_ENDS", 6)
    found = graph.find_paths(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(ends, "src long, dst long"), hops, most).collect()
    assert sorted((x.src, x.dst, ",".join(map(str, x.path)), x.score, x["rank"]) for x in found) == sorted(want)
    # no step lists paths of the last two edges, and none looks further back from the ends than paths have come
    assert names.count("paths") == max(0, hops - 2) and names.count("reach") == max(0, hops // 2 - 1)


def test_two_more_edges_in_small_steps():
    import pyarrow as pa

    r = random.Random(1)
    pairs = [(a, b) for a in range(6) for b in range(6, 15) if r.random() < 0.7]
    ways = pa.table({"node": pa.array([[a for a, _ in pairs], [0]]), "other": pa.array([[b for _, b in pairs], [6]]), "weight": pa.array([[0.1] * len(pairs), [0.2]])})
    paths = [(20, d, [20, a], 0.1) for d in (21, 22) for a in range(6)]
    rest = {"src": [p[0] for p in paths] + [None] * 2, "dst": [p[1] for p in paths] + [21, 22], "path": [p[2] for p in paths] + [None] * 2, "total": [p[3] for p in paths] + [None] * 2}
    ends = {21: list(range(6, 15)), 22: [6, 9, 9]}
    rest |= {"nodes": [None] * len(paths) + list(ends.values()), "last": [None] * len(paths) + [[0.1] * len(v) for v in ends.values()]}
    kinds = {"src": pa.int64(), "dst": pa.int64(), "path": pa.list_(pa.int64()), "total": pa.float64(), "nodes": pa.list_(pa.int64()), "last": pa.list_(pa.float64())}
    rest = pa.table({k: pa.array(v, kinds[k]) for k, v in rest.items()})
    full = sorted((d, 0.3 if w == 0.1 else 0.4, (20, a, b, d)) for d in ends for a, b, w in [*((a, b, 0.1) for a, b in pairs), (0, 6, 0.2)] for e in ends[d] if e == b)
    for most in (2, 1_000):
        want = [x for d in ends for x in sorted((x for x in full if x[0] == d), key=lambda x: (-x[1], ",".join(map(str, x[2]))))[:most]]
        for cells in (1, 7, 1_000):
            found = graph._two_more(ways, rest, most, cells).to_pylist()
            assert sorted((x["dst"], round(x["total"], 9), tuple(x["path"])) for x in found if most == 1_000) == (sorted(want) if most == 1_000 else [])
            assert {(x[0], x[2]) for x in want} <= {(x["dst"], tuple(x["path"])) for x in found}
            assert len(found) <= len(full) if most == 1_000 else len(found) <= 3 * most * len(ends)


def test_groups_deal_few_pairs(spark, monkeypatch):
    r = random.Random(2)
    groups = [list(range(0, 60)), list(range(100, 130)), list(range(200, 203)), list(range(300, 341))]
    pairs = [p if r.random() < 0.5 else p[::-1] for g in groups[:3] for p in combinations(g, 2)] + [(i, i + 1) for i in range(300, 340)]
    r.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long").coalesce(2)
    want = {n: g[0] for g in groups for n in g} | {999: 999}
    ids = spark.createDataFrame([(n,) for n in want], "id long")
    kept, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    assert dict(map(tuple, graph.duplicate_groups(df, ids).collect())) == want
    assert next(df for name, df in kept if name == "edges").count() < 2 * len(want)
    monkeypatch.setattr(graph, "PACKED_EDGES", 10)
    assert dict(map(tuple, graph.duplicate_groups(df, ids).collect())) == want
    named = spark.createDataFrame([("b", "c"), ("c", "a"), ("é", "z")], "a string, b string")
    assert {x.group for x in graph.duplicate_groups(named, named.select(F.explode(F.array("a", "b")).alias("id"))).collect()} == {"a", "z"}
