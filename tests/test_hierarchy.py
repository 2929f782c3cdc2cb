"""Hierarchical clusters against a plain version that looks at every pair of points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.operators import hierarchy
from presswire.operators.vectors import unit


def plain(x, m, samples):
    """The merges of all pairs in order of length, then the clusters that last longest, by recursion."""
    u, n = unit(np.asarray(x, float)), len(x)
    d = np.round(np.maximum(1 - u @ u.T, 0), 12)
    core = np.sort(d, axis=1)[:, min(samples, n) - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    up, node, size, kids, points = list(range(n)), {i: i for i in range(n)}, dict.fromkeys(range(n), 1), {}, {i: [i] for i in range(n)}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    last = None
    for length, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = root(i), root(j)
        if a != b:
            last = e = (length, i, j)
            kids[e] = node[a], node[b]
            size[e], points[e] = size[node[a]] + size[node[b]], points[node[a]] + points[node[b]]
            up[b], node[a] = a, e

    def solve(e, birth, whole):
        lasts, top, below, chosen = 0.0, e, 0.0, []
        while True:
            rate, (a, b) = 1 / max(e[0], 1e-12), kids[e]
            both = size[a] >= m and size[b] >= m
            lasts += sum(size[k] for k in (a, b) if both or size[k] < m) * (rate - birth)
            if both:
                for k in (a, b):
                    s, c = solve(k, rate, False)
                    below, chosen = below + s, chosen + c
                break
            if size[a] < m and size[b] < m:
                break
            e = a if size[a] >= m else b
        return (lasts, [top]) if not whole and lasts >= below else (below, chosen)

    label = [-1] * n
    for c in solve(last, 0.0, True)[1] if last is not None and size[last] >= m else []:
        for p in points[c]:
            label[p] = min(points[c])
    return label


@pytest.mark.parametrize("part", [200_000, 20])
def test_clusters_equal_the_plain_ones(spark, monkeypatch, part):
    monkeypatch.setattr(hierarchy, "PART_EDGES", part)
    rng = np.random.default_rng(part)
    centres = rng.normal(size=(5, 8))
    x = np.concatenate([c + s * rng.normal(size=(k, 8)) for c, s, k in zip(centres, (0.05, 0.2, 0.3, 0.1, 0.02), (25, 20, 20, 8, 10), strict=True)] + [rng.normal(size=(15, 8))])
    odd = [(500, x[3].tolist()), (501, x[3].tolist()), (502, None), (503, [1.0]), (504, x[90].tolist())]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, embedding array<double>")
    found = {r["id"]: r["cluster"] for r in hierarchy.hdbscan_cosine(df, "id", block=40).collect()}
    want = plain(x, 5, 5)
    assert [found[i] for i in range(len(x))] == want and len(set(want)) >= 4
    assert (found[500], found[501], found[502], found[503], found[504]) == (want[3], want[3], -1, -1, want[90])


def test_few_points_have_no_clusters(spark):
    schema = "id long, embedding array<double>"
    assert hierarchy.hdbscan_cosine(spark.createDataFrame([], schema), "id").count() == 0
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], schema)
    assert hierarchy.hdbscan_cosine(few, "id").select(F.sum("cluster")).first()[0] == -3


def _caterpillar(spark, depth):
    """Clusters each of which parts into a small one and one that parts again."""
    name = lambda i: (1.0 / (i + 1), i, i)
    rows = [(name(0), None, 0.0)]
    for i in range(depth):
        rows += [(name(2 * i + 1), name(2 * i), float(i % 3)), (name(2 * i + 2), name(2 * i), float(i % 5))]
    node = "struct<w:double,lo:long,hi:long>"
    return spark.createDataFrame(rows, f"c {node}, parent {node}, s double")


def test_deep_trees_of_clusters_take_few_jobs(spark, monkeypatch):
    pairs = lambda df: sorted((r["c"]["lo"], r["chosen"]["lo"]) for r in df.collect())
    few = pairs(hierarchy._chosen(_caterpillar(spark, 6)))
    with monkeypatch.context() as m:
        m.setattr(hierarchy, "PART_EDGES", 0)
        assert pairs(hierarchy._chosen(_caterpillar(spark, 6))) == few and few
    spark.sparkContext.setJobGroup("deep", "")
    hierarchy._chosen(_caterpillar(spark, 60)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 10


def test_points_are_held_against_all_only_where_their_nearest_leave_it_open(spark, monkeypatch):
    asked = []
    met = hierarchy._met
    monkeypatch.setattr(hierarchy, "_met", lambda left, *a, **k: asked.append(left.count()) or met(left, *a, **k))
    x = np.random.default_rng(3).normal(size=(200, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, v array<double>")
    tree = {(r["lo"], r["hi"]): r["w"] for r in hierarchy.spanning_tree(df, 6, 5, 1).collect()}
    d = np.round(np.maximum(1 - unit(x) @ unit(x).T, 0), 12)
    core = np.sort(d, axis=1)[:, 4]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    up, want = list(range(200)), {}
    for length, i, j in sorted((w[i, j], i, j) for i in range(200) for j in range(i + 1, 200)):
        if up[i] != up[j]:
            want[i, j] = length
            up = [up[i] if k == up[j] else k for k in up]
    assert set(tree) == set(want) and max(abs(tree[k] - want[k]) for k in want) < 1e-11
    assert asked[0] == 200 and sum(asked) < 500
