"""Merkle manifests of a table: trees of digests, proofs of rows, and their check.

Every row is a leaf; the leaves of a tree have ranks, and a node carries the interval of ranks that it covers. Three nodes in a row have a
parent, so nodes of a level lie in buckets of ranks of one size. Going up, a bucket of some levels is built at once; going down, a bucket's
nodes meet the bucket above that contains their interval, whose nodes on the way to the root are their ancestors. What is left of an
ancestor's interval without the child's are the child's siblings. The roots of the trees are leaves of a last tree.

No step depends on how many leaves a tree has: ranks come from sorted ranges and the counts of each range, and a bucket holds a bounded
number of nodes. All tables on the way are written to the shared folder, so a lost executor costs no rank.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.scratch import written

FAN = 3
#: Levels that one bucket holds, besides that of its leaves: at most 3 ** LEVELS nodes of the lowest.
LEVELS = 3
#: Rows of the counts by tree and range that are broadcast, about 60 bytes each; if they are more, they are joined.
MAX_BROADCAST_RANGES = 200_000


def leaf(*values: Column) -> Column:
    """The digest of a row: SHA-256, in hex, of its values, each with its size in bytes before it, null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def parent(children: Column) -> Column:
    """The digest of a node of the digests of its children, an array."""
    return F.sha2(F.array_join(children, ""), 256)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its proof, the siblings level by level, lead to."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings_digest(steps: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return parent(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


@dataclass
class Manifest:
    """``proofs``: (row, leaf, subroot, root, steps), ``steps`` an array of (left, right), the siblings of each level put together.

    ``nodes``: (tree, level, lo, hi, digest), for the trees of leaves; a tree is named by ``=`` and its value, by ``-`` where that is null.
    """

    proofs: DataFrame
    nodes: DataFrame


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "source", keep: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """A tree for each value of ``tree_col``, its leaves in the order of ``id_col``, over the digests of ``fields``.

    ``row``: the columns of ``keep``, by default ``id_col``, as a struct, so that no name can clash. Null ids come first; rows with one id
    follow their digests, so equal rows are leaves of their own, one beside the other. Null values, also of ``tree_col``, are values of
    their own. A tree of one leaf has that leaf as its root. An empty table has no rows and no root.
    """
    row = F.struct(*(c.alias(k) for k, c in (keep or {id_col: F.col(f"`{id_col}`")}).items()))
    tree = F.col(f"`{tree_col}`").cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), tree), F.lit("-")).alias("tree"), F.col(f"`{id_col}`").alias("key"), leaf(*(F.col(f"`{f}`") for f in fields)).alias("digest"), row.alias("row"))
    # written before the sort, whose sample would hash the texts a second time
    return _forest(written(leaves, "leaves"), levels, _crown(levels))


def _crown(levels: int) -> Callable[[DataFrame], DataFrame]:
    """(tree, above, root): for the root of each tree, its proof in the tree of all roots."""

    def crown(roots: DataFrame) -> DataFrame:
        items = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("apex").alias("digest"), F.struct("tree").alias("row"))
        alone = lambda r: r.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("apex").alias("root"))
        return _forest(items, levels, alone).proofs.select("row.tree", F.col("steps").alias("above"), "root")

    return crown


def _ranked(items: DataFrame) -> DataFrame:
    """(tree, n, lo, digest, row): each item's rank in its tree, and how many the tree has."""
    order = ["tree", F.col("key").asc_nulls_first(), "digest", "came"]
    rows = items.withColumn("came", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("tree", "digest", "row", F.monotonically_increasing_id().alias("at")), "sorted")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    counts = rows.groupBy("tree", "range").agg(F.min("at").alias("begin"), F.count("*").alias("here"))
    all_of = "sum(here) OVER (PARTITION BY tree)"
    counts = written(counts.select("tree", "range", F.expr("sum(here) OVER (PARTITION BY tree ORDER BY range) - here - begin").alias("shift"), F.expr(all_of).alias("n")), "ranges")
    small = counts.count() <= MAX_BROADCAST_RANGES
    return rows.join(F.broadcast(counts) if small else counts, ["tree", "range"]).select("tree", "n", (F.col("at") + F.col("shift")).alias("lo"), "digest", "row")


def _band(items: DataFrame, low: int, levels: int) -> DataFrame:
    """(tree, n, bucket, members, l0, l1, ...): buckets of nodes of level ``low``, and the ``levels`` levels over them as far as their tree goes.

    ``items``: (tree, n, lo, hi, digest, row), the nodes of level ``low``. A level is an array of (lo, hi, digest), in order.
    """
    wide = FAN ** (low + levels)
    found = items.groupBy("tree", "n", F.expr(f"lo DIV {wide}L").alias("bucket")).agg(F.collect_list(F.struct("lo", "hi", "digest", "row")).alias("members"))
    found = found.withColumn("members", F.array_sort("members", lambda a, b: F.signum(a["lo"] - b["lo"]).cast("int")))
    found = found.withColumn("l0", F.transform("members", lambda m: F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), m["digest"].alias("digest"))))
    for k in range(levels):
        found = found.withColumn(f"l{k + 1}", F.when((F.col("n") > FAN ** (low + k)) & (F.size(f"l{k}") > 0), _parents(F.col(f"l{k}"))).otherwise(F.expr(f"slice(l{k}, 1, 0)")))
    return written(found, f"band{low}")


def _parents(nodes: Column) -> Column:
    """The level over the nodes of a level, an array that is not empty."""

    def joined(i: Column) -> Column:
        run = F.slice(nodes, i * FAN + 1, FAN)
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), parent(run["digest"]).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), joined)


def _with_way(found: DataFrame, levels: int) -> DataFrame:
    """``found`` with ``way``: the siblings, at each level of a bucket, of the node that covers (lo, hi): its parent's interval without its own."""

    def around(k: int) -> Column:
        return F.get(F.filter(f"l{k}", lambda v: (v["lo"] <= F.col("lo")) & (F.col("hi") <= v["hi"])), F.lit(0))

    def within(k: int, lo: str, hi: str) -> Column:
        return F.array_join(F.filter(f"l{k}", lambda v: (v["lo"] >= F.col(lo)) & (v["hi"] <= F.col(hi)))["digest"], "")

    def step(k: int) -> Column:
        left, right = within(k, f"a{k + 1}.lo", f"a{k}.lo"), within(k, f"a{k}.hi", f"a{k + 1}.hi")
        return F.when(F.col(f"a{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right")))

    found = found.withColumns({f"a{k}": around(k) for k in range(levels + 1)})
    return found.withColumn("way", F.filter(F.array(*map(step, range(levels))), lambda s: s.isNotNull()))


def _forest(items: DataFrame, levels: int, crown: Callable[[DataFrame], DataFrame]) -> Manifest:
    """The trees over ``items`` (tree, key, digest, row); ``crown`` goes on from their roots (tree, apex)."""
    ranked = _ranked(items)
    most = ranked.agg(F.max("n")).first()[0] or 0
    nodes, bands = ranked.withColumn("hi", F.col("lo") + 1), []
    while True:
        low = len(bands) * levels
        band = _band(nodes, low, levels)
        bands.append(band)
        if most <= FAN ** (low + levels):
            break
        top = F.col(f"l{levels}")[0]
        nodes = band.where(F.col("n") > FAN ** (low + levels)).select("tree", "n", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), F.lit(None).cast("int").alias("row"))
    ends = lambda t: F.col("n") <= FAN ** ((t + 1) * levels)
    apex = F.coalesce(*(F.get(f"l{k}", F.lit(0))["digest"] for k in reversed(range(levels + 1))))
    roots = [b.where(ends(t)).select("tree", apex.alias("apex")) for t, b in enumerate(bands)]
    crowned = crown(_union(roots))
    above = None
    for t in reversed(range(len(bands))):
        whole = bands[t].withColumns({"lo": F.col("l0")[0]["lo"], "hi": F.element_at("l0", -1)["hi"]})
        # a tree has one bucket in the band where it ends: its root's proof joins there, one row a tree
        ended = whole.where(ends(t)).withColumn("apex", apex).join(crowned, "tree")
        if above is not None:
            names = ["above", "root", "apex", *(f"l{k}" for k in range(levels + 1))]
            up = above.select("tree", F.col("bucket").alias("over"), F.col("lo").alias("over_lo"), F.col("hi").alias("over_hi"), *(F.col(c).alias(f"over_{c}") for c in names))
            met = whole.where(~ends(t)).withColumn("over", F.expr(f"bucket DIV {FAN**levels}L")).join(up, ["tree", "over"]).where("over_lo <= lo AND hi <= over_hi")
            inner = met.select("lo", "hi", *(F.col(f"over_{c}").alias(c) for c in names), F.struct(*(F.col(c) for c in bands[t].columns)).alias("own"))
            inner = _with_way(inner, levels).select("own", "lo", "hi", "apex", F.concat("way", "above").alias("above"), "root").select("own.*", "lo", "hi", "apex", "above", "root")
            ended = ended.select(*inner.columns).unionAll(inner)
        above = ended
    out = above.drop("lo", "hi").select("*", F.explode("members").alias("m")).withColumns({"lo": F.col("m.lo"), "hi": F.col("m.hi")})
    proofs = _with_way(out, levels).select("m.row", F.col("m.digest").alias("leaf"), F.col("apex").alias("subroot"), "root", F.concat("way", "above").alias("steps"))
    listed = [b.select("tree", F.explode(f"l{k}").alias("v"), F.lit(t * levels + k).alias("level")) for t, b in enumerate(bands) for k in range(levels + (b is bands[-1]))]
    return Manifest(proofs, _union(listed).select("tree", "level", "v.lo", "v.hi", "v.digest"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out
