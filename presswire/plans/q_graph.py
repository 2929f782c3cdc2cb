"""Queries of graphs, vectors and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.operators import graph as g
from presswire.operators import textindex as ti
from presswire.operators import vectors as v
from presswire.operators.hierarchy import hdbscan_cosine
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.q_aggregates import EDGES, user_edges
from presswire.plans.q_ranking import _COPIED_SQL, copied
from presswire.plans.registry import Registry
from presswire.sources.scratch import written

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"


def _edges(spark, sf_dir, least=4, among=None):
    return user_edges(spark, sf_dir, least, among)


_E = f"e AS (SELECT * FROM ({EDGES}) WHERE weight >= 4), w AS (SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e)"


@R.add(f"WITH RECURSIVE {_E}, h AS (SELECT 3::BIGINT AS node, 0 AS hops UNION SELECT other, hops + 1 FROM h JOIN w USING (node) WHERE hops < 2) SELECT node, min(hops) AS hops FROM h GROUP BY node")
def g2_k_hop(spark, sf_dir):
    seeds = x.table(spark, sf_dir, "events").where("user_id = 3").select(c("user_id").alias("node"))
    return g.k_hop(_edges(spark, sf_dir), seeds, 2)


@R.add(
    f"""WITH {_E.replace('>= 4', '>= 5')}, a AS (SELECT node AS s, max(other) AS t FROM w WHERE node % 20 = 0 GROUP BY node), p1 AS (SELECT s AS src, t AS dst, other AS node, [s, other] AS path, weight AS total FROM a JOIN w ON node = s),
p2 AS (SELECT src, dst, w.other AS node, list_append(path, w.other) AS path, total + weight AS total FROM p1 JOIN w ON p1.node = w.node WHERE p1.node <> dst AND NOT list_contains(path, w.other)),
p3 AS (SELECT src, dst, w.other AS node, list_append(path, w.other) AS path, total + weight AS total FROM p2 JOIN w ON p2.node = w.node WHERE p2.node <> dst AND NOT list_contains(path, w.other)),
f AS (SELECT * FROM p1 WHERE node = dst UNION ALL SELECT * FROM p2 WHERE node = dst UNION ALL SELECT * FROM p3 WHERE node = dst),
s AS (SELECT src, dst, array_to_string(path, ',') AS path, len(path) AS n, round(least(1.0, total / 100 / (len(path) - 1) / (1 + 0.1 * len(path))), 9) AS score FROM f)
SELECT src, dst, path, round(s.score, 6) AS score, row_number() OVER (PARTITION BY src, dst ORDER BY s.score DESC, n, path) AS rank FROM s QUALIFY rank <= 10"""
)
def g3_find_paths(spark, sf_dir):
    e = written(_edges(spark, sf_dir, 5), "edges").withColumn("weight", c("weight") / 100)
    pairs = g.both_ways(e).where("node % 20 = 0").groupBy(c("node").alias("src")).agg(F.max("other").alias("dst"))
    return g.find_paths(e, pairs, 3, kept=True).select("src", "dst", F.array_join("path", ",").alias("path"), F.round("score", 6).alias("score"), "rank")


@R.add(f"WITH {_E} SELECT a, b, weight FROM e WHERE a % 3 = 0 AND b % 3 = 0")
def g4_induced_subgraph(spark, sf_dir):
    ids = x.table(spark, sf_dir, "events").select(c("user_id").alias("node")).where("node % 3 = 0")
    return g.induced_subgraph(_edges(spark, sf_dir, among="user_id % 3 = 0"), ids)


@R.add()
def g5_communities(spark, sf_dir):
    return g.communities(_edges(spark, sf_dir), once=True)


@R.add(
    f"""WITH {_E}, d AS (SELECT node, count(DISTINCT other) AS degree FROM w GROUP BY node ORDER BY degree DESC, node LIMIT 20)
SELECT x.node AS a, y.node AS b, x.degree + y.degree AS score FROM d x JOIN d y ON x.node < y.node AND x.node % 5 <> y.node % 5 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = x.node AND e.b = y.node) ORDER BY score DESC, a, b LIMIT 5"""
)
def j14_structural_gaps(spark, sf_dir):
    e = written(_edges(spark, sf_dir), "edges")
    return g.structural_gaps(e, e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", c("node") % 5), once=True)


_M = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS entity FROM documents"


def _mentions(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))).alias("entity")).distinct()


@R.add(f"SELECT entity, count(*) AS docs, min(doc_id) AS first_doc FROM ({_M}) GROUP BY entity ORDER BY docs DESC, entity LIMIT 200")
def x22_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).orderBy(c("docs").desc(), "entity").limit(200)


@R.add(
    f"""WITH m AS ({_M}), f AS (SELECT DISTINCT doc_id FROM m ORDER BY 1 LIMIT 20), n AS (SELECT entity FROM m GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 180), k AS (SELECT * FROM m WHERE entity IN (SELECT entity FROM n)),
e AS (SELECT x.entity AS a, y.entity AS b, 'shared' AS kind, count(*) AS docs, least(1.0, count(*) / 5)::DOUBLE AS weight FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.entity < y.entity GROUP BY 1, 2
 UNION ALL SELECT entity, 'doc:' || doc_id, 'mention', 1, 0.8 FROM (SELECT * FROM k WHERE doc_id IN (SELECT doc_id FROM f) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY doc_id) <= 3))
SELECT * FROM e ORDER BY weight DESC, docs DESC, a, b LIMIT 500"""
)
def g1_build_graph(spark, sf_dir):
    return g.build_graph(_mentions(spark, sf_dir))[1]


@R.add(
    """WITH RECURSIVE d AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda v: v <> ''))) AS s FROM documents), k AS (SELECT s, min(id) AS rep FROM d WHERE len(s) > 0 GROUP BY s),
w AS (SELECT rep AS id, len(s) AS n, unnest(s) AS word FROM k), p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS i FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT rep, id FROM d JOIN k USING (s) WHERE id <> rep
 UNION ALL SELECT min(article_id) OVER (PARTITION BY site, path, title), article_id FROM (""" + _COPIED_SQL + """)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS o FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a) SELECT id, min(o) AS "group" FROM r GROUP BY id""",
    "articles",
)
def d3_duplicate_groups(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    pairs = ti.near_dup_pairs(d, "doc_id", "text").select("a", "b").unionAll(ti.url_title_pairs(copied(spark, sf_dir)))
    return g.duplicate_groups(pairs, d.select(c("doc_id").alias("id")))


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@R.add(
    "SELECT q.vec_id AS query, e.vec_id AS id, round(" + _COS.format(a="q.embedding::DOUBLE[]", b="e.embedding::DOUBLE[]") + ", 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(" + _COS.format(a="q.embedding::DOUBLE[]", b="e.embedding::DOUBLE[]") + ", 9) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10"
)
def v1_vector_topk(spark, sf_dir):
    e = x.table(spark, sf_dir, "embeddings")
    return v.vector_topk(e, e.where("vec_id % 20 = 0"), "vec_id", "vec_id").withColumn("similarity", F.round("similarity", 6))


@R.add()
def v2_ann_search(spark, sf_dir):
    e = x.table(spark, sf_dir, "embeddings")
    index, model = v.ann_build(e, "vec_id")
    return v.ann_search(index, model, e.where("vec_id % 20 = 0"), "vec_id")


@R.add()
def v2_ann_recall(spark, sf_dir):
    """How much of the exact search the index finds, and the share of the items that a query is compared with."""
    e = x.table(spark, sf_dir, "embeddings")
    found = v.recall(v2_ann_search(spark, sf_dir), v1_vector_topk(spark, sf_dir))
    return found.crossJoin(e.agg(F.round(F.lit(50) / F.count("*"), 4).alias("compared_share")))


_BYTES = "list_transform(range(0, {dim}), lambda i: ((strpos('0123456789abcdef', sha256({text})[(i % 32) * 2 + 1]) - 1) * 16 + strpos('0123456789abcdef', sha256({text})[(i % 32) * 2 + 2]) - 1)::DOUBLE)"


@R.add(
    f"WITH v AS (SELECT chunk_id, embedding, {_BYTES.format(dim=64, text='chunk_text')} AS b FROM chunks), u AS (SELECT chunk_id, coalesce(embedding::DOUBLE[], list_transform(b, lambda y: (y / sqrt(list_dot_product(b, b)))::FLOAT::DOUBLE)) AS e FROM v) SELECT chunk_id, len(e)::INT AS dims, round(list_sum(e), 3) AS total, list_transform(e, lambda y: round(y, 4) + 0.0) AS embedding FROM u",
    "chunks",
)
def v3_embed_chunks(spark, sf_dir):
    k = v.embed_chunks(x.chunks(spark, sf_dir).select("chunk_id", "chunk_text", "embedding"), "chunk_text").withColumn("embedding", c("embedding").cast("array<double>"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y)
    return k.select("chunk_id", F.size("embedding").alias("dims"), F.round(total, 3).alias("total"), F.transform("embedding", lambda y: F.round(y, 4)).alias("embedding"))


@R.add(
    f"WITH m AS (SELECT memory_id, user_id, type, embedding::DOUBLE[] AS v FROM memory WHERE deleted_at IS NULL AND created_at + to_days(ttl_days) > {TS} AND embedding IS NOT NULL), q AS (SELECT vec_id AS query, CASE WHEN vec_id % 40 = 0 THEN 'src' || (vec_id / 40)::INT % 5 END AS user_id, CASE WHEN vec_id % 60 = 0 THEN 'semantic' END AS type, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, memory_id AS id, round("
    + _COS.format(a="q.v", b="m.v")
    + ", 9) AS similarity FROM q, m WHERE (q.user_id IS NULL OR q.user_id = m.user_id) AND (q.type IS NULL OR q.type = m.type)) SELECT query, id, round(s.similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s.similarity DESC, id) AS rank FROM s WHERE s.similarity >= 0.5 QUALIFY rank <= 5",
    "memory",
)
def v4_recall_memory(spark, sf_dir):
    return v.recall_memory(x.memory(spark, sf_dir), _memory_queries(spark, sf_dir), x.as_of()).withColumn("similarity", F.round("similarity", 6))


def _memory_queries(spark, sf_dir):
    """Every other query is of one user, every third asks for one type."""
    user, kind = F.when(c("vec_id") % 40 == 0, F.concat(F.lit("src"), (c("vec_id") / 40).cast("int") % 5)), F.when(c("vec_id") % 60 == 0, "semantic")
    return x.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), user.alias("user_id"), kind.alias("type"), "embedding")


@R.add()
def v4_memory_access(spark, sf_dir):
    """Memories with how often they were recalled, from the log that recalling leaves."""
    m = x.memory(spark, sf_dir).withColumn("access_count", c("memory_id") % 3)
    log = v.access_log(v.recall_memory(m, _memory_queries(spark, sf_dir), x.as_of()), x.as_of())
    return v.counted_access(m, log).select("memory_id", "access_count", "last_accessed_at")


@R.add()
def v5_hybrid_search(spark, sf_dir):
    from presswire.operators.ranking import rrf_fuse

    k = x.chunks(spark, sf_dir)
    q = x.queries(spark, sf_dir)
    # ranked search reads no positions
    index = written(ti.build_text_index(k, "chunk_id", "chunk_text", "language").drop("positions"), "index")
    text = ti.search_text(index, q, 20).select("query_id", c("id").alias("article_id"), "rank")
    vectors = q.join(x.table(spark, sf_dir, "embeddings"), c("query_id") == c("vec_id")).select("query_id", "embedding")
    near = v.vector_topk(k.select("chunk_id", "embedding"), vectors, "chunk_id", "query_id", 20).select(c("query").alias("query_id"), c("id").alias("article_id"), "rank")
    return rrf_fuse(text, near).withColumnRenamed("article_id", "chunk_id")


@R.add()
def k1_dbscan_cosine(spark, sf_dir):
    return v.dbscan_cosine(x.table(spark, sf_dir, "embeddings"), "vec_id")


@R.add()
def k1_hdbscan_cosine(spark, sf_dir):
    return hdbscan_cosine(x.table(spark, sf_dir, "embeddings"), "vec_id")


@R.add(f"SELECT doc_id, list_transform(b, lambda y: round((y / sqrt(list_dot_product(b, b)))::FLOAT::DOUBLE, 4)) AS embedding FROM (SELECT doc_id, {_BYTES.format(dim=32, text='text')} AS b FROM documents)")
def x35_hash_embedding(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("array<float>").alias("embedding"))
    return v.embed_chunks(d, "text", 32).select("doc_id", F.transform(c("embedding").cast("array<double>"), lambda e: F.round(e, 4)).alias("embedding"))
