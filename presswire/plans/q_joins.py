"""Queries of sinks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.functions.text import relation_type
from presswire.operators import joins as j
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.registry import Registry
from presswire.sources.scratch import new_path, written
from presswire.sources import tables as s

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"


@R.add("SELECT page_id, url, length(html)::INT AS chars FROM pages")
def s2_read_pages(spark, sf_dir):
    return x.table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("chars"))


@R.add("SELECT text_hash, min(article_id) AS article_id FROM raw WHERE text_hash NOT IN (SELECT text_hash FROM raw WHERE article_id % 4 = 0) GROUP BY text_hash", "raw")
def s4_insert_ignore(spark, sf_dir):
    r = x.raw(spark, sf_dir).select("text_hash", "article_id")
    return s.insert_ignore(r.where("article_id % 4 = 0"), r.where("article_id % 4 <> 0"), "text_hash", [c("article_id")])


@R.add("WITH t AS (SELECT DISTINCT text_hash FROM raw WHERE article_id % 4 = 0), b AS (SELECT text_hash, count(*) AS n FROM raw WHERE article_id % 4 <> 0 GROUP BY 1) SELECT count(*) FILTER (text_hash NOT IN (SELECT text_hash FROM t)) AS inserted, (sum(n) - count(*) FILTER (text_hash NOT IN (SELECT text_hash FROM t)))::BIGINT AS conflicted FROM b", "raw")
def s4_insert_counts(spark, sf_dir):
    r = x.raw(spark, sf_dir).select("text_hash", "article_id")
    return s.insert_counts(r.where("article_id % 4 = 0"), r.where("article_id % 4 <> 0"), "text_hash")


_IDX = "SELECT url_hash, max(article_id) AS article_id, max(processing_version) AS processing_version, max(ready_for_chunking::INT) = 1 AS ready_for_chunking FROM articles_index WHERE {} GROUP BY url_hash"


@R.add(
    f"SELECT coalesce(b.url_hash, t.url_hash) AS url_hash, coalesce(b.article_id, t.article_id) AS article_id, greatest(t.processing_version, b.processing_version) AS processing_version, coalesce(t.ready_for_chunking OR b.ready_for_chunking, t.ready_for_chunking, b.ready_for_chunking) AS ready_for_chunking FROM ({_IDX.format('article_id % 3 <> 1')}) t FULL JOIN ({_IDX.format('article_id % 3 <> 2')}) b ON t.url_hash = b.url_hash",
    "articles_index",
)
def s5_upsert_index(spark, sf_dir):
    i = x.articles_index(spark, sf_dir)
    part = lambda rest: i.where(c("article_id") % 3 != rest).groupBy("url_hash").agg(F.max("article_id").alias("article_id"), F.max("processing_version").alias("processing_version"), F.max("ready_for_chunking").alias("ready_for_chunking"))
    return s.upsert_index(part(1), part(2), "url_hash")


@R.add("SELECT chunk_id, article_id, CASE WHEN chunk_id % 3 = 0 THEN chunk_text || '!' ELSE chunk_text END AS chunk_text FROM chunks WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0", "chunks")
def s6_upsert_chunks(spark, sf_dir):
    k = x.chunks(spark, sf_dir).select("chunk_id", "article_id", "chunk_text")
    return s.upsert_rows(k.where("chunk_id % 2 = 0"), k.where("chunk_id % 3 = 0").withColumn("chunk_text", F.concat("chunk_text", F.lit("!"))), ["chunk_id"])


@R.add("SELECT chunk_id, article_id, CASE WHEN chunk_id % 3 = 0 THEN chunk_text || '!' ELSE chunk_text END AS chunk_text FROM chunks WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0", "chunks")
def s6_upsert_bucketed(spark, sf_dir):
    """As ``s6_upsert_chunks``, on a table in buckets by article."""
    k, path = x.chunks(spark, sf_dir).select("chunk_id", "article_id", "chunk_text"), new_path(spark, "bucketed")
    s.write_bucketed(k.where("chunk_id % 2 = 0"), path, ["article_id"])
    batch = k.where("chunk_id % 3 = 0").withColumn("chunk_text", F.concat("chunk_text", F.lit("!")))
    s.upsert_bucketed(batch, path, ["article_id"], lambda old, new: s.upsert_rows(old, new, ["chunk_id"]), k.schema)
    return s.read_bucketed(spark, path, k.schema).drop("bucket")


@R.add("SELECT article_id, CASE WHEN article_id % 10 = 0 THEN 'stored' ELSE status END AS status, CASE WHEN article_id % 20 = 0 THEN 'xx' ELSE language END AS language FROM raw", "raw")
def s7_apply_patches(spark, sf_dir):
    r = x.raw(spark, sf_dir).select("article_id", "status", "language")
    patch = r.where("article_id % 10 = 0").select("article_id", F.lit("stored").alias("status"), F.when(c("article_id") % 20 == 0, "xx").alias("language"))
    return s.apply_patches(r, patch, "article_id")


@R.add("SELECT url, article_id, coalesce(published_at, created_at) AS published_at FROM articles WHERE url NOT IN (SELECT url FROM articles WHERE article_id % 2 = 0)", "articles")
def s8_sync_new(spark, sf_dir):
    a = x.articles(spark, sf_dir)
    return s.sync_new(a, a.where("article_id % 2 = 0")).select("url", "article_id", "published_at")


@R.add("SELECT count(DISTINCT url) FILTER (status = 'stored') AS processed, count(DISTINCT url) FILTER (article_id % 4 = 0) AS copied, count(DISTINCT url) FILTER (status = 'stored') - count(DISTINCT url) FILTER (article_id % 4 = 0) AS gap FROM raw", "raw")
def s8_sync_gap(spark, sf_dir):
    r = x.raw(spark, sf_dir)
    return s.sync_gap(r.where("status = 'stored'"), r.where("article_id % 4 = 0"))


@R.add(
    """WITH s AS (SELECT language, source_domain, count(*) AS n FROM articles GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, source_domain) <= 5),
t AS (SELECT language, to_json(list(source_domain ORDER BY n DESC, source_domain))::VARCHAR AS top_domains FROM s GROUP BY 1), d AS (SELECT language, published_at::DATE AS day, count(*) AS n FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2),
l AS (SELECT language, '{' || string_agg('"' || day || '":' || n, ',' ORDER BY day) || '}' AS timeline FROM d GROUP BY 1)
SELECT language, articles, top_domains, timeline FROM (SELECT language, count(*) AS articles FROM articles GROUP BY 1) LEFT JOIN t USING (language) LEFT JOIN l USING (language)""",
    "articles",
)
def s9_reports(spark, sf_dir):
    return s.reports(x.articles(spark, sf_dir), "language")


@R.add("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 64 END::INT AS dims FROM embeddings")
def s10_migrate_embeddings(spark, sf_dir):
    e = x.table(spark, sf_dir, "embeddings")
    text = e.select("vec_id", F.to_json(F.when(c("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(c("embedding"))).alias("json"))
    return s.migrate_embeddings(text, "json", (64,)).select("vec_id", F.when(c("vector").isNotNull(), F.size("vector")).alias("dims"))


_TOPIC = "SELECT source AS topic_id, count(*) AS total_articles, (count(*) % 10 / 10)::DOUBLE AS freshness, max(created_at) AS updated_at FROM articles WHERE {} GROUP BY source"


@R.add(
    f"SELECT coalesce(t.topic_id, n.topic_id) AS topic_id, coalesce(n.total_articles, t.total_articles) AS total_articles, coalesce(t.freshness, n.freshness) AS freshness, CASE WHEN t.topic_id IS NOT NULL THEN 'established' WHEN n.freshness > 0.7 THEN 'emerging' ELSE 'established' END AS trend_status, coalesce(n.updated_at, t.updated_at) AS updated_at FROM ({_TOPIC.format('article_id % 2 = 0')}) t FULL JOIN ({_TOPIC.format('article_id % 2 = 1')}) n ON t.topic_id = n.topic_id",
    "articles",
)
def s11_store_trends(spark, sf_dir):
    a = x.articles(spark, sf_dir)
    part = lambda k: a.where(f"article_id % 2 = {k}").groupBy(c("source").alias("topic_id")).agg(F.count("*").alias("total_articles"), (F.count("*") % 10 / 10).alias("freshness"), F.max("created_at").alias("updated_at"))
    return s.store_trends(part(0).withColumn("trend_status", F.lit("established")), part(1))


@R.add(f"SELECT chunk_id, c.article_id, source, status FROM chunks c JOIN raw r USING (article_id) WHERE embedding IS NOT NULL AND r.published_at >= {TS} - to_hours(240) AND r.language = 'en'", "chunks", "raw")
def j1_chunks_with_article(spark, sf_dir):
    return j.chunks_with_article(x.chunks(spark, sf_dir), x.raw(spark, sf_dir), x.as_of(), 240, "en").select("chunk_id", "article_id", "source", "status")


@R.add("SELECT article_id, min(chunk_id) AS chunk_id FROM chunks WHERE embedding IS NOT NULL GROUP BY article_id", "chunks")
def j2_first_chunk_per_article(spark, sf_dir):
    return j.first_chunk_per_article(x.chunks(spark, sf_dir)).select("article_id", "chunk_id")


@R.add("SELECT a.article_id, m.i AS seen_id FROM raw a LEFT JOIN (SELECT text_hash, min(article_id) AS i FROM raw WHERE article_id % 3 = 0 GROUP BY 1) m USING (text_hash) WHERE a.article_id % 3 > 0", "raw")
def j3_text_seen(spark, sf_dir):
    r = x.raw(spark, sf_dir)
    return j.seen(r.where("article_id % 3 > 0").select("article_id", "text_hash"), r.where("article_id % 3 = 0"), "text_hash", "article_id").select("article_id", "seen_id")


_PROFILE = "SELECT domain AS source_domain, sum((interaction_type = 'click')::INT) AS clicks, sum((interaction_type = 'impression')::INT) AS impressions, 0.9::DOUBLE AS source_score, 'trusted' AS level FROM interactions WHERE domain <> 'src4.example.com' GROUP BY domain"


@R.add(f"SELECT article_id, coalesce(source_score, 0.5) AS source_score, coalesce(level, 'standard') AS level, coalesce(clicks, 0)::BIGINT AS clicks FROM articles LEFT JOIN ({_PROFILE}) p USING (source_domain)", "articles", "interactions")
def j4_with_domain_profile(spark, sf_dir):
    i = x.interactions(spark, sf_dir).where("domain <> 'src4.example.com'")
    p = i.groupBy(c("domain").alias("source_domain")).agg(F.count_if(c("interaction_type") == "click").alias("clicks"), F.count_if(c("interaction_type") == "impression").alias("impressions")).withColumns({"source_score": F.lit(0.9), "level": F.lit("trusted")})
    return j.with_domain_profile(x.articles(spark, sf_dir), p).select("article_id", "source_score", "level", "clicks")


@R.add("SELECT article_id, (CASE WHEN article_id % 3 = 0 THEN least(1, greatest(0, article_id % 7 / 5.0)) ELSE 0.5 END)::DOUBLE AS score FROM articles", "articles")
def j5_source_score(spark, sf_dir):
    return x.articles(spark, sf_dir).select("article_id", j.source_score(c("source_domain"), F.when(c("article_id") % 3 == 0, c("article_id") % 7 / 5)).alias("score"))


@R.add(
    f"SELECT metric, user_id, hours, (SELECT arg_max(m.value, (m.ts, m.event_id)) FROM metrics m WHERE m.metric = r.metric AND m.user_id = r.user_id AND m.ts <= r.at AND m.ts >= r.at - to_hours(r.hours)) AS value FROM (SELECT DISTINCT metric, user_id, (24 + user_id % 5 * 24)::INT AS hours, {TS} - to_hours(user_id % 400) AS at FROM metrics) r",
    "metrics",
)
def j6_latest_metric_as_of(spark, sf_dir):
    m = x.metrics(spark, sf_dir)
    rules = m.select("metric", "user_id").distinct().withColumns({"hours": (24 + c("user_id") % 5 * 24).cast("int"), "at": x.hours_ago(c("user_id") % 400)})
    return j.latest_metric_as_of(rules, m).select("metric", "user_id", "hours", "value")


@R.add(
    """WITH o AS (SELECT article_id, url FROM articles WHERE article_id % 2 = 0), n AS (SELECT article_id, url FROM articles WHERE article_id % 2 = 1 AND article_id NOT IN (SELECT article_id FROM o) AND url NOT IN (SELECT url FROM o) QUALIFY row_number() OVER (PARTITION BY url ORDER BY article_id) = 1)
SELECT * FROM o UNION ALL SELECT * FROM n""",
    "articles",
)
def j7_merge_docs(spark, sf_dir):
    a = x.articles(spark, sf_dir).select("article_id", "url", c("article_id").alias("pos"))
    return j.merge_docs(a.where("article_id % 2 = 0"), a.where("article_id % 2 = 1")).select("article_id", "url")


_MENTIONS = "SELECT doc_id, lower(text) AS text, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS entity FROM documents"


@R.add(
    f"WITH e AS ({_MENTIONS}), p AS (SELECT a.entity AS a, b.entity AS b, a.text FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.entity < b.entity) SELECT a, b, count(*) AS docs, least(1.0, count(*) / 5)::DOUBLE AS weight, min(CASE WHEN regexp_matches(text, 'invest|fund|acqui') THEN 'influences' WHEN regexp_matches(text, 'partner|collaborat') THEN 'relates_to' WHEN regexp_matches(text, 'mention|discuss|said') THEN 'mentions' ELSE 'relates_to' END) AS relation FROM p GROUP BY a, b"
)
def j8_entity_cooccurrence(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))
    # what a text says is worked out before its names become rows, and once for each text
    texts = written(d.select("doc_id", relation_type(F.lower("text")).alias("relation"), found.alias("entities")), "mentions")
    return j.entity_cooccurrence(texts.select("doc_id", "relation", F.explode("entities").alias("entity")))


@R.add(
    """WITH t AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 2)) AS s, w FROM t),
p AS (SELECT least(w[s + i], w[s + k]) AS a, greatest(w[s + i], w[s + k]) AS b FROM g, (VALUES (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) v(i, k) WHERE w[s + i] <> w[s + k])
SELECT a, b, count(*)::BIGINT AS weight FROM p GROUP BY a, b HAVING count(*) >= 2"""
)
def j9_word_cooccurrence(spark, sf_dir):
    d = x.table(spark, sf_dir, "documents")
    return j.word_cooccurrence(d.select(F.split(F.lower("text"), " ").alias("words"))).select("a", "b", c("weight").cast("long").alias("weight"))


_TERMS = "SELECT DISTINCT source_domain AS domain, unnest(regexp_extract_all(lower(title_norm), '[a-z]{5,}')) AS term FROM articles"


@R.add(
    f"WITH t AS ({_TERMS}), n AS (SELECT domain, count(*) AS n FROM t GROUP BY 1), s AS (SELECT a.domain AS a, b.domain AS b, count(*) AS shared FROM t a JOIN t b ON a.term = b.term AND a.domain < b.domain GROUP BY 1, 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.domain = a JOIN n y ON y.domain = b",
    "articles",
)
def j10_domain_overlap(spark, sf_dir):
    a = x.articles(spark, sf_dir)
    t = a.select(c("source_domain").alias("domain"), F.explode(F.regexp_extract_all(F.lower("title_norm"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))
    return j.domain_overlap(t).withColumn("jaccard", F.round("jaccard", 6))


_EVENTS = "SELECT source || '-' || language AS topic, min(article_id) AS event_id, min(published_at)::DATE AS \"start\", (min(published_at)::DATE + (min(article_id) % 4)::INT) AS \"end\" FROM articles WHERE published_at IS NOT NULL GROUP BY source, language, article_id % 6"


def topic_events(spark, sf_dir):
    a = x.articles(spark, sf_dir).where("published_at IS NOT NULL")
    g = a.groupBy(F.concat_ws("-", "source", "language").alias("topic"), (c("article_id") % 6).alias("k")).agg(F.min("article_id").alias("event_id"), F.to_date(F.min("published_at")).alias("start"))
    return g.withColumn("end", F.date_add("start", (c("event_id") % 4).cast("int"))).drop("k")


@R.add(f"""WITH e AS ({_EVENTS}) SELECT topic, event_id, prior_id, CASE WHEN "start" > prior_end THEN 'after' ELSE 'overlap' END AS relation FROM (SELECT *, lag(event_id) OVER w AS prior_id, lag("end") OVER w AS prior_end FROM e WINDOW w AS (PARTITION BY topic ORDER BY "start", event_id)) WHERE prior_id IS NOT NULL""", "articles")
def j11_event_timeline(spark, sf_dir):
    return j.event_timeline(topic_events(spark, sf_dir)).select("topic", "event_id", "prior_id", "relation")


@R.add(f"""WITH e AS ({_EVENTS}) SELECT a.topic, a.event_id AS cause, b.event_id AS effect, 0.4::DOUBLE AS confidence FROM e a JOIN e b ON a.topic = b.topic AND a.event_id <> b.event_id AND b."start" - a."end" BETWEEN 0 AND 7""", "articles")
def j12_causal_candidates(spark, sf_dir):
    return j.causal_candidates(topic_events(spark, sf_dir))


@R.add(
    f"""WITH e AS ({_EVENTS}), l AS (SELECT a.event_id AS cause, b.event_id AS effect FROM e a JOIN e b ON a.topic = b.topic AND a.event_id <> b.event_id AND b."start" - a."end" BETWEEN 0 AND 7),
m AS (SELECT event_id, article_id AS doc_id FROM articles JOIN e ON topic = source || '-' || language AND article_id % 6 = event_id % 6 WHERE published_at IS NOT NULL),
d AS (SELECT DISTINCT cause, effect, doc_id FROM l JOIN m ON event_id IN (cause, effect))
SELECT cause, effect, doc_id, row_number() OVER (PARTITION BY cause, effect ORDER BY doc_id) AS n FROM d QUALIFY n <= 3""",
    "articles",
)
def j13_causal_evidence(spark, sf_dir):
    e, a = topic_events(spark, sf_dir), x.articles(spark, sf_dir).where("published_at IS NOT NULL")
    members = a.withColumn("topic", F.concat_ws("-", "source", "language")).join(e.select("topic", "event_id"), "topic").where("article_id % 6 = event_id % 6").select("event_id", c("article_id").alias("doc_id"))
    return j.causal_evidence(j.causal_candidates(e), members)


@R.add(
    """WITH t AS (SELECT topic || ts AS topic, sentiment - 0.5 AS sentiment, CASE WHEN momentum > 3 THEN 'up' WHEN momentum < 2.6 THEN 'down' ELSE 'flat' END AS direction FROM snapshots),
k AS (SELECT *, CASE WHEN sentiment < -0.2 AND direction = 'up' THEN 'negative_rising' WHEN sentiment > 0.2 AND direction = 'down' THEN 'positive_falling' END AS kind FROM t)
SELECT kind, round(sentiment, 6) AS sentiment, direction FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY abs(sentiment) DESC, topic) <= 3""",
    "snapshots",
)
def j15_topic_conflicts(spark, sf_dir):
    t = x.snapshots(spark, sf_dir).select(F.concat("topic", c("ts").cast("string")).alias("topic"), (c("sentiment") - 0.5).alias("sentiment"), F.when(c("momentum") > 3, "up").when(c("momentum") < 2.6, "down").otherwise("flat").alias("direction"))
    return j.topic_conflicts(t).select("kind", F.round("sentiment", 6).alias("sentiment"), "direction")


@R.add(
    f"""WITH t AS (SELECT DISTINCT article_id, language, source_domain, published_at, unnest(string_split(lower(title_norm), ' ')) AS term FROM articles),
s AS (SELECT query_id AS sub_id, string_split(lower(query), ' ')[1] AS term, CASE WHEN query_id % 2 = 0 THEN 'en' END AS language_filter, CASE WHEN query_id % 3 = 0 THEN 'src0.example.com' END AS excluded_domain,
  CASE WHEN query_id % 7 = 1 THEN 'src1.example.com' END AS required_domain, CASE WHEN query_id % 4 = 0 THEN {TS} - to_hours(480) END AS since, 1 + query_id % 5 AS min_results FROM queries)
SELECT sub_id, min_results, count(DISTINCT article_id) AS matches, max(published_at) AS newest FROM t JOIN s USING (term) WHERE (language_filter IS NULL OR language = language_filter) AND source_domain IS DISTINCT FROM excluded_domain
  AND (required_domain IS NULL OR source_domain = required_domain) AND (since IS NULL OR published_at >= since) GROUP BY sub_id, min_results HAVING matches >= min_results""",
    "articles",
    "queries",
)
def j16_match_subscriptions(spark, sf_dir):
    t = x.articles(spark, sf_dir).select("article_id", "language", "source_domain", "published_at", F.explode(F.split(F.lower("title_norm"), " ")).alias("term")).distinct()
    q = x.queries(spark, sf_dir)
    limits = F.when(c("query_id") % 3 == 0, "src0.example.com").alias("excluded_domain"), F.when(c("query_id") % 7 == 1, "src1.example.com").alias("required_domain"), F.when(c("query_id") % 4 == 0, x.hours_ago(F.lit(480))).alias("since")
    subs = q.select(c("query_id").alias("sub_id"), F.split(F.lower("query"), " ")[0].alias("term"), F.when(c("query_id") % 2 == 0, "en").alias("language_filter"), *limits, (1 + c("query_id") % 5).alias("min_results"))
    return j.match_subscriptions(t, subs)
