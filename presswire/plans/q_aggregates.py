"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.functions import text as t
from presswire.operators import aggregates as a
from presswire.operators.graph import together
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.registry import Registry

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"
POSITIVE, NEGATIVE = ["the", "ou", "el"], ["and", "que", "der"]


def _r(df, *names):
    """Doubles to six places, for comparison."""
    return df.withColumns({n: F.round(n, 6) for n in names})


@R.add(f"SELECT status, count(*) AS n, count(*) FILTER (created_at >= {TS} - to_days(1)) AS last_day FROM raw GROUP BY status", "raw")
def a1_pipeline_stats(spark, sf_dir):
    return a.pipeline_stats(x.raw(spark, sf_dir), x.as_of())


@R.add(
    f"SELECT * FROM (SELECT source, count(*) AS n, 'all' AS span FROM articles GROUP BY source ORDER BY n DESC, source LIMIT 5) UNION ALL SELECT * FROM (SELECT source, count(*) AS n, 'recent' AS span FROM articles WHERE created_at >= {TS} - to_days(7) GROUP BY source ORDER BY n DESC, source LIMIT 5)",
    "articles",
)
def a2_source_counts(spark, sf_dir):
    return a.source_counts(x.articles(spark, sf_dir), x.as_of())


@R.add("SELECT CASE WHEN fts_length IS NULL THEN 'needs_fts' WHEN embedding IS NULL THEN 'needs_embedding' ELSE 'complete' END AS stage, count(*) AS n FROM chunks GROUP BY 1", "chunks")
def a3_chunk_stage_counts(spark, sf_dir):
    return a.chunk_stage_counts(x.chunks(spark, sf_dir))


@R.add("SELECT language, round(avg(n), 6) AS avg_chunks FROM (SELECT language, article_id, count(*) AS n FROM chunks GROUP BY 1, 2) GROUP BY 1", "chunks")
def a4_avg_chunks_per_article(spark, sf_dir):
    return _r(a.avg_chunks_per_article(x.chunks(spark, sf_dir)), "avg_chunks")


@R.add(
    "SELECT language, count(*) FILTER (ready_for_chunking AND chunking_completed IS DISTINCT FROM TRUE) AS pending, count(*) FILTER (chunking_completed) AS done, round(count(*) FILTER (chunking_completed) / count(*) * 100, 2) AS percent, count(*) FILTER (ready_for_chunking) AS ready FROM articles_index GROUP BY language",
    "articles_index",
)
def a5_backlog_completion(spark, sf_dir):
    return a.backlog_completion(x.articles_index(spark, sf_dir))


@R.add("SELECT lang, count(text) AS n, round(avg(length(text)), 6) AS avg, min(length(text))::INT AS min, max(length(text))::INT AS max, count(*) FILTER (length(text) > 1000) AS over, count(*) FILTER (length(text) = 1000) AS equal FROM documents GROUP BY lang")
def a6_length_stats(spark, sf_dir):
    return _r(a.length_stats(x.table(spark, sf_dir, "documents"), "text", "lang"), "avg")


@R.add("SELECT url, count(*) AS n FROM articles GROUP BY url HAVING count(*) > 1", "articles")
def a7_duplicate_keys(spark, sf_dir):
    return a.duplicate_keys(x.articles(spark, sf_dir), "url")


@R.add("SELECT 'title_norm' AS \"column\", count(title_norm) AS present, round(count(title_norm) / count(*) * 100, 2) AS percent FROM articles UNION ALL SELECT 'published_at', count(published_at), round(count(published_at) / count(*) * 100, 2) FROM articles", "articles")
def a8_fill_rates(spark, sf_dir):
    return a.fill_rates(x.articles(spark, sf_dir), ["title_norm", "published_at"])


@R.add("SELECT len(embedding)::INT AS dims, count(*) AS n FROM chunks WHERE embedding IS NOT NULL GROUP BY 1", "chunks")
def a9_dimension_histogram(spark, sf_dir):
    return a.dimension_histogram(x.chunks(spark, sf_dir))


@R.add("SELECT search_method, count(*) AS searches, count(DISTINCT user_id) AS users, round(avg(response_time_ms), 6) AS avg_response, round(avg(results_count), 6) AS avg_results, count(*) FILTER (results_count = 0) AS zero_results FROM search_logs GROUP BY 1", "search_logs")
def a10_search_analytics(spark, sf_dir):
    return _r(a.search_analytics(x.search_logs(spark, sf_dir)), "avg_response", "avg_results")


@R.add("SELECT query, count(*) AS n FROM search_logs WHERE query <> '' GROUP BY query ORDER BY n DESC, query LIMIT 20", "search_logs")
def a11_top_queries(spark, sf_dir):
    return a.top_k(x.search_logs(spark, sf_dir).where("query <> ''"), "query", 20)


@R.add("SELECT search_method, round(avg(response_time_ms), 6) AS avg, round(quantile_cont(response_time_ms, 0.95), 6) AS p95, round(quantile_cont(response_time_ms, 0.99), 6) AS p99 FROM search_logs GROUP BY 1", "search_logs")
def a12_latency_percentiles(spark, sf_dir):
    return _r(a.latency_percentiles(x.search_logs(spark, sf_dir)), "avg", "p95", "p99")


@R.add(
    "SELECT domain, i AS impressions, k AS clicks, p AS complaints, round(CASE WHEN i > 0 THEN k / i * 100 ELSE 0 END, 6) AS ctr FROM (SELECT domain, count(*) FILTER (interaction_type = 'impression') AS i, count(*) FILTER (interaction_type = 'click') AS k, count(*) FILTER (interaction_type = 'complaint') AS p FROM interactions GROUP BY domain)",
    "interactions",
)
def a13_domain_counters(spark, sf_dir):
    return _r(a.domain_counters(x.interactions(spark, sf_dir)), "ctr")


@R.add(f"SELECT metric, user_id, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_max(value, (ts, event_id)) AS latest, count(*) AS n FROM metrics WHERE ts >= {TS} - to_hours(240) GROUP BY 1, 2", "metrics")
def a14_metric_aggregate(spark, sf_dir):
    return _r(a.metric_aggregate(x.metrics(spark, sf_dir), x.as_of(), 240), "avg")


@R.add("SELECT metric, user_id, event_id, value, row_number() OVER (PARTITION BY metric, user_id ORDER BY ts DESC, event_id DESC) AS n FROM metrics QUALIFY n <= 3", "metrics")
def a15_metric_history(spark, sf_dir):
    return a.metric_history(x.metrics(spark, sf_dir), 3).select("metric", "user_id", "event_id", "value", "n")


@R.add("SELECT topic, ts, volume, row_number() OVER (PARTITION BY topic ORDER BY ts DESC) AS n FROM snapshots WHERE topic ILIKE '%C%' QUALIFY n <= 10", "snapshots")
def a15_snapshot_history(spark, sf_dir):
    return a.snapshot_history(x.snapshots(spark, sf_dir), "C").select("topic", "ts", "volume", "n")


@R.add("SELECT search_method, count(*) AS searches, count(*) FILTER (results_count = 0) AS zero_results, true AS users_close, true AS p95_close FROM search_logs WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1", "search_logs")
def a10_a12_from_sketches(spark, sf_dir):
    """Analytics of 16 days from the sketches of each day; users within four standard errors, and the p95 within 1 % in rank, of what the rows say."""
    logs = x.search_logs(spark, sf_dir)
    first, last = F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")
    found = a.search_analytics_over(a.daily_search_sketches(logs), first, last)
    some = logs.where(F.to_date("ts").between(first, last)).join(F.broadcast(found.select("search_method", c("p95").alias("p"))), "search_method")
    below, at_most = F.count_if(c("response_time_ms") < c("p")) / F.count("*"), F.count_if(c("response_time_ms") <= c("p")) / F.count("*")
    exact = some.groupBy("search_method").agg(F.countDistinct("user_id").alias("u"), ((below <= 0.96) & (at_most >= 0.94)).alias("p95_close"))
    return found.join(exact, "search_method").select("search_method", "searches", "zero_results", (F.abs(c("users") - c("u")) <= F.ceil(c("u") * 0.026)).alias("users_close"), "p95_close")


@R.add("SELECT topic, round(avg(momentum), 5) AS avg_momentum, round(avg(sentiment), 5) AS avg_sentiment, sum(volume)::BIGINT AS total_volume, count(*) AS samples FROM snapshots GROUP BY topic", "snapshots")
def a16_top_topics(spark, sf_dir):
    return a.top_topics(x.snapshots(spark, sf_dir)).withColumns({n: F.round(n, 5) for n in ("avg_momentum", "avg_sentiment")})


@R.add(
    f"SELECT user_id, type, count(*) AS total, count(*) FILTER (deleted_at IS NULL AND created_at + to_days(ttl_days) > {TS}) AS active, count(*) FILTER (deleted_at IS NOT NULL) AS deleted, round(avg(importance), 6) AS avg_importance, avg(ttl_days) AS avg_ttl, max(created_at) AS newest FROM memory GROUP BY 1, 2",
    "memory",
)
def a17_memory_stats(spark, sf_dir):
    return _r(a.memory_stats(x.memory(spark, sf_dir), x.as_of()), "avg_importance")


@R.add(
    "SELECT key, sum(n)::BIGINT AS n, round(sum(score * n) / sum(n), 6) AS mean, string_agg(score || 'x' || n, ',' ORDER BY score) AS scores FROM (SELECT date_trunc('week', published_at)::DATE AS key, article_id % 10 / 10 AS score, count(*) AS n FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "articles",
)
def a18_aggregate_articles(spark, sf_dir):
    d = x.articles(spark, sf_dir).where("published_at IS NOT NULL")
    found = a.aggregate_articles(d, F.to_date(F.date_trunc("week", "published_at")), c("article_id") % 10 / 10)
    return _r(found.withColumn("scores", F.array_join(F.transform("scores", lambda p: F.concat_ws("x", p["score"].cast("string"), p["n"])), ",")), "mean")


@R.add(
    """SELECT language, n, sources, span_days, round(avg_length, 6) AS avg_length, first_day, last_day, round(n / span_days, 6) AS velocity, round((least(1, n / 50) + least(1, sources / 10) + least(1, span_days / 7)) / 3, 6) AS confidence
 FROM (SELECT language, count(*) AS n, count(DISTINCT source) AS sources, greatest(1, date_diff('day', min(published_at), max(published_at)))::INT AS span_days, avg(length(clean_text)) AS avg_length, min(published_at)::DATE AS first_day, max(published_at)::DATE AS last_day FROM articles GROUP BY language)""",
    "articles",
)
def a19_corpus_profile(spark, sf_dir):
    return _r(a.corpus_profile(x.articles(spark, sf_dir), "language"), "avg_length", "velocity", "confidence")


_SENT = "(SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS s FROM (SELECT *, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in POSITIVE) + " AS p, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in NEGATIVE) + " AS n FROM {}))"


@R.add(f"SELECT source, round(avg(s), 6) AS mean, round(avg((s > 0.1)::INT), 6) AS positive, round(avg((s < -0.1)::INT), 6) AS negative, round(avg((s BETWEEN -0.1 AND 0.1)::INT), 6) AS neutral FROM {_SENT.format('documents')} GROUP BY source")
def a20_lexicon_sentiment(spark, sf_dir):
    return _r(a.sentiment_shares(a.lexicon_sentiment(x.table(spark, sf_dir, "documents"), POSITIVE, NEGATIVE), "source"), "mean", "positive", "negative", "neutral")


@R.add("SELECT lang, round(avg(contains(lower(text), 'now')::INT + contains(lower(text), 'ster')::INT), 6) AS urgency, round(avg(contains(lower(text), 'ea')::INT), 6) AS optimism FROM documents GROUP BY lang")
def a21_emotion_indicators(spark, sf_dir):
    return _r(a.emotion_indicators(x.table(spark, sf_dir, "documents"), {"urgency": ["now", "ster"], "optimism": ["ea"]}, "lang"), "urgency", "optimism")


@R.add("SELECT lang, count(*) AS types, sum(n)::BIGINT AS tokens, round(count(*) / sum(n), 6) AS ratio FROM (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda v: v <> '')) AS w FROM documents) GROUP BY 1, 2) GROUP BY lang")
def a21_type_token_ratio(spark, sf_dir):
    return _r(a.type_token_ratio(x.table(spark, sf_dir, "documents"), "lang"), "ratio")


@R.add("SELECT 'arm' || (user_id % 2) AS arm, event_type AS metric_name, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def a22_experiment_summary(spark, sf_dir):
    e = x.table(spark, sf_dir, "events")
    m = e.select(F.concat(F.lit("arm"), c("user_id") % 2).alias("arm"), c("event_type").alias("metric_name"), c("value").alias("metric_value"), "user_id")
    return _r(a.experiment_summary(m), "mean")


@R.add("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[least(count(*) * 50 // 100, count(*) - 1) + 1] AS p50, list_sort(list(value))[least(count(*) * 95 // 100, count(*) - 1) + 1] AS p95 FROM events GROUP BY 1")
def a23_ops_summary(spark, sf_dir):
    return _r(a.nearest_rank(x.table(spark, sf_dir, "events"), ["event_type"], "value", (50, 95)), "mean")


@R.add(
    f"SELECT query_id, count(*) FILTER (s >= 0.7) AS high, count(*) FILTER (s >= 0.4 AND s < 0.7) AS medium, count(*) FILTER (s < 0.4) AS low, count(*) FILTER (f >= 0.7) AS recent, count(*) FILTER (f >= 0.3 AND f < 0.7) AS moderate, count(*) FILTER (f < 0.3) AS old, count(DISTINCT source_domain) AS sources FROM (SELECT *, coalesce(similarity, 0.5) AS s, coalesce(exp(-(epoch({TS}) - epoch(published_at)) / 3600 / 72), 0) AS f FROM candidates) GROUP BY query_id",
    "candidates",
)
def a25_result_distribution(spark, sf_dir):
    return a.result_distribution(x.candidates(spark, sf_dir), F.coalesce("similarity", F.lit(0.5)), t.freshness(c("published_at"), x.as_of()))


@R.add(f"SELECT query_id, round(median(epoch({TS}) - epoch(published_at)), 2) AS median_age, least(1, count(*) / 30)::DOUBLE AS coverage FROM candidates GROUP BY query_id", "candidates")
def a26_freshness_median(spark, sf_dir):
    return a.freshness_median(x.candidates(spark, sf_dir), x.as_of(), 30)


_TERMS = "SELECT source_domain AS domain, unnest(list_slice(regexp_extract_all(lower(title_norm), '[a-z]{5,}'), 1, 10)) AS term FROM articles"


@R.add(
    f"WITH n AS (SELECT source_domain AS domain, count(*) AS articles FROM articles GROUP BY 1), t AS (SELECT domain, count(DISTINCT term) AS topics FROM ({_TERMS}) GROUP BY 1), j AS (SELECT *, sum(articles) OVER () AS total, avg(articles) OVER () AS mean FROM n LEFT JOIN t USING (domain)) SELECT domain, articles, coalesce(topics, 0) AS topics, CASE WHEN articles / total > 0.2 AND topics > 5 THEN 'leader' WHEN articles / total > 0.1 AND topics > 3 THEN 'fast_follower' ELSE 'niche' END AS stance, round(greatest(-2, least(2, (articles - mean) / mean)), 6) AS delta FROM j",
    "articles",
)
def a27_competitor_positioning(spark, sf_dir):
    d = x.articles(spark, sf_dir).withColumn("domain", c("source_domain"))
    terms = d.select("domain", F.explode(F.slice(F.regexp_extract_all(F.lower("title_norm"), F.lit("[a-z]{5,}"), F.lit(0)), 1, 10)).alias("term"))
    return _r(a.competitor_positioning(d, terms), "delta")


@R.add(
    f"SELECT article_id % 50 AS cluster, count(*) AS size, count(DISTINCT source) AS sources, round((epoch(max(published_at)) - epoch(min(published_at))) / 3600, 6) AS span_hours, round(avg(CASE WHEN published_at IS NOT NULL THEN greatest(0, 1 - (epoch({TS}) - epoch(published_at)) / 3600 / 72) ELSE 0 END), 6) AS freshness, arg_min(title_norm, article_id) AS sample FROM articles GROUP BY 1",
    "articles",
)
def a28_cluster_summary(spark, sf_dir):
    return _r(a.cluster_summary(x.articles(spark, sf_dir).withColumn("cluster", c("article_id") % 50), x.as_of()), "span_hours", "freshness")


@R.add(
    "SELECT cluster, term, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS rank FROM (SELECT article_id % 50 AS cluster, term, count(*) AS n FROM (SELECT article_id, unnest(regexp_extract_all(lower(title_norm), '[a-z]{4,}')) AS term FROM articles) GROUP BY 1, 2 HAVING count(*) >= 2) QUALIFY rank <= 10",
    "articles",
)
def a28_cluster_terms(spark, sf_dir):
    return a.cluster_terms(x.articles(spark, sf_dir).withColumn("cluster", c("article_id") % 50))


@R.add(
    """WITH k AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, article_id) AS rank FROM candidates), l AS (SELECT query_id, article_id, quality AS rel FROM candidates JOIN labels ON doc_id = article_id),
m AS (SELECT k.*, coalesce(rel, 0) AS rel FROM k LEFT JOIN l USING (query_id, article_id)),
g AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 THEN (rel > 0)::INT ELSE 0 END) / 10 AS prec, sum((rank <= 20 AND rel > 0)::INT) AS found FROM m GROUP BY 1),
i AS (SELECT query_id, sum(CASE WHEN pos <= 10 THEN (2 ** rel - 1) / log2(pos + 1) ELSE 0 END) AS idcg, count(*) FILTER (rel > 0) AS there FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, article_id) AS pos FROM l) GROUP BY 1)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(prec, 6) AS "precision", round(CASE WHEN there > 0 THEN found / there ELSE 0 END, 6) AS recall FROM g LEFT JOIN i USING (query_id)""",
    "candidates",
)
def a29_quality_metrics(spark, sf_dir):
    from pyspark.sql import Window

    k = x.candidates(spark, sf_dir)
    ranked = k.select("query_id", "article_id", F.row_number().over(Window.partitionBy("query_id").orderBy(c("fts_score").desc(), "article_id")).alias("rank"))
    l = x.table(spark, sf_dir, "labels").select(c("doc_id").alias("article_id"), c("quality").alias("rel"))  # noqa: E741
    return _r(a.quality_metrics(ranked, k.select("query_id", "article_id").join(l, "article_id")), "ndcg", "precision", "recall")


@R.add(
    "WITH p AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY source ORDER BY published_at DESC NULLS LAST, article_id) <= 20), s AS (SELECT DISTINCT url FROM articles WHERE article_id % 3 = 0) SELECT source AS feed, count(*) FILTER (s.url IS NULL) AS new, count(*) FILTER (s.url IS NOT NULL) AS duplicates, max(CASE WHEN s.url IS NULL THEN published_at END) AS watermark FROM p LEFT JOIN s USING (url) GROUP BY source",
    "articles",
)
def a30_feed_poll_stats(spark, sf_dir):
    d = x.articles(spark, sf_dir)
    return a.feed_poll_stats(d.withColumn("feed", c("source")), d.where("article_id % 3 = 0"))


def user_edges(spark, sf_dir, least=1, among=None):
    """Users who did the same kind of thing in the same hour, as edges, each once; of those that ``among`` holds of alone."""
    e = x.table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("h"), "event_type", "user_id")
    return together(e if among is None else e.where(among), ["h", "event_type"], "user_id", least)


EDGES = "SELECT a, b, count(*) AS weight FROM (SELECT DISTINCT x.h, x.event_type, x.user_id AS a, y.user_id AS b FROM (SELECT DISTINCT date_trunc('hour', ts) AS h, event_type, user_id FROM events) x JOIN (SELECT DISTINCT date_trunc('hour', ts) AS h, event_type, user_id FROM events) y ON x.h = y.h AND x.event_type = y.event_type AND x.user_id < y.user_id) GROUP BY a, b"


@R.add(f"WITH e AS ({EDGES}), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node, b AS o FROM e WHERE weight >= 4 UNION SELECT b, a FROM e WHERE weight >= 4) GROUP BY node) SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d")
def a31_degree_centrality(spark, sf_dir):
    return _r(a.degree_centrality(user_edges(spark, sf_dir, 4), once=True), "centrality")


@R.add(
    f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents), s AS {_SENT.format('l')}, w AS (SELECT s, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS word FROM s) SELECT word, round(avg(s) + 1e-9, 4) AS sentiment, count(*) AS n FROM w GROUP BY word"
)
def a32_term_sentiment(spark, sf_dir):
    lines = x.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return a.term_sentiment(lines, POSITIVE, NEGATIVE).withColumn("sentiment", F.round(c("sentiment") + 1e-9, 4))


@R.add(
    """WITH l AS (SELECT ts::DATE AS day, count(*) AS searches, avg((len(clicked_result_ids) > 0)::INT) AS ctr FROM search_logs GROUP BY 1), i AS (SELECT ts::DATE AS day, avg(dwell_time_seconds) AS dwell FROM interactions WHERE interaction_type = 'click' GROUP BY 1),
s AS (SELECT day, avg((NOT k)::INT) AS bounce FROM (SELECT ts::DATE AS day, session_id, bool_or(len(clicked_result_ids) > 0) AS k FROM search_logs GROUP BY 1, 2) GROUP BY 1)
SELECT day, searches, round(ctr, 6) AS ctr, round(dwell, 6) AS dwell, round(bounce, 6) AS bounce FROM l LEFT JOIN i USING (day) LEFT JOIN s USING (day)""",
    "search_logs",
    "interactions",
)
def a33_engagement(spark, sf_dir):
    return _r(a.engagement(x.search_logs(spark, sf_dir), x.interactions(spark, sf_dir)), "ctr", "dwell", "bounce")
