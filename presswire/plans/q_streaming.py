"""Queries of streaming jobs: each replays a whole table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.operators import textindex as ti
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.q_functions import _CLEAN, _NORM
from presswire.plans.registry import Registry
from presswire.streaming import jobs as j

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"
_STOP_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in ti.STOP.items()) + " ELSE [] END"


def _events(spark, sf_dir):
    e = j.read_stream(spark, f"{sf_dir}/events.parquet")
    return e.withColumn("ts", c("ts").cast("timestamp"))


def _articles(spark, sf_dir):
    return x.articles_of(j.read_stream(spark, f"{sf_dir}/documents.parquet"))


@R.add("SELECT sha256(url) AS url_hash, count(*) > 0 AS kept FROM articles GROUP BY url", "articles")
def st1_stream_ingest(spark, sf_dir):
    a = _articles(spark, sf_dir).withColumn("url_hash", F.sha2("url", 256)).select("url_hash", "created_at")
    return j.ingest_new(a).select("url_hash", F.lit(True).alias("kept"))


@R.add(
    f"""WITH a AS (SELECT *, {_NORM.format('clean_text')} AS norm FROM articles), o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY norm ORDER BY article_id) = 1),
l AS (SELECT article_id, language, unnest(string_split(clean_text, chr(10))) AS line FROM o),
w AS (SELECT article_id, len(list_filter(regexp_extract_all(lower(line), '{ti.WORD}'), lambda v: NOT list_contains({_STOP_SQL}, v))) AS n FROM l), c AS (SELECT article_id, count(*) AS chunks, sum(n)::BIGINT AS words FROM w GROUP BY 1)
SELECT article_id, CASE WHEN trim(title_norm) = '' THEN 'error' WHEN len(list_filter(string_split({_NORM.format(_CLEAN.format('clean_text'))}, ' '), lambda v: v <> '')) < 200 THEN 'partial' ELSE 'stored' END AS status, chunks, words FROM o JOIN c USING (article_id)""",
    "articles",
)
def st2_stream_stages(spark, sf_dir):
    articles, chunks, index = j.stream_stages(_articles(spark, sf_dir))
    words = index.postings().groupBy(F.floor(c("id") / 1_000_000).alias("article_id")).agg(F.sum("tf").alias("words"))
    found = articles.select("article_id", "status").join(chunks.groupBy("article_id").agg(F.count("*").alias("chunks")), "article_id").join(words, "article_id", "left")
    return found.withColumn("words", F.coalesce("words", F.lit(0)))


@R.add("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st3_stream_hourly_counts(spark, sf_dir):
    return j.flushed(_events(spark, sf_dir), lambda e: j.hourly_counts(e, "event_type"))


@R.add(
    """WITH w AS (SELECT event_type, ts, unnest(range(0, 24)) AS k FROM events), s AS (SELECT event_type, ts, date_trunc('hour', ts) - to_hours(k) AS "start" FROM w)
SELECT "start", event_type, count(*) FILTER (ts < "start" + INTERVAL 12 HOUR) AS earlier, count(*) FILTER (ts >= "start" + INTERVAL 12 HOUR) AS later,
 round((count(*) FILTER (ts >= "start" + INTERVAL 12 HOUR) - greatest(1, count(*) FILTER (ts < "start" + INTERVAL 12 HOUR))) / greatest(1, count(*) FILTER (ts < "start" + INTERVAL 12 HOUR)), 6) AS momentum FROM s GROUP BY 1, 2"""
)
def st4_stream_momentum(spark, sf_dir):
    return j.flushed(_events(spark, sf_dir), lambda e: j.momentum(e, "event_type")).withColumn("momentum", F.round("momentum", 6))


@R.add(
    """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true)::INT AS fresh FROM search_logs), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS "start", count(*) AS searches, count(*) FILTER (len(clicked_result_ids) > 0) AS clicks, count(*) FILTER (results_count = 0) AS zero_results FROM n GROUP BY user_id, s""",
    "search_logs",
)
def st5_stream_search_sessions(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    logs = e.select("ts", "user_id", (k % 10).alias("results_count"), F.when(c("event_type") == "click", F.array(k % 10)).otherwise(F.array().cast("array<int>")).alias("clicked_result_ids"))
    return j.flushed(logs, j.search_sessions)


def _rules(spark, sf_dir):
    """A rule above the mean of each kind of event."""
    e = x.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value") * 2, 2).alias("threshold"))
    return e.select(F.concat(F.lit("high_"), "event_type").alias("alert_id"), c("event_type").alias("metric"), F.lit(">").alias("operator"), "threshold", F.lit(1440).alias("cooldown_minutes"))


@R.add(
    """WITH RECURSIVE r AS (SELECT event_type, round(avg(value) * 2, 2) AS th FROM events GROUP BY 1), h AS (SELECT 'high_' || event_type AS alert_id, user_id, ts, event_id, value FROM events JOIN r USING (event_type) WHERE value > th),
f AS (SELECT alert_id, user_id, min(ts) AS ts FROM h GROUP BY 1, 2 UNION SELECT f.alert_id, f.user_id, (SELECT min(h.ts) FROM h WHERE h.alert_id = f.alert_id AND h.user_id = f.user_id AND h.ts >= f.ts + INTERVAL 1440 MINUTE) FROM f WHERE f.ts IS NOT NULL)
SELECT f.alert_id, f.user_id, f.ts, h.value, row_number() OVER (PARTITION BY f.alert_id, f.user_id ORDER BY f.ts) AS trigger_count FROM f JOIN h USING (alert_id, user_id, ts)"""
)
def st6_stream_alerts(spark, sf_dir):
    m = _events(spark, sf_dir).select("event_id", "ts", "user_id", c("event_type").alias("metric"), "value")
    return j.counted_alerts(j.collected(j.stream_alerts(m, _rules(spark, sf_dir))))


@R.add(f"SELECT memory_id, CASE WHEN deleted_at IS NULL AND created_at + to_days(ttl_days) <= {TS} THEN {TS} ELSE deleted_at END AS deleted_at FROM memory", "memory")
def st7_expire_memory(spark, sf_dir):
    return j.expire_memory(x.memory(spark, sf_dir), x.as_of()).select("memory_id", "deleted_at")


@R.add("SELECT event_id, event_type AS metric, value, '1h' AS time_window, 'batch' AS source FROM events")
def st8_stream_metrics_append(spark, sf_dir):
    m = _events(spark, sf_dir).select("event_id", c("event_type").alias("metric"), "value", F.lit(None).cast("string").alias("time_window"))
    return j.collected(j.with_metric_defaults(m))


@R.add()
def st9_late_rows(spark, sf_dir):
    fresh, late = j.split_late(_events(spark, sf_dir).select("event_id", "ts", "event_type"), "ts")
    mark = lambda df, k: df.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("late", F.lit(k))
    return mark(fresh, False).unionByName(mark(late, True))
