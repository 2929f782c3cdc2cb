"""Queries of trends and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswire.operators import trends as t
from presswire.plans import fixtures as x
from presswire.plans.fixtures import AS_OF
from presswire.plans.registry import Registry

R = Registry()
c = F.col
TS = f"TIMESTAMP '{AS_OF}'"
STOP = ("the", "of", "and", "de", "la", "le", "die", "der")


def _clusters(spark, sf_dir):
    return x.articles(spark, sf_dir).withColumn("cluster", c("source"))


@R.add(
    f"""WITH w AS (SELECT source AS cluster, list_filter(regexp_extract_all(lower(title_norm), '[a-z]{{2,}}'), lambda v: v NOT IN {STOP}) AS w FROM articles),
t AS (SELECT cluster, unnest(w) AS term FROM w UNION ALL SELECT cluster, w[i] || ' ' || w[i + 1] FROM (SELECT cluster, w, unnest(range(1, len(w))) AS i FROM w)),
f AS (SELECT cluster, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1 ORDER BY total DESC, term LIMIT 5000),
s AS (SELECT cluster, term, round(tf * (ln((1 + (SELECT count(DISTINCT source) FROM articles)) / (1 + df)) + 1), 6) AS score FROM f JOIN d USING (term))
SELECT cluster, term, round(score, 4) AS score, row_number() OVER (PARTITION BY cluster ORDER BY s.score DESC, term) AS rank FROM s QUALIFY rank <= 6""",
    "articles",
)
def k2_cluster_keywords(spark, sf_dir):
    return t.cluster_keywords(_clusters(spark, sf_dir).select("cluster", c("title_norm").alias("text")), STOP).withColumn("score", F.round("score", 4))


_SERIES = f"SELECT cluster, list(coalesce(n, 0) ORDER BY age DESC) AS s FROM (SELECT DISTINCT source AS cluster, unnest(range(48)) AS age FROM articles) LEFT JOIN (SELECT source AS cluster, floor((epoch({TS}) - epoch(published_at)) / 3600)::BIGINT AS age, count(*) AS n FROM articles GROUP BY 1, 2) USING (cluster, age) GROUP BY cluster"


@R.add(f"SELECT cluster, array_to_string(s, ',') AS series FROM ({_SERIES})", "articles")
def k3_hour_series(spark, sf_dir):
    return t.hour_series(_clusters(spark, sf_dir), x.as_of()).select("cluster", F.array_join("series", ",").alias("series"))


@R.add(
    f"""WITH m AS (SELECT cluster, s, list_sum(s[1:24]) AS l, list_sum(s[25:48]) AS r, list_avg(s[1:45]) AS mean, list_stddev_pop(s[1:45]) AS sd FROM ({_SERIES}))
SELECT cluster, round((r - greatest(1, l)) / greatest(1, l), 6) AS momentum, CASE WHEN (s[48] - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END >= 3 THEN 2 WHEN (s[48] - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END >= 2 THEN 1 ELSE 0 END AS burst FROM m""",
    "articles",
)
def k4_momentum_burst(spark, sf_dir):
    return t.momentum_burst(t.hour_series(_clusters(spark, sf_dir), x.as_of())).select("cluster", F.round("momentum", 6).alias("momentum"), "burst")


@R.add()
def k5_build_trends(spark, sf_dir):
    found = t.build_trends(x.articles(spark, sf_dir), x.chunks(spark, sf_dir), x.as_of(), stop=STOP)
    return found.withColumns({"keywords": F.array_join("keywords", ", "), "latest": F.array_join(F.transform("latest", lambda m: m["title"]), " | ")})


_EWMA = """d AS (SELECT source, published_at::DATE AS day, count(*) AS n FROM articles WHERE published_at IS NOT NULL GROUP BY 1, 2),
b AS (SELECT source, min(day) AS f, max(day) AS l, count(*) AS dates, sum(n)::BIGINT AS n, least(max(day) - min(day) + 1, 14) AS m FROM d GROUP BY 1),
s AS (SELECT b.source, dates, b.n, m, i, coalesce(d.n, 0)::DOUBLE AS x FROM (SELECT *, unnest(range(m)) AS i FROM b) b LEFT JOIN d ON d.source = b.source AND d.day = l - (m - 1 - i)::INT),
y AS (SELECT s.source, s.dates, s.n, s.m, s.i, x AS y FROM s WHERE i = 0 UNION ALL SELECT s.source, s.dates, s.n, s.m, s.i, 0.3 * s.x + 0.7 * y.y FROM y JOIN s ON s.source = y.source AND s.i = y.i + 1)"""


@R.add(
    f"WITH RECURSIVE {_EWMA} SELECT source, n, dates, round(CASE WHEN dates >= 2 THEN arg_max(y, i) ELSE 0 END, 6) AS ewma, round(CASE WHEN dates >= 2 THEN regr_slope(y, i) ELSE 0 END, 6) AS slope FROM y GROUP BY source, n, dates",
    "articles",
)
def k6_ewma_slope(spark, sf_dir):
    return t.ewma_slope(x.articles(spark, sf_dir), "source").withColumns({k: F.round(k, 6) for k in ("ewma", "slope")})


@R.add(
    f"""WITH RECURSIVE {_EWMA}, k AS (SELECT source, n, dates, CASE WHEN dates >= 2 THEN regr_slope(y, i) ELSE 0 END AS slope FROM y GROUP BY source, n, dates), w AS (SELECT *, least(abs(slope) / 2, 0.4) * least(n / 20, 1) AS w FROM k)
SELECT source, CASE WHEN dates < 3 THEN 'flat' WHEN slope > 0.1 THEN 'up' WHEN slope < -0.1 THEN 'down' ELSE 'flat' END AS direction, round(CASE WHEN dates < 3 THEN 0.4 ELSE greatest(0, 0.5 - w) END, 4) AS lo, round(CASE WHEN dates < 3 THEN 0.6 ELSE least(1, 0.5 + w) END, 4) AS hi,
 'ewma' || CASE WHEN n > 10 THEN ',volume' ELSE '' END || CASE WHEN last >= TIMESTAMP '{x.AS_OF}' - INTERVAL 1 DAY THEN ',recent' ELSE '' END AS drivers, evidence FROM w
 JOIN (SELECT source, max(published_at) AS last FROM articles GROUP BY 1) USING (source)
 JOIN (SELECT source, string_agg(article_id, ',' ORDER BY k) AS evidence FROM (SELECT source, article_id, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, article_id) AS k FROM articles WHERE published_at IS NOT NULL QUALIFY k <= 3) GROUP BY 1) USING (source)""",
    "articles",
)
def k7_forecast(spark, sf_dir):
    found = t.forecast(x.articles(spark, sf_dir), "source", x.as_of(), "article_id").withColumns({k: F.round(k, 4) for k in ("lo", "hi")})
    return found.withColumn("evidence", F.array_join("evidence", ","))
