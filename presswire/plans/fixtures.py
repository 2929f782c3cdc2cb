"""Views that give the driver's tables the shapes the operators read, and the same views as DuckDB SQL for the oracles.

Everything derives from ids, and ``AS_OF`` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def hours_ago(hours: Column) -> Column:
    return as_of() - F.make_dt_interval(F.lit(0), hours.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(table(spark, sf_dir, "documents"))


def articles_of(d: DataFrame) -> DataFrame:
    """Documents, landed or streamed, as articles."""
    domain = F.concat("source", F.lit(".example.com"))
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.col("text").alias("clean_text"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("title_norm"),
        "source",
        domain.alias("source_domain"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 17 != 0, hours_ago(F.col("doc_id") % 720)).alias("published_at"),
        hours_ago(F.col("doc_id") % 720 + 1).alias("created_at"),
        F.concat(F.lit("https://"), domain, F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 900).cast("string")).alias("url"),
    )


STATUSES = ("pending", "processing", "stored", "duplicate", "error", "partial")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("article_id") % 6 + 1).cast("int"))
    return articles(spark, sf_dir).withColumns({"status": status, "text_hash": F.sha2("clean_text", 256), "url_hash": F.sha2("url", 256)})


def articles_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("article_id") % 5
    return raw(spark, sf_dir).withColumns({"ready_for_chunking": F.col("article_id") % 3 != 0, "chunking_completed": F.when(k < 2, True).when(k < 4, False), "processing_version": (F.col("article_id") % 2 + 1).cast("int")})


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = articles(spark, sf_dir).groupBy("source").agg(F.max("published_at").alias("newest"), F.min("language").alias("lang"), F.min("article_id").alias("feed_id"))
    return per.select("feed_id", F.concat(F.lit("https://"), "source", F.lit(".example.com/rss")).alias("feed_url"), F.when(F.col("feed_id") % 7 == 6, "inactive").otherwise("active").alias("status"), "lang", F.when(F.col("source") != "src3", F.col("newest")).alias("last_entry_date"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line of a document, with an embedding for all but every seventh."""
    lines = articles(spark, sf_dir).select("*", F.posexplode(F.split("clean_text", "\n")).alias("chunk_index", "chunk_text"))
    lines = lines.withColumn("chunk_id", F.col("article_id") * 1_000_000 + F.col("chunk_index")).withColumn("vec_id", F.col("chunk_id") % 500)
    # ids of lines modulo 500 leave few vectors, which go to the lines, so that no text is dealt out
    vectors = table(spark, sf_dir, "embeddings").where(F.abs("vec_id") < 500).select("vec_id", "embedding")
    joined = lines.join(F.broadcast(vectors), "vec_id", "left").withColumn("embedding", F.when(F.col("chunk_id") % 7 != 0, F.col("embedding")))
    return joined.select("chunk_id", "article_id", "chunk_index", "chunk_text", "url", "title_norm", "source_domain", "language", "published_at", "embedding", F.when(F.col("chunk_id") % 5 != 0, F.length("chunk_text")).alias("fts_length"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four words of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("query"))


def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    method = F.element_at(F.array(F.lit("hybrid"), F.lit("fts"), F.lit("vector")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("query"), method.alias("search_method"), (k % 10).alias("results_count"), (F.col("value") * 10).cast("int").alias("response_time_ms"), F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "click", F.array((k % 10).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("clicked_result_ids"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "complaint")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.where(kind.isNotNull()).select("event_id", "ts", "user_id", kind.alias("interaction_type"), F.concat(F.lit("src"), F.col("user_id") % 20, F.lit(".example.com")).alias("domain"), F.col("user_id").alias("search_session_id"), (k % 10).alias("result_position"), F.col("value").cast("int").alias("dwell_time_seconds"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("metric"), "value", F.lit("1h").alias("time_window"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), F.date_trunc("hour", "ts").alias("ts"))
    return hour.agg(F.round(F.avg("value") / 10, 6).alias("momentum"), F.round((F.max("value") - F.min("value")) / 100, 6).alias("sentiment"), F.count("*").alias("volume"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("doc_id") % 500 == F.col("vec_id"), "left")
    even = F.col("doc_id") % 2 == 0
    return d.select(F.col("doc_id").alias("memory_id"), F.col("source").alias("user_id"), F.when(even, "episodic").otherwise("semantic").alias("type"), F.col("text").alias("content"), F.when(even, 30).otherwise(90).alias("ttl_days"), (F.col("doc_id") % 11 / 10).alias("importance"), hours_ago(F.col("doc_id") * 7 % 2000).alias("created_at"), F.when(F.col("doc_id") % 13 == 0, as_of()).alias("deleted_at"), "embedding")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the articles that have all of its words, or all but one, whatever they are: ``fts_score`` from how often each stands in the text,
    ``similarity`` from the cosine of how often each letter stands in title and query, spread over [-1, 1], null for every 23rd article."""
    a, q = articles(spark, sf_dir), queries(spark, sf_dir)
    asked = q.select("query_id", F.array_distinct(F.split(F.lower("query"), " ")).alias("t")).select("query_id", F.size("t").alias("need"), F.explode("t").alias("term"))
    words = a.select("article_id", F.explode(F.split(F.lower("clean_text"), " ")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("article_id", "term").agg(F.count("*").alias("tf"))
    hits = tf.join(asked, "term").groupBy("query_id", "article_id", "need").agg(F.count("*").alias("have"), F.round(F.sum(F.col("tf") / (F.col("tf") + 1.2)) / 4, 4).alias("fts_score")).where("have >= need - 1")
    letters = lambda t: F.array(*((F.size(F.split(F.lower(t), chr(97 + i))) - 1).cast("double") for i in range(26)))
    both = hits.join(a.select("article_id", letters("title_norm").alias("x")), "article_id").join(q.select("query_id", letters("query").alias("y")), "query_id")
    dot = lambda m, n: F.aggregate(F.zip_with(m, n, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    cosine = F.round(F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))) * 2 - 1, 6)
    scored = both.select("query_id", "article_id", F.when(F.col("article_id") % 23 != 0, cosine).alias("similarity"), "fts_score")
    met = a.join(scored, "article_id").join(q, "query_id")
    return met.select("query_id", "query", "article_id", "title_norm", "clean_text", "url", "source_domain", "language", "published_at", "similarity", "fts_score", F.sha2(F.lower(F.substring("clean_text", 1, 60)), 256).alias("content_hash"))


_TS = f"TIMESTAMP '{AS_OF}'"
DUCK = {
    "articles": f"""SELECT doc_id AS article_id, text AS clean_text, substring(split_part(text, chr(10), 1), 1, 120) AS title_norm, source, source || '.example.com' AS source_domain,
  lang AS language, CASE WHEN doc_id % 17 <> 0 THEN {_TS} - to_hours(doc_id % 720) END AS published_at, {_TS} - to_hours(doc_id % 720 + 1) AS created_at,
  'https://' || source || '.example.com/' || lang || '/' || (doc_id % 900) AS url FROM documents""",
    "raw": f"SELECT *, {list(STATUSES)}[article_id % 6 + 1] AS status, sha256(clean_text) AS text_hash, sha256(url) AS url_hash FROM articles",
    "articles_index": """SELECT *, article_id % 3 <> 0 AS ready_for_chunking, CASE WHEN article_id % 5 < 2 THEN true WHEN article_id % 5 < 4 THEN false END AS chunking_completed,
  (article_id % 2 + 1)::INT AS processing_version FROM raw""",
    "feeds": """SELECT feed_id, 'https://' || source || '.example.com/rss' AS feed_url, CASE WHEN feed_id % 7 = 6 THEN 'inactive' ELSE 'active' END AS status, lang,
  CASE WHEN source <> 'src3' THEN newest END AS last_entry_date
  FROM (SELECT source, max(published_at) AS newest, min(language) AS lang, min(article_id) AS feed_id FROM articles GROUP BY source)""",
    "chunks": """SELECT c.chunk_id, article_id, chunk_index, chunk_text, url, title_norm, source_domain, language, published_at,
  CASE WHEN c.chunk_id % 7 <> 0 THEN e.embedding END AS embedding, CASE WHEN c.chunk_id % 5 <> 0 THEN length(chunk_text) END AS fts_length
  FROM (SELECT *, article_id * 1000000 + chunk_index AS chunk_id FROM (SELECT *, unnest(range(len(l)))::INT AS chunk_index, unnest(l) AS chunk_text
    FROM (SELECT *, string_split(clean_text, chr(10)) AS l FROM articles))) c LEFT JOIN embeddings e ON e.vec_id = c.chunk_id % 500""",
    "queries": "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS query FROM benchmark",
    "search_logs": """SELECT event_id, ts, user_id, event_type AS query, ['hybrid', 'fts', 'vector'][event_id % 3 + 1] AS search_method, k % 10 AS results_count,
  trunc(value * 10)::INT AS response_time_ms, user_id AS session_id, CASE WHEN event_type = 'click' THEN [(k % 10)::BIGINT] ELSE [] END AS clicked_result_ids
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "interactions": """SELECT event_id, ts, user_id, interaction_type, 'src' || (user_id % 20) || '.example.com' AS domain, user_id AS search_session_id, k % 10 AS result_position,
  trunc(value)::INT AS dwell_time_seconds FROM (SELECT *, (props->>'$.k')::INT AS k, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'error' THEN 'complaint' END AS interaction_type FROM events)
  WHERE interaction_type IS NOT NULL""",
    "metrics": "SELECT event_id, ts, user_id, event_type AS metric, value, '1h' AS time_window FROM events",
    "snapshots": """SELECT event_type AS topic, date_trunc('hour', ts) AS ts, round(avg(value) / 10, 6) AS momentum, round((max(value) - min(value)) / 100, 6) AS sentiment, count(*) AS volume
  FROM events GROUP BY 1, 2""",
    "memory": f"""SELECT doc_id AS memory_id, source AS user_id, CASE WHEN doc_id % 2 = 0 THEN 'episodic' ELSE 'semantic' END AS type, text AS content,
  CASE WHEN doc_id % 2 = 0 THEN 30 ELSE 90 END AS ttl_days, doc_id % 11 / 10 AS importance, {_TS} - to_hours(doc_id * 7 % 2000) AS created_at,
  CASE WHEN doc_id % 13 = 0 THEN {_TS} END AS deleted_at, embedding FROM documents LEFT JOIN embeddings ON doc_id % 500 = vec_id""",
    "asked": "SELECT query_id, len(t) AS need, unnest(t) AS term FROM (SELECT query_id, list_distinct(string_split(lower(query), ' ')) AS t FROM queries)",
    "hits": """SELECT query_id, article_id, round(sum(tf / (tf + 1.2::DOUBLE)) / 4, 4) AS fts_score FROM
  (SELECT article_id, term, count(*) AS tf FROM (SELECT article_id, unnest(string_split(lower(clean_text), ' ')) AS term FROM articles) GROUP BY 1, 2) JOIN asked USING (term) GROUP BY query_id, article_id, need HAVING count(*) >= need - 1""",
    "candidates": """SELECT query_id, query, article_id, title_norm, clean_text, url, source_domain, language, published_at,
  CASE WHEN article_id % 23 <> 0 AND list_sum(x) > 0 AND list_sum(y) > 0 THEN round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) * 2 - 1, 6) END AS similarity, fts_score, sha256(lower(substring(clean_text, 1, 60))) AS content_hash
  FROM (SELECT *, list_transform(range(0, 26), lambda i: (len(string_split(lower(title_norm), chr(97 + i::INT))) - 1)::DOUBLE) AS x FROM articles) JOIN hits USING (article_id)
  JOIN (SELECT *, list_transform(range(0, 26), lambda i: (len(string_split(lower(query), chr(97 + i::INT))) - 1)::DOUBLE) AS y FROM queries) USING (query_id)""",
}
_NEEDS = {"raw": ["articles"], "articles_index": ["raw"], "feeds": ["articles"], "chunks": ["articles"], "asked": ["queries"], "hits": ["articles", "asked"], "candidates": ["articles", "queries", "hits"]}


def duck(sql: str, *views: str) -> str:
    """``sql`` with the named views, and those they need, as common table expressions before it."""
    order: list[str] = []

    def need(view: str) -> None:
        for other in _NEEDS.get(view, []):
            need(other)
        if view not in order:
            order.append(view)

    for view in views:
        need(view)
    own = sql.strip()
    head = "WITH " + ("RECURSIVE " if own.startswith("WITH RECURSIVE") else "")
    ctes = [f"{v} AS ({DUCK[v]})" for v in order]
    if own.startswith("WITH RECURSIVE "):
        return head + ",\n".join(ctes) + ",\n" + own.removeprefix("WITH RECURSIVE ")
    if own.startswith("WITH "):
        return head + ",\n".join(ctes) + ",\n" + own.removeprefix("WITH ")
    return head + ",\n".join(ctes) + "\n" + own
