"""Filters and work selection. Each takes DataFrames and gives a DataFrame; orders end with the id, so that they are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
WINDOW_LADDER = (6, 12, 24, 72, 168, 336, 720, 2160, 4320, 8760)
BLACKLIST = ("spam.com", "phishing.net", "malware.org", "scam.com")
WHITELIST = ("techcrunch.com", "wired.com", "theverge.com", "arstechnica.com", "reuters.com", "bloomberg.com", "wsj.com", "nytimes.com", "bbc.com", "cnn.com", "tass.ru", "rbc.ru", "vedomosti.ru", "kommersant.ru")


def feeds_due(feeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Active feeds, those never polled first, then the longest waiting."""
    due = feeds.where("status = 'active'").orderBy(F.col("last_entry_date").asc_nulls_first(), "feed_id")
    return due.limit(limit) if limit else due


def pending_articles(raw: DataFrame, limit: int | None = None) -> DataFrame:
    out = raw.where("status = 'pending'").orderBy("created_at", "article_id")
    return out.limit(limit) if limit else out


def ready_for_chunking(index: DataFrame, limit: int | None = None) -> DataFrame:
    """Ready articles whose chunking isn't known to be complete, the oldest first, undated last."""
    out = index.where(F.col("ready_for_chunking") & ~F.col("chunking_completed").eqNullSafe(True)).orderBy(F.col("published_at").asc_nulls_last(), "article_id")
    return out.limit(limit) if limit else out


def chunks_to_index(chunks: DataFrame, need: str = "any") -> DataFrame:
    """Chunks without a text index (``fts``), without a vector (``embedding``), or without either (``any``)."""
    fts, vector = F.col("fts_length").isNull(), F.col("embedding").isNull()
    return chunks.where({"fts": fts, "embedding": vector, "any": fts | vector}[need])


def recent(df: DataFrame, as_of: Column, hours: int, sources: list[str] | None = None, language: str | None = None) -> DataFrame:
    """Titled rows published in the window before ``as_of``, newest first."""
    out = df.where(F.col("published_at").between(as_of - F.make_dt_interval(F.lit(0), F.lit(hours)), as_of) & F.col("title_norm").isNotNull())
    if sources:
        out = out.where(F.col("source_domain").isin(sources))
    if language:
        out = out.where(F.col("language") == language)
    return out.orderBy(F.col("published_at").desc_nulls_last(), "article_id")


def smart_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column holds the value, whatever the case."""
    return df.where(F.lower(F.col(column).cast("string")).contains(value.lower()))


def filter_offtopic(results: DataFrame, threshold: float = 0.28) -> DataFrame:
    """Results at or above a similarity (missing: 1), each with how many of its query were dropped."""
    similarity = F.coalesce("similarity", F.lit(1.0))
    counted = results.withColumn("dropped", F.sum((similarity < threshold).cast("long")).over(Window.partitionBy("query_id")))
    return counted.where(similarity >= threshold)


def chunks_by_ids(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The chunks of each request's list of ids, with their place in it."""
    wanted = requests.select("request_id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    return wanted.join(chunks, "chunk_id")


def feed_quality_gate(feeds: DataFrame, as_of: Column, days: int = 7, language: str = "en") -> DataFrame:
    """Feeds with an entry younger than ``days`` and a language that starts with ``language``."""
    return feeds.where(F.col("last_entry_date").isNotNull() & (F.date_diff(as_of, "last_entry_date") < days) & F.col("lang").startswith(language))


def date_range_filter(results: DataFrame, bounds: DataFrame) -> DataFrame:
    """Results inside the dates (after, before) and the site of their query; a missing bound doesn't bind."""
    met = results.join(F.broadcast(bounds), "query_id")
    inside = F.coalesce(F.col("published_at") >= F.col("after"), F.col("after").isNull()) & F.coalesce(F.col("published_at") <= F.col("before"), F.col("before").isNull())
    return met.where(inside & F.coalesce(F.col("source_domain").endswith(F.col("site")), F.col("site").isNull())).select(*results.columns)


def domain_trust(domain: Column) -> Column:
    """0 for a blacklisted domain, 1 for a whitelisted one, else 0.7."""
    low = F.lower(domain)
    listed = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: low.contains(n))
    return F.when(listed(BLACKLIST), 0.0).when(listed(WHITELIST), 1.0).otherwise(0.7)


def drop_unsafe_domains(evidence: DataFrame, column: str = "source_domain") -> DataFrame:
    return evidence.where(domain_trust(F.col(column)) > 0)


def retrieve_with_fallback(hits: DataFrame, as_of: Column, k: int = 10, steps: int = 5, wide: DataFrame | None = None) -> DataFrame:
    """For each query the hits of its smallest window that has any, out of the first ``steps`` of the ladder, at most k, best first.

    A query without any takes the best k of ``wide``, its hits without filters of language and source, whatever their age; their window is null.
    """
    age = (as_of.cast("double") - F.col("published_at").cast("double")) / 3600
    step = F.when(F.lit(False), F.lit(0))
    for i, hours in enumerate(WINDOW_LADDER[:steps]):
        step = step.when(age.between(0, hours), i)
    stepped = hits.withColumn("step", step).where("step IS NOT NULL")
    least = stepped.withColumn("least", F.min("step").over(Window.partitionBy("query_id"))).where("step = least")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fts_score").desc(), "article_id"))
    hours = F.element_at(F.array(*map(F.lit, WINDOW_LADDER)), F.col("step") + 1)
    found = least.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("window_hours", hours).drop("step", "least")
    if wide is None:
        return found
    rest = wide.join(stepped.select("query_id").distinct(), "query_id", "left_anti").withColumn("rank", rank).where(F.col("rank") <= k)
    return found.unionByName(rest.withColumn("window_hours", F.lit(None).cast("int")))


def apply_retention(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows not older than ``days``."""
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def retention_counts(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """(kept, deleted): what ``apply_retention`` keeps and deletes; one row."""
    kept = F.coalesce(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    return df.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("deleted"))


def delete_by_domain(df: DataFrame, parts: tuple[str, ...], column: str = "feed_url") -> DataFrame:
    """Rows whose ``column`` has none of ``parts`` in it, whatever their case; rows without it stay."""
    found = F.lit(False)
    for part in parts:
        found = found | F.lower(column).contains(part.lower())
    return df.where(~F.coalesce(found, F.lit(False)))
