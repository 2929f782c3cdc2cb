"""Aggregations: pipeline, search, engagement, memory and quality figures. Rates are 0 where their base is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswire.operators.graph import degrees
from presswire.sources.scratch import written


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def pipeline_stats(raw: DataFrame, as_of: Column) -> DataFrame:
    """Rows by status, those of the last 24 hours among them."""
    return raw.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(1))).alias("last_day"))


def top_k(df: DataFrame, key: str, k: int, by: Column | None = None) -> DataFrame:
    """The k most frequent values, ties by value."""
    counted = df.groupBy(key).agg((by if by is not None else F.count("*")).alias("n"))
    return counted.orderBy(F.col("n").desc(), key).limit(k)


def source_counts(index: DataFrame, as_of: Column, days: int = 7, k: int = 5) -> DataFrame:
    """The top sources over all time and over the last days."""
    late = index.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return top_k(index, "source", k).withColumn("span", F.lit("all")).unionByName(top_k(late, "source", k).withColumn("span", F.lit("recent")))


def chunk_stage_counts(chunks: DataFrame) -> DataFrame:
    stage = F.when(F.col("fts_length").isNull(), "needs_fts").when(F.col("embedding").isNull(), "needs_embedding").otherwise("complete")
    return chunks.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def avg_chunks_per_article(chunks: DataFrame, by: str = "language") -> DataFrame:
    per = chunks.groupBy(by, "article_id").agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.avg("n").alias("avg_chunks"))


def backlog_completion(index: DataFrame, by: str = "language") -> DataFrame:
    done = F.count_if(F.col("chunking_completed").eqNullSafe(True))
    ready = F.count_if(F.col("ready_for_chunking"))
    pending = F.count_if(F.col("ready_for_chunking") & ~F.col("chunking_completed").eqNullSafe(True))
    return index.groupBy(by).agg(pending.alias("pending"), done.alias("done"), F.round(rate(done, F.count("*")) * 100, 2).alias("percent"), ready.alias("ready"))


def length_stats(df: DataFrame, column: str, by: str, limit: int = 1000) -> DataFrame:
    n = F.length(column)
    return df.groupBy(by).agg(F.count(column).alias("n"), F.avg(n).alias("avg"), F.min(n).alias("min"), F.max(n).alias("max"), F.count_if(n > limit).alias("over"), F.count_if(n == limit).alias("equal"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, percent) for each column."""
    counts = df.agg(F.count("*").alias("__all"), *(F.count(c).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns)))
    return counts.select("__all", pairs.alias("p")).select("p.*", F.round(rate(F.col("p.present"), F.col("__all")) * 100, 2).alias("percent"))


def dimension_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


def search_analytics(logs: DataFrame) -> DataFrame:
    return logs.groupBy("search_method").agg(F.count("*").alias("searches"), F.countDistinct("user_id").alias("users"), F.avg("response_time_ms").alias("avg_response"), F.avg("results_count").alias("avg_results"), F.count_if(F.col("results_count") == 0).alias("zero_results"))


def latency_percentiles(logs: DataFrame, by: str = "search_method") -> DataFrame:
    p = lambda q: F.percentile("response_time_ms", q)
    return logs.groupBy(by).agg(F.avg("response_time_ms").alias("avg"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def daily_search_sketches(logs: DataFrame, ts: str = "ts", by: str = "search_method") -> DataFrame:
    """(day, method, searches, zero_results, users, response): for each day what ``search_analytics_over`` merges, a few KB a row.

    ``users``: a HyperLogLog sketch of 2 ** 14 registers, its standard error 0.6 %; ``response``: a KLL sketch of response times, its error in
    rank 0.8 % (k = 400).
    """
    users, times = F.hll_sketch_agg(F.col("user_id").cast("long"), F.lit(14)), F.kll_sketch_agg_double(F.col("response_time_ms").cast("double"), F.lit(400))
    return logs.groupBy(F.to_date(ts).alias("day"), by).agg(F.count("*").alias("searches"), F.count_if(F.col("results_count") == 0).alias("zero_results"), users.alias("users"), times.alias("response"))


def search_analytics_over(sketches: DataFrame, first: Column, last: Column, by: str = "search_method") -> DataFrame:
    """(method, searches, zero_results, users, p50, p95, p99) of the days ``first`` to ``last``, from their sketches alone."""
    some = sketches.where(F.col("day").between(first, last)).groupBy(by)
    merged = some.agg(F.sum("searches").alias("searches"), F.sum("zero_results").alias("zero_results"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_double("response").alias("response"))
    return merged.select(by, "searches", "zero_results", "users", *(F.kll_sketch_get_quantile_double("response", F.lit(q / 100)).alias(f"p{q}") for q in (50, 95, 99)))


def snapshot_history(snapshots: DataFrame, topic: str | None = None, limit: int = 10) -> DataFrame:
    """The newest ``limit`` snapshots of each topic whose name holds ``topic``, whatever the case, newest first; all topics without one."""
    some = snapshots if topic is None else snapshots.where(F.lower("topic").contains(topic.lower()))
    return some.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("ts").desc()))).where(F.col("n") <= limit)


def domain_counters(interactions: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("interaction_type") == kind)
    out = interactions.groupBy("domain").agg(of("impression").alias("impressions"), of("click").alias("clicks"), of("complaint").alias("complaints"))
    return out.withColumn("ctr", rate(F.col("clicks"), F.col("impressions")) * 100)


def metric_aggregate(metrics: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """By metric and user over the last hours; the latest value by time, then id."""
    inside = metrics.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return inside.groupBy("metric", "user_id").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("n"))


def metric_history(metrics: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` values of each metric and user."""
    n = F.row_number().over(Window.partitionBy("metric", "user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return metrics.withColumn("n", n).where(F.col("n") <= limit)


def top_topics(snapshots: DataFrame, sort_by: str = "total_volume", k: int = 10) -> DataFrame:
    out = snapshots.groupBy("topic").agg(F.avg("momentum").alias("avg_momentum"), F.avg("sentiment").alias("avg_sentiment"), F.sum("volume").alias("total_volume"), F.count("*").alias("samples"))
    return out.orderBy(F.col(sort_by).desc(), "topic").limit(k)


def expires_at() -> Column:
    return F.col("created_at") + F.make_dt_interval(F.col("ttl_days"))


def memory_stats(memory: DataFrame, as_of: Column) -> DataFrame:
    gone = F.col("deleted_at").isNotNull()
    active = ~gone & (expires_at() > as_of)
    return memory.groupBy("user_id", "type").agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(gone).alias("deleted"), F.avg("importance").alias("avg_importance"), F.avg("ttl_days").alias("avg_ttl"), F.max("created_at").alias("newest"))


def aggregate_articles(df: DataFrame, key: Column, score: Column) -> DataFrame:
    """By source, day or week: count, mean score, and ``scores``, the scores to two digits in order, each with how often it is there."""
    each = df.groupBy(key.alias("key"), F.round(score, 2).alias("score")).agg(F.count("*").alias("n"), F.sum(score).alias("total"), F.count(score).alias("scored"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("score", "n"))))  # as many as there are two-digit scores
    return each.groupBy("key").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("scored")).alias("mean"), pairs.alias("scores"))


def corpus_profile(df: DataFrame, by: str) -> DataFrame:
    """Per group: sources, span in days (1 at least), mean length, dates, articles a day, and a confidence of three capped shares."""
    first, last = F.min("published_at"), F.max("published_at")
    span = F.greatest(F.lit(1), F.date_diff(last, first))
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), span.alias("span_days"), F.avg(F.length("clean_text")).alias("avg_length"), F.to_date(first).alias("first_day"), F.to_date(last).alias("last_day"))
    share = lambda c, full: F.least(F.lit(1.0), F.col(c) / full)
    return out.withColumns({"velocity": F.col("n") / F.col("span_days"), "confidence": (share("n", 50) + share("sources", 10) + share("span_days", 7)) / 3})


def lexicon_sentiment(docs: DataFrame, positive: list[str], negative: list[str], text: str = "text") -> DataFrame:
    """(pos - neg) / (pos + neg) over the distinct words of the lexicon inside each text; 0 without any."""
    low = F.lower(text)
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)))
    p, n = hits(positive), hits(negative)
    return docs.withColumn("sentiment", F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0))


def sentiment_shares(scored: DataFrame, by: str) -> DataFrame:
    s = F.col("sentiment")
    return scored.groupBy(by).agg(F.avg(s).alias("mean"), F.avg((s > 0.1).cast("double")).alias("positive"), F.avg((s < -0.1).cast("double")).alias("negative"), F.avg(s.between(-0.1, 0.1).cast("double")).alias("neutral"))


def emotion_indicators(docs: DataFrame, lexicons: dict[str, list[str]], by: str, text: str = "text") -> DataFrame:
    """Mean hits of each lexicon in a document, by group."""
    low = F.lower(text)
    return docs.groupBy(by).agg(*(F.avg(F.size(F.filter(F.array(*map(F.lit, w)), lambda x: low.contains(x)))).alias(k) for k, w in lexicons.items()))


def type_token_ratio(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Distinct words over words, by group."""
    words = docs.select(by, F.explode(F.array_remove(F.split(F.lower(text), r"\s+"), "")).alias("word"))
    per = words.groupBy(by, "word").agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), (F.count("*") / F.sum("n")).alias("ratio"))


def experiment_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("arm", "metric_name").agg(F.avg("metric_value").alias("mean"), F.min("metric_value").alias("min"), F.max("metric_value").alias("max"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """The value at index min(n * p / 100, n - 1), rounded down, of each group in order."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"__i": F.row_number().over(w.orderBy(value)) - 1, "__n": F.count("*").over(w)})
    at = lambda p: F.least(F.floor(F.col("__n") * p / 100), F.col("__n") - 1)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.max(F.when(F.col("__i") == at(p), F.col(value))).alias(f"p{p}") for p in percents))


def result_distribution(results: DataFrame, score: Column, freshness: Column) -> DataFrame:
    return results.groupBy("query_id").agg(
        F.count_if(score >= 0.7).alias("high"),
        F.count_if((score >= 0.4) & (score < 0.7)).alias("medium"),
        F.count_if(score < 0.4).alias("low"),
        F.count_if(freshness >= 0.7).alias("recent"),
        F.count_if((freshness >= 0.3) & (freshness < 0.7)).alias("moderate"),
        F.count_if(freshness < 0.3).alias("old"),
        F.countDistinct("source_domain").alias("sources"),
    )


def freshness_median(results: DataFrame, as_of: Column, k: int) -> DataFrame:
    """Per query the median age of dated results in seconds, and how much of k was returned."""
    age = as_of.cast("double") - F.col("published_at").cast("double")
    return results.groupBy("query_id").agg(F.round(F.percentile(age, 0.5), 2).alias("median_age"), F.least(F.lit(1.0), F.count("*") / k).alias("coverage"))


def competitor_positioning(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Domains with their share of articles, distinct terms, stance, and the difference from the mean count, in means within 2."""
    n = docs.groupBy("domain").agg(F.count("*").alias("articles"))
    t = terms.groupBy("domain").agg(F.countDistinct("term").alias("topics"))
    total = n.agg(F.sum("articles").alias("total"), F.avg("articles").alias("mean"))
    joined = n.join(t, "domain", "left").fillna(0, ["topics"]).join(F.broadcast(total))
    share = F.col("articles") / F.col("total")
    stance = F.when((share > 0.2) & (F.col("topics") > 5), "leader").when((share > 0.1) & (F.col("topics") > 3), "fast_follower").otherwise("niche")
    delta = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("articles") - F.col("mean")) / F.col("mean")))
    return joined.select("domain", "articles", "topics", stance.alias("stance"), delta.alias("delta"))


def cluster_summary(members: DataFrame, as_of: Column) -> DataFrame:
    """Size, sources, span in hours and mean freshness max(0, 1 - age / 72 h) of each cluster, and its first title."""
    age = (as_of.cast("double") - F.col("published_at").cast("double")) / 3600
    span = (F.max("published_at").cast("double") - F.min("published_at").cast("double")) / 3600
    return members.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("source").alias("sources"), span.alias("span_hours"), F.avg(F.greatest(F.lit(0.0), 1 - age / 72)).alias("freshness"), F.min_by("title_norm", "article_id").alias("sample"))


def cluster_terms(members: DataFrame, k: int = 10) -> DataFrame:
    """The words of more than three letters found twice or more in the titles of a cluster, the k most frequent."""
    words = members.select("cluster", F.explode(F.regexp_extract_all(F.lower("title_norm"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    n = words.groupBy("cluster", "term").agg(F.count("*").alias("n")).where("n >= 2")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), "term"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def quality_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10, deep: int = 20) -> DataFrame:
    """Per query nDCG and precision at k, recall at ``deep``; ranked: (query_id, article_id, rank), relevant: (query_id, article_id, rel)."""
    met = ranked.join(relevant, ["query_id", "article_id"], "left").fillna(0, ["rel"])
    gain = lambda rel, at: (F.pow(F.lit(2.0), rel) - 1) / F.log2(at + 1)
    r, at = F.col("rel"), F.col("rank")
    got = met.groupBy("query_id").agg(F.sum(F.when(at <= k, gain(r, at)).otherwise(0.0)).alias("dcg"), (F.sum(F.when(at <= k, (r > 0).cast("int")).otherwise(0)) / k).alias("precision"), F.sum(F.when((at <= deep) & (r > 0), 1).otherwise(0)).alias("found"))
    best = relevant.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "article_id")))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("at") <= k, gain(F.col("rel"), F.col("at"))).otherwise(0.0)).alias("idcg"), F.count_if(F.col("rel") > 0).alias("there"))
    return got.join(ideal, "query_id", "left").select("query_id", rate(F.col("dcg"), F.col("idcg")).alias("ndcg"), "precision", rate(F.col("found"), F.col("there")).alias("recall"))


def feed_poll_stats(entries: DataFrame, seen: DataFrame, cap: int = 20) -> DataFrame:
    """Per feed, over its newest ``cap`` entries: new and known ones, and the newest date among the new."""
    n = F.row_number().over(Window.partitionBy("feed").orderBy(F.col("published_at").desc_nulls_last(), "article_id"))
    polled = entries.withColumn("n", n).where(F.col("n") <= cap)
    marked = polled.join(seen.select("url").distinct().withColumn("known", F.lit(True)), "url", "left")
    new = F.col("known").isNull()
    return marked.groupBy("feed").agg(F.count_if(new).alias("new"), F.count_if(~new).alias("duplicates"), F.max(F.when(new, F.col("published_at"))).alias("watermark"))


def degree_centrality(edges: DataFrame, once: bool = False) -> DataFrame:
    """Undirected degree of each node of (a, b), and over the largest there can be. ``once``: ``edges`` has each pair once, so none are compared."""
    degree = written(degrees(edges, once), "degrees")
    n = degree.agg(F.count("*").alias("n"))
    return degree.join(F.broadcast(n)).select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def term_sentiment(sentences: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Mean polarity of the sentences (text) that hold a word."""
    scored = lexicon_sentiment(sentences, positive, negative)
    words = scored.select("sentiment", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.avg("sentiment").alias("sentiment"), F.count("*").alias("n"))


def engagement(logs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per day: searches, share with a click, mean dwell of clicks, and share of sessions with a search and no click."""
    day = F.to_date("ts").alias("day")
    clicked = F.size("clicked_result_ids") > 0
    l = logs.groupBy(day).agg(F.count("*").alias("searches"), F.avg(clicked.cast("double")).alias("ctr"))  # noqa: E741
    i = interactions.where("interaction_type = 'click'").groupBy(day).agg(F.avg("dwell_time_seconds").alias("dwell"))
    s = logs.groupBy(day, "session_id").agg(F.max(clicked).alias("any")).groupBy("day").agg(F.avg((~F.col("any")).cast("double")).alias("bounce"))
    return l.join(i, "day", "left").join(s, "day", "left")
