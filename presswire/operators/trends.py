"""Trends and forecasts: hourly series, bursts, cluster keywords, smoothed slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswire.functions.text import confidence_interval, direction
from presswire.operators.joins import first_chunk_per_article
from presswire.operators.ranking import latest_per_cluster, rank_trends
from presswire.operators.select import recent
from presswire.operators.vectors import dbscan_cosine
from presswire.sources.scratch import written


def cluster_keywords(texts: DataFrame, stop: tuple[str, ...], k: int = 6, features: int = 5_000) -> DataFrame:
    """(cluster, term, rank): of texts (cluster, text) each cluster as one document; words and pairs of words, the most frequent ``features``, by tf x (ln((1 + n) / (1 + df)) + 1)."""
    words = texts.select("cluster", F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    terms = words.select("cluster", F.explode(F.concat("w", F.array_compact(pairs))).alias("term"))
    tf = terms.groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).orderBy(F.col("all").desc(), "term").limit(features)
    n = texts.select(F.countDistinct("cluster").alias("n"))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 6))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("score").desc(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("cluster", "term", "score", "rank")


def hour_series(members: DataFrame, as_of: Column, hours: int = 48, key: str = "cluster", ts: str = "published_at") -> DataFrame:
    """(cluster, series): counts of each of the last hours, oldest first, zeros filled in."""
    age = F.floor((as_of.cast("double") - F.col(ts).cast("double")) / 3600)
    counted = members.where((age >= 0) & (age < hours)).groupBy(key, age.cast("int").alias("age")).agg(F.count("*").cast("int").alias("n"))
    spine = members.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("age"))
    filled = spine.join(counted, [key, "age"], "left").fillna(0, ["n"])
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("age")).alias("k"), "n")))
    return filled.groupBy(key).agg(F.transform(pairs, lambda p: p["n"]).alias("series"))


def momentum_burst(series: DataFrame) -> DataFrame:
    """Adds momentum, the change from the first to the second half, and burst, how far the last value stands out of all but the last three."""
    s = F.col("series")
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda x, y: x + y)
    half = F.floor(F.size(s) / 2).cast("int")
    left, right = total(F.slice(s, F.lit(1), half)), total(F.slice(s, half + 1, F.size(s)))
    base = F.slice(s, F.lit(1), F.greatest(F.size(s) - 3, F.lit(1)))
    mean = total(base) / F.size(base)
    sd = F.sqrt(F.aggregate(base, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(base))
    z = (F.element_at(s, -1) - mean) / F.when(sd > 0, sd).otherwise(1.0)
    enough = F.size(s) >= 4
    momentum = F.when(enough, (right - F.greatest(F.lit(1.0), left)) / F.greatest(F.lit(1.0), left)).otherwise(0.0)
    burst = F.when(enough & (z >= 3), 2).when(enough & (z >= 2), 1).otherwise(0)
    return series.withColumns({"momentum": momentum, "burst": burst})


def ewma_slope(docs: DataFrame, topic: str, ts: str = "published_at", days: int = 14, alpha: float = 0.3) -> DataFrame:
    """(topic, n, dates, ewma, slope): daily counts of the last days up to the newest, zeros filled in, smoothed, and their least-squares slope.

    The smoothing starts at the first value and takes it in again; fewer than two dates give zeros.
    """
    daily = docs.where(F.col(ts).isNotNull()).groupBy(topic, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    ends = daily.groupBy(topic).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("dates"), F.sum("n").alias("total"))
    span = F.least(F.date_diff("last", "first") + 1, F.lit(days))
    spine = ends.select(topic, "dates", "total", F.explode(F.sequence(F.lit(0), span - 1)).alias("i"), F.date_sub("last", span - 1).alias("start")).withColumn("day", F.date_add("start", F.col("i")))
    filled = spine.join(daily, [topic, "day"], "left").fillna(0, ["n"])
    series = filled.groupBy(topic, "dates", "total").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda p: p["n"].cast("double")).alias("x"))
    first = F.element_at("x", 1)
    smooth = F.aggregate("x", F.array(first), lambda a, v: F.array_append(a, alpha * v + (1 - alpha) * F.element_at(a, -1)), lambda a: F.slice(a, F.lit(2), F.size(a)))
    out = series.withColumn("y", smooth).withColumn("m", F.size("y"))
    sums = lambda f: F.aggregate(F.sequence(F.lit(0), F.col("m") - 1), F.lit(0.0), lambda a, i: a + f(i.cast("double"), F.get("y", i)))
    sx, sxx, sy, sxy = sums(lambda i, y: i), sums(lambda i, y: i * i), sums(lambda i, y: y), sums(lambda i, y: i * y)
    slope = (F.col("m") * sxy - sx * sy) / (F.col("m") * sxx - sx * sx)
    enough = (F.col("dates") >= 2) & (F.col("m") >= 2)
    return out.select(topic, F.col("total").alias("n"), "dates", F.when(enough, F.element_at("y", -1)).otherwise(0.0).alias("ewma"), F.when(enough, slope).otherwise(0.0).alias("slope"))


def newest(docs: DataFrame, key: str, id_col: str, ts: str = "published_at", n: int = 3, salts: int = 64) -> DataFrame:
    """(key, ids): the ``n`` newest ids of each key, ties to the smallest; first within ``salts`` parts of a key, so that a hot key is not one task's."""
    order = F.col(ts).desc(), id_col
    cut = docs.where(F.col(ts).isNotNull()).select(key, id_col, ts, F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("__salt"))
    for by in ([key, "__salt"], [key]):
        cut = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n)
    return cut.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", id_col))), lambda p: p[id_col]).alias("ids"))


def forecast(docs: DataFrame, topic: str, as_of: Column | None = None, id_col: str | None = None) -> DataFrame:
    """Direction, interval and drivers of each topic; flat within [0.4, 0.6] below three dates.

    Drivers: the smoothed slope, a volume of over ten, and with ``as_of`` something published within a day of it. With ``id_col`` the ids of the
    three newest documents are the evidence.
    """
    s = ewma_slope(docs, topic)
    few = F.col("dates") < 3
    if as_of is not None:
        last = docs.where(F.col("published_at") <= as_of).groupBy(topic).agg(F.max("published_at").alias("last"))
        s = s.join(last, topic, "left").withColumn("recent", F.col("last") >= as_of - F.make_dt_interval(F.lit(1)))
    interval = confidence_interval(F.col("slope"), F.col("n"))
    drivers = F.array_compact(F.array(F.lit("ewma"), F.when(F.col("n") > 10, "volume"), *([F.when(F.col("recent"), "recent")] if as_of is not None else [])))
    out = s.select(topic, F.when(few, "flat").otherwise(direction(F.col("slope"))).alias("direction"), F.when(few, 0.4).otherwise(interval[0]).alias("lo"), F.when(few, 0.6).otherwise(interval[1]).alias("hi"), F.array_join(drivers, ",").alias("drivers"))
    return out.join(newest(docs, topic, id_col).withColumnRenamed("ids", "evidence"), topic, "left") if id_col else out


def build_trends(articles: DataFrame, chunks: DataFrame, as_of: Column, hours: int | None = None, topn: int = 20, stop: tuple[str, ...] = (), eps: float = 0.30, min_samples: int = 5) -> DataFrame:
    """(cluster, size, momentum, burst, score, keywords, latest): the ``topn`` trends among dated articles, of the last ``hours`` if given.

    Articles are clustered by the vectors of their first chunks; each cluster has its hourly dynamics, the terms that set its titles apart and
    its three newest articles (n, article_id, title). Articles without a vector, and noise, are of no trend.
    """
    dated = articles.where(F.col("published_at").isNotNull())
    some = recent(dated, as_of, hours) if hours else dated
    first = first_chunk_per_article(chunks).join(some.select("article_id"), "article_id", "left_semi").select("article_id", "embedding")
    placed = dbscan_cosine(first, "article_id", eps, min_samples).where("cluster >= 0").withColumnRenamed("id", "article_id")
    members = written(some.join(placed, "article_id").select("article_id", "title_norm", "published_at", "cluster"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    ranked = rank_trends(sizes.join(momentum_burst(hour_series(members, as_of)), "cluster"), topn).select("cluster", "size", "momentum", "burst", "score")
    terms = cluster_keywords(members.select("cluster", F.col("title_norm").alias("text")), stop).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda p: p["term"]).alias("keywords"))
    latest = latest_per_cluster(members).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("n", "article_id", "title"))).alias("latest"))
    return ranked.join(terms, "cluster", "left").join(latest, "cluster", "left")
