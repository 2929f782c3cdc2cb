"""Reading and writing tables: keyed inserts, upserts and patches as joins over whole batches.

There is no table format underneath: each function gives the new snapshot, which a job writes to a new folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.sources.scratch import written


def read_feed_entries(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """One row for each entry of landed RSS or Atom XML: url, title, published, author, authors, keywords, enclosures (href, type, length).

    The url is the first http value of link, id and guid, or else of a link whose rel is alternate or missing; the date is the first there is.
    Elements may be repeated and may have attributes; what an entry lacks is null, or an empty list.
    """
    entries = spark.read.format("xml").option("rowTag", row_tag).load(path)

    def elements(name: str) -> tuple[Column, list[str] | None]:
        """(an array of the elements of a name, their fields if they have any)."""
        if name not in entries.columns:
            return F.array().cast("array<string>"), None
        kind, value = entries.schema[name].dataType, F.col(f"`{name}`")
        one = kind.elementType if isinstance(kind, T.ArrayType) else kind
        listed = F.filter(F.coalesce(value, F.array()), lambda v: v.isNotNull()) if isinstance(kind, T.ArrayType) else F.array_compact(F.array(value))
        return listed, one.names if isinstance(one, T.StructType) else None

    def values(name: str, *attributes: str) -> Column:
        """The texts of elements, or the first of their attributes that is there."""
        listed, fields = elements(name)
        wanted = [f for f in ("_VALUE", *attributes) if f in (fields or [])]
        if fields is not None and not wanted:
            return F.array().cast("array<string>")
        text = (lambda v: F.coalesce(*(v[f].cast("string") for f in wanted))) if fields is not None else (lambda v: v.cast("string"))
        return F.filter(F.transform(listed, text), lambda v: v.isNotNull() & (v != ""))

    def alternates() -> Column:
        listed, fields = elements("link")
        if fields is None or "_href" not in fields:
            return F.array().cast("array<string>")
        own = F.filter(listed, lambda v: F.coalesce(v["_rel"] == "alternate", F.lit(True))) if "_rel" in fields else listed
        return F.transform(own, lambda v: v["_href"].cast("string"))

    def enclosures() -> Column:
        listed, fields = elements("enclosure")
        pick = lambda v, *names: next((v[n].cast("string") for n in names if n in (fields or [])), F.lit(None).cast("string"))
        shaped = lambda v: F.struct(pick(v, "_url", "_href").alias("href"), pick(v, "_type").alias("type"), pick(v, "_length").try_cast("long").alias("length"))
        return F.transform(listed, shaped if fields is not None else lambda v: F.struct(v.cast("string").alias("href"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("long").alias("length")))

    urls = F.filter(F.concat(values("link"), values("id"), values("guid"), alternates()), lambda v: v.startswith("http"))
    dates = F.concat(*(values(n) for n in ("pubDate", "published", "updated", "created")))
    authors = F.concat(values("author", "name"), values("creator"), values("dc:creator"))
    words = F.concat(F.flatten(F.transform(values("keywords"), lambda v: F.split(v, r"\s*,\s*"))), values("category", "_term"), values("tag"))
    return entries.select(F.get(urls, 0).alias("url"), F.get(values("title"), 0).alias("title"), F.get(dates, 0).alias("published"), F.get(authors, 0).alias("author"), authors.alias("authors"), F.array_distinct(words).alias("keywords"), enclosures().alias("enclosures"))


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table over JDBC, in ``parts`` ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    n = "__row_number"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(n) == 1).drop(n)


def insert_ignore(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of ``batch`` to append: the first of each key that the target doesn't have."""
    return first_per_key(batch, [key], order).join(target.select(key).distinct(), key, "left_anti")


def insert_counts(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(inserted, conflicted): how many rows of ``batch`` ``insert_ignore`` appends and how many it leaves out; one row."""
    keys = batch.groupBy(key).agg(F.count("*").alias("n")).join(target.select(key).distinct().withColumn("__known", F.lit(1)), key, "left")
    fresh = F.col("__known").isNull() & F.col(key).isNotNull()
    inserted = F.count_if(fresh)
    return keys.agg(inserted.alias("inserted"), (F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("conflicted"))


def upsert_index(target: DataFrame, batch: DataFrame, key: str = "text_hash", keep_greatest: tuple[str, ...] = ("processing_version",), keep_true: tuple[str, ...] = ("ready_for_chunking",)) -> DataFrame:
    """The new snapshot: on a match the batch's values where it has any, the greater version, and flags that stay true."""
    t, b = target.alias("t"), batch.alias("b")
    out = []
    for name in target.columns:
        old, new = F.col(f"t.`{name}`"), F.col(f"b.`{name}`")
        value = F.greatest(old, new) if name in keep_greatest else F.coalesce(old | new, old, new) if name in keep_true else F.coalesce(new, old)
        out.append(value.alias(name))
    return t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full").select(*out)


def upsert_rows(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The new snapshot, with the batch's row wherever it has one: a repeat changes nothing."""
    return batch.unionByName(target.join(batch.select(*key).distinct(), key, "left_anti"))


def apply_patches(target: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """The new snapshot, changed where a patch has a value."""
    p = patches.select(F.col(key), *(F.col(n).alias(f"__{n}") for n in patches.columns if n != key))
    joined = target.join(p, key, "left")
    return joined.select(*(F.coalesce(F.col(f"__{n}"), F.col(n)).alias(n) if n in patches.columns and n != key else F.col(n) for n in target.columns))


def sync_new(source: DataFrame, target: DataFrame, key: str = "url") -> DataFrame:
    """Rows of the source that the target lacks, dated by creation where undated."""
    new = source.join(target.select(key).distinct(), key, "left_anti")
    return new.withColumn("published_at", F.coalesce("published_at", "created_at"))


def sync_gap(processed: DataFrame, copied: DataFrame, key: str = "url") -> DataFrame:
    """(processed, copied, gap): one row, how many keys are processed, how many copied, and how many of the former have still to be; negative if more are copied."""
    n = lambda df, name: df.agg(F.countDistinct(key).alias(name))
    return n(processed, "processed").join(F.broadcast(n(copied, "copied"))).select("processed", "copied", (F.col("processed") - F.col("copied")).alias("gap"))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """``df`` as a table in folders by the hash of its key, for ``upsert_bucketed``."""
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of such a table, with their ``bucket``."""
    return spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType())])).parquet(path)


def upsert_bucketed(batch: DataFrame, path: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType, buckets: int = 64) -> None:
    """Puts ``merge(old, batch)`` in place of the buckets that the keys of ``batch`` are in; the files of others aren't read or written.

    ``merge``: as ``upsert_rows``, ``upsert_index`` or ``apply_patches``. The new buckets are written aside first and then put in place, so a
    job that fails halfway is run again with the same batch.
    """
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select(_bucket(key, buckets)).distinct().collect()]  # as many as there are buckets at most
    if touched:
        old = read_bucketed(spark, path, schema).where(F.col("bucket").isin(touched)).drop("bucket")
        staged = written(merge(old, batch).select(*schema.names).withColumn("bucket", _bucket(key, buckets)), "staged")
        staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def migrate_embeddings(chunks: DataFrame, column: str, dims: tuple[int, ...] = (768, 1536, 3072)) -> DataFrame:
    """``vector`` from its JSON text, null unless it has a known length."""
    parsed = F.from_json(F.col(column), "array<float>")
    return chunks.withColumn("vector", F.when(F.size(parsed).isin(*dims), parsed))


def reports(df: DataFrame, group: str) -> DataFrame:
    """A report for each group: sources with their counts as JSON, and rows by day as JSON."""
    domains = df.groupBy(group, "source_domain").agg(F.count("*").alias("n"))
    top = domains.groupBy(group).agg(F.to_json(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "source_domain"))), 1, 5), lambda s: s["source_domain"])).alias("top_domains"))
    days = df.where("published_at IS NOT NULL").groupBy(group, F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))
    line = days.groupBy(group).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("day").cast("string"), "n"))))).alias("timeline"))
    return df.groupBy(group).agg(F.count("*").alias("articles")).join(top, group, "left").join(line, group, "left")


def write_reports(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def store_trends(target: DataFrame, trends: DataFrame) -> DataFrame:
    """The new snapshot by topic: on a match only the count and the time of the update change."""
    t, n = target.alias("t"), trends.alias("n")
    status = F.when(F.col("n.freshness") > 0.7, "emerging").otherwise("established")
    joined = t.join(n, F.col("t.topic_id") == F.col("n.topic_id"), "full")
    return joined.select(
        F.coalesce("t.topic_id", "n.topic_id").alias("topic_id"),
        F.coalesce("n.total_articles", "t.total_articles").alias("total_articles"),
        F.coalesce("t.freshness", "n.freshness").alias("freshness"),
        F.when(F.col("t.topic_id").isNotNull(), F.col("t.trend_status")).otherwise(status).alias("trend_status"),
        F.coalesce("n.updated_at", "t.updated_at").alias("updated_at"),
    )
