"""Streaming jobs with event time: ingest, stages, windowed counts, sessions, alerts, late rows. Each has a batch twin or a batch result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from presswire.functions import text as t
from presswire.operators.aggregates import expires_at
from presswire.operators.textindex import TextIndex
from presswire.operators.vectors import embed_chunks
from presswire.sources.scratch import new_path
from presswire.sources.tables import first_per_key

#: How late a row may be: the longest series that trends are read from.
LATENESS = "48 hours"


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table of one or more Parquet files as a stream, ``files`` at a time. The path is given as a pattern, as a stream takes a plain one for a folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def run_once(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Everything there is now, batch by batch, through ``sink``; with the same checkpoint a restart goes on where it stopped."""
    where = checkpoint or new_path(stream.sparkSession, "checkpoint")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def _into(base: str, numbers: list[int]) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch under its number, so that a batch that is repeated overwrites itself."""

    def sink(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={i}")
        numbers.append(i)

    return sink


def _read_batches(stream: DataFrame, base: str, numbers: list[int]) -> DataFrame:
    if not numbers:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.option("basePath", base).parquet(*(f"{base}/batch={i}" for i in sorted(set(numbers)))).drop("batch")


def collected(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """The rows of an appending stream."""
    base, numbers = new_path(stream.sparkSession, "stream"), []
    run_once(stream, "append", _into(base, numbers), checkpoint)
    return _read_batches(stream, base, numbers)


def flushed(stream: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str = "ts", progress: list[dict] | None = None) -> DataFrame:
    """All rows of ``build(stream)``, an aggregation by windows of ``ts``, each window once, when the watermark has passed it.

    The state of windows that are done is dropped as the stream goes. At its end one more row, far ahead in time and null in all else, closes
    what is still open; its own window is never done. ``progress``: gets what each batch reports.
    """
    spark = stream.sparkSession
    base, ends, where, numbers = new_path(spark, "stream"), new_path(spark, "end"), new_path(spark, "checkpoint"), []
    spark.createDataFrame([], stream.schema).coalesce(1).write.parquet(ends)
    out = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(ends)))
    for last in (False, True):
        if last:
            row = spark.range(1).select(*(F.to_timestamp(F.lit("9999-01-01")).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema))
            row.coalesce(1).write.mode("append").parquet(ends)
        query = run_once(out, "append", _into(base, numbers), where)
        if progress is not None:
            progress += query.recentProgress
    return _read_batches(out, base, numbers)


def stream_ingest(entries: DataFrame, key: str = "url_hash", ts: str = "created_at") -> DataFrame:
    """Entries whose key is new within the lateness."""
    return entries.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([key])


#: Parts of the keys that are stored; a batch reads those parts that its own keys are in.
BUCKETS = 64


def stored_rows(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """What ``store_new`` has written under ``base``, with ``batch`` and ``bucket``."""
    return spark.read.schema(StructType([*schema, StructField("batch", LongType()), StructField("bucket", LongType())])).option("basePath", base).parquet(base)


def store_new(batch: DataFrame, base: str, i: int, key: str, order: list[Column]) -> DataFrame:
    """Stores, under ``base``, the rows of batch number ``i`` whose key is new, the first of each; returns them.

    Rows are dealt and stored by bucket of their key's hash, a file for each, with a Bloom filter of the keys in it; of earlier batches only
    the keys in the batch's own buckets are read, and of the first batch nothing is kept for that. A batch that is repeated doesn't meet itself
    and overwrites what it wrote.
    """
    spark = batch.sparkSession
    own = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    own = own.persist() if i else own
    fresh = first_per_key(own.repartition("bucket"), ["bucket", key], order)
    if i:
        touched = [r[0] for r in own.select("bucket").distinct().collect()]
        known = stored_rows(spark, base, batch.schema).where(F.col("bucket").isin(touched) & (F.col("batch") < i)).select("bucket", key).distinct()
        fresh = fresh.join(known, ["bucket", key], "left_anti")
    fresh.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(f"{base}/batch={i}")
    if i:
        own.unpersist()
    return stored_rows(spark, base, batch.schema).where(F.col("batch") == i).select(*batch.columns)


def ingest_new(entries: DataFrame, base: str | None = None, checkpoint: str | None = None, key: str = "url_hash", ts: str = "created_at") -> DataFrame:
    """All stored entries, each key once for ever: a batch meets what earlier ones stored under ``base``, so that restarts and late repeats add nothing.

    A batch reads the keys of its own buckets alone, in entries that earlier batches stored.
    """
    spark, base = entries.sparkSession, base or new_path(entries.sparkSession, "ingest")
    run_once(stream_ingest(entries, key, ts), "append", lambda batch, i: store_new(batch, base, i, key, [F.col(ts)]), checkpoint)
    return stored_rows(spark, base, entries.schema).select(*entries.columns)


def stage_batch(batch: DataFrame, path: str, i: int) -> None:
    """One micro-batch through all stages: articles with text hash and status, whose text no earlier batch has; their lines as chunks, with
    vectors; and the text index with those chunks. All is written under the batch's number, so that a repeat changes nothing."""
    spark = batch.sparkSession
    parsed = batch.withColumns({"text_hash": t.text_hash(F.col("clean_text")), "status": t.article_status(F.col("title_norm"), F.col("clean_text"))})
    once = store_new(parsed, f"{path}/articles", i, "text_hash", [F.col("article_id")])
    lines = once.select("article_id", "language", F.posexplode(F.split("clean_text", "\n")).alias("chunk_index", "chunk_text"))
    lines = lines.withColumns({"chunk_id": F.col("article_id") * 1_000_000 + F.col("chunk_index"), "embedding": F.lit(None).cast("array<float>")})
    embed_chunks(lines, "chunk_text").write.mode("overwrite").parquet(f"{path}/chunks/batch={i}")
    chunks = spark.read.parquet(f"{path}/chunks/batch={i}")
    TextIndex(spark, f"{path}/index", version=i - 1).add(chunks, "chunk_id", "chunk_text", "language")


def stream_stages(articles: DataFrame, path: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame, TextIndex]:
    """(articles, chunks, text index) after all micro-batches, each text once."""
    spark, path, last = articles.sparkSession, path or new_path(articles.sparkSession, "stages"), []

    def sink(batch: DataFrame, i: int) -> None:
        stage_batch(batch, path, i)
        last.append(i)

    run_once(articles, "append", sink, checkpoint)
    schema = articles.schema.add("text_hash", "string").add("status", "string")
    return stored_rows(spark, f"{path}/articles", schema).drop("batch", "bucket"), spark.read.parquet(f"{path}/chunks").drop("batch"), TextIndex(spark, f"{path}/index", version=max(last, default=-1))


def hourly_counts(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Counts by tumbling hour."""
    w = F.window(ts, "1 hour")
    return events.withWatermark(ts, LATENESS).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), key, "n")


def momentum(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """By sliding window of 24 hours: counts of its earlier and later half, and the change."""
    w = F.window(ts, "24 hours", "1 hour")
    late = F.col(ts).cast("double") >= F.col("window.start").cast("double") + 12 * 3600
    marked = events.withWatermark(ts, LATENESS).withColumn("window", w)
    out = marked.groupBy("window", key).agg(F.count_if(~late).alias("earlier"), F.count_if(late).alias("later"))
    least = F.greatest(F.lit(1), F.col("earlier"))
    return out.select(F.col("window.start").alias("start"), key, "earlier", "later", ((F.col("later") - least) / least).alias("momentum"))


def search_sessions(logs: DataFrame, gap: str = "6 hours") -> DataFrame:
    """By user and session of searches less than ``gap`` apart: searches, clicks, searches without results."""
    s = F.session_window("ts", gap)
    out = logs.withWatermark("ts", LATENESS).groupBy("user_id", s).agg(F.count("*").alias("searches"), F.count_if(F.size("clicked_result_ids") > 0).alias("clicks"), F.count_if(F.col("results_count") == 0).alias("zero_results"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "searches", "clicks", "zero_results")


def _fired(rows: pd.DataFrame, last: float | None) -> tuple[list[tuple], float | None]:
    """(alert_id, user_id, ts, value) of the rows that fire, and when the last one did."""
    out = []
    for r in rows.sort_values(["ts", "event_id"]).itertuples(index=False):
        hit = r.value > r.threshold if r.operator == ">" else r.value < r.threshold
        at = r.ts.timestamp()
        if hit and (last is None or at - last >= r.cooldown_minutes * 60):
            out.append((r.alert_id, r.user_id, r.ts, r.value))
            last = at
    return out, last


ALERTS = "alert_id string, user_id long, ts timestamp, value double"
_NAMES = ["alert_id", "user_id", "ts", "value"]


def _watched(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    return metrics.join(rules, "metric").select("alert_id", "user_id", "ts", "event_id", "value", "operator", "threshold", "cooldown_minutes")


class Alerts(StatefulProcessor):
    """When an alert last fired for a user, as long as its cooldown goes on; then a timer drops it, as it can't hold back a firing any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double, until double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        every = pd.concat(list(rows))
        old, until = self.last.get() if self.last.exists() else (None, None)
        out, last = _fired(every, old)
        if last is not None and last != old:
            if until is not None:
                self.handle.deleteTimer(int(until * 1000))
            until = last + float(every["cooldown_minutes"].max()) * 60
            self.last.update((last, until))
            self.handle.registerTimer(int(until * 1000))
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def stream_alerts(metrics: DataFrame, rules: DataFrame, ts: str = "ts") -> DataFrame:
    """Firings of rules (alert_id, metric, operator, threshold, cooldown_minutes) on each user's metrics; none within the cooldown of the last.

    A user's rows are taken in the order of time within a batch. State is held for alerts in their cooldown alone, by event time. The session's
    state store becomes the one for such state.
    """
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = _watched(metrics.withWatermark(ts, LATENESS), rules).groupBy("alert_id", "user_id")
    return grouped.transformWithStateInPandas(Alerts(), ALERTS, "append", "eventTime")


def batch_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """The same alerts over a whole table."""
    return _watched(metrics, rules).groupBy("alert_id", "user_id").applyInPandas(lambda rows: pd.DataFrame(_fired(rows, None)[0], columns=_NAMES), ALERTS)


def counted_alerts(history: DataFrame) -> DataFrame:
    """``history`` with ``trigger_count``: the how-manieth firing of its alert for its user each is."""
    return history.withColumn("trigger_count", F.row_number().over(Window.partitionBy("alert_id", "user_id").orderBy("ts")).cast("long"))


def alert_states(history: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with ``last_triggered`` and ``trigger_count`` over all users of the history."""
    fired = history.groupBy("alert_id").agg(F.max("ts").alias("last_triggered"), F.count("*").alias("trigger_count"))
    return rules.join(fired, "alert_id", "left").withColumn("trigger_count", F.coalesce("trigger_count", F.lit(0)))


def expire_memory(memory: DataFrame, as_of: Column) -> DataFrame:
    """The new snapshot: memories whose time is over are marked deleted; a repeat changes nothing."""
    over = F.col("deleted_at").isNull() & (expires_at() <= as_of)
    return memory.withColumn("deleted_at", F.when(over, as_of).otherwise(F.col("deleted_at")))


def with_metric_defaults(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"time_window": F.coalesce("time_window", F.lit("1h")), "source": F.lit("batch")})


def split_late(stream: DataFrame, ts: str, hours: int = 48, base: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows): a row is late if it is ``hours`` behind the newest row of the batches before its own.

    Each batch leaves a log of one row, the newest time so far, and reads that of the batch before it alone; so a restart with the same
    ``base`` and ``checkpoint`` draws the same line.
    """
    spark, base = stream.sparkSession, base or new_path(stream.sparkSession, "late")
    schema = StructType([*stream.schema, StructField("late", BooleanType())])

    def sink(batch: DataFrame, i: int) -> None:
        line = batch.sparkSession.read.parquet(f"{base}/newest/batch={i - 1}").first()[0] if i else None
        late = F.lit(False) if line is None else F.coalesce(F.col(ts) < F.lit(line) - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{base}/rows/batch={i}")
        newest = batch.sparkSession.read.schema(schema).parquet(f"{base}/rows/batch={i}").agg(F.max(ts).alias("newest"))
        newest.select(F.greatest("newest", F.lit(line).cast(stream.schema[ts].dataType)).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{base}/newest/batch={i}")

    run_once(stream, "append", sink, checkpoint)
    out = spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    return out.where("not late").drop("late"), out.where("late").drop("late")
