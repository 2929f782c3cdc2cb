"""Streaming jobs: restarts, state that goes, windows that close, buckets that aren't read."""

import datetime as dt
import random

from pyspark.sql import functions as F

from presswire.streaming import jobs

AT = dt.datetime(2024, 1, 1)
METRICS = "event_id long, ts timestamp, user_id long, metric string, value double"
RULES = "alert_id string, metric string, operator string, threshold double, cooldown_minutes int"


def metrics_of(n, minutes=20, seed=5):
    rng = random.Random(seed)
    return [(i, AT + dt.timedelta(minutes=minutes * i), i % 3, rng.choice("mk"), float(rng.randint(0, 9))) for i in range(n)]


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_alerts_go_on_after_a_restart(spark, tmp_path):
    path, where = str(tmp_path / "in"), f"file://{tmp_path}/checkpoint"
    rows = metrics_of(200)
    rules = spark.createDataFrame([("high", "m", ">", 6.0, 90), ("low", "k", "<", 3.0, 1440), ("edge", "m", ">", 9.0, 1)], RULES)
    read = lambda: jobs.stream_alerts(spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).parquet(path), rules)
    found = []
    for a, b in ((0, 40), (40, 110), (110, 200)):
        put(spark, path, rows[a:b], METRICS)
        found += jobs.collected(read(), where).collect()
    want = jobs.batch_alerts(spark.createDataFrame(rows, METRICS), rules).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) > 10
    counted = jobs.counted_alerts(spark.createDataFrame(want)).groupBy("alert_id", "user_id").agg(F.max("trigger_count").alias("n"), F.count("*").alias("m"))
    assert counted.where("n <> m").count() == 0


def test_alert_state_goes_when_it_is_idle(spark, tmp_path):
    """Thousands of users fire once; after their cooldown, and the lateness, no state of them is left."""
    path = str(tmp_path / "in")
    put(spark, path, [(i, AT, i, "m", 9.0) for i in range(500)], METRICS)
    for day in (1, 5, 9):
        put(spark, path, [(1000 + day, AT + dt.timedelta(days=day), 1, "m", 0.0)], METRICS)
    rules = spark.createDataFrame([("high", "m", ">", 6.0, 90)], RULES)
    stream = jobs.stream_alerts(spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).parquet(path), rules)
    numbers = []
    query = jobs.run_once(stream, "append", jobs._into(f"file://{tmp_path}/out", numbers))
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) >= 500 and states[-1] <= 2
    assert jobs._read_batches(stream, f"file://{tmp_path}/out", numbers).count() == 500


def events_of(n=600):
    rng = random.Random(9)
    return [(i, AT + dt.timedelta(minutes=37 * i + rng.randint(0, 30)), rng.choice("ab"), rng.randint(0, 4)) for i in range(n)]


EVENTS = "event_id long, ts timestamp, kind string, user_id long"


def test_windows_close_once_and_state_is_dropped(spark, tmp_path):
    path, rows = str(tmp_path / "in"), events_of()
    for k in range(0, 600, 100):
        put(spark, path, rows[k : k + 100], EVENTS)
    batch = spark.createDataFrame(rows, EVENTS)
    sessions = lambda e: jobs.search_sessions(e.withColumns({"clicked_result_ids": F.when(F.col("kind") == "a", F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), "results_count": F.col("event_id") % 2}))
    for build, most in ((lambda e: jobs.hourly_counts(e, "kind"), 250), (lambda e: jobs.momentum(e, "kind"), 350), (sessions, 60)):
        progress = []
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
        found = jobs.flushed(stream, build, "ts", progress)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, build(batch).collect()))
        states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
        assert max(states) <= most < len(rows), states  # of the windows of two days and a file, not of all
    none = jobs.flushed(spark.readStream.schema(EVENTS).parquet(f"{path}/*"), lambda e: jobs.hourly_counts(e.where("false"), "kind"))
    assert none.count() == 0


def test_ingest_reads_the_buckets_of_a_batch_alone(spark, tmp_path):
    path, base, where = str(tmp_path / "in"), f"file://{tmp_path}/stored", f"file://{tmp_path}/checkpoint"
    schema = "url_hash string, created_at timestamp"
    read = lambda: spark.readStream.schema(schema).parquet(path)
    keys = [f"k{i}" for i in range(300)]
    put(spark, path, [(k, AT) for k in keys], schema)
    assert jobs.ingest_new(read(), base, where).count() == 300
    bucket = {r["k"]: r["b"] for r in spark.createDataFrame([(k,) for k in [*keys, "new"]], "k string").withColumn("b", F.pmod(F.xxhash64("k"), F.lit(jobs.BUCKETS))).collect()}
    touched = {bucket["k7"], bucket["new"]}
    files = [f for f in (tmp_path / "stored").rglob("*.parquet") if int(f.parent.name.split("=")[1]) not in touched]
    kept = {f: f.read_bytes() for f in files}
    for f in files:  # of other buckets nothing can be read now
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        f.write_bytes(b"not a table")
    put(spark, path, [("k7", AT + dt.timedelta(days=9)), ("new", AT + dt.timedelta(days=9))], schema)
    jobs.ingest_new(read(), base, where)
    for f, body in kept.items():
        f.write_bytes(body)
    stored = [r["url_hash"] for r in spark.read.schema(schema).parquet(str(tmp_path / "stored" / "*" / "*")).collect()]
    assert sorted(stored) == sorted([*keys, "new"]) and len(files) > 20


def test_late_rows_need_one_row_of_log(spark, tmp_path):
    path, base, where = str(tmp_path / "in"), f"file://{tmp_path}/late", f"file://{tmp_path}/checkpoint"
    read = lambda: spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    days = [0, 10, 3, 9, 1, 12, 9.5]
    for k, d in enumerate(days[:4]):
        put(spark, path, [(k, AT + dt.timedelta(days=d)), (100 + k, None)], "event_id long, ts timestamp")
    jobs.split_late(read(), "ts", 48, base, where)
    for f in (tmp_path / "late" / "rows").rglob("*.parquet"):  # rows of earlier batches aren't read
        if "batch=3" not in str(f):
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
            f.rename(f.with_suffix(".kept"))
    for k, d in enumerate(days[4:], 4):
        put(spark, path, [(k, AT + dt.timedelta(days=d))], "event_id long, ts timestamp")
    jobs.split_late(read(), "ts", 48, base, where)
    for f in (tmp_path / "late" / "rows").rglob("*.kept"):
        f.rename(f.with_suffix(".parquet"))
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    late = sorted(r["event_id"] for r in rows.where("late").collect())
    newest, want = None, []
    for k, d in enumerate(days):
        if newest is not None and d < newest - 2:
            want.append(k)
        newest = d if newest is None else max(newest, d)
    assert late == want and rows.where("not late AND event_id >= 100").count() == 4


def test_stages_batch_by_batch_equal_one_batch(spark, tmp_path):
    """Texts that come again, in a batch or later, after a restart, are stored, cut and indexed once."""
    schema = "article_id long, clean_text string, title_norm string, language string"
    rows = [(i, f"first line {i % 7} of the text\nsecond line {i % 5}" if i % 6 else None if i % 4 else "", f"t{i}", "en") for i in range(40)]
    path = str(tmp_path / "in")
    stages, where = f"file://{tmp_path}/stages", f"file://{tmp_path}/checkpoint"
    for k in range(0, 40, 10):
        put(spark, path, rows[k : k + 10], schema)
        found = jobs.stream_stages(spark.readStream.schema(schema).parquet(path), stages, where)
    put(spark, str(tmp_path / "all"), rows, schema)
    whole = jobs.stream_stages(spark.readStream.schema(schema).parquet(str(tmp_path / "all")))
    ids = lambda x: sorted(r["article_id"] for r in x[0].collect())
    chunks = lambda x: sorted((r["article_id"], r["chunk_index"], r["chunk_text"]) for r in x[1].collect())
    postings = lambda x: sorted((r["term"], r["id"], tuple(r["positions"])) for r in x[2].postings().collect())
    assert ids(found) == ids(whole) and chunks(found) == chunks(whole) and postings(found) == postings(whole) and len(ids(found)) > 20
    assert len({t for _, t, *_ in rows if t}) + 1 == len(ids(found))
