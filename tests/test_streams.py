"""Streams of several micro-batches against the batch operators."""

import time
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.freeze import shared_folder
from millrace.operators import logs, sample
from millrace.streaming import jobs


@pytest.fixture(scope="module")
def source(spark):
    """Events of 12 rules in four files, in time order."""
    folder = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    rows = spark.range(2000).select(
        "id",
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(997)) / 10).alias("v"),
    )
    for i in range(4):
        rows.where(F.floor(F.col("id") / 500) == i).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return folder, rows


def run(spark, source, begin):
    sink = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    stream = jobs.file_stream(spark, source[0], source[1].schema, files_per_batch=1)
    done = begin(stream, sink)
    done.awaitTermination()
    assert done.lastProgress["batchId"] >= 3
    return sink, done


def far_rows(rows, z):
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("id", "v", F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.stddev_pop("v").over(w).alias("d"))
    far = F.abs(F.col("v") - F.col("m")) / F.when(F.col("d") == 0, 1.0).otherwise(F.col("d"))
    return {r.id for r in want.where((F.col("n") >= 2) & (far > z)).collect()}


def test_anomalies(spark, source):
    sink, _ = run(spark, source, lambda s, p: jobs.stream_anomalies(s, ["ts", "id"], "k", "v", f"{p}/out", f"{p}/check", 1.6))
    got = spark.read.parquet(f"{sink}/out")
    assert got.columns == ["k", "ts", "id", "v", "mean", "score"]
    assert {r.id for r in got.collect()} == far_rows(source[1], 1.6)
    batch, _ = jobs.running_anomalies(source[1], None, ["ts", "id"], "k", "v", 1.6)
    assert {r.id for r in batch.collect()} == far_rows(source[1], 1.6)


def parts(spark, rows, cuts):
    """The rows in a folder per range of ids."""
    folders = [f"{shared_folder(spark)}/part-{uuid.uuid4().hex}" for _ in cuts]
    for folder, (low, high) in zip(folders, cuts, strict=True):
        rows.where(f"id >= {low} AND id < {high}").coalesce(1).write.parquet(folder)
    return folders


def grow(spark, folder, part):
    spark.read.parquet(part).coalesce(1).write.mode("append").parquet(folder)


def started(spark, folder, schema, base, **options):
    running = jobs.stream_anomalies(jobs.file_stream(spark, folder, schema), ["ts", "id"], "k", "v", f"{base}/out", f"{base}/check", 1.6, **options)
    running.awaitTermination()
    return running


def test_anomalies_go_on_after_a_restart_and_write_only_touched_keys(spark, source):
    rows = source[1].withColumn("v", F.when(F.col("id") % 50 != 7, F.col("v")))
    base, folder = (f"{shared_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("restart", "growing"))
    first, second, third = parts(spark, rows, [(0, 700), (700, 1400), (1400, 2000)])
    for part in (first, second):
        grow(spark, folder, part)
        started(spark, folder, rows.schema, base)
    assert {r.id for r in spark.read.parquet(f"{base}/out").collect()} == far_rows(rows.where("id < 1400 AND v IS NOT NULL"), 1.6)
    spark.read.parquet(third).where("k = 'k3'").coalesce(1).write.mode("append").parquet(folder)
    last = started(spark, folder, rows.schema, base)
    state = last.lastProgress["stateOperators"][0]
    assert state["numRowsUpdated"] == 1 and state["numRowsTotal"] == 12


def test_anomalies_from_a_table_of_the_past(spark, source):
    rows = source[1]
    base, folder = (f"{shared_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("seeded", "later"))
    _, state = jobs.running_anomalies(rows.where("id < 900"), None, ["ts", "id"], "k", "v", 1.6)
    rows.where("id >= 900").coalesce(1).write.parquet(folder)
    started(spark, folder, rows.schema, base, initial=state)
    assert {r.id for r in spark.read.parquet(f"{base}/out").collect()} == {i for i in far_rows(rows, 1.6) if i >= 900}


def test_idle_keys_are_forgotten(spark, source):
    rows = spark.createDataFrame([(i, "a", 1.0 + i % 2) for i in range(10)] + [(10, "b", 1.0), (11, "a", 99.0)], "id long, k string, v double")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.when(F.col("id") < 10, F.col("id")).otherwise(F.col("id") * 1000)))
    for idle_ms, found in ((60_000, 0), (3_600_000_000, 1)):
        base, folder = (f"{shared_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("idle", "in"))
        for part in parts(spark, rows, [(0, 10), (10, 11), (11, 12)]):
            grow(spark, folder, part)
            started(spark, folder, rows.schema, base, idle_ms=idle_ms, watermark="1 second")
        assert spark.read.schema("k string, id long").parquet(f"{base}/out").count() == found


def test_alerts(spark, source):
    stream = lambda s: s.select("k", "ts", "id", (F.col("v") > 30).alias("met"))
    sink, _ = run(spark, source, lambda s, p: jobs.stream_alerts(stream(s), "k", ["ts", "id"], "met", f"{p}/out", f"{p}/state", f"{p}/check", 1200))
    want = logs.alert_intervals(stream(source[1]), "k", ["ts", "id"], "met", 1200)
    expected = {(r.k, "firing", r.fired_at) for r in want.collect()} | {(r.k, "resolved", r.resolved_at) for r in want.where("resolved_at IS NOT NULL").collect()}
    got = [(r.k, r.state, r["at"]) for r in spark.read.parquet(f"{sink}/out").collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_sample(spark, source):
    sink, done = run(spark, source, lambda s, p: jobs.stream_sample(s, 100, ["id"], f"{p}/state", f"{p}/check", 5))
    want = {r.id for r in sample.reservoir_sample(source[1], 100, ["id"], 5).collect()}
    assert {r.id for r in jobs.latest_state(spark, f"{sink}/state", done).collect()} == want


def test_windows(spark, source):
    sink, _ = run(spark, source, lambda s, p: jobs.start(jobs.stream_kpi(s, "ts", "k", "v", "1 hour"), f"{p}/out", f"{p}/check"))
    got = spark.read.parquet(f"{sink}/out")
    want = jobs.stream_kpi(source[1], "ts", "k", "v", "1 hour")
    assert got.count() > 300 and got.select("window_start", "k", "count").exceptAll(want.select("window_start", "k", "count")).count() == 0


def test_sessions_are_merged_before_their_shuffle(spark, source):
    """Sessions across micro-batches equal those of the batch; the merging stands on both sides of the shuffle."""
    begin = lambda stream, sink: jobs.start(jobs.stream_sessions(stream, "ts", "k", "v", "5 minutes", "1 minute"), sink, f"{sink}-state")
    sink, done = run(spark, source, begin)
    lag = F.lag("ts").over(Window.partitionBy("k").orderBy("ts"))
    rows = source[1].withColumn("new", (lag.isNull() | (F.col("ts") >= lag + F.expr("INTERVAL 5 MINUTES"))).cast("int"))
    rows = rows.withColumn("session", F.sum("new").over(Window.partitionBy("k").orderBy("ts")))
    want = rows.groupBy("k", "session").agg(F.min("ts").alias("a"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("s"), F.max("ts").alias("last"))
    end = source[1].agg(F.max("ts")).first()[0]
    closed = {(r.k, r.a, r.n, r.s) for r in want.collect() if (end - r["last"]).total_seconds() >= 6 * 60}
    got = spark.read.parquet(sink).select("k", F.col("window_start").cast("timestamp_ntz").alias("a"), "count", F.round("sum", 6).alias("s"))
    assert {tuple(r) for r in got.collect()} == closed and closed
    plan = done._jsq.explainInternal(False)
    assert "MergingSessions" in plan.split("Exchange")[-1] and "MergingSessions" in plan.split("Exchange")[0]
