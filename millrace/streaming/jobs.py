"""Streaming jobs: windowed KPIs, anomalies, event validation, alerts, samples.

Running moments per key live in the state store, of which a batch touches only its own keys. Alerts and
samples run per micro-batch: the batch is ranged over as many partitions as it needs, so a hot key is not
one task's work, and the state (open runs, the sample) is a small table written per batch. Writing a batch
again replaces it, so a restart repeats nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from millrace.functions.order import join_totals, lay_out, running_sums
from millrace.operators.logs import EVENT_SCHEMAS, EventSchema, alert_runs, validate_events
from millrace.operators.sample import bottom_n


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the files of a folder. For topics use ``spark.readStream.format("kafka")`` instead."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def start(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write a stream to parquet; without ``every`` it stops once it has read what is there."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def each_batch(
    stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_kpi(
    stream: DataFrame, ts: str, key: str, value: str, window: str, slide: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """Count, sum and mean per key and window; rows later than the watermark are dropped.

    Works the same on a batch DataFrame."""
    rows = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    span = F.window("_at", window, slide) if slide else F.window("_at", window)
    return _kpi(rows.withWatermark("_at", watermark).groupBy(span.alias("w"), key), key, value)


def stream_sessions(stream: DataFrame, ts: str, key: str, value: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """The same over sessions that end after a gap without rows of the key.

    Rows are merged into sessions inside each input partition and only sessions are shuffled by key, so that a key
    with a third of the rows is merged by several tasks. The setting for that is turned on for the Spark session."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = stream.withColumn("_at", F.col(ts).cast("timestamp"))
    return _kpi(rows.withWatermark("_at", watermark).groupBy(F.session_window("_at", gap).alias("w"), key), key, value)


def _kpi(grouped, key: str, value: str) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("avg")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "count", "sum", "avg"
    )


# --- state kept as a table -------------------------------------------------------------------------

SLOTS = 3  # states of the latest batches that are kept, so that a repeated batch finds the one before it


def _slot(folder: str, batch: int) -> str:
    return f"{folder}/slot={batch % SLOTS}"


def _state(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    return spark.read.parquet(_slot(folder, batch - 1)) if batch > 0 else None


def _out(df: DataFrame, sink: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")


def running_anomalies(
    rows: DataFrame, state: DataFrame | None, order: Sequence[str], key: str, value: str, z: float
) -> tuple[DataFrame, DataFrame]:
    """Rows further than z deviations from the mean of the rows of their key before them, and the new
    state (key, n, mean, m2).

    Sums are taken of distances from a centre per key, which keeps them exact enough."""
    centres = rows.groupBy(key).agg(F.avg(value).alias("_first"))
    if state is None:
        known = centres.select(key, F.col("_first").alias("_c"), F.lit(0).cast("long").alias("_n0"), F.lit(0.0).alias("_m0"))
    else:
        joined = centres.join(state, key, "left")
        known = joined.select(
            key,
            F.coalesce("mean", "_first").alias("_c"),
            F.coalesce("n", F.lit(0)).cast("long").alias("_n0"),
            F.coalesce("m2", F.lit(0.0)).alias("_m0"),
        )
    distances = join_totals(rows, known, [key]).withColumn("_d", F.col(value) - F.col("_c"))
    distances = distances.withColumn("_dd", F.col("_d") * F.col("_d")).withColumn("_one", F.lit(1).cast("long"))
    run = running_sums(lay_out(distances, list(order), [key]), {"_sd": "_d", "_sdd": "_dd", "_s1": "_one"}, [key])
    n = F.col("_n0") + F.col("_s1") - 1
    shift = (F.col("_sd") - F.col("_d")) / F.nullif(n, F.lit(0))
    spread = F.col("_m0") + F.col("_sdd") - F.col("_dd") - n * shift * shift
    deviation = F.sqrt(F.greatest(F.lit(0.0), spread) / F.nullif(n, F.lit(0)))
    mean = F.col("_c") + shift
    score = F.abs(F.col(value) - mean) / F.when(deviation == 0, 1.0).otherwise(deviation)
    flagged = run.where((n >= 2) & (score > z)).select(key, *order, value, mean.alias("mean"), score.alias("score"))
    sums = distances.groupBy(key).agg(
        F.max("_c").alias("_c"), F.max("_n0").alias("_n0"), F.max("_m0").alias("_m0"),
        F.sum("_d").alias("_d"), F.sum("_dd").alias("_dd"), F.count(F.lit(1)).alias("_k"),
    )
    total = F.col("_n0") + F.col("_k")
    moved = F.col("_d") / total
    new = sums.select(
        key, total.alias("n"), (F.col("_c") + moved).alias("mean"),
        F.greatest(F.lit(0.0), F.col("_m0") + F.col("_dd") - total * moved * moved).alias("m2"),
    )
    if state is not None:
        new = state.join(rows.select(key).distinct(), key, "left_anti").unionByName(new)
    return flagged, new


class RunningMoments(StatefulProcessor):
    """Count, mean and sum of squared distances of each key, kept in the state store; scores each row against them.

    Rows of a key are put in order within a micro-batch, so a task holds the order columns and values of one key of one
    micro-batch, whose size the source's options bound. Only keys with new rows are read and written. With ``idle_ms``
    the rows carry ``ms``, and a key is forgotten once the watermark is so far beyond its latest row."""

    def __init__(self, order: list[str], z: float, idle_ms: int | None):
        self.order, self.z, self.idle_ms = order, z, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.moments = handle, handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.moments.update((int(row["n"]), float(row["mean"]), float(row["m2"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        if self.idle_ms is not None:
            self._put_off(int(frame["ms"].max()) + self.idle_ms, timerValues.getCurrentWatermarkInMs())
        frame = frame.loc[frame["v"].notna(), [*self.order, "v"]].sort_values(self.order, kind="stable", ignore_index=True)
        if len(frame):
            n, mean, m2 = self.moments.get() if self.moments.exists() else (0, float(frame["v"].iloc[0]), 0.0)
            score, means, state = moments_step(frame["v"].to_numpy(float), n, mean, m2)
            self.moments.update(state)
            far = score > self.z
            if far.any():
                found = frame[far]
                found.insert(0, "k", key[0])
                yield found.assign(mean=means[far], score=score[far])

    def _put_off(self, until: int, watermark: int) -> None:
        """One timer per key, at the latest time asked for."""
        for known in list(self.handle.listTimers()):
            until = max(until, known)
            self.handle.deleteTimer(known)
        self.handle.registerTimer(max(until, watermark + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.moments.clear()
        return iter([])

    def close(self) -> None:
        pass


def moments_step(values: np.ndarray, n: int, mean: float, m2: float) -> tuple[np.ndarray, np.ndarray, tuple[int, float, float]]:
    """Scores and means of ordered values against all before them (no score before the third), and the new state.

    Sums are taken of distances from the mean so far, which keeps them exact enough."""
    d = values - mean
    before = n + np.arange(len(values))
    known = np.maximum(before, 1)
    shift = (np.cumsum(d) - d) / known
    spread = np.maximum(m2 + np.cumsum(d * d) - d * d - before * shift * shift, 0)
    deviation = np.sqrt(spread / known)
    score = np.abs(d - shift) / np.where(deviation == 0, 1.0, deviation)
    total = n + len(values)
    moved = float(d.sum()) / total
    return np.where(before >= 2, score, -1.0), mean + shift, (total, mean + moved, max(0.0, m2 + float((d * d).sum()) - total * moved * moved))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, off the heap and with changes per batch only."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def scored_stream(
    stream: DataFrame,
    order: Sequence[str],
    key: str,
    value: str,
    z: float = 3.0,
    idle_ms: int | None = None,
    watermark: str = "10 minutes",
    initial: DataFrame | None = None,
) -> DataFrame:
    """The stream of (key, order columns, value, mean, score) of rows further than z deviations from the mean of the rows
    of their key before them. ``initial`` (key, n, mean, m2) is what a table of the past left, from
    ``running_anomalies``, which spreads hot keys. Rows without a value are passed over.

    With ``idle_ms`` the first order column is the event time; rows later than the watermark are dropped."""
    # Python's workers rename columns that begin with an underscore, so the rows get names of their own.
    names = {"k": key, **{f"o{i}": c for i, c in enumerate(order)}, "v": value}
    rows = stream.select(*[F.col(c).alias(name) for name, c in names.items()])
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", mean double, score double"
    if idle_ms is not None:
        rows = rows.withColumn("at", F.col("o0").cast("timestamp")).withWatermark("at", watermark).withColumn("ms", F.unix_millis("at"))
    processor = RunningMoments([f"o{i}" for i in range(len(order))], z, idle_ms)
    known = None if initial is None else initial.select(F.col(key).cast(stream.schema[key].dataType).alias("k"), "n", "mean", "m2").groupBy("k")
    found = rows.groupBy("k").transformWithStateInPandas(processor, schema, "append", "none" if idle_ms is None else "eventTime", known)
    return found.select(*[F.col(name).alias(c) for name, c in names.items()], "mean", "score")


def stream_anomalies(
    stream: DataFrame,
    order: Sequence[str],
    key: str,
    value: str,
    sink: str,
    checkpoint: str,
    z: float = 3.0,
    idle_ms: int | None = None,
    watermark: str = "10 minutes",
    initial: DataFrame | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """z-score of each row against the running mean and deviation of its key; see ``scored_stream``. A restart goes on
    from the state of the checkpoint."""
    with rocksdb(stream.sparkSession):
        return start(scored_stream(stream, order, key, value, z, idle_ms, watermark, initial), sink, checkpoint, "append", every)


def stream_validate(
    stream: DataFrame,
    name: str,
    payload: str,
    valid_sink: str,
    invalid_sink: str,
    checkpoint: str,
    schemas: Sequence[EventSchema] = EVENT_SCHEMAS,
    every: str | None = None,
) -> StreamingQuery:
    """Check event payloads; valid and invalid events go to two sinks."""

    def job(rows: DataFrame, batch: int) -> None:
        checked = validate_events(rows, name, payload, schemas).persist()
        try:
            _out(checked.where("valid").drop("errors", "valid"), valid_sink, batch)
            _out(checked.where("NOT valid").drop("valid"), invalid_sink, batch)
        finally:
            checked.unpersist()

    return each_batch(stream, job, checkpoint, every)


def alert_step(
    rows: DataFrame, state: DataFrame | None, rule: str, order: Sequence[str], met: str, for_seconds: float
) -> tuple[DataFrame, DataFrame]:
    """Transitions (rule, state, at) of one batch and the runs that stay open.

    An open run comes back as its first point, and as the point at which it fired."""
    points = rows.select(rule, *order, F.col(met).alias("met"))
    if state is not None:
        ts = order[0]
        began = state.select(rule, "run.*", F.lit(True).alias("met"))
        fired = state.where("fired_at IS NOT NULL").select(rule, F.col("fired_at").alias(ts), *[f"run.{c}" for c in order[1:]], F.lit(True).alias("met"))
        points = points.unionByName(began).unionByName(fired)
    runs = alert_runs(points, rule, order, "met", for_seconds)
    if state is not None:
        runs = join_totals_left(runs, state.select(rule, F.col("run").alias("_run"), F.col("fired_at").alias("_was")), rule)
    else:
        runs = runs.withColumn("_was", F.lit(None).cast("timestamp_ntz"))
    firing = runs.where("fired_at IS NOT NULL AND _was IS NULL").select(rule, F.lit("firing").alias("state"), F.col("fired_at").alias("at"))
    resolved = runs.where("fired_at IS NOT NULL AND resolved_at IS NOT NULL").select(
        rule, F.lit("resolved").alias("state"), F.col("resolved_at").alias("at")
    )
    still = runs.where("resolved_at IS NULL").select(rule, "run", "fired_at")
    return firing.unionByName(resolved), still


def join_totals_left(runs: DataFrame, state: DataFrame, rule: str) -> DataFrame:
    """Attach when an open run had fired before."""
    renamed = state.withColumnRenamed(rule, "_rule")
    same = F.col(rule).eqNullSafe(F.col("_rule")) & (F.col("run") == F.col("_run"))
    return runs.join(renamed, same, "left").drop("_rule", "_run")


def stream_alerts(
    stream: DataFrame, rule: str, order: Sequence[str], met: str, sink: str, state: str, checkpoint: str, for_seconds: float = 0.0, every: str | None = None
) -> StreamingQuery:
    """pending, firing, resolved per rule over a stream of true/false points."""

    def job(rows: DataFrame, batch: int) -> None:
        changes, still = alert_step(rows, _state(rows.sparkSession, state, batch), rule, order, met, for_seconds)
        _out(changes, sink, batch)
        still.write.mode("overwrite").parquet(_slot(state, batch))

    return each_batch(stream, job, checkpoint, every)


def stream_sample(
    stream: DataFrame, n: int, key: Sequence[str], state: str, checkpoint: str, seed: int = 0, every: str | None = None
) -> StreamingQuery:
    """Uniform sample of n rows over the stream so far: the n smallest seeded hashes, merged per batch."""

    def job(rows: DataFrame, batch: int) -> None:
        before = _state(rows.sparkSession, state, batch)
        merged = bottom_n(rows if before is None else before.unionByName(rows), n, key, seed)
        merged.write.mode("overwrite").parquet(_slot(state, batch))

    return each_batch(stream, job, checkpoint, every)


def latest_state(spark: SparkSession, folder: str, query: StreamingQuery) -> DataFrame:
    """The state after the last batch of a finished query."""
    return spark.read.parquet(_slot(folder, query.lastProgress["batchId"] if query.lastProgress else 0))
