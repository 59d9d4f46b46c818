"""Reading, writing, ingesting and previewing tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".pq": "parquet"}


def detect_format(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no format known for {path!r}")
    return FORMATS[suffix]


def read_source(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None, **options: str
) -> DataFrame:
    """Load a file or folder. Name the schema for large text sources: inference reads them twice."""
    fmt = fmt or detect_format(path)
    reader = spark.read.format("json" if fmt == "jsonl" else fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    return reader.options(**options).load(path)


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"cannot export as {fmt!r}")
    writer = df.write.format(fmt).mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_copies(source: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, nulls being equal: the smallest by ``order`` and then by all columns as they stand."""
    rest = [c for c in source.columns if c not in key]
    if not rest:
        return source.distinct()
    ranked = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)] + [F.col(c).alias(c) for c in rest]
    picked = source.groupBy(*key).agg(F.min(F.struct(*ranked)).alias("_first"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in source.columns])


def unseen(base: DataFrame, source: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Source rows whose key, nulls included, is not in the target yet; of several copies the first by ``order``."""
    held = base.select(*[F.col(c).alias(f"_held_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key]
    return first_copies(source.join(held, same, "left_anti"), key, order)


def _append(new: DataFrame, target: str, mode: str) -> int:
    """Write and count in one pass."""
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(target)
    return seen.get["rows"]


def ingest_table(
    source: DataFrame,
    target: str,
    mode: str = "full",
    key: Sequence[str] = (),
    gate: Callable[[DataFrame], DataFrame] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Write ``source`` to the parquet table at ``target``; returns one row with the rows written.

    ``full`` replaces the table, ``incremental`` adds rows with unseen keys, of each key the first by ``order``. ``gate`` is a contract
    check giving rows of (level, …); a row of level ``error`` stops the load before anything is
    written."""
    spark = source.sparkSession
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown ingest mode {mode!r}")
    if gate is not None:
        errors = gate(source).where("level = 'error'").limit(20).collect()
        if errors:
            raise ValueError(f"contract broken: {[r.asDict() for r in errors]}")
    if mode == "full" or not _exists(spark, target):
        new = source if mode == "full" or not key else first_copies(source, key, order)
        written = _append(new, target, "overwrite")
    else:
        if not key:
            raise ValueError("incremental ingest needs a key")
        written = _append(unseen(spark.read.parquet(target), source, key, order), target, "append")
    return spark.createDataFrame([(written, mode)], "rows_ingested long, mode string")


def table_preview(df: DataFrame, n: int = 100, order: Sequence[str] = (), items: int = 100) -> DataFrame:
    """The first ``n`` rows by ``order`` (without one, any), arrays cut to ``items``, with the row count of the
    whole table."""
    shown = [
        F.slice(F.col(f.name), 1, items).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in df.schema.fields
    ]
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.orderBy(*order) if order else df).limit(n).select(*shown, total.alias("total_rows"))


def etl(
    spark: SparkSession,
    source: str,
    steps: Sequence[Callable[[DataFrame], DataFrame]],
    target: str,
    gate: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Read parquet, apply the steps in order, check the result, overwrite the target, read it back."""
    df = spark.read.parquet(source)
    for step in steps:
        df = step(df)
    ingest_table(df, target, "full", gate=gate)
    return spark.read.parquet(target)
