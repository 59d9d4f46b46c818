"""Tables kept as numbered snapshots, with the lineage of every load.

A folder holds ``data/`` (Parquet parts, each written once and never changed) and ``log/`` (one JSON line per
version that names the parts of each member table, the rows added, and the job and its inputs). A load writes
its parts first and then publishes the next version by a rename that fails if that version exists. So a load that
fails leaves the table as it was, readers go on with the version they opened, reading from a table
while replacing it is safe, and of two writers at a time one is told to begin again. What feeds a table
is part of its log: lineage cannot be committed without rows, nor rows without lineage.

Only file names pass the driver. A version names all its parts, one per load since the last full one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.io import first_copies, unseen

ROWS = "rows"  # the member of a table that has only one
LOG_SCHEMA = (
    "version int, mode string, parts map<string, array<string>>, added map<string, long>, job string, inputs array<string>,"
    " tenant string, committed_at timestamp, facts map<string, string>"
)


class ConcurrentLoad(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Snapshot:
    """One version: the parts of each member table, the rows that its load added, and facts its writer noted."""

    version: int
    parts: dict[str, list[str]]
    schemas: dict[str, str]
    added: dict[str, int] = field(default_factory=dict)
    facts: dict[str, str] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, oldest first."""
    fs, log = _path(spark, f"{folder}/log")
    if not fs.exists(log):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(log))
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))


def open_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot | None:
    """The latest version, or a named one; None of a folder without any."""
    known = versions(spark, folder)
    if version is None and not known:
        return None
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"no version {version} of {folder}")
    fs, path = _path(spark, _entry(folder, version))
    stream = fs.open(path)
    try:
        entry = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(entry["version"], entry["parts"], entry["schemas"], entry["added"], entry["facts"])


def _entry(folder: str, version: int) -> str:
    return f"{folder}/log/{version:09d}.json"


def read(spark: SparkSession, folder: str, version: int | None = None, member: str = ROWS) -> DataFrame:
    """The rows of a version, by default the latest."""
    snapshot = open_snapshot(spark, folder, version)
    if snapshot is None:
        raise ValueError(f"nothing was loaded into {folder}")
    return read_member(spark, folder, snapshot, member)


def read_member(spark: SparkSession, folder: str, snapshot: Snapshot, member: str) -> DataFrame:
    """The rows of one member table; the schema is that of the log, for a part without rows may have no file."""
    schema = StructType.fromJson(json.loads(snapshot.schemas[member]))
    return spark.read.schema(schema).parquet(*[f"{folder}/data/{part}" for part in snapshot.parts[member]])


@dataclass(frozen=True)
class Part:
    """Rows that are written, and belong to a table once a version names them."""

    name: str
    schema: StructType
    rows: int


def write_part(folder: str, member: str, df: DataFrame, partition_by: Sequence[str] = ()) -> Part:
    """Write a part of a member table without publishing it."""
    name, seen = f"{member}-{uuid4().hex}", Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{folder}/data/{name}")
    return Part(name, df.schema, seen.get["rows"])


def read_parts(spark: SparkSession, folder: str, parts: Sequence[Part]) -> DataFrame:
    """The rows of parts of one member table, published or not."""
    return spark.read.schema(parts[0].schema).parquet(*[f"{folder}/data/{part.name}" for part in parts])


def publish(
    spark: SparkSession,
    folder: str,
    base: Snapshot | None,
    new: Mapping[str, DataFrame | Sequence[Part]],
    kept: Iterable[str] = (),
    mode: str = "full",
    job: str | None = None,
    inputs: Sequence[str] = (),
    tenant: str | None = None,
    facts: Mapping[str, str] | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> Snapshot:
    """Write a part of every table in ``new``, but for parts that are written, and publish the version after ``base``.
    Members named in ``kept`` keep the parts they have; the others consist of their new parts alone."""
    parts = {name: list(base.parts.get(name, ())) if base is not None else [] for name in kept}
    schemas = {name: base.schemas[name] for name in parts if base is not None and name in base.schemas}
    added = {}
    for name, df in new.items():
        schema = df.schema if isinstance(df, DataFrame) else df[0].schema
        if parts.get(name):
            held = _kinds(read_member(spark, folder, base, name).schema)
            if held != _kinds(schema):
                raise ValueError(f"columns of the new rows differ from those of {name}: {_kinds(schema)} and {held}")
        written = [write_part(folder, name, df, (partition_by or {}).get(name, ()))] if isinstance(df, DataFrame) else df
        parts.setdefault(name, []).extend(part.name for part in written)
        schemas[name] = schema.json()
        added[name] = sum(part.rows for part in written)
    version = 1 if base is None else base.version + 1
    now = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    entry = {"version": version, "mode": mode, "parts": parts, "schemas": schemas, "added": added, "job": job, "inputs": list(inputs), "tenant": tenant}
    entry |= {"committed_at": now, "facts": dict(facts or {})}
    _rename_once(spark, folder, version, json.dumps(entry))
    return Snapshot(version, parts, schemas, added, entry["facts"])


def _kinds(schema: StructType) -> dict[str, str]:
    return {column.name: column.dataType.simpleString() for column in schema}


def _rename_once(spark: SparkSession, folder: str, version: int, text: str) -> None:
    fs, draft = _path(spark, f"{folder}/log/.{uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    final = fs.makeQualified(_path(spark, _entry(folder, version))[1])
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    never = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), final, never)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise ConcurrentLoad(f"version {version} of {folder} was published by another load") from e
        raise


def load(
    source: DataFrame,
    folder: str,
    mode: str = "full",
    key: Sequence[str] = (),
    order: Sequence[str] = (),
    gate: Callable[[DataFrame], DataFrame] | None = None,
    job: str | None = None,
    inputs: Sequence[str] = (),
    tenant: str | None = None,
) -> Snapshot:
    """Load rows as the next version. ``full`` replaces the table, ``append`` adds all rows, ``incremental`` those with
    an unseen key (nulls being equal), of each key the first by ``order``.

    ``gate`` is a contract check giving rows of (level, …); one of level ``error`` stops the load."""
    spark = source.sparkSession
    if mode not in ("full", "append", "incremental"):
        raise ValueError(f"unknown load mode {mode!r}")
    if mode == "incremental" and not key:
        raise ValueError("an incremental load needs a key")
    if gate is not None and (errors := gate(source).where("level = 'error'").limit(20).collect()):
        raise ValueError(f"contract broken: {[r.asDict() for r in errors]}")
    base = open_snapshot(spark, folder)
    new = source
    if mode == "incremental":
        new = first_copies(source, key, order) if base is None else unseen(read_member(spark, folder, base, ROWS), source, key, order)
    return publish(spark, folder, base, {ROWS: new}, () if mode == "full" else (ROWS,), mode, job, inputs, tenant)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """One row per version: mode, rows added, job, inputs, tenant, time."""
    if not versions(spark, folder):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(f"{folder}/log")


def lineage(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every load of a table, in the form of ``record_job_lineage``: inputs feed the job, the
    job yields a version of the table; edges carry the version and the rows it added."""
    loads = history(spark, folder).where("job IS NOT NULL")
    artifact = F.concat(F.lit(f"{table}@"), F.col("version"))
    rows = F.aggregate(F.map_values("added"), F.lit(0).cast("long"), lambda total, n: total + n)
    reads = F.transform("inputs", lambda i: F.struct(i.alias("source"), F.col("job").alias("target"), F.lit("reads").alias("edge_type")))
    yields = F.array(F.struct(F.col("job").alias("source"), artifact.alias("target"), F.lit("produces").alias("edge_type")))
    edges = loads.select(F.explode(F.concat(reads, yields)).alias("e"), "version", rows.alias("rows_added")).select("e.*", "version", "rows_added")
    ends = F.array(
        F.struct(F.col("job").alias("node_id"), F.lit("job").alias("node_type")), F.struct(artifact.alias("node_id"), F.lit("artifact").alias("node_type"))
    )
    inputs = F.transform("inputs", lambda i: F.struct(i.alias("node_id"), F.lit("table").alias("node_type")))
    nodes = loads.select(F.explode(F.concat(ends, inputs)).alias("n"), F.col("tenant").alias("tenant_id")).select("n.*", "tenant_id").distinct()
    return nodes, edges


def vacuum(spark: SparkSession, folder: str, keep: int = 2, older_than_seconds: int = 86_400) -> int:
    """Remove versions but the latest ``keep``, and parts that no version left names (what failed loads left, too)
    unless they are younger than so many seconds, which a running load may be writing. Returns the parts removed."""
    if keep < 1:
        raise ValueError("keep must be positive")
    known = versions(spark, folder)
    named = {part for v in known[-keep:] for parts in open_snapshot(spark, folder, v).parts.values() for part in parts}
    for v in known[:-keep]:
        fs, path = _path(spark, _entry(folder, v))
        fs.delete(path, False)
    fs, data = _path(spark, f"{folder}/data")
    before, removed = spark._jvm.java.lang.System.currentTimeMillis() - older_than_seconds * 1000, 0
    for status in fs.listStatus(data) if fs.exists(data) else ():
        if status.getPath().getName() not in named and status.getModificationTime() <= before:
            removed += fs.delete(status.getPath(), True)
    return removed
