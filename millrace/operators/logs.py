"""Operational logs as tables: audit, cost, quotas, objectives, alerts, latency, retention, events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.order import fill_forward, join_totals, lay_out, order_stats, previous, with_index

# --- audit -----------------------------------------------------------------------------------------


def audit_query(
    log: DataFrame,
    ts: str,
    filters: Mapping[str, object] | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    limit: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """All rows that fit the filters within an inclusive time range, newest first, or the first ``limit``."""
    for column, value in (filters or {}).items():
        log = log.where(F.col(column) == F.lit(value))
    if start is not None:
        log = log.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        log = log.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    found = log.orderBy(F.desc(ts), *tie)
    return found if limit is None else found.limit(limit)


def audit_stats(log: DataFrame, ts: str, user: str, resource: str) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(resource).alias("unique_resources"),
        F.count_distinct(user).alias("unique_users"),
        F.min(ts).alias("oldest_record"),
        F.max(ts).alias("newest_record"),
    )


def audit_by_type(log: DataFrame, kind: str) -> DataFrame:
    return log.groupBy(F.col(kind).alias("event_type")).agg(F.count(F.lit(1)).alias("records"))


def integrity_hash(fields: Sequence[str]) -> Column:
    """First 16 hex digits of SHA-256 over the fields joined by colons."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in fields]
    return F.substring(F.sha2(F.concat_ws(":", *texts), 256), 1, 16)


def audit_verify(log: DataFrame, fields: Sequence[str], stored: str) -> DataFrame:
    """Rows whose stored hash does not fit their fields."""
    return log.where(~F.col(stored).eqNullSafe(integrity_hash(fields)))


# --- cost ------------------------------------------------------------------------------------------

# Price of a compute unit (CPU second) and a storage unit (MB).
COMPUTE_PRICE, STORAGE_PRICE = 0.001, 0.0001


def job_cost(log: DataFrame, cpu_seconds: str, storage_mb: str) -> DataFrame:
    cost = F.col(cpu_seconds) * COMPUTE_PRICE + F.col(storage_mb) * STORAGE_PRICE
    return log.withColumn("compute_units", F.col(cpu_seconds)).withColumn("storage_units", F.col(storage_mb)).withColumn("cost", cost)


def cost_by_tenant(
    log: DataFrame, tenant: str, cpu_seconds: str, storage_mb: str, ts: str, since: dt.datetime | None = None
) -> DataFrame:
    """Units and cost per tenant, the mean per job, and the jobs since a time."""
    recent = F.lit(True) if since is None else F.col(ts) >= F.lit(since).cast("timestamp_ntz")
    return (
        job_cost(log, cpu_seconds, storage_mb)
        .groupBy(F.col(tenant).alias("tenant_id"))
        .agg(
            F.sum("compute_units").alias("total_compute_units"),
            F.sum("storage_units").alias("total_storage_units"),
            F.sum("cost").alias("total_cost"),
            F.count(F.lit(1)).alias("total_jobs"),
            F.count_if(recent).alias("recent_jobs_count"),
            F.avg("compute_units").alias("avg_compute_units_per_job"),
        )
    )


# --- quotas ----------------------------------------------------------------------------------------

# Tier, resource, limit and period in seconds. A period of 0 counts the last 300 s.
DAY = 86_400
TIER_LIMITS = (
    ("free", "jobs_per_day", 10, DAY),
    ("free", "jobs_concurrent", 2, 0),
    ("free", "artifact_size_mb", 50, DAY),
    ("free", "total_storage_mb", 500, DAY),
    ("free", "api_calls_per_minute", 60, 60),
    ("free", "cpu_seconds_per_day", 3_600, DAY),
    ("free", "workflows_per_day", 5, DAY),
    ("starter", "jobs_per_day", 100, DAY),
    ("starter", "jobs_concurrent", 10, 0),
    ("starter", "artifact_size_mb", 200, DAY),
    ("starter", "total_storage_mb", 5_000, DAY),
    ("starter", "api_calls_per_minute", 300, 60),
    ("starter", "cpu_seconds_per_day", 14_400, DAY),
    ("starter", "workflows_per_day", 50, DAY),
    ("professional", "jobs_per_day", 1_000, DAY),
    ("professional", "jobs_concurrent", 50, 0),
    ("professional", "artifact_size_mb", 1_000, DAY),
    ("professional", "total_storage_mb", 50_000, DAY),
    ("professional", "api_calls_per_minute", 1_000, 60),
    ("professional", "cpu_seconds_per_day", 86_400, DAY),
    ("professional", "workflows_per_day", 500, DAY),
    ("enterprise", "jobs_per_day", 10_000, DAY),
    ("enterprise", "jobs_concurrent", 200, 0),
    ("enterprise", "artifact_size_mb", 5_000, DAY),
    ("enterprise", "total_storage_mb", 500_000, DAY),
    ("enterprise", "api_calls_per_minute", 5_000, 60),
    ("enterprise", "cpu_seconds_per_day", 864_000, DAY),
    ("enterprise", "workflows_per_day", 5_000, DAY),
)
CONCURRENT_SECONDS = 300
# Daily jobs, artifact GB, sources, concurrent jobs per tier.
PLAN_LIMITS = {
    "free": (10, 1.0, 3, 1),
    "starter": (100, 10.0, 10, 3),
    "professional": (1_000, 100.0, 50, 10),
    "enterprise": (10_000, 1_000.0, 500, 50),
}


def tier_limits(spark: SparkSession) -> DataFrame:
    """(tier, resource, limit, period_seconds); the tier ``unlimited`` has no rows."""
    rows = [(tier, resource, float(limit), period) for tier, resource, limit, period in TIER_LIMITS]
    return spark.createDataFrame(rows, "tier string, resource string, limit double, period_seconds long")


def _within(log: DataFrame, limits: DataFrame, by: Sequence[str], seconds: Column, now: Column, sums: dict[str, Column]) -> DataFrame:
    """``limits`` with sums over the ``log`` rows of the same ``by`` columns from ``seconds`` before ``now`` up to it.

    The distinct periods cut time into steps; the log is summed per key and step first, so a busy key joins as
    no more rows than there are periods. Rows later than ``now`` are not part of any period."""
    by, micros = list(by), (seconds.cast("double") * 1e6).cast("long")
    steps = limits.select(F.sort_array(F.collect_set(micros))).scalar()
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), now)
    framed = log.withColumns({"_age": age, "_steps": steps}).where("_age >= 0")
    stepped = framed.withColumn("_step", F.size(F.filter("_steps", lambda s: s < F.col("_age"))))
    counted = stepped.groupBy(*by, "_step").agg(*[c.alias(name) for name, c in sums.items()])
    numbered = limits.withColumn("_last", F.array_position(steps, micros) - 1)
    keys = [F.col(c).alias(f"_{c}") for c in by]
    joined = numbered.join(counted.select(*keys, "_step", *sums), [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_step") <= F.col("_last")], "left")
    return joined.groupBy(*limits.columns).agg(*[F.sum(name).alias(name) for name in sums])


def quota_usage(
    log: DataFrame, limits: DataFrame, as_of: dt.datetime, requested: float = 1.0, by: Sequence[str] = ("tenant_id", "resource")
) -> DataFrame:
    """Usage in the trailing period per (tenant, resource) that has a limit, and whether a request fits.

    ``log`` has the ``by`` columns, ts and amount; ``limits`` has the ``by`` columns, limit and
    period_seconds. Rows after ``as_of`` do not count."""
    by = list(by)
    period = F.when(F.col("period_seconds") == 0, CONCURRENT_SECONDS).otherwise(F.col("period_seconds"))
    joined = _within(log, limits, by, period, F.lit(as_of).cast("timestamp_ntz"), {"_used": F.sum("amount")})
    used = F.coalesce("_used", F.lit(0.0))
    return joined.select(
        *by,
        used.alias("current_usage"),
        "limit",
        F.when(F.col("limit") > 0, used / F.nullif("limit", F.lit(0.0)) * 100).otherwise(0.0).alias("utilization_percent"),
        F.greatest(F.lit(0.0), F.col("limit") - used).alias("remaining"),
        (used + requested <= F.col("limit")).alias("allowed"),
    )


def tier_usage(log: DataFrame, tenants: DataFrame, as_of: dt.datetime, requested: float = 1.0) -> DataFrame:
    """Usage of every tenant (tenant_id, tier) against the limits of its tier. A tier without limits has no rows:
    whatever it asks for is allowed."""
    limits = tenants.join(F.broadcast(tier_limits(log.sparkSession)), "tier")
    return quota_usage(log, limits, as_of, requested, ("tenant_id", "resource"))


def plan_status(usage: DataFrame) -> DataFrame:
    """Limits of the plan next to usage (tenant_id, tier, jobs_today, artifacts_bytes, sources, running)."""
    limits = usage.sparkSession.createDataFrame(
        [(tier, *values) for tier, values in PLAN_LIMITS.items()],
        "tier string, jobs_limit long, artifacts_limit_gb double, sources_limit long, concurrent_limit long",
    )
    gb = F.col("artifacts_bytes") / (1024.0**3)
    return usage.join(limits, "tier").select(
        "tenant_id",
        "tier",
        "jobs_today",
        "jobs_limit",
        F.greatest(F.lit(0), F.col("jobs_limit") - F.col("jobs_today")).alias("jobs_remaining"),
        F.round(gb, 3).alias("artifacts_gb"),
        "artifacts_limit_gb",
        (F.col("jobs_today") < F.col("jobs_limit")).alias("jobs_allowed"),
        (F.col("artifacts_bytes") < F.col("artifacts_limit_gb") * 1024.0**3).alias("artifacts_allowed"),
        (F.col("sources") < F.col("sources_limit")).alias("sources_allowed"),
        (F.col("running") < F.col("concurrent_limit")).alias("running_allowed"),
    )


# --- objectives and alerts -------------------------------------------------------------------------


def slo_status(points: DataFrame, slos: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rate, compliance and error budget of each objective.

    ``points`` has sli, ts and good (0 or 1); ``slos`` has slo, sli, target and window_hours. Points after
    ``as_of`` do not count."""
    now = F.lit(as_of).cast("timestamp_ntz")
    sums = {"_good": F.sum("good"), "_n": F.count("good")}
    joined = _within(points, slos, ["sli"], F.col("window_hours") * 3_600, now, sums)
    size = F.col("_n")
    rate = F.col("_good") / F.nullif("_n", F.lit(0))
    value = F.coalesce(rate, F.lit(1.0))
    open_budget = 1 - F.col("target")
    left = F.when(
        open_budget > 0, F.greatest(F.lit(0.0), 1 - (1 - value) / F.nullif(open_budget, F.lit(0.0)))
    ).otherwise(F.when(value >= F.col("target"), 1.0).otherwise(0.0))
    return joined.select(
        "slo",
        "sli",
        value.alias("current_value"),
        "target",
        (value >= F.col("target")).alias("is_meeting"),
        left.alias("error_budget_remaining"),
        F.coalesce(size, F.lit(0)).alias("data_points"),
    )


def alert_intervals(signal: DataFrame, rule: str, order: Sequence[str], met: str, for_seconds: float = 0.0) -> DataFrame:
    """Alerts of each rule: pending since, fired at, resolved at (null while firing).

    ``order`` is the time column and a unique key. An alert fires at the first point at which the
    condition has held for the duration, and resolves at the first false point after."""
    runs = alert_runs(signal, rule, order, met, for_seconds).where("fired_at IS NOT NULL")
    return runs.select(rule, F.col(f"run.{order[0]}").alias("pending_since"), "fired_at", "resolved_at")


def alert_runs(signal: DataFrame, rule: str, order: Sequence[str], met: str, for_seconds: float = 0.0) -> DataFrame:
    """Every stretch of true points (``run`` is its first point), fired or not."""
    ts = order[0]
    points = signal.select(rule, *order, F.coalesce(F.col(met), F.lit(False)).alias("met"))
    laid = previous(lay_out(points, list(order), [rule]), "met", "was", [rule])
    begins = F.col("met") & ~F.coalesce("was", F.lit(False))
    laid = laid.withColumn("begin", F.when(begins, F.struct(*order)))
    laid = fill_forward(laid, "begin", "run", [rule]).where("run IS NOT NULL")
    held = F.timestamp_diff("MICROSECOND", F.col(f"run.{ts}"), F.col(ts)) >= int(for_seconds * 1_000_000)
    return laid.groupBy(rule, "run").agg(
        F.min(F.when(F.col("met") & held, F.col(ts))).alias("fired_at"),
        F.min(F.when(~F.col("met"), F.col(ts))).alias("resolved_at"),
    )


def latency_stats(log: DataFrame, operation: str, duration: str, slow_above: float | None = None) -> DataFrame:
    """Range, mean, median, p95 and p99 of each operation (values at int(n·p)); slow ones only, if asked."""
    n = F.col("n")
    picks = {"median": F.floor(n / 2), "p95": F.floor(n * 0.95), "p99": F.floor(n * 0.99)}
    places = order_stats(log, duration, picks, [operation]).drop("n")
    plain = log.where(F.col(duration).isNotNull()).groupBy(operation).agg(
        F.count(F.lit(1)).alias("samples"), F.min(duration).alias("min"), F.max(duration).alias("max"), F.avg(duration).alias("mean")
    )
    stats = join_totals(plain, places, [operation])
    return stats if slow_above is None else stats.where(F.col("p95") > slow_above).orderBy(F.desc("p95"), operation)


# --- retention -------------------------------------------------------------------------------------


def retention_by_age(
    jobs: DataFrame, artifacts: DataFrame, job: str, created: str, as_of: dt.datetime, days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Jobs older than ``days`` and their artifacts, as left-over frames to delete; nothing is deleted."""
    cutoff = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    old = jobs.where(F.col(created) < cutoff)
    return old, artifacts.join(old.select(job), job, "left_semi")


def retention_summary(old_jobs: DataFrame, old_artifacts: DataFrame, size: str) -> DataFrame:
    counts = old_artifacts.agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return counts.select(old_jobs.select(F.count(F.lit(1))).scalar().alias("jobs"), "artifacts", "bytes")


def retention_by_count(artifacts: DataFrame, tenant: str, created: Sequence[str], keep: int = 1000) -> DataFrame:
    """Per tenant the artifacts beyond the newest ``keep``. A tenant of any size is ranked by range."""
    newest = [F.col(c).desc() for c in created]
    return with_index(artifacts, newest, [tenant], "_i").where(F.col("_i") >= keep).drop("_i")


# --- event schemas ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = True
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class EventSchema:
    name: str
    fields: tuple[Field, ...]
    version: str = "1.0.0"
    deprecated: str | None = None


# The event types and their fields.
_JOB = (Field("job_id"), Field("tenant_id"), Field("job_type"))
EVENT_SCHEMAS = (
    EventSchema("job.started", (*_JOB, Field("source_id", required=False), Field("started_at", "datetime"))),
    EventSchema(
        "job.completed",
        (*_JOB, Field("completed_at", "datetime"), Field("duration_seconds", "float"), Field("artifact_count", "integer")),
    ),
    EventSchema(
        "job.failed",
        (*_JOB, Field("failed_at", "datetime"), Field("error_code"), Field("error_message"), Field("retryable", "boolean")),
    ),
    EventSchema(
        "artifact.created",
        (
            Field("artifact_key"), Field("job_id"), Field("tenant_id"),
            Field("artifact_type", "enum", allowed=("profile", "kpi", "quality", "sufficiency", "chart", "narrative")),
            Field("size_bytes", "integer"), Field("created_at", "datetime"),
        ),
    ),
    EventSchema(
        "data.ingested",
        (Field("source_id"), Field("tenant_id"), Field("table_name"), Field("row_count", "integer"), Field("ingested_at", "datetime")),
    ),
    EventSchema(
        "data.drift_detected",
        (Field("source_id"), Field("tenant_id"), Field("drift_score", "float"), Field("columns_drifted", "array"), Field("detected_at", "datetime")),
    ),
    EventSchema(
        "quota.warning",
        (
            Field("tenant_id"),
            Field("quota_type", "enum", allowed=("jobs_per_day", "concurrent_jobs", "storage_gb", "sources_count")),
            Field("current_usage", "float"), Field("limit", "float"), Field("percentage", "float"),
        ),
    ),
    EventSchema(
        "quality.alert",
        (Field("source_id"), Field("score", "float"), Field("failed_checks", "array"), Field("severity", "enum", allowed=("critical", "warning"))),
    ),
)


def _fits(kind: Column, value: Column, field: Field) -> Column:
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    tests = {
        "string": kind == "STRING",
        "datetime": kind == "STRING",
        "integer": kind == "BIGINT",
        "float": number,
        "boolean": kind == "BOOLEAN",
        "array": kind.startswith("ARRAY"),
        "object": kind.startswith("OBJECT"),
    }
    if field.kind == "enum":
        return (kind == "STRING") & F.coalesce(value.isin(*field.allowed), F.lit(False))
    return tests[field.kind]


def validate_events(
    df: DataFrame, name: str, payload: str, schemas: Sequence[EventSchema] = EVENT_SCHEMAS
) -> DataFrame:
    """Add ``errors``, ``warnings`` and ``valid`` to events with a JSON payload.

    The payload is parsed once into a variant; a null value fits every type."""
    parsed = df.withColumn("_p", F.try_parse_json(payload)).withColumn(
        "_keys", F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    )
    has = lambda f: F.array_contains("_keys", f.name)

    def problems(schema: EventSchema) -> Column:
        out = []
        for f in schema.fields:
            path = f"$['{f.name}']"
            kind = F.schema_of_variant(F.try_variant_get("_p", path, "variant"))
            value = F.try_variant_get("_p", path, "string")
            out.append(F.when(F.lit(f.required) & ~has(f), F.lit(f"missing:{f.name}")))
            wrong = has(f) & (kind != "VOID") & ~_fits(kind, value, f)
            out.append(F.when(wrong, F.lit(f"type:{f.name}")))
        return F.array_compact(F.array(*out))

    def remarks(schema: EventSchema) -> Column:
        unknown = F.transform(
            F.array_except("_keys", F.array(*[F.lit(f.name) for f in schema.fields])), lambda k: F.concat(F.lit("unknown:"), k)
        )
        return F.concat(F.array(F.lit("deprecated")), unknown) if schema.deprecated else unknown

    errors = F.array(F.lit("no_schema"))
    warnings = F.array().cast("array<string>")
    for schema in schemas:
        here = F.col(name) == schema.name
        errors = F.when(here, problems(schema)).otherwise(errors)
        warnings = F.when(here, remarks(schema)).otherwise(warnings)
    broken = F.when(F.col(payload).isNull() | F.col("_p").isNull(), F.array(F.lit("not_json"))).otherwise(errors)
    return (
        parsed.withColumn("errors", broken)
        .withColumn("warnings", warnings)
        .withColumn("valid", F.size("errors") == 0)
        .drop("_p", "_keys")
    )
