"""Data contracts, schema changes and baselines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.order import lay_out, previous

# Physical type names each contract type accepts (as parts of the name), the Spark type
# used to read it, and its JSON Schema type.
#: Spark types that a contract type takes; types inside arrays, maps and structs do not count.
_NUMBERS = (T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
ACCEPTED = {
    "string": (T.StringType, T.CharType, T.VarcharType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": _NUMBERS,
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "datetime": _TIMES,
    "timestamp": _TIMES,
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}
READ_AS = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
    "array": T.ArrayType(T.StringType()),
    "object": T.MapType(T.StringType(), T.StringType()),
    "any": T.StringType(),
}
#: The same by the first word of a type's name.
ACCEPTED_NAMES = {
    "string": ("string", "char", "varchar"),
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "float": ("float", "double", "decimal"),
    "boolean": ("boolean",),
    "date": ("date",),
    "datetime": ("timestamp", "timestamp_ntz"),
    "timestamp": ("timestamp", "timestamp_ntz"),
    "array": ("array",),
    "object": ("struct", "map"),
}
JSON_TYPE = {"float": "number", "date": "string", "datetime": "string", "timestamp": "string", "any": "string"}
TYPE_RANK = {
    "int": 1, "integer": 1, "smallint": 1, "bigint": 2, "long": 2, "float": 3, "double": 4, "decimal": 5,
    "numeric": 5, "string": 10, "text": 10, "varchar": 10, "char": 10,
}
UNKNOWN_RANK = 99


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "any"
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: tuple[object, ...] = ()
    unique: bool = False
    max_null_rate: float | None = None
    sensitive: bool = False

    def __post_init__(self):
        if self.type not in READ_AS:
            raise ValueError(f"unknown contract type {self.type!r}")


@dataclass(frozen=True)
class Contract:
    name: str
    columns: tuple[ColumnSpec, ...]
    version: str = "1.0.0"
    completeness: float | None = None
    freshness_column: str | None = None
    freshness_hours: float | None = None

    def read_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, READ_AS[c.type], c.nullable) for c in self.columns])

    def sensitive_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.sensitive]

    def json_schema(self) -> dict:
        fields: dict[str, dict] = {}
        for c in self.columns:
            entry: dict[str, object] = {"type": JSON_TYPE.get(c.type, c.type)}
            named = (("minimum", c.low), ("maximum", c.high), ("minLength", c.min_length), ("maxLength", c.max_length), ("pattern", c.pattern))
            entry.update({k: v for k, v in named if v is not None})
            if c.allowed:
                entry["enum"] = list(c.allowed)
            fields[c.name] = entry
        required = [c.name for c in self.columns if not c.nullable]
        return {"title": self.name, "type": "object", "properties": fields, "required": required}


def validate_schema(df: DataFrame, contract: Contract) -> DataFrame:
    """(column, level, code, expected, actual) for every difference between table and contract."""
    have = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for c in contract.columns:
        if c.name not in have:
            rows.append((c.name, "warning" if c.nullable else "error", "missing_optional" if c.nullable else "missing_required", c.type, None))
        elif c.type != "any" and not isinstance(have[c.name], ACCEPTED[c.type]):
            rows.append((c.name, "error", "type_mismatch", c.type, have[c.name].simpleString()))
    named = {c.name for c in contract.columns}
    rows += [(name, "warning", "extra_column", None, kind.simpleString()) for name, kind in have.items() if name not in named]
    schema = "column string, level string, code string, expected string, actual string"
    return df.sparkSession.createDataFrame(rows, schema)


def validate_schemas(fields: DataFrame, contract: Contract, by: Sequence[str]) -> DataFrame:
    """(by, column, level, code, expected, actual): ``validate_schema`` for many registered schemas at once.

    ``fields`` has a row (by, name, type) per field; a schema without fields is not among them. One shuffle by
    ``by``; null is a schema's key like any other. Of a name that occurs twice the type that sorts first counts."""
    have = F.array_sort(F.collect_set(F.struct("name", F.lower("type").alias("type")))).alias("have")
    schemas = fields.groupBy(*by).agg(have)

    def finding(name: Column, level: str, code: str, expected: str | None, actual: Column) -> Column:
        text = F.lit(expected).cast("string")
        return F.struct(name.alias("column"), F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("expected"), actual.cast("string").alias("actual"))

    def named(name: str) -> Callable[[Column], Column]:
        return lambda f: f["name"] == name

    found = []
    for c in contract.columns:
        kind = F.get(F.filter("have", named(c.name)), F.lit(0))["type"]
        level, code = ("warning", "missing_optional") if c.nullable else ("error", "missing_required")
        missing = F.when(kind.isNull(), finding(F.lit(c.name), level, code, c.type, F.lit(None)))
        if c.type != "any":
            fits = F.regexp_extract(kind, "^[a-z_]+", 0).isin(*ACCEPTED_NAMES[c.type])
            missing = missing.when(~fits, finding(F.lit(c.name), "error", "type_mismatch", c.type, kind))
        found.append(missing)
    extra = F.filter("have", lambda f: ~f["name"].isin(*[c.name for c in contract.columns]))
    extras = F.transform(extra, lambda f: finding(f["name"], "warning", "extra_column", None, f["type"]))
    return schemas.select(*by, F.inline(F.concat(F.array_compact(F.array(*found)), extras)))


def _row_rules(c: ColumnSpec) -> dict[str, Column]:
    """Tests a single row can break, by rule name; null only breaks ``not_null``."""
    value, rules = F.col(c.name), {}
    if not c.nullable:
        rules["not_null"] = value.isNull()
    if c.low is not None or c.high is not None:
        below = value < c.low if c.low is not None else F.lit(False)
        above = value > c.high if c.high is not None else F.lit(False)
        rules["range"] = below | above
    if c.min_length is not None or c.max_length is not None:
        short = F.length(value) < c.min_length if c.min_length is not None else F.lit(False)
        long = F.length(value) > c.max_length if c.max_length is not None else F.lit(False)
        rules["length"] = short | long
    if c.pattern is not None:
        rules["pattern"] = ~F.regexp_like(value, F.lit(c.pattern))
    if c.allowed:
        rules["enum"] = ~value.isin(*c.allowed)
    return rules


def validate_rows(df: DataFrame, contract: Contract, as_of: dt.datetime | None = None) -> DataFrame:
    """(column, rule, failures, total_rows, passed) for every rule of the contract, in one aggregation."""
    columns = [c for c in contract.columns if c.name in df.columns]
    total = F.count(F.lit(1))
    cells = []

    def cell(name: str, rule: str, failures: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(rule).alias("rule"),
            failures.cast("long").alias("failures"),
            total.alias("total_rows"),
            F.coalesce(passed, F.lit(True)).alias("passed"),
        )

    for c in columns:
        for rule, broken in _row_rules(c).items():
            failures = F.count_if(broken)
            cells.append(cell(c.name, rule, failures, failures == 0))
        nulls = F.count_if(F.col(c.name).isNull())
        if c.max_null_rate is not None:
            cells.append(cell(c.name, "max_null_rate", nulls, nulls / F.nullif(total, F.lit(0)) <= c.max_null_rate))
        if c.unique:
            repeats = F.count(c.name) - F.count_distinct(c.name)
            cells.append(cell(c.name, "unique", repeats, repeats == 0))
    if contract.completeness is not None and columns:
        known = sum((F.count(c.name) for c in columns[1:]), F.count(columns[0].name))
        wanted = total * len(columns)
        cells.append(cell("*", "completeness", wanted - known, known / F.nullif(wanted, F.lit(0)) >= contract.completeness))
    if contract.freshness_column and contract.freshness_hours is not None and as_of is not None:
        oldest = as_of - dt.timedelta(hours=contract.freshness_hours)
        fresh = F.max(contract.freshness_column) >= F.lit(oldest)
        cells.append(cell(contract.freshness_column, "freshness", F.when(fresh, 0).otherwise(1), fresh))
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def violating_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows that break a row rule, with the names of the broken rules."""
    broken = [
        F.when(test, F.lit(f"{c.name}:{rule}"))
        for c in contract.columns
        if c.name in df.columns
        for rule, test in _row_rules(c).items()
    ]
    return df.withColumn("broken_rules", F.array_compact(F.array(*broken))).where(F.size("broken_rules") > 0)


# --- schema changes ------------------------------------------------------------------------------

FIELD = "struct<name:string,type:string,nullable:boolean,default:string>"


def schema_rows(spark: SparkSession, schema: T.StructType, defaults: dict[str, str] | None = None) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable, (defaults or {}).get(f.name)) for f in schema.fields]
    return spark.createDataFrame(rows, "name string, type string, nullable boolean, default string")


def _rank(kind: str) -> Column:
    bare = F.regexp_replace(F.lower(F.col(kind)), r"\(.*\)", "")
    ranks = F.create_map(*[F.lit(x) for pair in TYPE_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, bare), F.lit(UNKNOWN_RANK))


def _changes(both: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Change rows out of joined old (o_) and new (n_) fields. A field can change in several ways."""
    added, removed = F.col("o_type").isNull(), F.col("n_type").isNull()
    kept = ~added & ~removed

    def change(test: Column, kind: str, breaking: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("change"), breaking.alias("breaking")))

    found = F.array_compact(
        F.array(
            change(added, "added", ~F.col("n_nullable") & F.col("n_default").isNull()),
            change(removed, "removed", F.lit(True)),
            change(kept & (F.lower("o_type") != F.lower("n_type")), "type_changed", _rank("n_type") < _rank("o_type")),
            change(kept & F.col("o_nullable") & ~F.col("n_nullable"), "made_required", F.lit(True)),
            change(kept & ~F.col("o_nullable") & F.col("n_nullable"), "made_nullable", F.lit(False)),
            change(kept & ~F.col("o_default").eqNullSafe(F.col("n_default")), "default_changed", F.lit(False)),
        )
    )
    return both.select(*keep, "name", F.inline(found), F.col("o_type").alias("old_type"), F.col("n_type").alias("new_type"))


def schema_diff(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Changes between two schemas given as (name, type, nullable, default) rows; with ``by``, between the schemas
    of each key, many at once. Keys must not be null."""
    side = lambda df, p: df.select(*by, "name", *[F.col(c).alias(f"{p}_{c}") for c in ("type", "nullable", "default")])
    return _changes(side(old, "o").join(side(new, "n"), [*by, "name"], "full"), by)


def verdict() -> Column:
    """Compatibility over change rows: full, none, backward or forward."""
    return (
        F.when(F.count_if("breaking") > 0, "none")
        .when(F.count_if(F.col("change") == "added") > 0, "backward")
        .when(F.count_if(F.col("change") == "removed") > 0, "forward")
        .otherwise("full")
    )


def compatibility(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and verdict over change rows, per key of ``by`` that has any."""
    return changes.groupBy(*by).agg(
        F.count("change").alias("changes"), F.count_if("breaking").alias("breaking_changes"), verdict().alias("compatibility")
    )


def schema_history(registry: DataFrame) -> DataFrame:
    """Every version of every table with its changes against the version before.

    ``registry`` has table_name, version, created_at and columns (array of name, type, nullable,
    default)."""
    laid = lay_out(registry, ["created_at", "version"], ["table_name"])
    steps = previous(laid, "columns", "before", ["table_name"]).select("table_name", "version", "created_at", "columns", "before")
    key = ["table_name", "version"]
    fields = lambda side: F.explode(side)
    new = steps.select(*key, fields("columns").alias("f")).select(*key, "f.name", *[F.col(f"f.{c}").alias(f"n_{c}") for c in ("type", "nullable", "default")])
    old = steps.select(*key, fields("before").alias("f")).select(*key, "f.name", *[F.col(f"f.{c}").alias(f"o_{c}") for c in ("type", "nullable", "default")])
    changed = _changes(old.join(new, [*key, "name"], "full"), key)
    counts = changed.groupBy(*key).agg(
        F.count("change").alias("changes"), F.count_if("breaking").alias("breaking_changes"), verdict().alias("compatibility")
    )
    first = F.col("before").isNull()
    return (
        steps.join(counts, key, "left")
        .select(
            *key,
            "created_at",
            F.size("columns").alias("column_count"),
            F.when(first, 0).otherwise(F.coalesce("changes", F.lit(0))).alias("changes"),
            F.when(first, 0).otherwise(F.coalesce("breaking_changes", F.lit(0))).alias("breaking_changes"),
            F.when(first, "full").otherwise(F.coalesce("compatibility", F.lit("full"))).alias("compatibility"),
        )
        .withColumn("badge", F.when(F.col("breaking_changes") > 0, "Breaking").otherwise("Compatible"))
    )


def schema_timeline(history: DataFrame) -> DataFrame:
    """Totals per table over its history."""
    return history.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("versions"),
        F.sum("changes").alias("changes"),
        F.sum("breaking_changes").alias("breaking_changes"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.max_by("version", F.struct("created_at", "version")).alias("latest_version"),
    )


# --- baselines -----------------------------------------------------------------------------------

BASELINE = ("tenant_id", "source_id", "baseline_type")


def version_key(version: str) -> Column:
    """Semantic version as an array of numbers, which compares in the right order."""
    return F.transform(F.split(F.col(version), r"\."), lambda p: p.cast("int"))


def checksum(data: str) -> Column:
    """SHA-256 over the sorted entries of a map."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(data)))), 256)


def baseline_latest(store: DataFrame) -> DataFrame:
    """Newest version per tenant, source and type, with the number of the next one."""
    rest = [c for c in store.columns if c not in BASELINE]
    newest = store.groupBy(*BASELINE).agg(F.max_by(F.struct(*rest), version_key("version")).alias("r"))
    parts = F.split("version", r"\.")
    bumped = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array((F.element_at(parts, -1).cast("int") + 1).cast("string")))
    return newest.select(*BASELINE, "r.*").withColumn("next_version", F.array_join(bumped, "."))


def _drift(old: str, new: str) -> list[Column]:
    before, after = F.map_keys(old), F.map_keys(new)
    return [
        F.array_sort(F.array_except(after, before)).alias("added_keys"),
        F.array_sort(F.array_except(before, after)).alias("removed_keys"),
        F.size(F.array_intersect(before, after)).alias("common_keys"),
        (checksum(old) != checksum(new)).alias("checksum_changed"),
    ]


def baseline_compare(store: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """Key drift and change of checksum between two versions, for every baseline that has both."""
    a = store.where(F.col("version") == version_a).select(*BASELINE, F.col("data").alias("a"))
    b = store.where(F.col("version") == version_b).select(*BASELINE, F.col("data").alias("b"))
    return a.join(b, list(BASELINE)).select(*BASELINE, *_drift("a", "b"))


def baseline_history(store: DataFrame) -> DataFrame:
    """Every version with its parent and the drift from it."""
    ordered = lay_out(store.withColumn("_v", version_key("version")), ["_v"], list(BASELINE))
    steps = previous(previous(ordered, "data", "before", list(BASELINE)), "version", "parent_version", list(BASELINE))
    return steps.select(*BASELINE, "version", "parent_version", *_drift("before", "data"))


def baseline_activate(store: DataFrame, tenant: str, source: str, kind: str, version: str) -> DataFrame:
    """The store with one version active and the formerly active one deprecated; unknown versions change nothing."""
    same = (F.col("tenant_id") == tenant) & (F.col("source_id") == source) & (F.col("baseline_type") == kind)
    known = store.where(same & (F.col("version") == version)).select(F.count(F.lit(1)) > 0).scalar()
    status = (
        F.when(same & (F.col("version") == version), "active")
        .when(same & (F.col("status") == "active"), "deprecated")
        .otherwise(F.col("status"))
    )
    return store.withColumn("_known", known).withColumn("status", F.when(F.col("_known"), status).otherwise(F.col("status"))).drop("_known")


def baseline_due(policies: DataFrame, history: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Enabled sources whose refresh is due: never refreshed, or later than the interval in hours."""
    last = history.groupBy("source_id").agg(F.max("refreshed_at").alias("last_refresh"))
    elapsed = F.timestamp_diff("SECOND", F.col("last_refresh"), F.lit(as_of).cast("timestamp_ntz"))
    due = F.col("last_refresh").isNull() | (elapsed > F.col("interval_hours") * 3600)
    return policies.where("enabled").join(last, "source_id", "left").where(due)
