"""Analyzer registry, one-call analysis and chart data."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.profile import profile_table
from millrace.plans.sql import run_kpis

# What analyzers are sorted into.
CATEGORIES = ("visualization", "report", "data_quality", "statistics", "security", "other")


@dataclass(frozen=True)
class Analyzer:
    name: str
    category: str
    run: Callable[[DataFrame, Mapping[str, object]], DataFrame]
    core: bool = False
    flag: str | None = None
    order: int = 100
    kind: str = "analyzer"

    def enabled(self) -> bool:
        """Without a flag always; with one, if the environment variable of that name is not switched off."""
        return self.flag is None or os.environ.get(self.flag, "true").strip().lower() in ("1", "true", "yes", "on")


class Registry:
    """Named DataFrame functions: analyzers take (table, context), generators the context alone."""

    def __init__(self) -> None:
        self._known: dict[str, Analyzer] = {}

    def register(
        self, name: str, category: str = "other", core: bool = False, flag: str | None = None, order: int = 100, kind: str = "analyzer"
    ):
        if category not in CATEGORIES:
            raise ValueError(f"unknown category {category!r}")

        def add(run: Callable):
            if name in self._known:
                raise ValueError(f"{name} is registered twice")
            self._known[name] = Analyzer(name, category, run, core, flag, order, kind)
            return run

        return add

    def list(self, category: str | None = None, kind: str | None = None) -> list[Analyzer]:
        known = [a for a in self._known.values() if category in (None, a.category) and kind in (None, a.kind)]
        return sorted(known, key=lambda a: (a.order, a.name))

    def run(
        self, kind: str, names: Sequence[str] | None, arguments: tuple, errors: dict[str, str]
    ) -> dict[str, DataFrame]:
        """Results by name. A failing function stops everything if it is core, else it is noted."""
        for name in names or ():
            if name not in self._known:
                errors[name] = "not registered"
        out: dict[str, DataFrame] = {}
        for analyzer in self.list(kind=kind):
            if (names is not None and analyzer.name not in names) or not analyzer.enabled():
                continue
            try:
                out[analyzer.name] = analyzer.run(*arguments)
            except Exception as problem:
                if analyzer.core:
                    raise RuntimeError(f"core {kind} {analyzer.name} failed") from problem
                errors[analyzer.name] = str(problem)
        return out


REGISTRY = Registry()
register_analyzer = REGISTRY.register


@dataclass
class Analysis:
    summary: DataFrame
    profile: DataFrame | None = None
    kpis: dict[str, DataFrame] = field(default_factory=dict)
    analyzers: dict[str, DataFrame] = field(default_factory=dict)
    generators: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """(part, name, label, measure, value): every number of every KPI, analyzer and generator as a row.

        A result's first column, if it has several, and all columns that are not numbers make up the ``label``;
        nulls in it are left out. A result without numbers gives its labels with no measure."""
        out = None
        for part, results in (("kpi", self.kpis), ("analyzer", self.analyzers), ("generator", self.generators)):
            for name, df in results.items():
                fields = df.schema.fields
                measures = [f.name for f in fields[len(fields) > 1 :] if isinstance(f.dataType, T.NumericType)]
                labels = [F.col(f"`{f.name}`").cast("string") for f in fields if f.name not in measures]
                cells = [F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("value")) for m in measures]
                cells = cells or [F.struct(F.lit(None).cast("string").alias("measure"), F.lit(None).cast("double").alias("value"))]
                rows = df.select(F.lit(part).alias("part"), F.lit(name).alias("name"), F.concat_ws("|", *labels).alias("label"), F.inline(F.array(*cells)))
                out = rows if out is None else out.union(rows)
        empty = "part string, name string, label string, measure string, value double"
        return self.summary.sparkSession.createDataFrame([], empty) if out is None else out


def analyze(
    spark: SparkSession,
    table: str,
    kpis: Sequence[Mapping[str, object]] = (),
    analyzers: Sequence[str] | None = None,
    context: Mapping[str, object] | None = None,
    profile: bool = True,
    run_analyzers: bool = True,
    generate: bool = True,
    registry: Registry = REGISTRY,
) -> Analysis:
    """Profile, analyzers, KPIs and generators over one table or view, each a DataFrame of its own.

    KPIs run when read; the profile counts the values of the table on the way."""
    df = spark.table(table)
    errors: dict[str, str] = {}
    context = dict(context or {})
    shape = profile_table(df) if profile else None
    found = registry.run("analyzer", analyzers, (df, context), errors) if run_analyzers else {}
    measured = run_kpis(spark, kpis) if kpis else {}
    made = {}
    if generate:
        made = registry.run("generator", None, ({**context, "table": table, "profile": shape, "kpis": measured, "analyzers": found},), errors)
    parts = [(table, len(measured), len(found), len(made), len(errors))]
    summary = spark.createDataFrame(
        parts, "table string, kpi_count int, analyzer_count int, generator_count int, error_count int"
    )
    return Analysis(summary, shape, measured, found, made, errors)


# --- chart data ----------------------------------------------------------------------------------


def bar_chart(df: DataFrame, x: str, y: str, limit: int = 50) -> DataFrame:
    """Bars, largest first: sum of y per x. Bars beyond ``limit`` are summed into a last one, ``other``."""
    bars = df.groupBy(F.col(x).alias("x")).agg(F.sum(y).alias("y"))
    largest = bars.orderBy(F.desc_nulls_last("y"), "x").limit(limit)
    top = largest.select(F.col("x").alias("_x"), F.lit(True).alias("_top"))
    marked = bars.join(top, bars["x"].eqNullSafe(top["_x"]), "left")
    last = F.col("_top").isNull()
    pooled = marked.groupBy(last.alias("_last"), F.when(last, F.lit("other")).otherwise(F.col("x").cast("string")).alias("x")).agg(F.sum("y").alias("y"))
    return pooled.orderBy("_last", F.desc_nulls_last("y"), "x").drop("_last")


def line_chart(df: DataFrame, x: str, y: str, unit: str = "day") -> DataFrame:
    """Mean of y per time unit."""
    at = F.date_trunc(unit, x).cast("timestamp_ntz")
    return df.groupBy(at.alias("x")).agg(F.avg(y).alias("y"))


def outlier_scatter(df: DataFrame, x: str, y: str, flag: str, cells: int = 100) -> DataFrame:
    """Points by cell of a grid, split into inliers and outliers, small enough to draw at any table size."""
    ends = df.select(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    framed = df.withColumn("_e", ends)

    def cell(c: str, low: str, high: str):
        width = (F.col(f"_e.{high}") - F.col(f"_e.{low}")) / cells
        place = F.floor((F.col(c) - F.col(f"_e.{low}")) / F.nullif(width, F.lit(0.0)))
        return F.least(F.lit(cells - 1), F.coalesce(place, F.lit(0)))

    return (
        framed.groupBy(cell(x, "x0", "x1").alias("cell_x"), cell(y, "y0", "y1").alias("cell_y"), F.col(flag).alias("outlier"))
        .agg(F.count(F.lit(1)).alias("points"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    )


def forecast_chart(history: DataFrame, forecast: DataFrame, ts: str, value: str) -> DataFrame:
    """History and forecast as one series, told apart by ``part``."""
    null = F.lit(None).cast("double")
    past = history.select(
        F.col(ts).cast("timestamp_ntz").alias("x"), F.col(value).cast("double").alias("y"), null.alias("lower"), null.alias("upper"), F.lit("history").alias("part")
    )
    ahead = forecast.where(F.col(ts).isNotNull()).select(
        F.col(ts).cast("timestamp_ntz").alias("x"),
        F.col("forecast").alias("y"),
        F.col("lower_bound").alias("lower"),
        F.col("upper_bound").alias("upper"),
        F.lit("forecast").alias("part"),
    )
    return past.unionByName(ahead)
