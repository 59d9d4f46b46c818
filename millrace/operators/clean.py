"""Repair of tables: duplicates, strings, missing values, outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.order import fill_forward, join_totals, lay_out, order_stats, quantiles, value_counts


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, columns: Sequence[str], kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """(column, value) rows of the named columns, plus the kept ones."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def per_column(stats: DataFrame, columns: Sequence[str], value: str):
    """One struct with a field per column out of (column, value) rows: a scalar subquery."""
    picked = [F.max(F.when(F.col("column") == c, F.col(value))).alias(c) for c in columns]
    return stats.agg(F.struct(*picked)).scalar()


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns) if columns else None)


def duplicate_report(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("original_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates_removed"),
    )


def normalize_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip all white space at the ends, lower-case; the texts "nan" and "none" become null."""

    def clean(c: str):
        text = F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
        return F.when(text.isin("nan", "none"), None).otherwise(text)

    return df.withColumns({c: clean(c) for c in columns if c in df.columns})


def _filled(df: DataFrame, columns: Sequence[str], fills) -> DataFrame:
    """Coalesce the columns with the fields of a one-row struct."""
    plain = df.withColumn("_fill", fills)
    return plain.withColumns({c: F.coalesce(F.col(c), F.col("_fill").getField(c)) for c in columns}).drop("_fill")


def _modes(df: DataFrame, columns: Sequence[str], kind: str):
    counts = value_counts(long_form(df, columns, kind), "value", ["column"])
    top = counts.groupBy("column").agg(F.min_by("_v", F.struct(-F.col("_c"), F.col("_v"))).alias("mode"))
    return per_column(top, columns, "mode")


def impute(
    df: DataFrame,
    strategy: str = "drop",
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    order: Sequence[str] = (),
    partition: Sequence[str] = (),
) -> DataFrame:
    """Fill missing values: drop, mean, median, mode or ffill; text columns take their mode.

    ``ffill`` follows the named ``order`` (ending in a unique key), per ``partition`` if given; values
    missing at the start take the first known one."""
    if strategy == "drop":
        return df.dropna()
    if strategy not in ("mean", "median", "mode", "ffill"):
        raise ValueError(f"unknown strategy {strategy!r}")
    source = df
    numeric = [c for c in (numeric_columns(df) if numeric is None else numeric) if c in df.columns]
    categorical = [c for c in (text_columns(df) if categorical is None else categorical) if c in df.columns]
    if numeric and strategy == "ffill":
        if not order:
            raise ValueError("ffill needs an order")
        laid = lay_out(df, list(order), partition)
        for c in numeric:
            laid = fill_forward(laid, c, f"_ff_{c}", partition)
        first = F.struct(*order)
        firsts = source.groupBy(*partition).agg(
            *[F.min_by(c, F.when(F.col(c).isNotNull(), first)).alias(f"_first_{c}") for c in numeric]
        )
        laid = join_totals(laid, firsts, partition)
        df = laid.withColumns({c: F.coalesce(f"_ff_{c}", f"_first_{c}") for c in numeric}).select(*source.columns)
    elif numeric and strategy == "mean":
        df = _filled(df, numeric, source.agg(F.struct(*[F.avg(c).alias(c) for c in numeric])).scalar())
    elif numeric and strategy == "median":
        medians = quantiles(long_form(source, numeric, "double"), "value", {"median": 0.5}, ["column"])
        df = _filled(df, numeric, per_column(medians, numeric, "median"))
    elif numeric:
        # By type: a whole number beyond 2^53 has no double of its own.
        kinds = dict(source.dtypes)
        for kind in sorted({kinds[c] for c in numeric}):
            same = [c for c in numeric if kinds[c] == kind]
            df = _filled(df, same, _modes(source, same, kind))
    if categorical:
        df = _filled(df, categorical, _modes(source, categorical, "string"))
    return df


@dataclass(frozen=True)
class Treated:
    df: DataFrame
    treated: int


def _spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """mean, population and sample deviation of the columns with at least two values: one small row."""
    row = df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("pop"),
                F.stddev_samp(c).alias("samp"),
                (F.min(c) < F.max(c)).alias("varies"),
            ).alias(c)
            for c in columns
        ]
    ).first()
    return {c: (row[c].mean, row[c].pop, row[c].samp) for c in columns if row[c].varies and row[c].pop}


def _count_where(df: DataFrame, tests: Sequence) -> int:
    return sum(df.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(tests)]).first() or [0])


def treat_outliers(df: DataFrame, how: str, columns: Sequence[str] | None = None, z: float = 3.0) -> Treated:
    """``remove`` drops rows with a z-score above ``z``, column after column, each on what is left;
    ``cap`` clips to mean ± z sample deviations; ``winsorize`` clips to the 5th and 95th percentile."""
    columns = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    if how == "none" or not columns:
        return Treated(df, 0)
    if how == "winsorize":
        return winsorize(df, columns)
    if how == "cap":
        spread = _spread(df, columns)
        if not spread:
            return Treated(df, 0)
        tests = [F.abs(F.col(c) - m) / pop > z for c, (m, pop, _) in spread.items()]
        capped = df.withColumns(
            {
                c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(m + z * s)), F.lit(m - z * s)))
                for c, (m, _, s) in spread.items()
            }
        )
        return Treated(capped, _count_where(df, tests))
    if how != "remove":
        raise ValueError(f"unknown outlier treatment {how!r}")
    treated = 0
    for c in columns:
        spread = _spread(df, [c])
        if c in spread:
            mean, pop, _ = spread[c]
            far = F.abs(F.col(c) - mean) / pop > z
            found = _count_where(df, [far])
            if found:
                treated += found
                df = df.where(F.coalesce(~far, F.lit(True)))
    return Treated(df, treated)


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> Treated:
    """Clip to the order statistics at floor((n-1)·q), so integers stay integers."""
    n = F.col("n")
    picks = {"low": F.floor((n - 1) * F.lit(low)), "high": F.floor((n - 1) * F.lit(high))}
    stats = order_stats(long_form(df, columns, "double"), "value", picks, ["column"])
    bounds = {r["column"]: (r["low"], r["high"]) for r in stats.collect()}  # one row per named column
    bounds = {c: b for c, b in bounds.items() if b[0] is not None}
    types = dict(df.dtypes)
    outside = [(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in bounds.items()]
    clipped = df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(hi).cast(types[c])), F.lit(lo).cast(types[c])))
            for c, (lo, hi) in bounds.items()
        }
    )
    return Treated(clipped, _count_where(df, outside) if outside else 0)


def fix_data_quality(
    df: DataFrame,
    imputation: str = "median",
    outliers: str = "cap",
    threshold: float = 3.0,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    duplicates: str = "keep",
    normalize: bool = False,
    order: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Repair a table; returns the cleaned rows and a one-row report.

    Cells in the quality score are rows times named columns, columns that do not exist included."""
    numeric_named = list(numeric) if numeric is not None else numeric_columns(df)
    text_named = list(categorical) if categorical is not None else text_columns(df)
    cells = len(numeric_named) + len(text_named)
    step = drop_duplicates(df) if duplicates == "drop" else df
    if normalize:
        step = normalize_strings(step, text_named)
    before = step
    step = impute(step, imputation, numeric_named, text_named, order)
    after = step
    result = treat_outliers(step, outliers, numeric_named, threshold)

    def missing(frame: DataFrame):
        total = sum((F.count_if(F.col(c).isNull()) for c in frame.columns[1:]), F.count_if(F.col(frame.columns[0]).isNull()))
        return frame.agg(total.alias("m")).scalar()

    counted = df.agg(F.count(F.lit(1)).alias("original_rows")).select(
        "original_rows",
        result.df.agg(F.count(F.lit(1))).scalar().alias("cleaned_rows"),
        missing(before).alias("before"),
        missing(after).alias("after"),
    )

    def score(rows: str, gone: str):
        size = F.col(rows) * cells
        value = F.when(size == 0, 1.0).otherwise((size - F.col(gone)) / F.nullif(size, F.lit(0)))
        return F.when(F.col("original_rows") == 0, 0.0).otherwise(value)

    report = (
        counted.withColumn("quality_score_before", score("original_rows", "before"))
        .withColumn("quality_score_after", score("cleaned_rows", "after"))
        .select(
            "original_rows",
            "cleaned_rows",
            (F.col("before") - F.col("after")).alias("missing_value_fixes"),
            F.lit(result.treated).cast("long").alias("outliers_treated"),
            "quality_score_before",
            "quality_score_after",
            (F.col("quality_score_after") - F.col("quality_score_before")).alias("improvement"),
        )
    )
    return result.df, report
