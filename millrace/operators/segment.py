"""Profiles of segments and comparisons between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import ratio, round_to
from millrace.functions.order import leading, order_stats, quantiles
from millrace.operators.clean import long_form, numeric_columns


OTHER = "other"


def _pooled(df: DataFrame, segment: str, most: int | None) -> DataFrame:
    """Rows with a segment; with ``most``, all but the largest segments become one called ``other``."""
    df = df.where(F.col(segment).isNotNull())
    if most is None:
        return df
    largest = df.groupBy(segment).count().orderBy(F.desc("count"), segment).limit(most).select(segment, F.lit(True).alias("_large"))
    named = F.when(F.col("_large"), F.col(segment).cast("string")).otherwise(F.lit(OTHER))
    return df.join(largest, segment, "left").withColumn(segment, named).drop("_large")


def segment_profile(
    df: DataFrame, segment: str, numeric: Sequence[str] | None = None, max_segments: int | None = None
) -> DataFrame:
    """Per segment and column: rows, share of all rows, count, mean, median, deviation, range, sum.

    Rows without a segment are left out but count in the share. With ``max_segments``, the segments beyond
    the largest are one more, called ``other``."""
    numeric = list(numeric or [c for c in numeric_columns(df) if c != segment])
    total = df.select(F.count(F.lit(1))).scalar()
    kept = _pooled(df.select(segment, *numeric), segment, max_segments)

    def measures(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.sum(x).alias("sum"),
        )

    wide = kept.groupBy(segment).agg(
        F.count(F.lit(1)).alias("row_count"), F.array(*[measures(c) for c in numeric]).alias("m")
    )
    flat = wide.select(segment, "row_count", (F.col("row_count") / total).alias("share"), F.inline("m"))
    medians = quantiles(long_form(kept, numeric, "double", [segment]), "value", {"median": 0.5}, [segment, "column"])
    return (
        flat.join(medians.drop("n"), [segment, "column"], "left")
        .where("count > 0")
        .withColumnRenamed(segment, "segment")
        .withColumnRenamed("column", "column_name")
    )


def segment_categories(df: DataFrame, segment: str, columns: Sequence[str], max_segments: int | None = None) -> DataFrame:
    """Value counts of text columns per segment; ``max_segments`` as in ``segment_profile``."""
    kept = _pooled(df, segment, max_segments)
    cells = long_form(kept, columns, "string", [segment]).where("value IS NOT NULL")
    return cells.groupBy(F.col(segment).alias("segment"), F.col("column").alias("column_name"), "value").agg(
        F.count(F.lit(1)).alias("count")
    )


def rough_p(t: Column) -> Column:
    """Coarse p-value by the size of |t|, as a step table."""
    # Threshold on |t| and the p reported above it.
    steps = ((3.5, 0.001), (2.5, 0.01), (2.0, 0.05), (1.5, 0.10), (1.0, 0.30))
    p = F.lit(0.50)
    for threshold, value in reversed(steps):
        p = F.when(t > threshold, value).otherwise(p)
    return p


def segment_compare(df: DataFrame, segment: str, a: object, b: object, numeric: Sequence[str] | None = None) -> DataFrame:
    """Means of two segments, their difference and a coarse Welch p-value; one pass over both."""
    numeric = list(numeric or [c for c in numeric_columns(df) if c != segment])
    is_a, is_b = F.col(segment) == F.lit(a), F.col(segment) == F.lit(b)

    def measures(c: str) -> Column:
        fields = [F.lit(c).alias("column_name")]
        for side, test in (("a", is_a), ("b", is_b)):
            x = F.when(test, F.col(c).cast("double"))
            fields += [F.count(x).alias(f"n_{side}"), F.avg(x).alias(f"mean_{side}"), F.var_samp(x).alias(f"var_{side}")]
        return F.struct(*fields)

    wide = df.where(is_a | is_b).agg(
        ratio(F.count_if(is_a), F.count_if(is_b)).alias("size_ratio"), F.array(*[measures(c) for c in numeric]).alias("m")
    )
    flat = wide.select(F.coalesce("size_ratio", F.lit(0.0)).alias("size_ratio"), F.inline("m"))
    difference = F.col("mean_a") - F.col("mean_b")
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    usable = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (error > 0)
    return flat.where("n_a > 0 AND n_b > 0").select(
        F.lit(str(a)).alias("segment_a"),
        F.lit(str(b)).alias("segment_b"),
        "size_ratio",
        "column_name",
        "mean_a",
        "mean_b",
        difference.alias("difference"),
        F.coalesce(ratio(difference, "mean_b") * 100, F.lit(0.0)).alias("percent_diff"),
        F.when(usable, rough_p(F.abs(difference) / F.nullif(error, F.lit(0.0)))).otherwise(1.0).alias("p_value"),
    )


def segment_drift(old: DataFrame, new: DataFrame, segment: str) -> DataFrame:
    """Share of each segment before and after, in percent."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.select(F.count(F.lit(1))).scalar()
        sizes = df.where(F.col(segment).isNotNull()).groupBy(F.col(segment).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        return sizes.select("segment", (F.col("n") / total).alias(name))

    both = shares(old, "old").join(shares(new, "new"), "segment", "full")
    before, after = F.coalesce("old", F.lit(0.0)), F.coalesce("new", F.lit(0.0))
    change = round_to((after - before) * 100, 2)
    return both.select(
        "segment",
        round_to(before * 100, 2).alias("old_percentage"),
        round_to(after * 100, 2).alias("new_percentage"),
        change.alias("absolute_change"),
        (F.abs(change) > 1).alias("changed"),
    )


def numeric_like(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns whose known values are numbers for more than 80 %: by type, or by parsing the text."""
    typed = set(numeric_columns(df))
    asked = [c for c in columns if c not in typed]
    if not asked:
        return typed & set(columns)
    row = df.agg(
        *[F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("double").isNotNull().cast("int"))).alias(c) for c in asked]
    ).first()
    return (typed & set(columns)) | {c for c in asked if row[c] is not None and row[c] > 0.8}


def segment_column_profile(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    """Per segment (null included) and column: counts, moments, quartiles and adjusted skewness of
    number-like columns, distinct values of the others."""
    numbers = numeric_like(df, columns)

    def measures(c: str) -> Column:
        n = F.col(c).cast("string").try_cast("double") if c in numbers else F.lit(None).cast("double")
        known = F.count(n) if c in numbers else F.count(c)
        size = F.count(n)
        skew = F.skewness(n) * F.sqrt(size * (size - 1)) / F.nullif(size - 2, F.lit(0))
        return F.struct(
            F.lit(c).alias("column"),
            F.lit("numeric" if c in numbers else "categorical").alias("data_type"),
            F.count(F.lit(1)).alias("count"),
            (F.count(F.lit(1)) - known).alias("missing_count"),
            F.avg(n).alias("mean"),
            F.when(size > 0, F.coalesce(F.stddev_samp(n), F.lit(0.0))).alias("std_dev"),
            F.min(n).alias("min_value"),
            F.max(n).alias("max_value"),
            F.when(size >= 3, F.when(F.min(n) == F.max(n), 0.0).otherwise(skew)).alias("skewness"),
        )

    flat = df.groupBy(segment).agg(F.array(*[measures(c) for c in columns]).alias("m")).select(segment, F.inline("m"))
    n = F.col("n")
    picks = {
        "q25": F.least(F.floor(n * 0.25), n - 1),
        "q75": F.least(F.floor(n * 0.75), n - 1),
        "below": F.floor((n - 1) / 2),
        "above": F.floor(n / 2),
    }
    keys = [segment, "column"]
    out = flat
    numeric = [c for c in columns if c in numbers]
    if numeric:
        cells = long_form(df, numeric, "string", [segment]).withColumn("value", F.col("value").try_cast("double"))
        quartiles = order_stats(cells, "value", picks, keys).select(
            *keys, "q25", "q75", ((F.col("below") + F.col("above")) / 2).alias("median")
        )
        out = _left(out, quartiles, keys)
    texts = [c for c in columns if c not in numbers]
    if texts:
        counts = long_form(df, texts, "string", [segment]).where("value IS NOT NULL").groupBy(*keys, "value").count()
        out = _left(out, counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_count")), keys)
    return out.withColumnRenamed(segment, "segment").withColumnRenamed("column", "column_name")


def _left(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys match."""
    renamed = other
    match = None
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_o_{k}")
        same = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        match = same if match is None else match & same
    return df.join(renamed, match, "left").drop(*[f"_o_{k}" for k in keys])


def segment_top_values(df: DataFrame, segment: str, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The most frequent values per segment and column."""
    counts = (
        long_form(df, columns, "string", [segment])
        .where("value IS NOT NULL")
        .groupBy(F.col(segment).alias("segment"), F.col("column").alias("column_name"), "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return leading(counts, ["segment", "column_name"], [F.desc("count"), "value"], top, "rank")


def segment_pairs(profile: DataFrame) -> DataFrame:
    """Every two segments of a profile (rows of ``segment``, ``column_name``, ``row_count``, ``mean``,
    ``std``): mean and deviation difference, Cohen's d, overlap of the two normal curves.

    The pairs are the result itself, over a profile of at most ``max_segments`` segments; they are
    formed by an equi-join on the rank of the partner."""
    ranked = profile.where("mean IS NOT NULL").select(
        "column_name",
        F.col("segment").cast("string").alias("segment"),
        F.col("row_count").alias("n"),
        "mean",
        "std",
        F.row_number().over(Window.partitionBy("column_name").orderBy(F.col("segment").cast("string"))).alias("rank"),
    )
    most = ranked.agg(F.max("rank")).scalar()
    a = ranked.select("column_name", *[F.col(c).alias(f"{c}_a") for c in ("segment", "n", "mean", "std", "rank")])
    b = ranked.select("column_name", *[F.col(c).alias(f"{c}_b") for c in ("segment", "n", "mean", "std", "rank")])
    # Partners of a segment: the ranks after its own.
    partners = F.when(F.col("rank_a") < most, F.sequence(F.col("rank_a") + 1, most)).otherwise(F.array().cast("array<int>"))
    pairs = a.withColumn("rank_b", F.explode(partners)).join(b, ["column_name", "rank_b"])
    m, va, vb = F.col("mean_a") - F.col("mean_b"), F.pow("std_a", F.lit(2)), F.pow("std_b", F.lit(2))
    spread = (F.col("std_a") != 0) & (F.col("std_b") != 0)
    pooled = F.sqrt(((F.col("n_a") - 1) * va + (F.col("n_b") - 1) * vb) / (F.col("n_a") + F.col("n_b") - 2))
    va_, vb_ = F.nullif(va, F.lit(0.0)), F.nullif(vb, F.lit(0.0))
    distance = 0.25 * F.ln(0.25 * (va_ / vb_ + vb_ / va_ + 2)) + 0.25 * F.pow(m, F.lit(2)) / (va_ + vb_)
    return pairs.select(
        "segment_a",
        "segment_b",
        "column_name",
        m.alias("mean_diff"),
        (m / F.nullif(F.abs("mean_b"), F.lit(0.0)) * 100).alias("mean_diff_percent"),
        (F.col("std_a") - F.col("std_b")).alias("std_diff"),
        F.when(spread, m / F.nullif(pooled, F.lit(0.0))).alias("effect_size"),
        F.when(spread, F.exp(-distance)).alias("distribution_overlap"),
    )
