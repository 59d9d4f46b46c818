"""Forecasts, trends and gap filling, for any number of series at once.

``order`` names the time column followed by a key that makes it unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.numbers import round_to, z_of
from millrace.functions.order import fill_forward, join_totals, lay_out, leading, previous, with_index

def _points(df: DataFrame, order: Sequence[str], value: str, series: Sequence[str]) -> DataFrame:
    kept = [*series, *order]
    return df.where(F.col(value).isNotNull()).select(*kept, F.col(value).cast("double").alias("v"))


def _deviation() -> Column:
    return F.coalesce(F.stddev_samp("v"), F.lit(0.0))


def _ahead(fit: DataFrame, series: Sequence[str], periods: int, value: Column, margin: Column) -> DataFrame:
    """One row per series and future period with the forecast and its bounds."""
    return (
        fit.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .withColumn("forecast", value)
        .withColumn("margin", margin)
        .select(
            *series,
            "period",
            "forecast",
            (F.col("forecast") - F.col("margin")).alias("lower_bound"),
            (F.col("forecast") + F.col("margin")).alias("upper_bound"),
        )
    )


def _root_margin(confidence: float) -> Column:
    return F.lit(z_of(confidence)) * F.col("dev") * F.sqrt(F.col("period"))


def forecast_naive(
    df: DataFrame, order: Sequence[str], value: str, periods: int, series: Sequence[str] = (), confidence: float = 0.95
) -> DataFrame:
    """The last value, repeated."""
    points = _points(df, order, value, series)
    fit = points.groupBy(*series).agg(F.max_by("v", F.struct(*order)).alias("level"), _deviation().alias("dev"))
    return _ahead(fit.where("level IS NOT NULL"), series, periods, F.col("level"), _root_margin(confidence))


def forecast_sma(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    periods: int,
    window: int = 7,
    series: Sequence[str] = (),
    confidence: float = 0.95,
) -> DataFrame:
    """Mean of the last ``window`` values; series with fewer than two values give nothing."""
    points = _points(df, order, value, series)
    latest = [F.col(o).desc() for o in order]
    if series:
        last = leading(points, series, latest, window)
    else:
        last = points.orderBy(*latest).limit(window)
    level = last.groupBy(*series).agg(F.avg("v").alias("level"))
    spread = points.groupBy(*series).agg(_deviation().alias("dev"), F.count(F.lit(1)).alias("n"))
    fit = join_totals(spread.where("n >= 2"), level, series)
    return _ahead(fit, series, periods, F.col("level"), _root_margin(confidence))


def forecast_ema(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    periods: int,
    alpha: float = 0.3,
    series: Sequence[str] = (),
    confidence: float = 0.95,
) -> DataFrame:
    """Exponential smoothing in closed form: alpha·(1-alpha)^age per value, (1-alpha)^age for the first."""
    alpha = min(max(alpha, 0.01), 0.99)
    aged = with_index(_points(df, order, value, series), [F.col(o).desc() for o in order], series, "age")
    weight = F.pow(F.lit(1 - alpha), F.col("age"))
    fit = (
        aged.groupBy(*series)
        .agg(
            F.sum(F.col("v") * weight).alias("weighted"),
            F.max_by(F.col("v") * weight, "age").alias("first"),
            _deviation().alias("dev"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n >= 2")
    )
    level = F.lit(alpha) * F.col("weighted") + F.lit(1 - alpha) * F.col("first")
    return _ahead(fit, series, periods, level, _root_margin(confidence))


def linear_fit(df: DataFrame, order: Sequence[str], value: str, series: Sequence[str] = ()) -> DataFrame:
    """Least squares on the position 0, 1, 2, … : slope, intercept, residual deviation, r², trend."""
    indexed = with_index(_points(df, order, value, series), list(order), series, "i")  # its layout is frozen already
    line = indexed.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("v", F.col("i").cast("double")).alias("slope"),
        F.regr_intercept("v", F.col("i").cast("double")).alias("intercept"),
        F.avg("v").alias("mean"),
    )
    off = F.col("v") - (F.col("slope") * F.col("i") + F.col("intercept"))
    rest = (
        join_totals(indexed, line.where("n >= 3"), series)
        .groupBy(*series)
        .agg(
            F.max("n").alias("n"),
            F.max("slope").alias("slope"),
            F.max("intercept").alias("intercept"),
            F.stddev_samp(off).alias("raw"),
            F.sum(F.pow(F.col("v") - F.col("mean"), 2)).alias("total"),
        )
        .where("n >= 3")
    )
    slope = F.col("slope")
    residual = F.when(F.col("raw") < 1e-10, 0.1).otherwise(F.col("raw"))
    explained = 1 - F.pow("residual_std", F.lit(2)) * (F.col("n") - 2) / F.nullif("total", F.lit(0.0))
    return (
        rest.withColumn("residual_std", residual)
        .withColumn("direction", F.when(F.abs(slope) < 0.001, "flat").when(slope > 0, "up").otherwise("down"))
        .withColumn("strength", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), explained)), F.lit(0.0)))
        .select(*series, "n", "slope", "intercept", "residual_std", "direction", "strength")
    )


def forecast_linear(
    df: DataFrame, order: Sequence[str], value: str, periods: int, series: Sequence[str] = (), confidence: float = 0.95
) -> DataFrame:
    fit = linear_fit(df, order, value, series)
    level = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("period"))
    margin = F.lit(z_of(confidence)) * F.col("residual_std") * F.sqrt(1 + F.col("period") / F.col("n"))
    return _ahead(fit, series, periods, level, margin)


def detect_trend(df: DataFrame, order: Sequence[str], value: str, series: Sequence[str] = ()) -> DataFrame:
    """up, down or flat, with slope and strength; series with fewer than three values are flat."""
    fit = linear_fit(df, order, value, series).select(
        *series, "direction", round_to("slope", 4).alias("slope"), round_to("strength", 4).alias("strength")
    )
    counts = _points(df, order, value, series).groupBy(*series).agg(F.count(F.lit(1)).alias("n")).where("n < 3")
    short = counts.select(*series, F.lit("flat").alias("direction"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("strength"))
    return fit.unionByName(short)


STEPS = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}


def _bin(ts: str, freq: str) -> Column:
    """Start of the period, as a timestamp without zone. Weeks and months are labelled by their last day later."""
    if freq not in STEPS:
        raise ValueError(f"unknown frequency {freq!r}")
    if freq == "W":
        return F.date_sub(F.next_day(F.date_sub(F.to_date(ts), 1), "SUN"), 6).cast("timestamp_ntz")
    unit = {"H": "hour", "D": "day", "M": "month"}[freq]
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def _label(start: Column, freq: str) -> Column:
    if freq == "W":
        return F.date_add(start.cast("date"), 6).cast("timestamp_ntz")
    if freq == "M":
        return F.last_day(start.cast("date")).cast("timestamp_ntz")
    return start


def resample_fill(df: DataFrame, ts: str, value: str, freq: str = "D", series: Sequence[str] = ()) -> DataFrame:
    """Mean per period; a period without values repeats the one before, or is 0 at the start.

    Each observed period fills the gap before it, so no calendar table and no join are needed."""
    means = df.groupBy(*series, _bin(ts, freq).alias("p")).agg(F.avg(value).alias("v")).where("p IS NOT NULL")
    laid = lay_out(means, ["p"], series)
    laid = fill_forward(laid, "v", "filled", series)
    laid = previous(previous(laid, "p", "before", series), "filled", "held", series)
    gap = F.expr(f"CASE WHEN before IS NULL THEN array(p) ELSE sequence(before + {STEPS[freq]}, p, {STEPS[freq]}) END")
    spread = laid.withColumn("at", F.explode(gap))
    filled = F.coalesce(F.when(F.col("at") == F.col("p"), F.col("filled")).otherwise(F.col("held")), F.lit(0.0))
    return spread.select(*series, _label(F.col("at"), freq).alias("ts"), filled.alias("value"))


FEATURES = ("trend", "month", "dow")


def _features(ts: Column) -> list[Column]:
    """Julian date, month, weekday (Monday = 0)."""
    julian = F.unix_micros(ts.cast("timestamp")) / F.lit(86_400e6) + F.lit(2_440_587.5)
    return [
        julian.alias("trend"),
        F.month(ts).cast("double").alias("month"),
        F.weekday(ts).cast("double").alias("dow"),
    ]


def calendar_fit(filled: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Linear model of a filled series on date, month and weekday, from its covariances.

    One aggregation; the normal equations are then solved in expressions. A feature that is constant, or a
    combination of those before it, gets the slope 0."""
    points = filled.select(*series, "ts", "value", *_features(F.col("ts")))
    moments = [F.avg(f).alias(f"m_{f}") for f in FEATURES]
    moments += [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    moments += [F.covar_pop(a, "value").alias(f"c_{a}") for a in FEATURES]
    stats = points.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("ts").alias("last"),
        F.avg("value").alias("m_value"),
        F.var_pop("value").alias("v_value"),
        *moments,
    ).where("n >= 10")
    fitted = stats.withColumn("b", F.array(*_slopes()))
    explained = sum((F.get("b", F.lit(i)) * F.col(f"c_{f}") for i, f in enumerate(FEATURES)), F.lit(0.0))
    return fitted.withColumn("rmse", F.sqrt(F.greatest(F.lit(0.0), F.col("v_value") - explained)))


#: A feature of which less than this share of its variance is left beside the features before it says nothing new.
OWN_SHARE = 1e-12


def _slopes() -> list[Column]:
    """Slopes per feature out of the columns of covariances, by elimination without exchange of rows: covariance
    matrices need none."""
    size = range(len(FEATURES))
    left = {(i, j): F.col(f"c_{FEATURES[i]}_{FEATURES[j]}") for i in size for j in size if j >= i}
    right = [F.col(f"c_{f}") for f in FEATURES]
    pivots = []
    for k in size:
        pivot = F.when(left[k, k] > OWN_SHARE * F.col(f"c_{FEATURES[k]}_{FEATURES[k]}"), left[k, k])
        pivots.append(pivot)
        for i in size[k + 1 :]:
            share = F.coalesce(left[k, i] / pivot, F.lit(0.0))
            right[i] = right[i] - share * right[k]
            for j in size[i:]:
                left[i, j] = left[i, j] - share * left[k, j]
    slopes: dict[int, Column] = {}
    for k in reversed(size):
        rest = sum((left[k, j] * slopes[j] for j in size[k + 1 :]), F.lit(0.0))
        slopes[k] = F.coalesce((right[k] - rest) / pivots[k], F.lit(0.0))
    return [slopes[k] for k in size]


def forecast_calendar(
    df: DataFrame, ts: str, value: str, horizon: int = 30, freq: str = "D", series: Sequence[str] = ()
) -> DataFrame:
    """Trend and season by date, month and weekday. A series of fewer than 10 periods gives one row without a
    forecast, whose ``reason`` says so; so does a table without series keys that is as short, or empty."""
    fit = calendar_fit(freeze(resample_fill(df, ts, value, freq, series)), series)
    first = F.expr("last + INTERVAL 1 DAY")
    start = _bin("first", freq)
    ahead = fit.withColumn("first", first).withColumn("start", start)
    # A period counts from the first label on or after the day that follows the last one.
    late = _label(F.col("start"), freq) < F.col("first")
    ahead = ahead.withColumn("start", F.when(late, F.expr(f"start + {STEPS[freq]}")).otherwise(F.col("start")))
    ahead = ahead.withColumn(
        "at", F.explode(F.expr(f"transform(sequence(0, {horizon} - 1), i -> start + i * {STEPS[freq]})"))
    ).withColumn("ts", _label(F.col("at"), freq))
    ahead = ahead.select("*", *_features(F.col("ts")))
    level = F.col("m_value")
    for i, f in enumerate(FEATURES):
        level = level + F.get("b", F.lit(i)) * (F.col(f) - F.col(f"m_{f}"))
    margin = F.lit(1.96) * F.col("rmse")
    forecasts = ahead.select(
        *series,
        "ts",
        level.alias("forecast"),
        (level - margin).alias("lower_bound"),
        (level + margin).alias("upper_bound"),
        "rmse",
        F.lit(None).cast("string").alias("reason"),
    )
    # Grouped, as null is a series too and a join would lose it.
    known = fit.select(*series, F.lit(1).alias("fitted")).union(df.select(*series, F.lit(0).alias("fitted")))
    short = known.groupBy(*series).agg(F.coalesce(F.max("fitted"), F.lit(0)).alias("fitted")).where("fitted = 0")
    nothing = [F.lit(None).cast(forecasts.schema[c].dataType).alias(c) for c in ("ts", "forecast", "lower_bound", "upper_bound", "rmse")]
    return forecasts.union(short.select(*series, *nothing, F.lit("fewer than 10 periods").alias("reason")))
