from datetime import datetime, timedelta

from millrace.operators import series


def test_short_series_of_the_calendar_forecast_are_told(spark):
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    rows = [("long", day(i), float(i)) for i in range(12)] + [("short", day(i), 1.0) for i in range(9)]
    rows += [(None, day(0), 1.0), ("undated", None, 1.0)]
    df = spark.createDataFrame(rows, "s string, day timestamp, v double")
    got = series.forecast_calendar(df, "day", "v", 3, "D", ["s"]).collect()
    assert [r.s for r in got if r.reason is None] == ["long"] * 3
    told = {r.s: (r.ts, r.forecast, r.lower_bound, r.upper_bound, r.reason) for r in got if r.reason}
    assert told == {s: (None, None, None, None, "fewer than 10 periods") for s in ("short", None, "undated")}


def test_constant_and_dependent_features_get_no_slope(spark):
    """Weekly periods all fall on one weekday, and these in one month: only the trend is left."""
    rows = [(datetime(2024, 1, 1) + timedelta(hours=2 * i), 5.0 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "day timestamp, v double")
    fit = series.calendar_fit(df.select(df.day.cast("timestamp_ntz").alias("ts"), df.v.alias("value"))).first()
    assert abs(fit.b[0] - 12) < 1e-6 and list(fit.b[1:]) == [0.0, 0.0] and fit.rmse < 1e-3
