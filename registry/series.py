"""Forecast and resampling queries: daily order revenue, one series per priority."""

from pyspark.sql import functions as F

from millrace.operators import series
from registry import query, rounded, table

DAILY_SQL = """
    d AS (SELECT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS day,
                 CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
    i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s ORDER BY day) - 1 AS i, COUNT(*) OVER (PARTITION BY s) AS n FROM d),
    p AS (SELECT CAST(UNNEST(RANGE(1, 8)) AS INTEGER) AS period)"""


def daily(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("s"), F.to_date("o_orderdate").alias("day")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v")
    )


def _root_sql(level):
    return f"""WITH {DAILY_SQL},
      f AS (SELECT s, {level} AS level, STDDEV_SAMP(v) AS dev FROM i GROUP BY s)
    SELECT s, period, ROUND(level, 4) AS forecast, ROUND(level - 1.96 * dev * SQRT(period), 4) AS lower_bound,
           ROUND(level + 1.96 * dev * SQRT(period), 4) AS upper_bound FROM f, p"""


@query("forecast_naive", _root_sql("MAX(v) FILTER (i = n - 1)"))
def _(spark, sf):
    return rounded(series.forecast_naive(daily(spark, sf), ["day"], "v", 7, ["s"]))


@query("forecast_sma", _root_sql("AVG(v) FILTER (i >= n - 7)"))
def _(spark, sf):
    return rounded(series.forecast_sma(daily(spark, sf), ["day"], "v", 7, 7, ["s"]))


@query("forecast_ema", _root_sql("SUM(v * POW(0.7, n - 1 - i) * CASE WHEN i = 0 THEN 1 ELSE 0.3 END)"))
def _(spark, sf):
    return rounded(series.forecast_ema(daily(spark, sf), ["day"], "v", 7, 0.3, ["s"]))


FIT_SQL = """
    l AS (SELECT s, COUNT(*) AS n, REGR_SLOPE(v, i) AS b, REGR_INTERCEPT(v, i) AS a, AVG(v) AS m FROM i GROUP BY s),
    r AS (SELECT s, MAX(l.n) AS n, MAX(b) AS b, MAX(a) AS a, STDDEV_SAMP(v - a - b * i) AS dev, SUM(POW(v - m, 2)) AS tot
          FROM i JOIN l USING (s) GROUP BY s)"""


@query(
    "forecast_linear",
    f"""WITH {DAILY_SQL}, {FIT_SQL}
    SELECT s, period, ROUND(a + b * (n - 1 + period), 3) AS forecast,
           ROUND(a + b * (n - 1 + period) - 1.96 * dev * SQRT(1 + period / n), 3) AS lower_bound,
           ROUND(a + b * (n - 1 + period) + 1.96 * dev * SQRT(1 + period / n), 3) AS upper_bound FROM r, p""",
)
def _(spark, sf):
    return rounded(series.forecast_linear(daily(spark, sf), ["day"], "v", 7, ["s"]), 3)


@query(
    "detect_trend",
    f"""WITH {DAILY_SQL}, {FIT_SQL}
    SELECT s, CASE WHEN ABS(b) < 0.001 THEN 'flat' WHEN b > 0 THEN 'up' ELSE 'down' END AS direction,
           ROUND(b, 4) AS slope, ROUND(GREATEST(0, LEAST(1, 1 - dev * dev * (n - 2) / tot)), 4) AS strength FROM r""",
)
def _(spark, sf):
    return series.detect_trend(daily(spark, sf), ["day"], "v", ["s"])


@query(
    "resample_fill",
    """
    WITH h AS (SELECT event_type AS s, DATE_TRUNC('hour', ts) AS p, AVG(value) AS v FROM events GROUP BY 1, 2),
         g AS (SELECT s, UNNEST(RANGE(MIN(p), MAX(p) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM h GROUP BY s)
    SELECT g.s, g.ts, ROUND(COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY g.s ORDER BY g.ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 4) AS value
    FROM g LEFT JOIN h ON g.s = h.s AND g.ts = h.p
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_type", "s")
    return rounded(series.resample_fill(events, "ts", "value", "H", ["s"]))


@query(
    "forecast_calendar",
    f"""
    WITH {DAILY_SQL},
      g AS (SELECT s, UNNEST(RANGE(MIN(day), MAX(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS ts FROM d GROUP BY s),
      y AS (SELECT g.s, g.ts, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY g.s ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
            FROM g LEFT JOIN d ON g.s = d.s AND g.ts = d.day),
      x AS (SELECT *, EPOCH(ts) / 86400.0 + 2440587.5 AS t, MONTH(ts)::DOUBLE AS m, (ISODOW(ts) - 1)::DOUBLE AS w FROM y),
      c AS (SELECT s, MAX(ts) AS ends, AVG(y) AS ay, AVG(t) AS avg_t, AVG(m) AS am, AVG(w) AS aw, VAR_POP(y) AS yy, VAR_POP(t) AS tt, COVAR_POP(t, m) AS tm,
                   COVAR_POP(t, w) AS tw, VAR_POP(m) AS mm, COVAR_POP(m, w) AS mw, VAR_POP(w) AS ww, COVAR_POP(t, y) AS ty, COVAR_POP(m, y) AS my, COVAR_POP(w, y) AS wy
            FROM x GROUP BY s HAVING COUNT(*) >= 10),
      k AS (SELECT *, tt * (mm * ww - mw * mw) - tm * (tm * ww - mw * tw) + tw * (tm * mw - mm * tw) AS det FROM c),
      b AS (SELECT *, (ty * (mm * ww - mw * mw) - tm * (my * ww - mw * wy) + tw * (my * mw - mm * wy)) / det AS bt,
                   (tt * (my * ww - mw * wy) - ty * (tm * ww - mw * tw) + tw * (tm * wy - my * tw)) / det AS bm,
                   (tt * (mm * wy - my * mw) - tm * (tm * wy - my * tw) + ty * (tm * mw - mm * tw)) / det AS bw FROM k),
      f AS (SELECT *, SQRT(GREATEST(0, yy - bt * ty - bm * my - bw * wy)) AS rmse, UNNEST(RANGE(1, 31)) AS i FROM b),
      a AS (SELECT *, ends + TO_DAYS(CAST(i AS INTEGER)) AS ts FROM f),
      o AS (SELECT s, ts, rmse, ay + bt * (EPOCH(ts) / 86400.0 + 2440587.5 - avg_t) + bm * (MONTH(ts) - am) + bw * (ISODOW(ts) - 1 - aw) AS forecast FROM a)
    SELECT s, ts::TIMESTAMP AS ts, ROUND(forecast, 3) AS forecast, ROUND(forecast - 1.96 * rmse, 3) AS lower_bound, ROUND(forecast + 1.96 * rmse, 3) AS upper_bound,
           ROUND(rmse, 3) AS rmse, CAST(NULL AS VARCHAR) AS reason FROM o
    """,
)
def _(spark, sf):
    return rounded(series.forecast_calendar(daily(spark, sf), "day", "v", 30, "D", ["s"]), 3)
