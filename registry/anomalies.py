"""Anomaly queries."""

from pyspark.sql import functions as F

from millrace.operators import anomaly
from registry import query, rounded, table


@query(
    "anomalies_zscore",
    """
    WITH s AS (SELECT event_type, AVG(value) AS m, STDDEV_POP(value) AS d FROM events GROUP BY 1 HAVING COUNT(*) >= 3)
    SELECT event_type, event_id, value, ROUND(ABS(value - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 4) AS score,
           ROUND(m, 4) AS expected
    FROM events JOIN s USING (event_type) WHERE ABS(value - m) / CASE WHEN d = 0 THEN 1 ELSE d END > 3
    """,
)
def _(spark, sf):
    return rounded(anomaly.anomalies_zscore(table(spark, sf, "events"), "value", ["event_id"], ["event_type"]))


@query(
    "anomalies_iqr",
    """
    WITH r AS (SELECT event_id, value, ROW_NUMBER() OVER (ORDER BY value) - 1 AS i, COUNT(*) OVER () AS n FROM events),
         q AS (SELECT MAX(value) FILTER (i = n // 4) AS q1, MAX(value) FILTER (i = 3 * n // 4) AS q3 FROM r),
         b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM q)
    SELECT event_id, value, ROUND(CASE WHEN iqr > 0 THEN (CASE WHEN value < lo THEN lo - value ELSE value - hi END) / iqr ELSE 0 END, 4) AS score,
           ROUND(lo, 4) AS lower, ROUND(hi, 4) AS upper
    FROM events, b WHERE value < lo OR value > hi
    """,
)
def _(spark, sf):
    return rounded(anomaly.anomalies_iqr(table(spark, sf, "events"), "value", ["event_id"]))


@query(
    "anomalies_mad",
    """
    WITH r AS (SELECT event_type, event_id, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
                      COUNT(*) OVER (PARTITION BY event_type) AS n FROM events),
         m AS (SELECT event_type, MAX(value) FILTER (i = n // 2) AS med, MAX(n) AS n FROM r GROUP BY 1),
         o AS (SELECT event_type, event_id, value, med, ABS(value - med) AS off,
                      ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ABS(value - med)) - 1 AS j, n FROM events JOIN m USING (event_type)),
         d AS (SELECT event_type, MAX(off) FILTER (j = n // 2) AS mad FROM o GROUP BY 1)
    SELECT event_type, event_id, value, ROUND(0.6745 * off / CASE WHEN mad = 0 THEN 1 ELSE mad END, 4) AS score, med AS expected
    FROM o JOIN d USING (event_type) WHERE 0.6745 * off / CASE WHEN mad = 0 THEN 1 ELSE mad END > 3.5
    """,
)
def _(spark, sf):
    return rounded(anomaly.anomalies_mad(table(spark, sf, "events"), "value", ["event_id"], ["event_type"]))


@query(
    "anomalies_by_column",
    """
    WITH c AS (SELECT o_orderkey AS k, 'o_totalprice' AS column_name, o_totalprice AS v FROM orders
               UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders),
         s AS (SELECT column_name, COUNT(*) AS total, AVG(v) AS mean, MIN(v) AS min, MAX(v) AS max, STDDEV_POP(v) AS d FROM c GROUP BY 1),
         h AS (SELECT column_name, COUNT(*) AS n FROM c JOIN s USING (column_name) WHERE ABS(v - mean) / d > 1.7 GROUP BY 1)
    SELECT column_name, total, ROUND(mean, 4) AS mean, min, max, COALESCE(n, 0) AS anomaly_count,
           ROUND(COALESCE(n, 0) / total, 4) AS anomaly_rate FROM s LEFT JOIN h USING (column_name)
    """,
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return rounded(anomaly.anomalies_by_column(orders, ["o_orderkey"], ["o_totalprice", "o_custkey"], "zscore", 1.7)[1])


@query("isolation_forest")
def _(spark, sf):
    parts = table(spark, sf, "orders").withColumn("day", F.unix_date(F.to_date("o_orderdate")).cast("double"))
    return rounded(anomaly.isolation_forest(parts, ["o_totalprice", "day"], ["o_orderkey"], 0.05), 6)


@query("isolation_summary")
def _(spark, sf):
    events = table(spark, sf, "events")
    return rounded(anomaly.isolation_summary(anomaly.isolation_forest(events, ["value"], ["event_id"], None, nulls="drop"))[0])


@query("isolation_planted", "SELECT o_orderkey, TRUE AS is_anomaly FROM orders WHERE o_orderkey % 500 = 0")
def _(spark, sf):
    """Orders at a hundred times their price; each of them is to be flagged among a fiftieth of all."""
    priced = F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 100 + 1e7).otherwise(F.col("o_totalprice"))
    orders = table(spark, sf, "orders").select("o_orderkey", priced.cast("double").alias("price"))
    scored = anomaly.isolation_forest(orders, ["price"], ["o_orderkey"], 0.02, trees=50, tree_rows=512)
    return scored.where("o_orderkey % 500 = 0").select("o_orderkey", "is_anomaly")
