"""Segment queries."""

from pyspark.sql import functions as F

from millrace.operators import ml, segment
from registry import query, rounded, table

PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT o_orderpriority AS segment, '{c}' AS column_name, COUNT(*) AS row_count, COUNT({c}) AS count, AVG({c}) AS mean,
        COALESCE(STDDEV_SAMP({c}), 0) AS std, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
        CAST(SUM({c}) AS DOUBLE) AS sum, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS median FROM orders GROUP BY 1"""
    for c in ("o_totalprice", "o_custkey")
)
NUMERIC = ["o_totalprice", "o_custkey"]


@query(
    "segment_profile",
    f"""WITH p AS ({PROFILE_SQL}) SELECT segment, column_name, row_count, ROUND(row_count / (SELECT COUNT(*) FROM orders), 6) AS share, count,
        ROUND(mean, 4) AS mean, ROUND(std, 4) AS std, min, max, ROUND(sum, 4) AS sum, ROUND(median, 4) AS median FROM p""",
)
def _(spark, sf):
    return rounded(segment.segment_profile(table(spark, sf, "orders"), "o_orderpriority", NUMERIC), 4, share=6)


@query(
    "segment_categories",
    """SELECT event_type AS segment, 'user_id' AS column_name, CAST(user_id AS VARCHAR) AS value, COUNT(*) AS count
       FROM events GROUP BY 1, 3""",
)
def _(spark, sf):
    return segment.segment_categories(table(spark, sf, "events"), "event_type", ["user_id"])


@query(
    "segment_compare",
    """
    WITH m AS (SELECT o_orderstatus AS g, COUNT(*) AS n, AVG(o_totalprice) AS m, VAR_SAMP(o_totalprice) AS v FROM orders
               WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
         j AS (SELECT a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, ABS(a.m - b.m) / SQRT(a.v / a.n + b.v / b.n) AS t
               FROM m a, m b WHERE a.g = 'F' AND b.g = 'O')
    SELECT 'F' AS segment_a, 'O' AS segment_b, ROUND(na / nb, 4) AS size_ratio, 'o_totalprice' AS column_name, ROUND(ma, 4) AS mean_a,
           ROUND(mb, 4) AS mean_b, ROUND(ma - mb, 4) AS difference, ROUND((ma - mb) / mb * 100, 4) AS percent_diff,
           CASE WHEN t > 3.5 THEN 0.001 WHEN t > 2.5 THEN 0.01 WHEN t > 2 THEN 0.05 WHEN t > 1.5 THEN 0.1 WHEN t > 1 THEN 0.3 ELSE 0.5 END::DOUBLE AS p_value
    FROM j
    """,
)
def _(spark, sf):
    return rounded(segment.segment_compare(table(spark, sf, "orders"), "o_orderstatus", "F", "O", ["o_totalprice"]))


@query(
    "segment_drift",
    """
    WITH o AS (SELECT event_type AS segment, COUNT(*) / (SELECT COUNT(*) FROM events WHERE ts < TIMESTAMP '2024-01-15') AS s
               FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
         n AS (SELECT event_type AS segment, COUNT(*) / (SELECT COUNT(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15') AS s
               FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1
               UNION ALL SELECT NULL, 0 WHERE FALSE),
         b AS (SELECT segment, COALESCE(o.s, 0) AS x, COALESCE(n.s, 0) AS y FROM o FULL JOIN n USING (segment))
    SELECT segment, ROUND(x * 100, 2) AS old_percentage, ROUND(y * 100, 2) AS new_percentage, ROUND((y - x) * 100, 2) + 0.0 AS absolute_change,
           ABS(ROUND((y - x) * 100, 2)) > 1 AS changed FROM b
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events")
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    new = events.where(late).withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return segment.segment_drift(events.where(~late), new, "event_type")


@query(
    "segment_column_profile",
    """
    WITH x AS (SELECT CASE WHEN event_id % 11 <> 0 THEN event_type END AS segment, CASE WHEN event_id % 10 <> 0 THEN value END AS value,
                      props FROM events),
         r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY segment) AS n
               FROM x WHERE value IS NOT NULL),
         q AS (SELECT segment, MAX(value) FILTER (i = LEAST(FLOOR(n * 0.25), n - 1)) AS q25, MAX(value) FILTER (i = LEAST(FLOOR(n * 0.75), n - 1)) AS q75
               FROM r GROUP BY 1)
    SELECT x.segment, 'value' AS column_name, 'numeric' AS data_type, COUNT(*) AS count, COUNT(*) - COUNT(value) AS missing_count,
           ROUND(AVG(value), 4) AS mean, ROUND(STDDEV_SAMP(value), 4) AS std_dev, MIN(value) AS min_value, MAX(value) AS max_value,
           ROUND(SKEWNESS(value), 4) AS skewness, MAX(q25) AS q25, MAX(q75) AS q75, ROUND(QUANTILE_CONT(value, 0.5), 4) AS median,
           CAST(NULL AS BIGINT) AS unique_count
    FROM x LEFT JOIN q ON x.segment IS NOT DISTINCT FROM q.segment GROUP BY 1
    UNION ALL
    SELECT segment, 'props', 'categorical', COUNT(*), COUNT(*) - COUNT(props), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, COUNT(DISTINCT props)
    FROM x GROUP BY 1
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
        "props",
    )
    return rounded(segment.segment_column_profile(events, "kind", ["value", "props"]))


@query(
    "segment_top_values",
    """
    WITH c AS (SELECT event_type AS segment, 'props' AS column_name, props AS value, COUNT(*) AS count FROM events GROUP BY 1, 3),
         r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY segment ORDER BY count DESC, value) AS INTEGER) AS rank FROM c)
    SELECT * FROM r WHERE rank <= 10
    """,
)
def _(spark, sf):
    return segment.segment_top_values(table(spark, sf, "events"), "event_type", ["props"])


@query(
    "segment_pairs",
    f"""
    WITH p AS ({PROFILE_SQL}),
         j AS (SELECT a.segment AS segment_a, b.segment AS segment_b, a.column_name, a.mean - b.mean AS d, b.mean AS mb, a.std AS sa, b.std AS sb,
                      a.row_count AS na, b.row_count AS nb FROM p a JOIN p b ON a.column_name = b.column_name AND a.segment < b.segment)
    SELECT segment_a, segment_b, column_name, ROUND(d, 4) AS mean_diff, ROUND(d / ABS(mb) * 100, 4) AS mean_diff_percent, ROUND(sa - sb, 4) AS std_diff,
           ROUND(d / SQRT(((na - 1) * sa * sa + (nb - 1) * sb * sb) / (na + nb - 2)), 6) AS effect_size,
           ROUND(EXP(-(0.25 * LN(0.25 * (sa * sa / (sb * sb) + sb * sb / (sa * sa) + 2)) + 0.25 * d * d / (sa * sa + sb * sb))), 6) AS distribution_overlap
    FROM j
    """,
)
def _(spark, sf):
    profile = segment.segment_profile(table(spark, sf, "orders"), "o_orderpriority", NUMERIC)
    return rounded(segment.segment_pairs(profile), 4, effect_size=6, distribution_overlap=6)


@query("segment_customers")
def _(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"), F.avg("o_totalprice").alias("basket")
    )
    return rounded(ml.segment_customers(totals, ["orders", "spent", "basket"], 3))
