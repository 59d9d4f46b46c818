"""KPI queries."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import kpi
from registry import query, rounded, table

ORDERS_AS_OF = dt.date(2001, 8, 1)


def orders_by_day(spark, sf):
    """Orders with their day and the price as a decimal, whose sums are exact."""
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return orders.withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))


def sparse_lineitem(spark, sf):
    """lineitem with nulls where the part key ends in 0."""
    return table(spark, sf, "lineitem").withColumn(
        "qty", F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity"))
    ).withColumn("flag", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_returnflag")))


@query(
    "revenue_growth",
    """
    WITH p AS (SELECT CAST(o_orderdate AS DATE) AS period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1),
         l AS (SELECT *, LAG(revenue) OVER (ORDER BY period) AS prev FROM p)
    SELECT period, ROUND(revenue, 4) AS revenue, ROUND(prev, 4) AS prev_revenue,
           ROUND((revenue - prev) / NULLIF(prev, 0) * 100, 2) + 0.0 AS growth_pct FROM l
    """,
)
def _(spark, sf):
    return rounded(kpi.revenue_growth(orders_by_day(spark, sf), "day", "amount"))


@query(
    "revenue_by_segment",
    """
    SELECT o_orderpriority AS segment, ROUND(SUM(o_totalprice), 4) AS revenue,
           ROUND(SUM(o_totalprice) * 100 / (SELECT SUM(o_totalprice) FROM orders), 2) AS pct_of_total
    FROM orders GROUP BY 1
    """,
)
def _(spark, sf):
    return rounded(kpi.revenue_by_segment(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "profit_margin",
    """
    WITH s AS (SELECT l_returnflag AS segment, SUM(l_extendedprice) AS revenue,
                      SUM(l_extendedprice * (1 - l_discount)) AS cost FROM lineitem GROUP BY 1)
    SELECT segment, ROUND(revenue, 4) AS revenue, ROUND(cost, 4) AS cost, ROUND(revenue - cost, 4) AS profit,
           ROUND((revenue - cost) / NULLIF(revenue, 0) * 100, 2) AS margin_pct FROM s
    """,
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("cost", F.expr("l_extendedprice * (1 - l_discount)"))
    return rounded(kpi.profit_margin(lines, "l_returnflag", "l_extendedprice", "cost"))


@query(
    "average_order_value",
    """
    WITH p AS (SELECT CAST(o_orderdate AS DATE) AS period, COUNT(DISTINCT o_orderkey) AS order_count,
                      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
               FROM orders GROUP BY 1)
    SELECT *, ROUND(total_revenue / NULLIF(order_count, 0), 2) AS aov FROM p
    """,
)
def _(spark, sf):
    return rounded(kpi.average_order_value(orders_by_day(spark, sf), "day", "o_orderkey", "amount"))


@query(
    "customer_count_by_period",
    """
    WITH p AS (SELECT CAST(o_orderdate AS DATE) AS period, COUNT(DISTINCT o_custkey) AS unique_customers
               FROM orders GROUP BY 1),
         l AS (SELECT *, LAG(unique_customers) OVER (ORDER BY period) AS prev_customers FROM p)
    SELECT period, unique_customers, prev_customers, unique_customers - COALESCE(prev_customers, 0) AS net_new FROM l
    """,
)
def _(spark, sf):
    return kpi.customer_count_by_period(orders_by_day(spark, sf), "day", "o_custkey")


@query(
    "customer_revenue_distribution",
    """
    WITH c AS (SELECT o_custkey, SUM(o_totalprice) AS rev FROM orders GROUP BY 1),
         r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rev DESC, o_custkey) AS rk, SUM(rev) OVER () AS total FROM c)
    SELECT CASE WHEN rk <= 10 THEN 'Top 10' WHEN rk <= 50 THEN 'Top 11-50' WHEN rk <= 100 THEN 'Top 51-100'
                ELSE 'Others' END AS customer_tier,
           COUNT(*) AS customer_count, ROUND(SUM(rev), 4) AS tier_revenue,
           ROUND(SUM(rev) / MAX(total) * 100, 2) AS pct_of_total
    FROM r GROUP BY 1
    """,
)
def _(spark, sf):
    return rounded(kpi.customer_revenue_distribution(table(spark, sf, "orders"), "o_custkey", "o_totalprice"))


@query(
    "rfm_segments",
    """
    WITH c AS (SELECT o_custkey AS customer_id,
                      CAST(DATE_DIFF('day', CAST(MAX(o_orderdate) AS DATE), DATE '2001-08-01') AS INTEGER) AS recency_days,
                      COUNT(DISTINCT o_orderkey) AS frequency, ROUND(SUM(o_totalprice), 4) AS monetary
               FROM orders GROUP BY 1)
    SELECT *, CASE WHEN recency_days <= 30 AND frequency >= 5 AND monetary >= 1000 THEN 'Champions'
                   WHEN recency_days <= 60 AND frequency >= 3 THEN 'Loyal'
                   WHEN recency_days <= 30 THEN 'Recent'
                   WHEN recency_days > 90 AND frequency >= 3 THEN 'At Risk' ELSE 'Other' END AS segment
    FROM c
    """,
)
def _(spark, sf):
    return rounded(
        kpi.rfm_segments(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", ORDERS_AS_OF)
    )


@query(
    "null_rate",
    """
    WITH x AS (SELECT CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS qty,
                      CASE WHEN l_suppkey % 10 <> 0 THEN l_returnflag END AS flag, l_tax FROM lineitem),
         c AS (SELECT 'qty' AS column_name, COUNT(*) AS total_rows, COUNT(*) - COUNT(qty) AS null_count FROM x
               UNION ALL SELECT 'flag', COUNT(*), COUNT(*) - COUNT(flag) FROM x
               UNION ALL SELECT 'l_tax', COUNT(*), COUNT(*) - COUNT(l_tax) FROM x)
    SELECT *, ROUND(null_count * 100 / total_rows, 2) AS null_pct FROM c
    """,
)
def _(spark, sf):
    return kpi.null_rate(sparse_lineitem(spark, sf), ["qty", "flag", "l_tax"])


@query(
    "duplicate_rate",
    """
    WITH d AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
    SELECT COUNT(*) AS duplicate_groups, CAST(SUM(n) AS BIGINT) AS total_duplicate_rows,
           CAST(SUM(n - 1) AS BIGINT) AS excess_rows FROM d
    """,
)
def _(spark, sf):
    return kpi.duplicate_rate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "value_distribution",
    """
    WITH x AS (SELECT COALESCE(CASE WHEN event_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END, 'NULL') AS value FROM events)
    SELECT value, COUNT(*) AS count, ROUND(COUNT(*) * 100 / (SELECT COUNT(*) FROM events), 2) AS pct
    FROM x GROUP BY 1 ORDER BY count DESC, value LIMIT 20
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("who", F.when(F.col("event_id") % 10 != 0, F.col("user_id")))
    return kpi.value_distribution(events, "who")


@query(
    "inventory_turnover",
    """
    SELECT l_partkey AS product_id, ROUND(SUM(l_quantity), 4) AS units_sold, ROUND(AVG(p_size), 4) AS avg_stock,
           ROUND(SUM(l_quantity) / NULLIF(AVG(p_size), 0), 2) AS turnover_rate
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def _(spark, sf):
    sold = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    stock = table(spark, sf, "part").select("p_partkey", "p_size")
    joined = sold.join(stock, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(kpi.inventory_turnover(joined, "l_partkey", "l_quantity", "p_size"))


@query(
    "lead_time_analysis",
    """
    WITH d AS (SELECT o_orderpriority AS segment,
                      DATE_DIFF('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
               FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate IS NOT NULL)
    SELECT segment, COUNT(*) AS order_count, ROUND(AVG(days), 4) AS avg_lead_days,
           CAST(MIN(days) AS INTEGER) AS min_lead_days, CAST(MAX(days) AS INTEGER) AS max_lead_days
    FROM d GROUP BY 1
    """,
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(kpi.lead_time_analysis(joined, "o_orderpriority", "o_orderdate", "l_shipdate"))


@query(
    "moving_average",
    """
    SELECT o_orderdate, o_orderkey, o_totalprice,
           ROUND(AVG(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 4)
             AS moving_avg
    FROM orders
    """,
)
def _(spark, sf):
    return rounded(kpi.moving_average(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "o_totalprice"))


@query(
    "moving_average_by_group",
    """
    SELECT event_type, ts, event_id, value,
           ROUND(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 4)
             AS moving_avg
    FROM events
    """,
)
def _(spark, sf):
    return rounded(kpi.moving_average(table(spark, sf, "events"), ["ts", "event_id"], "value", 30, ["event_type"]))


@query(
    "year_over_year",
    """
    WITH c AS (SELECT EXTRACT(MONTH FROM o_orderdate) AS month, SUM(o_totalprice) AS v FROM orders
               WHERE EXTRACT(YEAR FROM o_orderdate) = 2001 GROUP BY 1),
         p AS (SELECT EXTRACT(MONTH FROM o_orderdate) AS month, SUM(o_totalprice) AS v FROM orders
               WHERE EXTRACT(YEAR FROM o_orderdate) = 2000 GROUP BY 1)
    SELECT CAST(c.month AS INTEGER) AS month, ROUND(c.v, 4) AS current_value, ROUND(p.v, 4) AS previous_value,
           ROUND((c.v - COALESCE(p.v, 0)) / NULLIF(p.v, 0) * 100, 2) AS yoy_change_pct
    FROM c LEFT JOIN p ON c.month = p.month
    """,
)
def _(spark, sf):
    return rounded(kpi.year_over_year(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ORDERS_AS_OF))


@query(
    "cumulative_sum",
    """
    SELECT CAST(o_orderdate AS DATE) AS period, o_totalprice AS value,
           ROUND(SUM(o_totalprice) OVER (ORDER BY CAST(o_orderdate AS DATE)), 3) AS cumulative_sum
    FROM orders
    """,
)
def _(spark, sf):
    return rounded(kpi.cumulative_sum(orders_by_day(spark, sf), "day", "o_totalprice"), 3)


@query(
    "cumulative_sum_by_group",
    """
    SELECT event_type, CAST(ts AS DATE) AS period, value,
           ROUND(SUM(value) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)), 4) AS cumulative_sum
    FROM events
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return rounded(kpi.cumulative_sum(events, "day", "value", ["event_type"]))
