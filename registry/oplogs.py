"""Operational log queries over events: user as tenant, event type as resource, value as amount."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.operators.logs import EventSchema, Field
from registry import query, rounded, table

AS_OF = dt.datetime(2024, 1, 30)


def usage_log(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("tenant_id"), F.col("event_type").alias("resource"), F.col("value").alias("amount")
    )


@query(
    "audit_query",
    """SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
       ORDER BY ts DESC, event_id LIMIT 100""",
)
def _(spark, sf):
    found = logs.audit_query(
        table(spark, sf, "events"), "ts", {"event_type": "purchase"}, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25), 100, ["event_id"]
    )
    return found.select("event_id", "ts", "user_id")


@query(
    "audit_stats",
    """SELECT COUNT(*) AS total_records, COUNT(DISTINCT props) AS unique_resources, COUNT(DISTINCT user_id) AS unique_users, MIN(ts) AS oldest_record,
              MAX(ts) AS newest_record FROM events""",
)
def _(spark, sf):
    return logs.audit_stats(table(spark, sf, "events"), "ts", "user_id", "props")


@query("audit_by_type", "SELECT event_type, COUNT(*) AS records FROM events GROUP BY 1")
def _(spark, sf):
    return logs.audit_by_type(table(spark, sf, "events"), "event_type")


@query("audit_verify", "SELECT event_id, event_type FROM events WHERE event_id % 97 = 0")
def _(spark, sf):
    fields = ["event_id", "event_type", "user_id", "props"]
    stored = table(spark, sf, "events").withColumn("hash", logs.integrity_hash(fields))
    tampered = stored.withColumn("props", F.when(F.col("event_id") % 97 == 0, F.lit("{}")).otherwise(F.col("props")))
    return logs.audit_verify(tampered, fields, "hash").select("event_id", "event_type")


@query(
    "job_cost",
    "SELECT event_id, ROUND(value * 0.001 + LENGTH(props) * 0.0001, 6) AS cost FROM events",
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("mb", F.length("props"))
    return rounded(logs.job_cost(events, "value", "mb").select("event_id", "cost"), 6)


@query(
    "cost_by_tenant",
    """SELECT user_id AS tenant_id, ROUND(SUM(value), 4) AS total_compute_units, CAST(SUM(LENGTH(props)) AS BIGINT) AS total_storage_units,
       ROUND(SUM(value * 0.001 + LENGTH(props) * 0.0001), 6) AS total_cost, COUNT(*) AS total_jobs, COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS recent_jobs_count,
       ROUND(AVG(value), 4) AS avg_compute_units_per_job FROM events GROUP BY 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("mb", F.length("props"))
    return rounded(logs.cost_by_tenant(events, "user_id", "value", "mb", "ts", dt.datetime(2024, 1, 20)), 4, total_cost=6)


@query(
    "quota_usage",
    """
    WITH l AS (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 0 ELSE 604800 END AS p, 50.0 + user_id AS lim FROM events),
         u AS (SELECT l.*, COALESCE(SUM(value) FILTER (EPOCH(TIMESTAMP '2024-01-30') - EPOCH(ts) BETWEEN 0 AND CASE p WHEN 0 THEN 300 ELSE p END), 0) AS used
               FROM l JOIN events USING (user_id, event_type) GROUP BY ALL)
    SELECT user_id AS tenant_id, event_type AS resource, ROUND(used, 4) AS current_usage, CAST(lim AS DOUBLE) AS "limit", ROUND(used / lim * 100, 4) AS utilization_percent,
           ROUND(GREATEST(0, lim - used), 4) AS remaining, used + 1 <= lim AS allowed FROM u
    """,
)
def _(spark, sf):
    log = usage_log(spark, sf)
    limits = log.select("tenant_id", "resource").distinct().select(
        "*",
        F.when(F.col("resource") == "view", 86_400).when(F.col("resource") == "click", 0).otherwise(604_800).alias("period_seconds"),
        (F.lit(50.0) + F.col("tenant_id")).alias("limit"),
    )
    return rounded(logs.quota_usage(log, limits, AS_OF))


@query(
    "tier_usage",
    """
    WITH t AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' ELSE 'unlimited' END AS tier FROM events),
         l AS (SELECT * FROM (VALUES ('free', 'jobs_per_day', 10, 86400), ('free', 'api_calls_per_minute', 60, 60), ('starter', 'jobs_per_day', 100, 86400),
                                     ('starter', 'api_calls_per_minute', 300, 60)) l(tier, resource, lim, p)),
         e AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'api_calls_per_minute' ELSE 'jobs_per_day' END AS resource, ts FROM events),
         u AS (SELECT t.user_id, l.resource, lim, COUNT(e.ts) FILTER (EPOCH(TIMESTAMP '2024-01-20') - EPOCH(ts) BETWEEN 0 AND p) AS used
               FROM t JOIN l USING (tier) LEFT JOIN e ON e.user_id = t.user_id AND e.resource = l.resource GROUP BY ALL)
    SELECT user_id AS tenant_id, resource, CAST(used AS DOUBLE) AS current_usage, CAST(lim AS DOUBLE) AS "limit", ROUND(used / lim * 100, 4) AS utilization_percent,
           CAST(GREATEST(0, lim - used) AS DOUBLE) AS remaining, used + 1 <= lim AS allowed FROM u
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events")
    tenants = events.select(F.col("user_id").alias("tenant_id")).distinct()
    tenants = tenants.withColumn("tier", F.element_at(F.array(F.lit("free"), F.lit("starter"), F.lit("unlimited")), (F.col("tenant_id") % 3 + 1).cast("int")))
    resource = F.when(F.col("event_type") == "view", "api_calls_per_minute").otherwise("jobs_per_day")
    log = events.select(F.col("user_id").alias("tenant_id"), resource.alias("resource"), "ts", F.lit(1.0).alias("amount"))
    used = logs.tier_usage(log, tenants, dt.datetime(2024, 1, 20))
    return rounded(used.where(F.col("resource").isin("jobs_per_day", "api_calls_per_minute")))


@query(
    "plan_status",
    """
    WITH u AS (SELECT user_id AS tenant_id, CASE WHEN user_id % 2 = 0 THEN 'free' ELSE 'starter' END AS tier, COUNT(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-29') AS jobs_today,
                      SUM(value) * 1000000 AS b, COUNT(DISTINCT event_type) AS s, COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-29 22:00:00' AND CAST(ts AS DATE) = DATE '2024-01-29') AS r FROM events GROUP BY 1),
         l AS (SELECT * FROM (VALUES ('free', 10, 1.0, 3, 1), ('starter', 100, 10.0, 10, 3)) t(tier, jobs_limit, gb, sl, cl))
    SELECT tenant_id, tier, jobs_today, CAST(jobs_limit AS BIGINT) AS jobs_limit, CAST(GREATEST(0, jobs_limit - jobs_today) AS BIGINT) AS jobs_remaining,
           jobs_today < jobs_limit AS jobs_allowed, b < gb * POW(1024, 3) AS artifacts_allowed, s < sl AS sources_allowed, r < cl AS running_allowed
    FROM u JOIN l USING (tier)
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events")
    today = F.to_date("ts") == F.lit("2024-01-29").cast("date")
    usage = events.groupBy(F.col("user_id").alias("tenant_id")).agg(
        F.count_if(today).alias("jobs_today"),
        (F.sum("value") * 1_000_000).alias("artifacts_bytes"),
        F.count_distinct("event_type").alias("sources"),
        F.count_if(today & (F.col("ts") >= F.lit("2024-01-29 22:00:00").cast("timestamp_ntz"))).alias("running"),
    ).withColumn("tier", F.when(F.col("tenant_id") % 2 == 0, "free").otherwise("starter"))
    return logs.plan_status(usage).drop("artifacts_gb", "artifacts_limit_gb")


@query(
    "slo_status",
    """
    WITH s AS (SELECT 'slo_' || user_id AS slo, user_id AS sli, 0.7 + user_id % 4 * 0.1 AS target, CASE WHEN user_id % 2 = 0 THEN 24 ELSE 168 END AS h FROM (SELECT DISTINCT user_id FROM events)),
         r AS (SELECT slo, sli, CAST(target AS DOUBLE) AS target, AVG(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) FILTER (EPOCH(TIMESTAMP '2024-01-30') - EPOCH(ts) BETWEEN 0 AND h * 3600) AS v,
                      COUNT(*) FILTER (EPOCH(TIMESTAMP '2024-01-30') - EPOCH(ts) BETWEEN 0 AND h * 3600) AS data_points FROM s JOIN events ON user_id = sli GROUP BY ALL)
    SELECT slo, sli, ROUND(COALESCE(v, 1), 6) AS current_value, ROUND(target, 6) AS target, COALESCE(v, 1) >= target AS is_meeting,
           ROUND(CASE WHEN 1 - target > 0 THEN GREATEST(0, 1 - (1 - COALESCE(v, 1)) / (1 - target)) ELSE CASE WHEN COALESCE(v, 1) >= target THEN 1 ELSE 0 END END, 6) AS error_budget_remaining, data_points
    FROM r
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events")
    points = events.select(F.col("user_id").alias("sli"), "ts", (F.col("event_type") != "error").cast("int").alias("good"))
    slos = events.select(F.col("user_id").alias("sli")).distinct().select(
        F.concat(F.lit("slo_"), "sli").alias("slo"),
        "sli",
        (F.lit("0.7").cast("decimal(3,1)") + (F.col("sli") % 4) * F.lit("0.1").cast("decimal(3,1)")).cast("double").alias("target"),
        F.when(F.col("sli") % 2 == 0, 24).otherwise(168).alias("window_hours"),
    )
    return rounded(logs.slo_status(points, slos, AS_OF), 6)


ALERT_SQL = """
    s AS (SELECT event_type AS rule, ts, event_id, value > 20 AS met FROM events),
    l AS (SELECT *, LAG(met) OVER (PARTITION BY rule ORDER BY ts, event_id) AS was FROM s),
    b AS (SELECT *, SUM(CASE WHEN met AND NOT COALESCE(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
    g AS (SELECT rule, run, MIN(ts) AS pending_since, MIN(ts) FILTER (NOT met) AS resolved_at FROM b WHERE run > 0 GROUP BY 1, 2),
    f AS (SELECT g.rule, pending_since, MIN(ts) AS fired_at, resolved_at FROM g JOIN b USING (rule, run) WHERE met AND EPOCH_US(ts) - EPOCH_US(pending_since) >= 3600000000 GROUP BY ALL)"""


@query("alert_intervals", f"WITH {ALERT_SQL} SELECT * FROM f")
def _(spark, sf):
    signal = table(spark, sf, "events").select(F.col("event_type").alias("rule"), "ts", "event_id", (F.col("value") > 20).alias("met"))
    return logs.alert_intervals(signal, "rule", ["ts", "event_id"], "met", 3600)


LATENCY_SQL = """
    r AS (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events),
    s AS (SELECT event_type, COUNT(*) AS samples, MIN(value) AS min, MAX(value) AS max, ROUND(AVG(value), 4) AS mean, MAX(value) FILTER (i = n // 2) AS median,
                 MAX(value) FILTER (i = FLOOR(n * 0.95)) AS p95, MAX(value) FILTER (i = FLOOR(n * 0.99)) AS p99 FROM r GROUP BY 1)"""


@query("latency_stats", f"WITH {LATENCY_SQL} SELECT * FROM s")
def _(spark, sf):
    return rounded(logs.latency_stats(table(spark, sf, "events"), "event_type", "value"))


@query("slow_operations", f"WITH {LATENCY_SQL} SELECT * FROM s WHERE p95 > 147")
def _(spark, sf):
    return rounded(logs.latency_stats(table(spark, sf, "events"), "event_type", "value", 147.0))


@query(
    "retention_by_age",
    """WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-12-02')
       SELECT (SELECT COUNT(*) FROM o) AS jobs, COUNT(*) AS artifacts, ROUND(SUM(l_quantity), 4) AS bytes FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
)
def _(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), "o_orderdate")
    artifacts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), "l_quantity")
    old = logs.retention_by_age(jobs, artifacts, "job", "o_orderdate", dt.datetime(1998, 1, 1))
    return rounded(logs.retention_summary(*old, "l_quantity"))


@query(
    "retention_by_count",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       SELECT o_orderkey, o_orderpriority FROM r WHERE rn > 100""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return logs.retention_by_count(orders, "o_orderpriority", ["o_orderdate", "o_orderkey"], 100).drop("o_orderdate")


SCHEMAS = (
    EventSchema("view", (Field("k", "integer"),)),
    EventSchema("click", (Field("k", "string"),)),
    EventSchema("purchase", (Field("k", "float"), Field("sku"))),
    EventSchema("signup", (Field("plan", "enum", False, ("a", "b")),), deprecated="use register"),
)


@query(
    "validate_events",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'type:k' WHEN 'purchase' THEN 'missing:sku' WHEN 'signup' THEN '' ELSE 'no_schema' END AS errors,
       CASE event_type WHEN 'signup' THEN 'deprecated,unknown:k' ELSE '' END AS warnings, event_type IN ('view', 'signup') AS valid FROM events""",
)
def _(spark, sf):
    checked = logs.validate_events(table(spark, sf, "events"), "event_type", "props", SCHEMAS)
    return checked.select("event_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")


@query(
    "validate_known_events",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'type:row_count' WHEN event_id % 3 = 1 THEN 'missing:table_name' ELSE '' END AS errors, event_id % 3 = 2 AS valid FROM events""",
)
def _(spark, sf):
    payload = F.expr(
        """concat('{"source_id": "s", "tenant_id": "t', user_id, '", "ingested_at": "', string(ts), '", "row_count": ',
           CASE event_id % 3 WHEN 0 THEN '"7"' WHEN 1 THEN '7, "x": null' ELSE '7' END, if(event_id % 3 = 1, '', ', "table_name": "q"'), '}')"""
    )
    events = table(spark, sf, "events").select("event_id", F.lit("data.ingested").alias("name"), payload.alias("payload"))
    return logs.validate_events(events, "name", "payload").select("event_id", F.array_join("errors", ",").alias("errors"), "valid")
