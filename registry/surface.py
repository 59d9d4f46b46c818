"""SQL surface, sources, streams and flows."""

import os

from pyspark.sql import functions as F

from millrace.operators import anomaly, kpi, series
from millrace.operators.contracts import ColumnSpec, Contract, validate_schema
from millrace.plans import flow, sql
from millrace.sources import io, snapshots
from millrace.streaming import jobs
from registry import query, rounded, scratch, table
from registry.oplogs import ALERT_SQL, SCHEMAS

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def views(spark, sf):
    for name in TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)


def sql_query(name, text, oracle=None):
    def run(spark, sf):
        views(spark, sf)
        return rounded(spark.sql(text))

    query(f"sql_{name}", oracle or text)(run)


sql_query(
    "projection_filter",
    "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS amount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R')",
    "SELECT l_orderkey, l_linenumber, ROUND(l_quantity * l_extendedprice, 4) AS amount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R')",
)
JOIN = "SELECT c_custkey, o_orderkey FROM customer {} JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'"
sql_query("join_inner", JOIN.format("INNER"))
sql_query("join_left", JOIN.format("LEFT"))
sql_query("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 20")
sql_query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sql_query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sql_query("join_theta", "SELECT o_orderkey, COUNT(*) AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate GROUP BY o_orderkey")
sql_query("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
sql_query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
GROUPED = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {sum} AS qty FROM lineitem GROUP BY {by}"
for name, by in (
    ("rollup", "ROLLUP (l_returnflag, l_linestatus)"),
    ("cube", "CUBE (l_returnflag, l_linestatus)"),
    ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
):
    sql_query(name, GROUPED.format(sum="SUM(l_quantity)", by=by), GROUPED.format(sum="ROUND(SUM(l_quantity), 4)", by=by))
sql_query("distinct_agg", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority")
sql_query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query(
    "correlated_subquery",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem o WHERE l_quantity > (SELECT 1.3 * AVG(i.l_quantity) FROM lineitem i WHERE i.l_partkey = o.l_partkey)",
)
sql_query(
    "window",
    "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk, SUM(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders",
    "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS rk, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS total FROM orders",
)
sql_query(
    "cte_case",
    "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT CASE WHEN n > 15 THEN 'many' WHEN n > 8 THEN 'some' ELSE 'few' END AS band, COUNT(*) AS customers FROM t GROUP BY 1",
)
sql_query(
    "scalar_functions",
    "SELECT c_custkey, UPPER(c_mktsegment) AS seg, COALESCE(NULLIF(c_nationkey, 0), -1) AS nk, ABS(CAST(c_acctbal AS INT)) % 10 AS digit, SUBSTR(c_name, 10) AS code, c_name LIKE '%7' AS seven FROM customer",
    "SELECT c_custkey, UPPER(c_mktsegment) AS seg, COALESCE(NULLIF(c_nationkey, 0), -1) AS nk, ABS(CAST(TRUNC(c_acctbal) AS INT)) % 10 AS digit, SUBSTR(c_name, 10) AS code, c_name LIKE '%7' AS seven FROM customer",
)
sql_query(
    "date_functions",
    "SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n, MAX(DAY(o_orderdate)) AS last_day FROM orders GROUP BY 1, 2",
    "SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, COUNT(*) AS n, CAST(MAX(DAY(o_orderdate)) AS INTEGER) AS last_day FROM orders GROUP BY 1, 2",
)
sql_query(
    "array_functions",
    "SELECT p_partkey, SIZE(SPLIT(p_name, ' ')) AS words, ELEMENT_AT(SPLIT(p_name, ' '), 1) AS first_word FROM part",
    "SELECT p_partkey, CAST(LEN(STRING_SPLIT(p_name, ' ')) AS INTEGER) AS words, STRING_SPLIT(p_name, ' ')[1] AS first_word FROM part",
)
sql_query(
    "map_functions",
    "SELECT n_nationkey, MAP(n_name, r_name)[n_name] AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "SELECT n_nationkey, MAP {n_name: r_name}[n_name] AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
)
sql_query(
    "json_functions",
    "SELECT event_type, SUM(CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type",
    "SELECT event_type, CAST(SUM(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type",
)


@query("guarded_sql", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(spark, sf):
    views(spark, sf)
    text = "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY o_orderpriority -- drop it"
    return sql.guarded_sql(spark, text, 1000, {"least": 100_000})


KPIS = [
    {"name": "orders", "sql": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"},
    {"name": "segments", "sql": "SELECT c_mktsegment, AVG(c_acctbal) AS balance FROM customer GROUP BY c_mktsegment"},
    {"name": "parts", "sql": "SELECT l_partkey, SUM(l_extendedprice) AS amount FROM lineitem GROUP BY l_partkey"},
]


@query(
    "run_kpis",
    """SELECT 'orders' AS name, 'o_orderstatus,n' AS columns, COUNT(DISTINCT o_orderstatus) AS row_count, FALSE AS truncated FROM orders
       UNION ALL SELECT 'segments', 'c_mktsegment,balance', COUNT(DISTINCT c_mktsegment), FALSE FROM customer
       UNION ALL SELECT 'parts', 'l_partkey,amount', COUNT(DISTINCT l_partkey), COUNT(DISTINCT l_partkey) > 1000 FROM lineitem""",
)
def _(spark, sf):
    views(spark, sf)
    return sql.kpi_summary(sql.run_kpis(spark, KPIS), limit=1000).withColumn("columns", F.array_join("columns", ","))


STATEMENTS = {
    "own": "SELECT COUNT(*) AS n FROM t0_orders",
    "own, in parts": "WITH big AS (SELECT * FROM T0_Orders WHERE o_totalprice > 100000) SELECT COUNT(*) AS n FROM big WHERE EXISTS (SELECT 1 FROM `t0_orders`)",
    "another's": "SELECT COUNT(*) AS n FROM t1_orders",
    "another's, below": "SELECT COUNT(*) AS n FROM t0_orders WHERE o_custkey IN (SELECT o_custkey FROM t1_orders)",
    "another's, under a name of its own": "SELECT (SELECT COUNT(*) FROM (WITH t1_orders AS (SELECT 1) SELECT * FROM t1_orders)) + COUNT(*) AS n FROM t1_orders",
}


@query(
    "guarded_sql_tenant",
    """SELECT 'own' AS statement, TRUE AS allowed, (SELECT COUNT(*) FROM orders WHERE o_orderkey % 2 = 0) AS n
    UNION ALL SELECT 'own, in parts', TRUE, (SELECT COUNT(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice > 100000)
    UNION ALL SELECT UNNEST(['another''s', 'another''s, below', 'another''s, under a name of its own']), FALSE, NULL""",
)
def _(spark, sf):
    """The statements that tenant t0 may run with their results, and those that it may not."""
    orders, out = table(spark, sf, "orders"), None
    for tenant in (0, 1):
        orders.where(F.col("o_orderkey") % 2 == tenant).createOrReplaceTempView(f"t{tenant}_orders")
    for name, text in STATEMENTS.items():
        try:
            row = sql.guarded_sql(spark, text, tables=sql.tenant_rule("t0")).select(F.lit(name).alias("statement"), F.lit(True).alias("allowed"), "n")
        except sql.RejectedSql:
            row = spark.createDataFrame([(name, False, None)], "statement string, allowed boolean, n long")
        out = row if out is None else out.unionByName(row)
    return out


@query("tenant_scope", "SELECT event_id, value FROM events WHERE user_id = 17")
def _(spark, sf):
    return sql.tenant_scope(table(spark, sf, "events"), 17, "user_id").select("event_id", "value")


@query(
    "table_allowed",
    "SELECT n_name, STARTS_WITH(n_name, 'NATION_1') AS prefix, FALSE AS metadata, REGEXP_MATCHES(n_name, '[AEIOU]N') AS custom FROM nation",
)
def _(spark, sf):
    name = F.col("n_name")
    return table(spark, sf, "nation").select(
        "n_name",
        sql.table_allowed(name, "NATION", "prefix", "_1").alias("prefix"),
        sql.table_allowed(name, "NATION", "metadata").alias("metadata"),
        sql.table_allowed(name, "NATION", "custom", pattern="[AEIOU]N").alias("custom"),
    )


# --- sources -------------------------------------------------------------------------------------


def _round_trip(fmt):
    def run(spark, sf):
        folder = scratch(spark)
        customers = table(spark, sf, "customer")
        io.export(customers, folder, fmt)
        back = io.read_source(spark, folder, fmt)
        return back.select(*[F.col(c).cast(k).alias(c) for c, k in customers.dtypes])

    return run


for fmt in ("csv", "json", "parquet"):
    query(f"read_source_{fmt}", "SELECT * FROM customer")(_round_trip(fmt))


@query("export", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    folder = scratch(spark)
    io.export(table(spark, sf, "customer"), folder, "parquet", ["c_mktsegment"])
    return spark.read.parquet(folder).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_table_full", "SELECT COUNT(*) AS rows_ingested, 'full' AS mode FROM orders")
def _(spark, sf):
    return io.ingest_table(table(spark, sf, "orders"), scratch(spark), "full")


@query("ingest_table_incremental", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    orders, folder = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), scratch(spark)
    gate = Contract("orders", (ColumnSpec("o_orderkey", "integer", nullable=False),))
    io.ingest_table(orders.where("o_orderkey % 3 = 0"), folder, "full")
    io.ingest_table(orders, folder, "incremental", ["o_orderkey"], lambda df: validate_schema(df, gate))
    return spark.read.parquet(folder)


def _loaded(spark, sf):
    """Orders in two loads; a third one, which would replace them, breaks off in its rows."""
    orders, folder = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), scratch(spark)
    snapshots.load(orders.where("o_orderkey % 3 = 0"), folder, job="nightly", inputs=["raw.orders"], tenant="t0")
    snapshots.load(orders, folder, "incremental", ["o_orderkey"], job="catch_up", inputs=["raw.orders", "raw.late"], tenant="t0")
    broken = orders.withColumn("o_custkey", F.when(F.col("o_custkey") >= 0, F.raise_error(F.lit("broken row"))).cast(orders.schema["o_custkey"].dataType))
    try:
        snapshots.load(broken, folder, job="broken", inputs=["raw.orders"], tenant="t0")
    except Exception as e:
        if "broken row" not in str(e):
            raise
    return folder


@query("snapshot_table", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    return snapshots.read(spark, _loaded(spark, sf))


@query(
    "load_lineage",
    """WITH n AS (SELECT COUNT(*) FILTER (o_orderkey % 3 = 0) AS a, COUNT(*) FILTER (o_orderkey % 3 <> 0) AS b FROM orders)
    SELECT 'raw.orders' AS source, 'nightly' AS target, 'reads' AS edge_type, 1 AS version, a AS rows_added FROM n UNION ALL SELECT 'nightly', 'orders@1', 'produces', 1, a FROM n
    UNION ALL SELECT 'raw.orders', 'catch_up', 'reads', 2, b FROM n UNION ALL SELECT 'raw.late', 'catch_up', 'reads', 2, b FROM n UNION ALL SELECT 'catch_up', 'orders@2', 'produces', 2, b FROM n""",
)
def _(spark, sf):
    return snapshots.lineage(spark, _loaded(spark, sf), "orders")[1]


@query("table_preview", "SELECT vec_id, LEAST(LEN(embedding), 100) AS shown, (SELECT COUNT(*) FROM embeddings) AS total_rows FROM embeddings ORDER BY vec_id LIMIT 100")
def _(spark, sf):
    return io.table_preview(table(spark, sf, "embeddings"), 100, ["vec_id"]).select("vec_id", F.size("embedding").alias("shown"), "total_rows")


@query("etl", "SELECT o_orderstatus, ROUND(SUM(o_totalprice), 4) AS total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def _(spark, sf):
    steps = [
        lambda df: df.where("o_orderpriority <> '5-LOW'"),
        lambda df: df.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total")),
    ]
    return rounded(io.etl(spark, f"{sf}/orders.parquet", steps, scratch(spark)))


# --- streams -------------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.file_stream(spark, sf, schema, pattern="events.parquet")


def _finish(running):
    running.awaitTermination()
    return running


def _windowed(slide):
    edge = "(SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"
    starts = "DATE_TRUNC('hour', ts)" if slide is None else "UNNEST([DATE_TRUNC('hour', ts), DATE_TRUNC('hour', ts) - INTERVAL 1 HOUR])"
    hours = 1 if slide is None else 2
    return f"""WITH w AS (SELECT {starts} AS window_start, event_type, value FROM events)
      SELECT window_start, window_start + INTERVAL {hours} HOUR AS window_end, event_type, COUNT(*) AS count, ROUND(SUM(value), 4) AS sum, ROUND(AVG(value), 4) AS avg
      FROM w GROUP BY ALL HAVING window_start + INTERVAL {hours} HOUR <= {edge}"""


def _stream_windows(window, slide):
    def run(spark, sf):
        out = jobs.stream_kpi(event_stream(spark, sf), "ts", "event_type", "value", window, slide)
        sink = scratch(spark)
        _finish(jobs.start(out, f"{sink}/out", f"{sink}/checkpoint"))
        windows = spark.read.parquet(f"{sink}/out")
        return rounded(windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}))

    return run


query("stream_kpi", _windowed(None))(_stream_windows("1 hour", None))
query("stream_kpi_sliding", _windowed("1 hour"))(_stream_windows("2 hours", "1 hour"))


@query(
    "stream_sessions",
    """WITH l AS (SELECT *, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL 6 HOUR OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l)
       SELECT MIN(ts) AS window_start, MAX(ts) + INTERVAL 6 HOUR AS window_end, user_id, COUNT(*) AS count, ROUND(SUM(value), 4) AS sum, ROUND(AVG(value), 4) AS avg
       FROM s GROUP BY user_id, sid HAVING MAX(ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    out = jobs.stream_sessions(event_stream(spark, sf), "ts", "user_id", "value", "6 hours")
    sink = scratch(spark)
    _finish(jobs.start(out, f"{sink}/out", f"{sink}/checkpoint"))
    windows = spark.read.parquet(f"{sink}/out")
    return rounded(windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}))


@query(
    "stream_anomalies",
    """WITH r AS (SELECT event_type, ts, event_id, value, COUNT(*) OVER w AS n, AVG(value) OVER w AS m, STDDEV_POP(value) OVER w AS d FROM events
         WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT event_type, ts, event_id, value, ROUND(m, 4) AS mean, ROUND(ABS(value - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 4) AS score FROM r
       WHERE n >= 2 AND ABS(value - m) / CASE WHEN d = 0 THEN 1 ELSE d END > 3""",
)
def _(spark, sf):
    sink = scratch(spark)
    _finish(jobs.stream_anomalies(event_stream(spark, sf), ["ts", "event_id"], "event_type", "value", f"{sink}/out", f"{sink}/checkpoint"))
    return rounded(spark.read.parquet(f"{sink}/out"))


VALID_SQL = "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'signup')"


def _validated(which):
    def run(spark, sf):
        sink = scratch(spark)
        _finish(
            jobs.stream_validate(event_stream(spark, sf), "event_type", "props", f"{sink}/good", f"{sink}/bad", f"{sink}/checkpoint", SCHEMAS)
        )
        return spark.read.parquet(f"{sink}/{which}").select("event_id", "event_type")

    return run


query("stream_validate", VALID_SQL)(_validated("good"))
query("stream_validate_invalid", VALID_SQL.replace("IN", "NOT IN"))(_validated("bad"))


@query(
    "stream_alerts",
    f"WITH {ALERT_SQL} SELECT rule, 'firing' AS state, fired_at AS at FROM f UNION ALL SELECT rule, 'resolved', resolved_at FROM f WHERE resolved_at IS NOT NULL",
)
def _(spark, sf):
    points = event_stream(spark, sf).select(F.col("event_type").alias("rule"), "ts", "event_id", (F.col("value") > 20).alias("met"))
    sink = scratch(spark)
    _finish(jobs.stream_alerts(points, "rule", ["ts", "event_id"], "met", f"{sink}/out", f"{sink}/state", f"{sink}/checkpoint", 3600))
    return spark.read.parquet(f"{sink}/out").drop("batch")


@query("stream_sample", "SELECT * FROM events ORDER BY SUBSTR(MD5('11|' || event_id), 1, 15), event_id LIMIT 500")
def _(spark, sf):
    sink = scratch(spark)
    done = _finish(jobs.stream_sample(event_stream(spark, sf), 500, ["event_id"], f"{sink}/state", f"{sink}/checkpoint", 11))
    return jobs.latest_state(spark, f"{sink}/state", done)


# --- flows ---------------------------------------------------------------------------------------


def analyzers() -> flow.Registry:
    known = flow.Registry()
    known.register("anomalies", "statistics")(lambda df, ctx: anomaly.anomalies_zscore(df, ctx["value"], ctx["key"]))
    known.register("segments", "report", order=10)(lambda df, ctx: kpi.revenue_by_segment(df, ctx["segment"], ctx["value"]))
    known.register("hidden", "other", flag="MILLRACE_ANALYZER_HIDDEN")(lambda df, ctx: df)
    known.register("broken", "other")(lambda df, ctx: df.select("no_such_column"))
    known.register("bars", "visualization", kind="generator")(lambda ctx: flow.bar_chart(ctx["analyzers"]["segments"], "segment", "revenue"))
    return known


def run_analysis(spark, sf):
    views(spark, sf)
    os.environ["MILLRACE_ANALYZER_HIDDEN"] = "off"
    context = {"value": "o_totalprice", "segment": "o_orderpriority", "key": ["o_orderkey"]}
    return flow.analyze(spark, "orders", KPIS, context=context, registry=analyzers())


@query(
    "analyze",
    """
    WITH s AS (SELECT o_orderpriority AS p, SUM(o_totalprice) AS r, ROUND(SUM(o_totalprice), 4) AS y FROM orders GROUP BY 1),
      k AS (SELECT AVG(o_totalprice) AS m, STDDEV_POP(o_totalprice) AS d FROM orders),
      z AS (SELECT o_orderkey, o_totalprice, m, ABS(o_totalprice - m) / d AS score FROM orders, k WHERE ABS(o_totalprice - m) / d > 3)
    SELECT 'kpi' AS part, 'orders' AS name, o_orderstatus AS label, 'n' AS measure, COUNT(*)::DOUBLE AS value FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'kpi', 'segments', c_mktsegment, 'balance', ROUND(AVG(c_acctbal), 4) FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 'kpi', 'parts', CAST(l_partkey AS VARCHAR), 'amount', ROUND(SUM(l_extendedprice), 4) FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT 'analyzer', 'segments', p, 'revenue', y FROM s
    UNION ALL SELECT 'analyzer', 'segments', p, 'pct_of_total', ROUND(100 * r / (SELECT SUM(r) FROM s), 2) FROM s
    UNION ALL SELECT 'generator', 'bars', p, 'y', y FROM s
    UNION ALL SELECT 'analyzer', 'anomalies', CAST(o_orderkey AS VARCHAR), UNNEST(['value', 'score', 'expected']),
      UNNEST([ROUND(o_totalprice, 4), ROUND(score, 4), ROUND(m, 4)]) FROM z
    """,
)
def _(spark, sf):
    return rounded(run_analysis(spark, sf).report())


@query("analyze_profile")
def _(spark, sf):
    return rounded(run_analysis(spark, sf).profile)


@query(
    "register_analyzer",
    "SELECT o_orderpriority AS x, ROUND(SUM(o_totalprice), 4) AS y FROM orders GROUP BY 1 ORDER BY y DESC LIMIT 50",
)
def _(spark, sf):
    return rounded(run_analysis(spark, sf).generators["bars"])


@query("bar_chart", "SELECT c_mktsegment AS x, ROUND(SUM(c_acctbal), 4) AS y FROM customer GROUP BY 1 ORDER BY y DESC LIMIT 50")
def _(spark, sf):
    return rounded(flow.bar_chart(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@query("line_chart", "SELECT DATE_TRUNC('day', ts)::TIMESTAMP AS x, ROUND(AVG(value), 4) AS y FROM events GROUP BY 1")
def _(spark, sf):
    return rounded(flow.line_chart(table(spark, sf, "events"), "ts", "value"))


@query(
    "outlier_scatter",
    """WITH e AS (SELECT MIN(event_id) AS x0, (MAX(event_id) - MIN(event_id)) / 100 AS wx, MIN(value) AS y0, (MAX(value) - MIN(value)) / 100 AS wy FROM events)
       SELECT CAST(LEAST(99, FLOOR((event_id - x0) / wx)) AS BIGINT) AS cell_x, CAST(LEAST(99, FLOOR((value - y0) / wy)) AS BIGINT) AS cell_y, value > 200 AS outlier,
              COUNT(*) AS points, ROUND(AVG(event_id), 4) AS x, ROUND(AVG(value), 4) AS y FROM events, e GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("far", F.col("value") > 200)
    return rounded(flow.outlier_scatter(events, "event_id", "value", "far"))


@query("forecast_chart")
def _(spark, sf):
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    ahead = series.forecast_calendar(days, "ts", "v", 14)
    return rounded(flow.forecast_chart(days, ahead, "ts", "v"))
