"""Contract, schema, privacy, lineage and baseline queries."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.operators import contracts, lineage, privacy
from millrace.operators.contracts import ColumnSpec, Contract
from registry import query, rounded, table

PARTS = Contract(
    "parts",
    (
        ColumnSpec("p0", "integer", nullable=False),
        ColumnSpec("p1", "string"),
        ColumnSpec("p3", "integer", nullable=False),
    ),
)


@query(
    "validate_schema",
    """
    WITH v AS (SELECT p_brand AS table_name, CAST(p_partkey AS VARCHAR) AS version, p_size % 5 AS m FROM part)
    SELECT table_name, version, 'p1' AS "column", 'error' AS level, 'type_mismatch' AS code, 'string' AS expected, 'bigint' AS actual FROM v WHERE m >= 1
    UNION ALL SELECT table_name, version, 'p1', 'warning', 'missing_optional', 'string', NULL FROM v WHERE m < 1
    UNION ALL SELECT table_name, version, 'p3', 'error', 'missing_required', 'integer', NULL FROM v WHERE m < 3
    UNION ALL SELECT table_name, version, 'p2', 'warning', 'extra_column', NULL, 'bigint' FROM v WHERE m >= 2
    UNION ALL SELECT table_name, version, 'p4', 'warning', 'extra_column', NULL, 'bigint' FROM v WHERE m >= 4
    """,
)
def _(spark, sf):
    fields = schema_registry(spark, sf).select("table_name", "version", F.inline("columns"))
    return contracts.validate_schemas(fields, PARTS, ["table_name", "version"])


EVENTS = Contract(
    "events",
    (
        ColumnSpec("event_id", "integer", nullable=False, unique=True),
        ColumnSpec("value", "float", low=1.0, high=200.0, max_null_rate=0.05),
        ColumnSpec("event_type", "string", max_length=6, allowed=("view", "click", "purchase")),
        ColumnSpec("props", "string", pattern=r'^\{"k": [0-9]\}$'),
    ),
    completeness=0.9,
    freshness_column="ts",
    freshness_hours=24,
)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
SPARSE_SQL = "x AS (SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN value END AS value) FROM events)"


def sparse_events(spark, sf):
    return table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))


@query(
    "validate_rows",
    f"""
    WITH {SPARSE_SQL}, t AS (SELECT COUNT(*) AS n FROM x), r AS (
      SELECT 'event_id' AS column_name, 'not_null' AS rule, COUNT(*) FILTER (event_id IS NULL) AS failures FROM x
      UNION ALL SELECT 'event_id', 'unique', COUNT(event_id) - COUNT(DISTINCT event_id) FROM x
      UNION ALL SELECT 'value', 'range', COUNT(*) FILTER (value < 1 OR value > 200) FROM x
      UNION ALL SELECT 'event_type', 'length', COUNT(*) FILTER (LENGTH(event_type) > 6) FROM x
      UNION ALL SELECT 'event_type', 'enum', COUNT(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) FROM x
      UNION ALL SELECT 'props', 'pattern', COUNT(*) FILTER (NOT REGEXP_MATCHES(props, '^\\{{"k": [0-9]\\}}$')) FROM x)
    SELECT column_name, rule, failures, n AS total_rows, failures = 0 AS passed FROM r, t
    UNION ALL SELECT 'value', 'max_null_rate', COUNT(*) - COUNT(value), COUNT(*), (COUNT(*) - COUNT(value)) / COUNT(*) <= 0.05 FROM x
    UNION ALL SELECT '*', 'completeness', COUNT(*) - COUNT(value), COUNT(*), (3 * COUNT(*) + COUNT(value)) / (4 * COUNT(*)) >= 0.9 FROM x
    UNION ALL SELECT 'ts', 'freshness', CASE WHEN MAX(ts) >= TIMESTAMP '2024-01-30' THEN 0 ELSE 1 END, COUNT(*), MAX(ts) >= TIMESTAMP '2024-01-30' FROM x
    """,
)
def _(spark, sf):
    return contracts.validate_rows(sparse_events(spark, sf), EVENTS, EVENTS_AS_OF)


@query(
    "violating_rows",
    f"""
    WITH {SPARSE_SQL}, b AS (SELECT event_id, CONCAT_WS(',', CASE WHEN value < 1 OR value > 200 THEN 'value:range' END,
        CASE WHEN LENGTH(event_type) > 6 THEN 'event_type:length' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'event_type:enum' END,
        CASE WHEN NOT REGEXP_MATCHES(props, '^\\{{"k": [0-9]\\}}$') THEN 'props:pattern' END) AS broken_rules FROM x)
    SELECT * FROM b WHERE broken_rules <> ''
    """,
)
def _(spark, sf):
    broken = contracts.violating_rows(sparse_events(spark, sf), EVENTS)
    return broken.select("event_id", F.array_join("broken_rules", ",").alias("broken_rules"))


DIFF_SQL = """
    a AS (SELECT p_brand AS table_name, ARG_MIN(p_size % 5, p_partkey) AS m0, ARG_MAX(p_size % 5, p_partkey) AS m1,
                 ARG_MIN(p_size % 2, p_partkey) AS e0, ARG_MAX(p_size % 2, p_partkey) AS e1 FROM part GROUP BY 1),
    p AS (SELECT *, UNNEST(RANGE(1, 5)) AS i FROM a),
    d AS (SELECT table_name, CONCAT('p', i) AS name, 'added' AS change, FALSE AS breaking, NULL AS old_type, 'bigint' AS new_type FROM p WHERE i > m0 AND i <= m1
          UNION ALL SELECT table_name, CONCAT('p', i), 'removed', TRUE, 'bigint', NULL FROM p WHERE i <= m0 AND i > m1
          UNION ALL SELECT table_name, 'p0', 'type_changed', e1 = 0, CASE e0 WHEN 0 THEN 'int' ELSE 'bigint' END, CASE e1 WHEN 0 THEN 'int' ELSE 'bigint' END
          FROM a WHERE e0 <> e1)"""


def _ends(spark, sf):
    """The fields of every table's first and last version."""
    ends = schema_registry(spark, sf).groupBy("table_name").agg(
        F.min_by("columns", "created_at").alias("first"), F.max_by("columns", "created_at").alias("last")
    )
    return ends.select("table_name", F.inline("first")), ends.select("table_name", F.inline("last"))


@query("schema_diff", f"WITH {DIFF_SQL} SELECT * FROM d")
def _(spark, sf):
    return contracts.schema_diff(*_ends(spark, sf), ["table_name"])


@query(
    "schema_compatibility",
    f"""WITH {DIFF_SQL} SELECT table_name, COUNT(*) AS changes, COUNT(*) FILTER (breaking) AS breaking_changes,
        CASE WHEN BOOL_OR(breaking) THEN 'none' WHEN BOOL_OR(change = 'added') THEN 'backward' ELSE 'full' END AS compatibility FROM d GROUP BY 1""",
)
def _(spark, sf):
    return contracts.compatibility(contracts.schema_diff(*_ends(spark, sf), ["table_name"]), ["table_name"])


def schema_registry(spark, sf):
    """A version per part: from version to version columns p0 … p(size % 5) come and go, p0 changes its type."""
    parts = table(spark, sf, "part")
    columns = F.expr(
        """transform(sequence(0, p_size % 5), i -> named_struct('name', concat('p', i), 'type', if(i = 0 AND p_size % 2 = 0, 'int', 'bigint'),
           'nullable', i > 0, 'default', CAST(NULL AS STRING)))"""
    )
    return parts.select(
        F.col("p_brand").alias("table_name"),
        F.col("p_partkey").cast("string").alias("version"),
        F.timestamp_seconds("p_partkey").cast("timestamp_ntz").alias("created_at"),
        columns.alias("columns"),
    )


HISTORY_SQL = """
    v AS (SELECT p_brand AS table_name, p_partkey, p_size % 5 AS m, p_size % 2 AS e,
                 LAG(p_size % 5) OVER w AS pm, LAG(p_size % 2) OVER w AS pe FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
    h AS (SELECT table_name, CAST(p_partkey AS VARCHAR) AS version, p_partkey, CAST(m + 1 AS INTEGER) AS column_count,
                 COALESCE(ABS(m - pm) + CASE WHEN e <> pe THEN 1 ELSE 0 END, 0)::BIGINT AS changes,
                 COALESCE(GREATEST(0, pm - m) + CASE WHEN pe = 1 AND e = 0 THEN 1 ELSE 0 END, 0)::BIGINT AS breaking_changes,
                 CASE WHEN pm IS NULL THEN 'full' WHEN pm > m OR (pe = 1 AND e = 0) THEN 'none' WHEN m > pm THEN 'backward' ELSE 'full' END AS compatibility
          FROM v)"""


@query(
    "schema_history",
    f"WITH {HISTORY_SQL} SELECT * EXCLUDE (p_partkey), CASE WHEN breaking_changes > 0 THEN 'Breaking' ELSE 'Compatible' END AS badge FROM h",
)
def _(spark, sf):
    return contracts.schema_history(schema_registry(spark, sf)).drop("created_at")


@query(
    "schema_timeline",
    f"""WITH {HISTORY_SQL} SELECT table_name, COUNT(*) AS versions, CAST(SUM(changes) AS BIGINT) AS changes, CAST(SUM(breaking_changes) AS BIGINT) AS breaking_changes,
        ARG_MAX(version, p_partkey) AS latest_version FROM h GROUP BY 1""",
)
def _(spark, sf):
    history = contracts.schema_history(schema_registry(spark, sf))
    return contracts.schema_timeline(history).drop("first_seen", "last_seen")


# --- privacy -------------------------------------------------------------------------------------


def contacts(spark, sf):
    """Customers with a phone number, a card number and an address derived from their key."""
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("customer_name"),
        F.expr("concat('555-', lpad(c_custkey % 1000, 3, '0'), '-', lpad(c_custkey % 10000, 4, '0'))").alias("contact"),
        F.expr("if(c_custkey % 4 = 0, '-', concat('4000-1234-5678-', lpad(c_custkey % 10000, 4, '0')))").alias("card_number"),
        F.expr("concat('10.0.', c_custkey % 256, '.', c_nationkey)").alias("origin"),
        F.expr("concat(lower(c_mktsegment), '@example.com')").alias("email"),
        F.col("c_acctbal").alias("balance"),
    )


@query(
    "match_rates",
    """SELECT 'email' AS column_name, 'email' AS kind, 0 AS pattern, COUNT(*) AS known, 1.0::DOUBLE AS rate FROM customer
       UNION ALL SELECT 'contact', 'phone', 2, COUNT(*), 1.0 FROM customer UNION ALL SELECT 'origin', 'ip_address', 0, COUNT(*), 1.0 FROM customer
       UNION ALL SELECT 'card_number', 'credit_card', 0, COUNT(*), ROUND(AVG(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END), 6) FROM customer""",
)
def _(spark, sf):
    return rounded(privacy.match_rates(contacts(spark, sf)).where("rate >= 0.5"), 6)


CLASS_SQL = """
    r AS (SELECT AVG(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END) AS card FROM customer),
    c AS (SELECT 'customer_name' AS column_name, 'pii' AS level, 0.85::DOUBLE AS confidence, 'full_name' AS kind, 'name' AS matched_by
          UNION ALL SELECT 'contact', 'pii', 0.9 * 0.8, 'phone', 'value' UNION ALL SELECT 'origin', 'confidential', 0.9 * 0.8, 'ip_address', 'value'
          UNION ALL SELECT 'email', 'pii', 1.0, 'email', 'both' UNION ALL SELECT 'balance', 'internal', 0.5, NULL, 'none'
          UNION ALL SELECT 'card_number', 'secret', ROUND(LEAST(1, (0.95 + card * 0.95) / 2 + 0.1), 6), 'credit_card', 'both' FROM r)"""


@query("classify_columns", f"WITH {CLASS_SQL} SELECT * FROM c")
def _(spark, sf):
    return rounded(privacy.classify_columns(contacts(spark, sf)).drop("advice"), 6)


@query(
    "sensitivity_report",
    f"""WITH {CLASS_SQL} SELECT level, COUNT(*) AS columns, COALESCE(STRING_AGG(CASE WHEN level IN ('pii', 'secret') THEN column_name END, ',' ORDER BY column_name), '') AS high_risk
        FROM c GROUP BY 1""",
)
def _(spark, sf):
    return privacy.sensitivity_report(privacy.classify_columns(contacts(spark, sf)))


@query("pii_columns", f"WITH {CLASS_SQL} SELECT column_name FROM c WHERE level IN ('pii', 'secret')")
def _(spark, sf):
    return privacy.pii_columns(privacy.classify_columns(contacts(spark, sf)))


@query(
    "redact",
    """SELECT c_custkey, '***REDACTED***' AS api_token, c_name AS name, '***REDACTED***' AS inner_password, c_mktsegment AS inner_segment,
       '***REDACTED***' AS map_cookie, c_mktsegment AS map_page FROM customer""",
)
def _(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_name").alias("api_token"),
        F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_name").alias("Password"), F.col("c_mktsegment").alias("segment")).alias("inner")).alias("who"),
        F.create_map(F.lit("Cookie"), "c_name", F.lit("page"), "c_mktsegment").alias("extra"),
    )
    return privacy.redact(customers).select(
        "c_custkey",
        "api_token",
        "who.name",
        F.col("who.inner.Password").alias("inner_password"),
        F.col("who.inner.segment").alias("inner_segment"),
        F.col("extra")["Cookie"].alias("map_cookie"),
        F.col("extra")["page"].alias("map_page"),
    )


@query(
    "drop_personal",
    r"""
    SELECT doc_id, lang AS key, text FROM documents
    WHERE NOT REGEXP_MATCHES(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')
      AND NOT (LENGTH(REGEXP_REPLACE(text, '[^0-9]', '', 'g')) >= 9 AND REGEXP_MATCHES(text, '(?:^|[^0-9])(?:\+?[0-9][0-9\s().-]{7,}[0-9])(?:[^0-9]|$)'))
    """,
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("key"), "text")
    return privacy.drop_personal(rows, "key", "text")


@query(
    "drop_personal_map",
    """SELECT event_id, '{"kind":"' || event_type || '"}' AS kept FROM events""",
)
def _(spark, sf):
    pairs = F.create_map(
        F.lit("kind"), "event_type", F.lit("Correo"), "props", F.lit("note"),
        F.concat(F.lit("call +1 (555) 010-"), F.lpad((F.col("user_id") % 10_000).cast("string"), 4, "0")),
    )
    return table(spark, sf, "events").select("event_id", F.to_json(privacy.drop_personal_map(pairs)).alias("kept"))


# --- lineage -------------------------------------------------------------------------------------

EDGES_SQL = """
    e AS (SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t FROM nation
          UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
          UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem)"""
DOWN_SQL = f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT t, 1 AS depth FROM e WHERE s = '{{start}}' UNION SELECT e.t, depth + 1 FROM w JOIN e ON e.s = w.t WHERE depth < {{depth}}),
    hit AS (SELECT t AS node_id, CAST(MIN(depth) AS INTEGER) AS depth FROM w GROUP BY 1)"""


def edges(spark, sf):
    nation, supplier, lines = (table(spark, sf, t) for t in ("nation", "supplier", "lineitem"))
    pair = lambda df, a, ac, b, bc: df.select(
        F.concat(F.lit(f"{a}:"), ac).alias("source"), F.concat(F.lit(f"{b}:"), bc).alias("target")
    )
    return freeze(  # derived here; a stored edge table would be read as it is
        pair(nation, "region", "n_regionkey", "nation", "n_nationkey")
        .unionByName(pair(supplier, "nation", "s_nationkey", "supplier", "s_suppkey"))
        .unionByName(pair(lines, "supplier", "l_suppkey", "part", "l_partkey").distinct())
    )


def nodes(spark, sf):
    all_edges = edges(spark, sf)
    ids = all_edges.select(F.col("source").alias("node_id")).unionByName(all_edges.select(F.col("target").alias("node_id"))).distinct()
    number = F.substring_index("node_id", ":", -1).cast("long")
    return ids.select(
        "node_id", F.substring_index("node_id", ":", 1).alias("node_type"), F.concat(F.lit("t"), number % 2).alias("tenant_id")
    )


@query("lineage_downstream", DOWN_SQL.format(start="region:1", depth=99) + " SELECT * FROM hit")
def _(spark, sf):
    return lineage.lineage_downstream(edges(spark, sf), "region:1", -1)


@query("lineage_downstream_direct", DOWN_SQL.format(start="region:1", depth=1) + " SELECT * FROM hit")
def _(spark, sf):
    return lineage.lineage_downstream(edges(spark, sf), "region:1", 1)


@query(
    "lineage_upstream",
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT s, 1 AS depth FROM e WHERE t = 'part:7' UNION SELECT e.s, depth + 1 FROM w JOIN e ON e.t = w.s)
    SELECT s AS node_id, CAST(MIN(depth) AS INTEGER) AS depth FROM w GROUP BY 1""",
)
def _(spark, sf):
    return lineage.lineage_upstream(edges(spark, sf), "part:7", -1)


@query(
    "impact_analysis",
    DOWN_SQL.format(start="nation:3", depth=99)
    + """ SELECT 'nation:3' AS node_id, SPLIT_PART(h.node_id, ':', 1) AS node_type, COUNT(*) AS affected, (SELECT COUNT(*) FROM hit) AS total_affected
          FROM hit h GROUP BY 2""",
)
def _(spark, sf):
    return lineage.impact_analysis(nodes(spark, sf), edges(spark, sf), "nation:3")


@query("impacted_nodes", DOWN_SQL.format(start="nation:3", depth=99) + " SELECT 'nation:3' AS changed, node_id, SPLIT_PART(node_id, ':', 1) AS node_type, depth FROM hit")
def _(spark, sf):
    return lineage.impacted_nodes(nodes(spark, sf), edges(spark, sf), "nation:3")


@query(
    "lineage_reach",
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT s AS start, t AS node_id, 1 AS depth FROM e WHERE s LIKE 'nation:%' UNION SELECT w.start, e.t, depth + 1 FROM w JOIN e ON e.s = w.node_id)
    SELECT start, node_id, CAST(MIN(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""",
)
def _(spark, sf):
    """From every nation at a time."""
    all_edges = edges(spark, sf)
    return lineage.reach(all_edges, all_edges.where("source LIKE 'nation:%'").select(F.col("source").alias("start")).distinct())


@query(
    "lineage_export",
    f"WITH {EDGES_SQL} SELECT s AS source, t AS target FROM e WHERE CAST(SPLIT_PART(s, ':', 2) AS INTEGER) % 2 = 0 AND CAST(SPLIT_PART(t, ':', 2) AS INTEGER) % 2 = 0",
)
def _(spark, sf):
    return lineage.lineage_export(nodes(spark, sf), edges(spark, sf), "t0")[1]


# --- baselines -----------------------------------------------------------------------------------

STORE_SQL = """
    b AS (SELECT 't' || (user_id % 5) AS tenant_id, 's' || user_id AS source_id, event_type AS baseline_type, event_id, '1.' || (event_id % 3) || '.' || event_id AS version,
                 event_id % 3 AS minor, user_id, value FROM events)"""


def baseline_store(spark, sf):
    """A baseline version per event: keys a, b and k<event id modulo 4>."""
    return table(spark, sf, "events").select(
        F.expr("concat('t', user_id % 5)").alias("tenant_id"),
        F.expr("concat('s', user_id)").alias("source_id"),
        F.col("event_type").alias("baseline_type"),
        F.expr("concat('1.', event_id % 3, '.', event_id)").alias("version"),
        F.expr("map('a', '1', concat('k', event_id % 4), '2', 'b', string(event_id % 2))").alias("data"),
        F.expr("if(event_id % 7 = 0, 'active', 'draft')").alias("status"),
    )


@query(
    "baseline_latest",
    f"""WITH {STORE_SQL} SELECT tenant_id, source_id, baseline_type, ARG_MAX(version, (minor, event_id)) AS version,
        '1.' || MAX(minor) || '.' || (ARG_MAX(event_id, (minor, event_id)) + 1) AS next_version FROM b GROUP BY ALL""",
)
def _(spark, sf):
    return contracts.baseline_latest(baseline_store(spark, sf)).drop("data", "status")


@query(
    "baseline_activate",
    f"""WITH {STORE_SQL}, f AS (SELECT ARG_MIN(version, event_id) AS v, ARG_MIN(source_id, event_id) AS s, ARG_MIN(baseline_type, event_id) AS k FROM b)
    SELECT tenant_id, source_id, baseline_type, version, CASE WHEN source_id = s AND baseline_type = k AND version = v THEN 'active'
        WHEN event_id % 7 = 0 THEN CASE WHEN source_id = s AND baseline_type = k THEN 'deprecated' ELSE 'active' END ELSE 'draft' END AS status FROM b, f""",
)
def _(spark, sf):
    store = baseline_store(spark, sf)
    one = store.orderBy(F.split("version", r"\.")[2].cast("long")).first()
    return contracts.baseline_activate(store, one.tenant_id, one.source_id, one.baseline_type, one.version).drop("data")


@query(
    "baseline_history",
    f"""WITH {STORE_SQL}, l AS (SELECT *, event_id % 4 AS k, LAG(event_id % 4) OVER w AS pk, LAG(version) OVER w AS parent_version, event_id % 2 AS v, LAG(event_id % 2) OVER w AS pv
        FROM b WINDOW w AS (PARTITION BY tenant_id, source_id, baseline_type ORDER BY minor, event_id))
    SELECT tenant_id, source_id, baseline_type, version, parent_version, CASE WHEN pk IS NULL THEN NULL WHEN k <> pk THEN 'k' || k ELSE '' END AS added_keys,
           CASE WHEN pk IS NULL THEN NULL WHEN k <> pk THEN 'k' || pk ELSE '' END AS removed_keys, CAST(CASE WHEN pk IS NULL THEN NULL WHEN k <> pk THEN 2 ELSE 3 END AS INTEGER) AS common_keys,
           CASE WHEN pk IS NOT NULL THEN k <> pk OR v <> pv END AS checksum_changed FROM l""",
)
def _(spark, sf):
    steps = contracts.baseline_history(baseline_store(spark, sf))
    joined = {c: F.array_join(c, ",") for c in ("added_keys", "removed_keys")}
    return steps.withColumns({**joined, "common_keys": F.when(F.col("parent_version").isNotNull(), F.col("common_keys"))})


@query(
    "baseline_compare",
    """SELECT 't' || (user_id % 5) AS tenant_id, 's' || user_id AS source_id, 'x' AS baseline_type, CASE WHEN MAX(event_id) % 4 <> MIN(event_id) % 4 THEN 'k' || (MAX(event_id) % 4) ELSE '' END AS added_keys,
       MAX(event_id) % 4 <> MIN(event_id) % 4 OR MAX(event_id) % 2 <> MIN(event_id) % 2 AS checksum_changed FROM events GROUP BY user_id HAVING COUNT(*) > 0""",
)
def _(spark, sf):
    per_user = table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    store = per_user.select(
        F.expr("concat('t', user_id % 5)").alias("tenant_id"),
        F.expr("concat('s', user_id)").alias("source_id"),
        F.lit("x").alias("baseline_type"),
        F.expr("inline(array(named_struct('version', '1.0.0', 'event_id', lo), named_struct('version', '1.0.1', 'event_id', hi)))"),
    ).withColumn("data", F.expr("map('a', '1', concat('k', event_id % 4), '2', 'b', string(event_id % 2))"))
    drift = contracts.baseline_compare(store, "1.0.0", "1.0.1")
    return drift.select(*contracts.BASELINE, F.array_join("added_keys", ",").alias("added_keys"), "checksum_changed")


@query(
    "baseline_due",
    """SELECT c_custkey AS source_id, (c_custkey % 5 + 1) * 24 AS interval_hours, MAX(o_orderdate) AS last_refresh FROM customer LEFT JOIN orders ON c_custkey = o_custkey
       WHERE c_custkey % 3 <> 0 GROUP BY c_custkey HAVING MAX(o_orderdate) IS NULL OR EPOCH(TIMESTAMP '2001-08-01') - EPOCH(MAX(o_orderdate)) > (c_custkey % 5 + 1) * 24 * 3600""",
)
def _(spark, sf):
    policies = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("source_id"), ((F.col("c_custkey") % 5 + 1) * 24).alias("interval_hours"), (F.col("c_custkey") % 3 != 0).alias("enabled")
    )
    history = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("refreshed_at"))
    return contracts.baseline_due(policies, history, dt.datetime(2001, 8, 1)).drop("enabled")
