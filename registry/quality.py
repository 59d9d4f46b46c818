"""Profile, quality rule, cleaning and sampling queries."""

from pyspark.sql import functions as F

from millrace.operators import clean, profile, sample
from millrace.operators.profile import Check
from registry import query, rounded, table

SPARSE = """
    x AS (SELECT event_id, ts, user_id, event_type, props,
                 CASE WHEN event_id % 10 <> 0 THEN value END AS amount,
                 CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind FROM events)"""


def sparse_events(spark, sf):
    return (
        table(spark, sf, "events")
        .withColumn("amount", F.when(F.col("event_id") % 10 != 0, F.col("value")))
        .withColumn("kind", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
        .drop("value")
    )


def _number_profile(c, kind):
    return f"""
    SELECT '{c}' AS column_name, '{kind}' AS dtype, COUNT(*) AS total_rows, COUNT(*) - COUNT({c}) AS null_count,
           COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
           CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, COUNT(DISTINCT {c}) AS unique_count,
           CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
           ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 4) AS q25, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
           ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM x"""


def _text_profile(c):
    top = f"(SELECT {{0}} FROM (SELECT {c} AS v, COUNT(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
    return f"""
    SELECT '{c}', 'string', COUNT(*), COUNT(*) - COUNT({c}), COUNT({c}), NULL, NULL, NULL, NULL,
           COUNT(DISTINCT {c}), {top.format("v")}, {top.format("n")}, NULL, NULL, NULL FROM x"""


PROFILED = ["user_id", "amount", "kind", "props"]


@query(
    "profile_table",
    f"WITH {SPARSE} {_number_profile('user_id', 'bigint')} UNION ALL {_number_profile('amount', 'double')}"
    f" UNION ALL {_text_profile('kind')} UNION ALL {_text_profile('props')}",
)
def _(spark, sf):
    return rounded(profile.profile_table(sparse_events(spark, sf), PROFILED))


@query("profile_table_sketched")
def _(spark, sf):
    return rounded(profile.profile_table(sparse_events(spark, sf), PROFILED, exact=False))


MERGED_EXACT = ("column_name", "dtype", "total_rows", "null_count", "count", "min", "max")


@query(
    "profile_sketches_merged",
    f"WITH {SPARSE}, p AS ({_number_profile('user_id', 'bigint')} UNION ALL {_number_profile('amount', 'double')})"
    f" SELECT {', '.join(MERGED_EXACT)}, TRUE AS distinct_near, TRUE AS median_near FROM p",
)
def _(spark, sf):
    """The profile of events out of the sketches of five parts, and whether its estimates are near the exact profile."""
    events, names = sparse_events(spark, sf), ["user_id", "amount"]
    parts = None
    for i in range(5):
        part = profile.profile_sketches(events.where(F.col("event_id") % 5 == i), names)
        parts = part if parts is None else parts.unionByName(part)
    exact = profile.profile_table(events, names).select("column_name", F.col("unique_count").alias("kinds"), F.col("std").alias("spread"), F.col("q50").alias("middle"))
    found = profile.profile_of_sketches(profile.merge_sketches(parts)).join(exact, "column_name")
    distinct_near = F.abs(F.col("unique_count") - F.col("kinds")) <= 0.06 * F.col("kinds")
    median_near = F.abs(F.col("q50") - F.col("middle")) <= 0.1 * F.col("spread")
    return rounded(found.select(*MERGED_EXACT, distinct_near.alias("distinct_near"), median_near.alias("median_near")))


QUALITY_CHECKS = [
    Check("null", "amount", max_null_pct=0.05),
    Check("null", "kind", max_null_pct=0.2),
    Check("range", "amount", low=1.0, high=200.0),
    Check("unique", "event_id"),
    Check("unique", "kind"),
    Check("null", "absent"),
]
QUALITY_SQL = f"""
    WITH {SPARSE}, d AS (
      SELECT 'null' AS rule, 'amount' AS column_name, COUNT(*) AS total_rows, COUNT(*) - COUNT(amount) AS failures, 0.05 AS most FROM x
      UNION ALL SELECT 'null', 'kind', COUNT(*), COUNT(*) - COUNT(kind), 0.2 FROM x
      UNION ALL SELECT 'range', 'amount', COUNT(*), COUNT(*) FILTER (amount < 1 OR amount > 200), 0 FROM x
      UNION ALL SELECT 'unique', 'event_id', COUNT(*), COUNT(*) - COUNT(DISTINCT event_id), 0 FROM x
      UNION ALL SELECT 'unique', 'kind', COUNT(*), COUNT(*) - COUNT(DISTINCT COALESCE(kind, '?')), 0 FROM x),
    r AS (SELECT rule, column_name, failures * 1.0 / total_rows <= most AS passed, total_rows, failures,
                 ROUND(CAST(failures AS DOUBLE) / total_rows, 4) AS failure_rate, CAST(NULL AS VARCHAR) AS error FROM d
          UNION ALL SELECT 'null', 'absent', FALSE, COUNT(*), NULL, NULL, 'Column not found' FROM x)
"""


@query("quality_checks", QUALITY_SQL + "SELECT * FROM r")
def _(spark, sf):
    return rounded(profile.quality_checks(sparse_events(spark, sf), QUALITY_CHECKS))


@query(
    "quality_summary",
    QUALITY_SQL
    + """SELECT COUNT(*) AS total_rules, COUNT(*) FILTER (passed) AS passed_rules, COUNT(*) FILTER (NOT passed) AS failed_rules,
                BOOL_AND(passed) AS is_valid FROM r""",
)
def _(spark, sf):
    return profile.quality_summary(profile.quality_checks(sparse_events(spark, sf), QUALITY_CHECKS))


@query(
    "default_checks",
    " UNION ALL ".join(
        f"""SELECT 'null' AS rule, '{c}' AS column_name, COUNT(*) - COUNT({c}) <= 0.2 * COUNT(*) AS passed, COUNT(*) AS total_rows,
            COUNT(*) - COUNT({c}) AS failures, ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*), 4) AS failure_rate,
            CAST(NULL AS VARCHAR) AS error FROM documents"""
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
    + """ UNION ALL SELECT 'unique', 'doc_id', COUNT(*) = COUNT(DISTINCT doc_id), COUNT(*), COUNT(*) - COUNT(DISTINCT doc_id),
            ROUND(CAST(COUNT(*) - COUNT(DISTINCT doc_id) AS DOUBLE) / COUNT(*), 4), NULL FROM documents""",
)
def _(spark, sf):
    return rounded(profile.quality_checks(table(spark, sf, "documents")))


@query("quality_sample", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5000")
def _(spark, sf):
    return profile.quality_sample(table(spark, sf, "lineitem"), 5000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return clean.drop_duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "duplicate_report",
    """SELECT COUNT(*) AS original_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS unique_rows,
              COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates_removed
       FROM lineitem""",
)
def _(spark, sf):
    return clean.duplicate_report(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "normalize_strings",
    """
    WITH n AS (SELECT o_orderkey, LOWER(TRIM('  ' || o_orderpriority || ' ')) AS p,
                      CASE o_orderstatus WHEN 'P' THEN 'none' ELSE LOWER(o_orderstatus) END AS s FROM orders)
    SELECT o_orderkey, p AS o_orderpriority, NULLIF(s, 'none') AS o_orderstatus FROM n
    """,
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("  "), "o_orderpriority", F.lit("\t")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "P", " None ").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return clean.normalize_strings(orders, ["o_orderpriority", "o_orderstatus"])


MODE_KIND = "(SELECT kind FROM x WHERE kind IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, kind LIMIT 1)"


def _impute_sql(fill):
    return f"""WITH {SPARSE} SELECT event_id, ROUND(COALESCE(amount, {fill}), 4) AS amount,
               COALESCE(kind, {MODE_KIND}) AS kind FROM x"""


def _imputed(strategy):
    def run(spark, sf):
        done = clean.impute(sparse_events(spark, sf), strategy, ["amount"], ["kind"])
        return rounded(done.select("event_id", "amount", "kind"))

    return run


query("impute_mean", _impute_sql("(SELECT AVG(amount) FROM x)"))(_imputed("mean"))
query("impute_median", _impute_sql("(SELECT QUANTILE_CONT(amount, 0.5) FROM x)"))(_imputed("median"))
query(
    "impute_mode",
    _impute_sql("(SELECT amount FROM x WHERE amount IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, amount LIMIT 1)"),
)(_imputed("mode"))
query("impute_drop", f"WITH {SPARSE} SELECT event_id, amount, kind FROM x WHERE amount IS NOT NULL AND kind IS NOT NULL")(
    _imputed("drop")
)


@query(
    "impute_ffill",
    f"""WITH {SPARSE}
    SELECT event_id, COALESCE(
             LAST_VALUE(amount IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             FIRST_VALUE(amount IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           ) AS amount FROM x""",
)
def _(spark, sf):
    events = sparse_events(spark, sf)
    return clean.impute(events, "ffill", ["amount"], [], ["ts", "event_id"], ["event_type"]).select("event_id", "amount")


@query(
    "treat_outliers_remove",
    """
    WITH a AS (SELECT AVG(value) AS m, STDDEV_POP(value) AS s FROM events),
         x AS (SELECT event_id, value, user_id FROM events WHERE ABS(value - (SELECT m FROM a)) / (SELECT s FROM a) <= 2.5),
         b AS (SELECT AVG(user_id) AS m, STDDEV_POP(user_id) AS s FROM x)
    SELECT * FROM x WHERE ABS(user_id - (SELECT m FROM b)) / (SELECT s FROM b) <= 2.5
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", "user_id")
    return clean.treat_outliers(events, "remove", ["value", "user_id"], 2.5).df


@query(
    "treat_outliers_cap",
    """
    WITH a AS (SELECT AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, ROUND(LEAST(GREATEST(l_extendedprice, m - 1.5 * s), m + 1.5 * s), 4) AS l_extendedprice
    FROM lineitem, a
    """,
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(clean.treat_outliers(lines, "cap", ["l_extendedprice"], 1.5).df)


@query(
    "winsorize",
    """
    WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY l_extendedprice) - 1 AS i, ROW_NUMBER() OVER (ORDER BY l_quantity) - 1 AS j,
                      COUNT(*) OVER () AS n FROM lineitem),
         b AS (SELECT MAX(l_extendedprice) FILTER (i = FLOOR((n - 1) * 0.05)) AS plo, MAX(l_extendedprice) FILTER (i = FLOOR((n - 1) * 0.95)) AS phi,
                      MAX(l_quantity) FILTER (j = FLOOR((n - 1) * 0.05)) AS qlo, MAX(l_quantity) FILTER (j = FLOOR((n - 1) * 0.95)) AS qhi FROM r)
    SELECT l_orderkey, l_linenumber, LEAST(GREATEST(l_extendedprice, plo), phi) AS l_extendedprice,
           LEAST(GREATEST(l_quantity, qlo), qhi) AS l_quantity FROM lineitem, b
    """,
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return clean.winsorize(lines, ["l_extendedprice", "l_quantity"]).df


@query(
    "fix_data_quality",
    f"""WITH {SPARSE}, y AS (SELECT COALESCE(amount, (SELECT QUANTILE_CONT(amount, 0.5) FROM x)) AS amount FROM x),
      a AS (SELECT AVG(amount) AS m, STDDEV_POP(amount) AS s FROM y),
      c AS (SELECT COUNT(*) AS n, 2 * COUNT(*) - COUNT(amount) - COUNT(kind) AS gone FROM x)
    SELECT n AS original_rows, n AS cleaned_rows, gone AS missing_value_fixes,
           (SELECT COUNT(*) FROM y, a WHERE ABS(amount - m) / s > 3) AS outliers_treated,
           ROUND((2 * n - gone) / (2.0 * n), 4) AS quality_score_before, 1.0::DOUBLE AS quality_score_after,
           ROUND(1 - (2 * n - gone) / (2.0 * n), 4) AS improvement FROM c""",
)
def _(spark, sf):
    events = sparse_events(spark, sf).select("event_id", "amount", "kind")
    return rounded(clean.fix_data_quality(events, numeric=["amount"], categorical=["kind"])[1])


@query("random_sample", "SELECT * FROM events ORDER BY SUBSTR(MD5('7|' || event_id), 1, 15), event_id LIMIT 500")
def _(spark, sf):
    return sample.random_sample(table(spark, sf, "events"), 500, ["event_id"], 7)


@query("reservoir_sample", "SELECT * FROM events ORDER BY SUBSTR(MD5('11|' || event_id), 1, 15), event_id LIMIT 500")
def _(spark, sf):
    return sample.reservoir_sample(table(spark, sf, "events"), 500, ["event_id"], 11)


@query(
    "systematic_sample",
    """
    WITH i AS (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, COUNT(*) OVER () // 400 AS k FROM orders)
    SELECT o_orderkey, o_custkey, o_orderdate FROM i WHERE i % k = 0 AND i // k < 400
    """,
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return sample.systematic_sample(orders, 400, ["o_orderdate", "o_orderkey"])


@query(
    "stratified_sample",
    """
    WITH s AS (SELECT event_type, COUNT(*) AS size FROM events GROUP BY 1),
         q AS (SELECT event_type, LEAST(GREATEST(1, CAST(ROUND_EVEN(500.0 * size / (SELECT COUNT(*) FROM events), 0) AS BIGINT)), size) AS want FROM s),
         u AS (SELECT *, SUM(want) OVER (ORDER BY event_type) AS upto FROM q)
    SELECT event_type, CAST(LEAST(want, GREATEST(0, 500 - (upto - want))) AS BIGINT) AS n FROM u
    """,
)
def _(spark, sf):
    drawn = sample.stratified_sample(table(spark, sf, "events"), 500, "event_type", ["event_id"], 3)
    return drawn.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "deterministic_sample",
    """
    WITH b AS (SELECT event_id, (
                 ((CAST('0x' || SUBSTR(MD5(CAST(event_id AS VARCHAR)), 1, 16) AS UBIGINT) % 10000) * 1616
                  + CAST('0x' || SUBSTR(MD5(CAST(event_id AS VARCHAR)), 17, 16) AS UBIGINT) % 10000) % 10000) AS b FROM events)
    SELECT event_id FROM b WHERE b / 10000.0 < 500.0 / (SELECT COUNT(*) FROM events) ORDER BY b, event_id LIMIT 500
    """,
)
def _(spark, sf):
    return sample.deterministic_sample(table(spark, sf, "events"), 500, "event_id").select("event_id")


@query(
    "adaptive_sample",
    """
    WITH t AS (SELECT COUNT(*) AS n FROM events), z AS (SELECT n, 1.96 * 1.96 * 0.25 / (0.03 * 0.03) AS n0 FROM t),
         w AS (SELECT n, LEAST(n, GREATEST(100, CAST(CEIL(n0 / (1 + (n0 - 1) / n)) AS BIGINT))) AS want FROM z),
         s AS (SELECT event_type, COUNT(*) AS size FROM events GROUP BY 1),
         q AS (SELECT SUM(LEAST(GREATEST(1, CAST(ROUND_EVEN(want * size / n::DOUBLE, 0) AS BIGINT)), size)) AS drawn FROM s, w),
         d AS (SELECT n, CAST(CASE WHEN want >= n THEN n WHEN n > 1000 THEN LEAST(drawn, want) ELSE want END AS BIGINT) AS k FROM w, q)
    SELECT n AS total_rows, k AS sample_size, ROUND(k / n, 6) AS sampling_rate, CASE WHEN n > 1000 THEN 'stratified' ELSE 'random' END AS strategy,
           0.95::DOUBLE AS confidence_level, ROUND(1.96 * SQRT(0.25 / k) * SQRT((n - k) / (n - 1)), 6) AS margin_of_error FROM d
    """,
)
def _(spark, sf):
    _, stats = sample.adaptive_sample(table(spark, sf, "events"), ["event_id"], stratum="event_type")
    return rounded(stats, 6)
