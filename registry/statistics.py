"""Statistics and machine learning queries."""

from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import ml, stats
from registry import query, rounded, table


@query(
    "describe",
    """
    WITH a AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS s FROM events)
    SELECT COUNT(*) AS n, ROUND(AVG(value), 4) AS mean, ROUND(QUANTILE_CONT(value, 0.5), 4) AS median, ROUND(STDDEV_SAMP(value), 4) AS sd,
           MIN(value) AS min, MAX(value) AS max, ROUND(QUANTILE_CONT(value, 0.25), 4) AS q1, ROUND(QUANTILE_CONT(value, 0.75), 4) AS q3,
           ROUND(QUANTILE_CONT(value, 0.75) - QUANTILE_CONT(value, 0.25), 4) AS iqr,
           ROUND(AVG(POW(value - m, 3)) / POW(MAX(s), 3), 4) AS skew, ROUND(AVG(POW(value - m, 4)) / POW(MAX(s), 4) - 3, 4) AS kurt
    FROM events, a
    """,
)
def _(spark, sf):
    return rounded(stats.describe(table(spark, sf, "events"), "value"))


def sparse_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", F.when(F.col("l_partkey") % 10 != 0, F.col("l_discount")).alias("discount")
    )


LINES_SQL = "x AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_partkey % 10 <> 0 THEN l_discount END AS discount FROM lineitem)"
PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "discount"), ("l_extendedprice", "discount"))


@query(
    "correlation_pearson",
    f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, ROUND(CORR({a}, {b}), 6) AS r FROM x" for a, b in PAIRS),
)
def _(spark, sf):
    return rounded(stats.correlation(sparse_lines(spark, sf), ["l_quantity", "l_extendedprice", "discount"]), 6)


@query(
    "correlation_complete",
    f"WITH {LINES_SQL} "
    + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, ROUND(CORR({a}, {b}), 6) AS r FROM x WHERE discount IS NOT NULL" for a, b in PAIRS),
)
def _(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "discount"]
    return rounded(stats.correlation(sparse_lines(spark, sf), columns, complete=True), 6)


@query(
    "correlation_spearman",
    """
    WITH r AS (SELECT RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
                      RANK() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, ROUND(CORR(a, b), 6) AS r FROM r
    """,
)
def _(spark, sf):
    return rounded(stats.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman"), 6)


MATRIX = ["l_quantity", "l_extendedprice", "discount", "l_tax", "l_suppkey"]
MATRIX_SQL = " UNION ALL ".join(
    f"""SELECT '{a}' AS x, '{b}' AS y, (SELECT ROUND(CORR(a, b), 6) FROM (
        SELECT RANK() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS a, RANK() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS b
        FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) AS r"""
    for a, b in combinations(MATRIX, 2)
)


@query("correlation_ranks", "WITH t AS (SELECT *, CASE WHEN l_partkey % 10 <> 0 THEN l_discount END AS discount FROM lineitem) " + MATRIX_SQL)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("discount", F.when(F.col("l_partkey") % 10 != 0, F.col("l_discount")))
    return rounded(stats.correlation(lines, MATRIX, "spearman"), 6)


@query(
    "correlation_kendall",
    """
    WITH c AS (SELECT l_quantity AS x, l_discount AS y, CAST(COUNT(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2),
         s AS (SELECT SUM(a.c * b.c) FILTER ((a.x - b.x) * (a.y - b.y) > 0) / 2 AS con, SUM(a.c * b.c) FILTER ((a.x - b.x) * (a.y - b.y) < 0) / 2 AS dis,
                      SUM(a.c * b.c) FILTER (a.x <> b.x) / 2 AS nx, SUM(a.c * b.c) FILTER (a.y <> b.y) / 2 AS ny FROM c a, c b)
    SELECT 'l_quantity' AS x, 'l_discount' AS y, ROUND((con - dis) / SQRT(nx) / SQRT(ny), 6) AS r FROM s
    """,
)
def _(spark, sf):
    return rounded(stats.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "kendall"), 6)


@query(
    "fit_distribution",
    """
    SELECT 'normal' AS distribution, 'mean' AS parameter, ROUND(AVG(value), 6) AS value FROM events
    UNION ALL SELECT 'normal', 'sd', ROUND(STDDEV_POP(value), 6) FROM events
    UNION ALL SELECT 'lognormal', 'meanlog', ROUND(AVG(LN(value)), 6) FROM events
    UNION ALL SELECT 'lognormal', 'sdlog', ROUND(STDDEV_POP(LN(value)), 6) FROM events
    UNION ALL SELECT 'exponential', 'rate', ROUND(1 / AVG(value), 6) FROM events
    """,
)
def _(spark, sf):
    events = table(spark, sf, "events")
    fits = [stats.fit_distribution(events, "value", d) for d in ("normal", "lognormal", "exponential")]
    return rounded(fits[0].unionByName(fits[1]).unionByName(fits[2]), 6)


@query("fit_gamma")
def _(spark, sf):
    return rounded(stats.fit_distribution(table(spark, sf, "events"), "value", "gamma"), 6)


@query(
    "market_share",
    """
    SELECT ROUND(SUM(l_extendedprice), 4) AS total_market, ROUND(SUM(l_extendedprice) FILTER (p_brand = 'Brand#2') / SUM(l_extendedprice), 6) AS brand_share,
           ROUND(1 - SUM(l_extendedprice) FILTER (p_brand = 'Brand#2') / SUM(l_extendedprice), 6) AS competitor_share
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def _(spark, sf):
    brand, others = brands(spark, sf)
    return rounded(stats.market_share(brand, others, "l_extendedprice"), 6, total_market=4)


def brands(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sold = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice").join(part, "l_partkey")
    return sold.where("p_brand = 'Brand#2'"), sold.where("p_brand <> 'Brand#2'")


WELCH_SQL = """
    w AS (SELECT a.m - b.m AS d, a.v / a.n AS ea, b.v / b.n AS eb, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb FROM g a, g b WHERE a.side AND NOT b.side),
    t AS (SELECT *, d / SQRT(ea + eb) AS statistic, POW(ea + eb, 2) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) AS df FROM w)"""


@query(
    "t_test",
    f"""
    WITH g AS (SELECT l_linestatus = 'F' AS side, COUNT(*) AS n, AVG(l_extendedprice) AS m, VAR_SAMP(l_extendedprice) AS v FROM lineitem GROUP BY 1), {WELCH_SQL}
    SELECT 'F' AS group_a, 'O' AS group_b, ROUND(ma, 4) AS mean_a, ROUND(mb, 4) AS mean_b, ROUND(statistic, 6) AS statistic, ROUND(df, 4) AS df FROM t
    """,
)
def _(spark, sf):
    test = stats.t_test(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")
    return rounded(test.drop("p_value", "significant"), 4, statistic=6)


@query(
    "anova",
    """
    WITH a AS (SELECT AVG(o_totalprice) AS g FROM orders),
         s AS (SELECT COUNT(*) AS n, AVG(o_totalprice) AS m, VAR_POP(o_totalprice) AS v FROM orders GROUP BY o_orderpriority)
    SELECT ROUND((SUM(n * POW(m - g, 2)) / (COUNT(*) - 1)) / (SUM(n * v) / (SUM(n) - COUNT(*))), 6) AS f_statistic,
           CAST(COUNT(*) - 1 AS DOUBLE) AS df_between, CAST(SUM(n) - COUNT(*) AS DOUBLE) AS df_within FROM s, a
    """,
)
def _(spark, sf):
    return rounded(stats.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").drop("p_value", "significant"), 6)


@query(
    "normality",
    """
    WITH a AS (SELECT AVG(l_extendedprice) AS m, STDDEV_POP(l_extendedprice) AS s FROM lineitem),
         k AS (SELECT COUNT(*) AS n, AVG(POW((l_extendedprice - m) / s, 3)) AS sk, AVG(POW((l_extendedprice - m) / s, 4)) - 3 AS ku FROM lineitem, a)
    SELECT 'jarque-bera' AS test, ROUND(n / 6 * (sk * sk + ku * ku / 4), 4) AS statistic, ROUND(EXP(-n / 12 * (sk * sk + ku * ku / 4)), 6) AS p_value,
           EXP(-n / 12 * (sk * sk + ku * ku / 4)) > 0.05 AS is_normal FROM k
    """,
)
def _(spark, sf):
    return rounded(stats.normality(table(spark, sf, "lineitem"), "l_extendedprice"), 4, p_value=6)


@query("normality_ks")
def _(spark, sf):
    return rounded(stats.normality_ks(table(spark, sf, "orders"), "o_totalprice"), 6)


@query(
    "brand_benchmark",
    f"""
    WITH s AS (SELECT p_brand = 'Brand#2' AS side, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
         g AS (SELECT side, COUNT(*) AS n, AVG(v) AS m, VAR_SAMP(v) AS v FROM s GROUP BY 1), {WELCH_SQL},
         k AS (SELECT SUM(v) AS total, SUM(v) FILTER (side) / SUM(v) AS share FROM s)
    SELECT ROUND(total, 4) AS total_market, ROUND(share, 6) AS brand_share, ROUND(1 - share, 6) AS competitor_share, na AS brand_rows, nb AS competitor_rows,
           ROUND(ma, 4) AS brand_mean, ROUND(mb, 4) AS competitor_mean, ROUND(statistic, 4) AS statistic, ROUND(df, 4) AS df FROM t, k
    """,
)
def _(spark, sf):
    brand, others = brands(spark, sf)
    out = stats.brand_benchmark(brand, others, "l_extendedprice").drop("p_value", "significant")
    return rounded(out, 4, brand_share=6, competitor_share=6)


@query("kmeans")
def _(spark, sf):
    customers = table(spark, sf, "customer")
    return rounded(ml.kmeans(customers, ["c_acctbal", "c_nationkey"], 3).centers)


@query("train_classifier")
def _(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", r"\s+")).alias("words"))
    labels = table(spark, sf, "labels")
    fit = ml.train_classifier(joined.join(labels, "doc_id"), "quality", ["n_chars", "words", "toxic"])
    return rounded(fit.importances)


@query(
    "train_regression",
    """
    WITH r AS (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS b, REGR_INTERCEPT(l_extendedprice, l_quantity) AS a,
                      REGR_R2(l_extendedprice, l_quantity) AS r2, COUNT(*) AS n FROM lineitem),
         e AS (SELECT SQRT(AVG(POW(l_extendedprice - a - b * l_quantity, 2))) AS rmse FROM lineitem, r)
    SELECT 'l_quantity' AS feature, ROUND(b, 3) AS coefficient, ROUND(ABS(b), 3) AS importance, ROUND(a, 3) AS intercept, ROUND(r2, 3) AS r_squared,
           ROUND(rmse, 3) AS rmse, n, CASE WHEN r2 >= 0.9 THEN 'excellent' WHEN r2 >= 0.7 THEN 'good' WHEN r2 >= 0.5 THEN 'moderate' ELSE 'poor' END AS fit
    FROM r, e
    """,
)
def _(spark, sf):
    return rounded(ml.train_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]).drop("equation"), 3)


@query(
    "simple_regression",
    """SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS coefficient, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 4) AS intercept,
              ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r_squared, COUNT(*) AS n FROM lineitem""",
)
def _(spark, sf):
    return rounded(ml.simple_regression(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"), 4, r_squared=6)
