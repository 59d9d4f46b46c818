import pytest

from millrace.plans import authorize, sql


@pytest.fixture(scope="module")
def views(spark):
    for name in ("t0_a", "t0_b", "t1_a"):
        spark.range(4).createOrReplaceTempView(name)


def test_names_of_a_statement(spark):
    text = """WITH RECURSIVE c AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM c WHERE x < 3), d AS (SELECT * FROM c JOIN a.b USING (x))
      SELECT upper(s), (SELECT MAX(x) FROM e), x IN (SELECT x FROM f) FROM d, LATERAL (SELECT * FROM g) l, range(3), VALUES (1) v
      WHERE EXISTS (SELECT 1 FROM (SELECT * FROM `odd.name`) WHERE x = 1) ORDER BY (SELECT COUNT(*) FROM h)"""
    used = authorize.uses(spark, text)
    assert set(used.tables) == {("a", "b"), ("e",), ("f",), ("g",), ("odd.name",), ("h",)}
    assert {"upper", "max", "count"} <= used.functions and used.table_functions == {"range"} and not used.commands
    assert authorize.uses(spark, "WITH c AS (SELECT * FROM c) SELECT * FROM c").tables == [("c",)]
    assert authorize.uses(spark, "SELECT * FROM (WITH c AS (SELECT 1) SELECT * FROM c), c").tables == [("c",)]
    assert authorize.uses(spark, "WITH x AS (SELECT 1 AS i) MERGE INTO t USING x ON t.i = x.i WHEN MATCHED THEN DELETE").commands


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM parquet.`testdata/orders.parquet`",
        "SELECT * FROM `parquet`.`/root/x`",
        "SELECT * FROM `org.apache.spark.sql.parquet`.`x/y`",
        "SELECT (SELECT COUNT(*) FROM json.`x`) FROM t0_a",
        "SELECT id FROM t0_a UNION ALL SELECT id FROM csv.`x`",
        "SELECT try_reflect('a', 'b')",
        "SELECT builtin.java_method('a', 'b') FROM t0_a",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t0_a",
        "SELECT * FROM IDENTIFIER('t1' || '_a')",
        "SELECT * FROM some_table_function(1)",
        "EXPLAIN SELECT * FROM parquet.`x`",
        "DESCRIBE parquet.`x`",
        "SELECT * FROM no_such_table",
    ],
)
def test_what_nobody_may(spark, views, text):
    with pytest.raises(sql.RejectedSql):
        sql.guarded_sql(spark, text)


def test_tenants(spark, views):
    rule = sql.tenant_rule("T0")
    assert sql.guarded_sql(spark, "SELECT a.id FROM t0_a a JOIN T0_B b ON a.id = b.id CROSS JOIN range(2)", tables=rule).count() == 8
    assert sql.guarded_sql(spark, "WITH t1_a AS (SELECT * FROM t0_a) SELECT * FROM t1_a", tables=rule).count() == 4
    assert sql.run_kpis(spark, [{"sql": "SELECT id FROM t0_a"}], tables=rule)["kpi_1"].count() == 4
    for text in ("SELECT * FROM t1_a", "SELECT 1 FROM t0_a WHERE id IN (SELECT id FROM t1_a)", "SHOW TABLES", "DESCRIBE t1_a", "EXPLAIN SELECT * FROM t1_a", "TABLE t1_a"):
        with pytest.raises(sql.RejectedSql):
            sql.guarded_sql(spark, text, tables=rule)
    assert sql.guarded_sql(spark, "SELECT * FROM t1_a", tables=authorize.names("T1_A")).count() == 4
    with pytest.raises(sql.RejectedSql):
        sql.is_truncated(spark, "SELECT * FROM t1_a", 2, tables=rule)
    for mode, name in (("schema", "t0.x"), ("custom", "zz_t0"), ("prefix", "t0_x")):
        assert sql.tenant_rule("t0", mode, pattern="_t0$")(name) and not sql.tenant_rule("t0", mode, pattern="_t0$")("other")
    assert not sql.tenant_rule("t0", "metadata")("t0_x")
    with pytest.raises(ValueError, match="pattern"):
        sql.tenant_rule("t0", "custom")
