from millrace.operators import contracts
from millrace.operators.contracts import ColumnSpec, Contract

FIELDS = "t string, name string, type string, nullable boolean, default string"


def test_many_schemas_against_one_contract(spark):
    """Types go by their first word; a null key is a schema, a repeated name counts once, extra columns are told."""
    rows = [("a", "id", "BIGINT", True, None), ("a", "price", "decimal(10,2)", True, None), ("a", "tags", "map<string,int>", True, None)]
    rows += [(None, "id", "int", True, None), (None, "price", "string", True, None), (None, "price", "array<double>", True, None)]
    contract = Contract("c", (ColumnSpec("id", "integer", nullable=False), ColumnSpec("price", "float"), ColumnSpec("tags", "object", nullable=False)))
    got = contracts.validate_schemas(spark.createDataFrame(rows, FIELDS), contract, ["t"]).collect()
    assert {(r.t, r["column"], r.level, r.code, r.actual) for r in got} == {
        (None, "price", "error", "type_mismatch", "array<double>"),
        (None, "tags", "error", "missing_required", None),
    }
    assert contracts.validate_schemas(spark.createDataFrame([], FIELDS), contract, ["t"]).count() == 0


def test_one_schema_and_many_agree(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    contract = Contract("c", (ColumnSpec("a", "string"), ColumnSpec("b", "string"), ColumnSpec("d", "date", nullable=False), ColumnSpec("e")))
    one = {tuple(r) for r in contracts.validate_schema(df, contract).collect()}
    many = contracts.validate_schemas(contracts.schema_rows(spark, df.schema).selectExpr("1 AS k", "*"), contract, ["k"])
    assert {tuple(r)[1:] for r in many.collect()} == one and len(one) == 4


def test_differences_by_table(spark):
    old = spark.createDataFrame([("a", "x", "int", True, None), ("b", "x", "bigint", True, None)], FIELDS)
    new = spark.createDataFrame([("a", "x", "bigint", True, None), ("a", "y", "int", True, None), ("b", "x", "int", True, None)], FIELDS)
    changes = contracts.schema_diff(old, new, ["t"])
    assert {(r.t, r.name, r.change, r.breaking) for r in changes.collect()} == {
        ("a", "x", "type_changed", False),
        ("a", "y", "added", False),
        ("b", "x", "type_changed", True),
    }
    assert {(r.t, r.changes, r.compatibility) for r in contracts.compatibility(changes, ["t"]).collect()} == {("a", 2, "backward"), ("b", 1, "none")}
