import pytest
from pyspark.sql import functions as F

from millrace.operators import profile
from millrace.sources import snapshots


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 10 != 3, F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double")).alias("v"),
        F.when(F.col("id") % 5 == 0, "often").when(F.col("id") % 2 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("g"),
        F.lit(None).cast("double").alias("none"),
    )


def test_a_table_that_grew_by_one_part(spark, rows, tmp_path):
    folder = f"{tmp_path}/sketches"
    snapshots.load(profile.profile_sketches(rows.where("id < 15000")), folder)
    snapshots.load(profile.profile_sketches(rows.where("id >= 15000")), folder, "append")
    stored = profile.merge_sketches(snapshots.read(spark, folder))
    got = {r.column_name: r for r in profile.profile_of_sketches(stored).collect()}
    want = {r.column_name: r for r in profile.profile_table(rows).collect()}
    assert got.keys() == want.keys()
    for name, exact in want.items():
        found = got[name]
        for field in ("dtype", "total_rows", "null_count", "count", "min", "max", "top"):
            assert found[field] == exact[field], (name, field)
        for field in ("mean", "std"):
            assert found[field] == (exact[field] if exact[field] is None else pytest.approx(exact[field], rel=1e-9))
        assert abs(found.unique_count - exact.unique_count) <= 0.06 * exact.unique_count
    values = rows.where("v IS NOT NULL")
    for q, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(values.where(F.col("v") <= got["v"][q]).count() / values.count() - share) < 0.015
    assert {n: r.freq for n, r in got.items()} == {n: r.freq for n, r in want.items()} and got["none"].q50 is None


def test_merging_in_any_order_and_an_empty_part(spark, rows):
    parts = [profile.profile_sketches(rows.where(f"id % 3 = {i}")) for i in range(3)] + [profile.profile_sketches(rows.where("false"))]
    once = profile.profile_of_sketches(profile.merge_sketches(parts[0].union(parts[1]).union(parts[2]).union(parts[3])))
    pairs = profile.merge_sketches(parts[3].union(parts[2])).union(profile.merge_sketches(parts[1].union(parts[0])))
    twice = profile.profile_of_sketches(profile.merge_sketches(pairs))
    fields = ["column_name", "total_rows", "null_count", "min", "max", "top", "freq"]
    assert sorted(once.select(fields).collect(), key=str) == sorted(twice.select(fields).collect(), key=str)
    distinct = [{r.column_name: r.unique_count for r in df.collect()} for df in (once, twice)]
    assert all(abs(distinct[0][c] - distinct[1][c]) <= 0.05 * distinct[0][c] for c in distinct[0])
