"""Order primitives against plain windows, with a group that holds a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import order as o


@pytest.fixture(scope="module", params=[1, 7])
def rows(spark, request):
    df = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 90)).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(40)).alias("t"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10).alias("v"),
    )
    return df.withColumn("w", F.when(F.col("id") % 4 != 0, F.col("v"))).repartition(request.param)


@pytest.fixture(params=[(), ("g",)])
def group(request):
    return list(request.param)


def window(group):
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy("t", "id")


def same(got, want, name, tolerance=1e-6):
    both = got.select("id", F.col(name).cast("double").alias("a")).join(want.select("id", F.col(name).cast("double").alias("b")), "id")
    assert both.count() == want.count() == got.count()
    close = F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) < tolerance)
    assert both.where(~F.coalesce(close, F.lit(False))).count() == 0


def test_index(rows, group):
    same(o.with_index(rows, ["t", "id"], group), rows.withColumn("idx", F.row_number().over(window(group)) - 1), "idx")


def test_running_sum(rows, group):
    got = o.running_sum(o.lay_out(rows, ["t", "id"], group), "v", "s", group)
    frame = window(group).rowsBetween(Window.unboundedPreceding, 0)
    same(got, rows.withColumn("s", F.sum("v").over(frame)), "s")


def test_previous(rows, group):
    got = o.previous(o.lay_out(rows, ["t", "id"], group), "w", "p", group)
    same(got, rows.withColumn("p", F.lag("w").over(window(group))), "p")


def test_fill_forward(rows, group):
    got = o.fill_forward(o.lay_out(rows, ["t", "id"], group), "w", "f", group)
    same(got, rows.withColumn("f", F.last("w", True).over(window(group))), "f")


def test_trailing(rows, group, monkeypatch):
    got = o.trailing(rows, ["t", "id"], 9, lambda f: {"m": F.avg("v").over(f)}, group)
    same(got, rows.withColumn("m", F.avg("v").over(window(group).rowsBetween(-9, 0))), "m")


@pytest.mark.parametrize("width", [0, 1, 9, 4000])
def test_trailing_mean(rows, group, width):
    """A window of 4000 reaches back over several ranges."""
    frame = window(group).rowsBetween(-width, 0)
    for value in ("v", "w"):
        same(o.trailing_mean(rows, ["t", "id"], value, width, "m", group), rows.withColumn("m", F.avg(value).over(frame)), "m")


def test_trailing_mean_of_special_values(rows):
    odd = rows.withColumn("v", F.when(F.col("id") % 400 == 3, float("nan")).when(F.col("id") % 500 == 4, float("inf")).otherwise(F.col("v")))
    want = odd.withColumn("m", F.avg("v").over(window([]).rowsBetween(-9, 0)))
    got = o.trailing_mean(odd, ["t", "id"], "v", 9, "m")
    both = got.select("id", F.col("m").alias("a")).join(want.select("id", F.col("m").alias("b")), "id")
    assert both.where("NOT (a <=> b OR abs(a - b) < 1e-6)").count() == 0 and both.where("isnan(a)").count() > 20
    cents = rows.withColumn("v", F.col("v").cast("decimal(10,2)"))
    assert dict(o.trailing_mean(cents, ["t", "id"], "v", 9, "m").dtypes)["m"].startswith("decimal")
    assert o.trailing_mean(rows.where("false"), ["t", "id"], "v", 9, "m").count() == 0


def test_trailing_mean_beyond_what_ranges_may_hand_on(rows, group, monkeypatch):
    monkeypatch.setattr(o, "HALO_VALUES", 5)
    same(o.trailing_mean(rows, ["t", "id"], "w", 9, "m", group), rows.withColumn("m", F.avg("w").over(window(group).rowsBetween(-9, 0))), "m")


def test_trailing_mean_shuffles_rows_once(rows):
    plan = o.trailing_mean(rows, ["t", "id"], "v", 9, "m")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan  # the layout is the only exchange


def test_quantiles(rows, group):
    got = o.quantiles(rows, "w", {"a": 0.1, "b": 0.5, "c": 0.95}, group)
    want = rows.groupBy(*group).agg(*[F.percentile("w", p).alias(f"w{n}") for n, p in (("a", 0.1), ("b", 0.5), ("c", 0.95))], F.count("w").alias("k"))
    both = o.join_totals(got, want, group)
    bad = " OR ".join(f"abs({c} - w{c}) > 1e-9" for c in "abc")
    assert both.count() == want.where("k > 0").count()
    assert both.where(f"{bad} OR n <> k").count() == 0


def test_trailing_needs_no_single_task(rows):
    plan = o.trailing(rows, ["t", "id"], 9, lambda f: {"m": F.avg("v").over(f)})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan.split("BroadcastExchange")[0]
