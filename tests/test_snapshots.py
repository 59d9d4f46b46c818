import pytest
from pyspark.sql import functions as F

from millrace.operators import lineage
from millrace.sources import snapshots


def test_loads_failures_and_lineage(spark, tmp_path):
    folder = f"{tmp_path}/t"
    rows = spark.createDataFrame([(None, "b", 2), (None, "a", 1), (1, "c", 3)], "k long, v string, n int")
    assert snapshots.open_snapshot(spark, folder) is None and snapshots.history(spark, folder).count() == 0
    assert snapshots.load(rows, folder, "incremental", ["k"], ["n"], job="load", inputs=["raw"], tenant="x").added == {"rows": 2}
    assert snapshots.load(rows, folder, "incremental", ["k"], ["n"], job="load", inputs=["raw"], tenant="x").added == {"rows": 0}
    broken = rows.withColumn("n", F.when(F.col("k") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="no"):
        snapshots.load(broken, folder, "full", job="bad", inputs=["raw"])
    with pytest.raises(ValueError, match="contract broken"):
        snapshots.load(rows, folder, "full", gate=lambda df: df.select(F.lit("error").alias("level")), job="bad")
    with pytest.raises(ValueError, match="differ"):
        snapshots.load(rows.drop("n"), folder, "append", job="bad")
    assert {(r.k, r.v) for r in snapshots.read(spark, folder).collect()} == {(None, "a"), (1, "c")}
    nodes, edges = snapshots.lineage(spark, folder, "t")
    assert {tuple(r) for r in edges.collect()} == {
        ("raw", "load", "reads", 1, 2), ("load", "t@1", "produces", 1, 2), ("raw", "load", "reads", 2, 0), ("load", "t@2", "produces", 2, 0)
    }
    assert {tuple(r) for r in nodes.collect()} == {("raw", "table", "x"), ("load", "job", "x"), ("t@1", "artifact", "x"), ("t@2", "artifact", "x")}
    assert {r.node_id for r in lineage.lineage_downstream(edges, "raw", -1).collect()} == {"load", "t@1", "t@2"}


def test_a_table_can_replace_itself_and_old_versions_stay_readable(spark, tmp_path):
    folder = f"{tmp_path}/t"
    snapshots.load(spark.range(5), folder)
    snapshots.load(snapshots.read(spark, folder).where("id > 1"), folder)
    snapshots.load(spark.range(2), folder, "append")
    assert [snapshots.read(spark, folder, v).count() for v in (1, 2, 3)] == [5, 3, 5]
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, folder, 9)
    assert snapshots.vacuum(spark, folder, keep=1) == 0  # too young
    assert snapshots.vacuum(spark, folder, keep=1, older_than_seconds=0) == 1
    assert snapshots.versions(spark, folder) == [3] and snapshots.read(spark, folder).count() == 5


def test_of_two_writers_one_is_told(spark, tmp_path):
    folder = f"{tmp_path}/t"
    first = snapshots.load(spark.range(5), folder)
    snapshots.publish(spark, folder, first, {"rows": spark.range(1)})
    with pytest.raises(snapshots.ConcurrentLoad):
        snapshots.publish(spark, folder, first, {"rows": spark.range(2)})
    assert snapshots.read(spark, folder).count() == 1 and snapshots.versions(spark, folder) == [1, 2]
