import random

from pyspark.sql import functions as F

from millrace.operators import lineage


def brute(edges, starts, depth):
    out = set()
    for start in starts:
        seen, frontier, level = {start}, {start}, 0
        while frontier and (depth < 0 or level < depth):
            level += 1
            frontier = {t for s, t in edges if s in frontier} - seen
            seen |= frontier
            out |= {(start, node, level) for node in frontier}
    return out


def test_many_starts_cycles_and_a_hub(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [("n1", f"leaf{i}") for i in range(400)] + [("n2", "n1"), ("n1", "n2"), ("n3", "n3")]
    df = spark.createDataFrame([*edges, (None, "n1"), ("n1", None)] + edges[:20], "source string, target string")
    starts = ["n1", "n2", "n3", "n44", "nowhere"]
    asked = spark.createDataFrame([(s,) for s in starts] + [(None,), ("n1",)], "start string")
    for depth in (-1, 0, 1, 3):
        got = [tuple(r) for r in lineage.reach(df, asked, depth).collect()]
        assert set(got) == brute(edges, starts, depth) and len(got) == len(set(got))
    up = {(r.node_id, r.depth) for r in lineage.lineage_upstream(df, "n1", -1).collect()}
    assert up == {(n, d) for _, n, d in brute([(t, s) for s, t in edges], ["n1"], -1)}


def test_a_level_shuffles_no_edges_again(spark):
    edges = spark.range(1000).select(F.concat(F.lit("a"), F.col("id") % 9).alias("source"), F.concat(F.lit("b"), "id").alias("target"))
    steps = lineage._laid_out(edges, "source", "target")
    try:
        steps.count()
        frontier = spark.createDataFrame([("x", "a1")], "start string, node_id string")
        plan = lineage._step(frontier, steps)._jdf.queryExecution().executedPlan().toString()
        side = plan[: plan.index("InMemoryTableScan")].splitlines()[-6:]
        assert not any("Exchange" in line and "part" in line for line in side), plan
    finally:
        steps.unpersist()
