"""Lineage as two tables: nodes (node_id, node_type, tenant_id) and edges (source, target)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze


#: Parts that the edges of one node are dealt to, so that a hub is not one task's work.
HUB_PARTS = 8


def _laid_out(edges: DataFrame, here: str, there: str) -> DataFrame:
    """Edges by node, shuffled and sorted once; every level of a walk joins them where they lie."""
    steps = edges.select(F.col(here).alias("here"), F.col(there).alias("node_id")).dropna()
    part = F.pmod(F.xxhash64("node_id"), F.lit(HUB_PARTS)).cast("int")
    return steps.withColumn("part", part).repartition("here", "part").sortWithinPartitions("here", "part").persist()


def _step(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """(start, node_id) one edge on; a node of the frontier asks every part of its edges."""
    asked = frontier.select("start", F.col("node_id").alias("here"), F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).alias("part"))
    return steps.join(asked, ["here", "part"]).select("start", "node_id").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int = -1, here: str = "source", there: str = "target") -> DataFrame:
    """(start, node_id, depth) of all nodes that each node of ``starts`` (start) reaches in up to ``depth`` steps, -1
    for all, with the least number of steps; a start does not reach itself.

    All starts walk at a time, level by level; cycles end a walk. Edges are shuffled once and stay on the executors
    (a lost part is read again); a level moves only its frontier and what is known of it."""
    steps = _laid_out(edges, here, there)
    try:
        seen = freeze(starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("depth")).dropna().distinct())
        frontier, level = seen, 0
        while depth < 0 or level < depth:
            level += 1
            reached = _step(frontier, steps).join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
            frontier = freeze(reached.withColumn("depth", F.lit(level)))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            if level % 5 == 0:
                seen = freeze(seen)
        return seen.where("depth > 0")
    finally:
        steps.unpersist()


def _walk(edges: DataFrame, start: str, depth: int, here: str, there: str) -> DataFrame:
    starts = edges.sparkSession.createDataFrame([(start,)], "start string")
    return reach(edges, starts, depth, here, there).select("node_id", "depth")


def lineage_downstream(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """Nodes fed by ``node``: directly, up to ``depth`` levels, or all for -1."""
    return _walk(edges, node, depth, "source", "target")


def lineage_upstream(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    return _walk(edges, node, depth, "target", "source")


def impacted_nodes(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Everything downstream of a node with its type and distance: what ``impact_analysis`` counts."""
    return lineage_downstream(edges, node, -1).join(nodes, "node_id", "left").select(F.lit(node).alias("changed"), "node_id", "node_type", "depth")


def impact_analysis(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Everything downstream of a node, counted by node type, with the total."""
    hit = impacted_nodes(nodes, edges, node)
    by_type = freeze(hit.groupBy("node_type").agg(F.count(F.lit(1)).alias("affected")))
    total = by_type.select(F.coalesce(F.sum("affected"), F.lit(0))).scalar()
    return by_type.select(F.lit(node).alias("node_id"), "node_type", "affected", total.alias("total_affected"))


def record_job_lineage(
    spark: SparkSession, job: str, tables: Sequence[str], artifacts: Sequence[str], tenant: str
) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of one job: tables feed it, it yields artifacts. Append them to the tables."""
    nodes = [(job, "job", tenant)] + [(t, "table", tenant) for t in tables] + [(a, "artifact", tenant) for a in artifacts]
    edges = [(t, job, "reads") for t in tables] + [(job, a, "produces") for a in artifacts]
    return (
        spark.createDataFrame(nodes, "node_id string, node_type string, tenant_id string"),
        spark.createDataFrame(edges, "source string, target string, edge_type string"),
    )


def lineage_export(nodes: DataFrame, edges: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a tenant and the edges with both ends among them."""
    own = nodes.where(F.col("tenant_id") == tenant)
    ids = own.select("node_id")
    inside = edges.join(ids, edges["source"] == ids["node_id"], "left_semi")
    inside = inside.join(ids, inside["target"] == ids["node_id"], "left_semi")
    return own, inside
