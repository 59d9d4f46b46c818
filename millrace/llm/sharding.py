"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level each child draws an exponential waiting time from a hash of (key, child) with its weight
as the rate, and the shortest one wins, so a child is taken in proportion to its weight. A child's draw
does not depend on its siblings: if one weight changes, rows move only into or out of that child. A
changed shard changes the weights of its rack and its region, so rows move between the region and the
others, inside the region between the rack and the others, inside the rack between the shard and the
others, and nowhere else.

Only built-in functions over a constant table of children per level: a row evaluates one draw per child
of the three nodes it descends through.

Null keys hash like any value, so all of them share one shard. Rows with equal keys share a shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

BASE_SHARDS, REGIONS, RACKS = 40, 5, 2
_MANTISSA = 53


def layout(shards: int, base: int = BASE_SHARDS, regions: int = REGIONS, racks: int = RACKS) -> dict[str, dict[str, dict[int, float]]]:
    """The tree of equal shards in use: the first ``base`` are dealt over regions and racks; each later one
    is a region of its own, so that growing by one adds a subtree and takes rows only into it."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        region, rack = (f"r{shard % regions}", f"k{shard // regions % racks}") if shard < base else (f"grown{shard}", "k0")
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _weight(tree) -> float:
    return sum(map(_weight, tree.values())) if isinstance(tree, Mapping) else float(tree)


def _levels(tree: Tree) -> list[list[list[tuple[str, float, int]]]]:
    """Per level, per node of that level: (path, weight, number) of each child with a weight above 0. The
    number counts the nodes of the level below; at the last level it is the shard."""
    levels, nodes = [], [("", tree)]
    for depth in range(3):
        level, following = [], []
        for path, node in nodes:
            children = []
            for name, child in node.items():
                if _weight(child) > 0:
                    children.append((f"{path}/{name}", _weight(child), name if depth == 2 else len(following)))
                    following.append((f"{path}/{name}", child))
            level.append(children)
        levels.append(level)
        nodes = following
    if not nodes:
        raise ValueError("a tree needs a shard with a weight above 0")
    return levels


def shard_of(keys: Sequence[str | Column], tree: Tree) -> Column:
    """The shard of a row: an expression that descends the three levels."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(child["path"], *columns), 64 - _MANTISSA)
        u = (bits.cast("double") + 0.5) / float(1 << _MANTISSA)
        return F.struct((-F.log(u) / child["weight"]).alias("wait"), child["number"].alias("number"))

    node = F.lit(0)
    for level in _levels(tree):
        table = F.array(
            *[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(n).alias("number")) for p, w, n in children]) for children in level]
        )
        node = F.array_min(F.transform(F.get(table, node), draw))["number"]
    return node


def shard(df: DataFrame, keys: Sequence[str | Column], tree: Tree, grown: Tree | None = None, out: str = "shard") -> DataFrame:
    """Add the shard, and with a second tree the shard under that one as ``grown_<out>``."""
    df = df.withColumn(out, shard_of(keys, tree))
    return df if grown is None else df.withColumn(f"grown_{out}", shard_of(keys, grown))


def number(df: DataFrame, group: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of each group 0, 1, 2, … without gaps.

    Rows are counted per (partition, group); the counts of earlier partitions give each its first number.
    A window never holds more than what one partition has of a group, so a hot group stays spread out.
    The rows are checkpointed first, because their places in the partitions must not change between the
    two passes; hand in narrow rows."""
    part, place, start, size = (f"_{out}_{x}" for x in ("part", "place", "start", "size"))
    placed = freeze(df.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)))
    sizes = placed.groupBy(group, part).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias(f"_{group}"), F.col(part).alias(f"_{part}"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    local = F.row_number().over(Window.partitionBy(group, part).orderBy(place)) - 1
    numbered = placed.withColumn(out, local.cast("long"))
    same = numbered[group].eqNullSafe(F.col(f"_{group}")) & (numbered[part] == F.col(f"_{part}"))
    return numbered.join(starts, same).withColumn(out, F.col(out) + F.col(start)).drop(part, place, start, f"_{group}", f"_{part}")
