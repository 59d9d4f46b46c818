"""Anomaly detection: z-score, interquartile range, median deviation, isolation forest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.order import join_totals, order_stats, order_stats_of_counts, quantiles, value_counts, with_index
from millrace.operators.clean import _filled, long_form, numeric_columns, per_column
from millrace.operators.sample import bottom_n

def _n() -> Column:
    return F.col("n")


def _values(df: DataFrame, value: str, key: Sequence[str], group: Sequence[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(*group, *key, F.col(value).cast("double").alias("value"))


def _found(df: DataFrame, test: Column, score: Column, group: Sequence[str], key: Sequence[str], *extra: Column) -> DataFrame:
    return df.where(test).select(*group, *key, "value", score.alias("score"), *extra)


def anomalies_zscore(
    df: DataFrame, value: str, key: Sequence[str], group: Sequence[str] = (), threshold: float = 3.0
) -> DataFrame:
    """Rows further than ``threshold`` population deviations from the mean of their group."""
    rows = _values(df, value, key, group)
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev")
    )
    deviation = F.when(F.col("dev") == 0, 1.0).otherwise(F.col("dev"))
    score = F.abs((F.col("value") - F.col("mean")) / deviation)
    joined = join_totals(rows, stats.where(_n() >= 3), group)
    return _found(joined, score > threshold, score, group, key, F.col("mean").alias("expected"))


def anomalies_iqr(
    df: DataFrame, value: str, key: Sequence[str], group: Sequence[str] = (), threshold: float = 1.5
) -> DataFrame:
    """Rows outside q1 - t·iqr … q3 + t·iqr; the quartiles are the values at n//4 and 3n//4."""
    rows = _values(df, value, key, group)
    stats = order_stats(rows, "value", {"q1": F.floor(_n() / 4), "q3": F.floor(_n() * 3 / 4)}, group).where(_n() >= 4)
    q1, q3, v = F.col("q1"), F.col("q3"), F.col("value")
    iqr = q3 - q1
    low, high = q1 - threshold * iqr, q3 + threshold * iqr
    distance = F.when(v < low, low - v).otherwise(v - high)
    score = F.when(iqr > 0, distance / F.nullif(iqr, F.lit(0.0))).otherwise(0.0)
    joined = join_totals(rows, stats, group)
    return _found(joined, (v < low) | (v > high), score, group, key, low.alias("lower"), high.alias("upper"))


def anomalies_mad(
    df: DataFrame, value: str, key: Sequence[str], group: Sequence[str] = (), threshold: float = 3.5
) -> DataFrame:
    """Rows whose modified z-score 0.6745·|x - median| / MAD exceeds ``threshold`` (upper medians)."""
    rows = _values(df, value, key, group)
    middle = {"middle": F.floor(_n() / 2)}
    # Both medians come from the counts of distinct values; the rows themselves are read for the verdict alone.
    counts = freeze(value_counts(rows, "value", group))
    medians = freeze(order_stats_of_counts(counts, middle, group).where(_n() >= 3).withColumnRenamed("middle", "median").drop("n"))
    gaps = join_totals(counts, medians, group).groupBy(*group, F.abs(F.col("_v") - F.col("median")).alias("_v")).agg(F.sum("_c").alias("_c"))
    mads = order_stats_of_counts(gaps, middle, group).withColumnRenamed("middle", "mad").drop("n")
    joined = join_totals(join_totals(rows, medians, group), mads, group).withColumn("off", F.abs(F.col("value") - F.col("median")))
    score = F.lit(0.6745) * F.col("off") / F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))
    return _found(joined, score > threshold, score, group, key, F.col("median").alias("expected"))


METHODS: dict[str, tuple[Callable[..., DataFrame], float]] = {
    "zscore": (anomalies_zscore, 3.0),
    "iqr": (anomalies_iqr, 1.5),
    "mad": (anomalies_mad, 3.5),
}


def anomalies_by_column(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | None = None,
    method: str = "mad",
    threshold: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The anomalous (column, key, value) rows of all numeric columns, and a summary per column."""
    detect, default = METHODS[method]
    columns = list(columns or [c for c in numeric_columns(df) if c not in key])
    cells = long_form(df, columns, "double", key)
    found = detect(cells, "value", key, ["column"], default if threshold is None else threshold)
    sizes = cells.groupBy("column").agg(
        F.count("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    hits = found.groupBy("column").agg(F.count(F.lit(1)).alias("anomaly_count"))
    count = F.coalesce("anomaly_count", F.lit(0))
    summary = sizes.join(hits, "column", "left").select(
        F.col("column").alias("column_name"),
        "total",
        "mean",
        "min",
        "max",
        count.alias("anomaly_count"),
        (count / F.nullif("total", F.lit(0))).alias("anomaly_rate"),
    )
    return found, summary


# --- isolation forest -------------------------------------------------------------------------

TREES, TREE_ROWS = 100, 256


# A grown tree is five arrays over its nodes: split feature (-1 at a leaf), split value, left child,
# right child, path length at a leaf. Plain arrays travel to the executors without this module.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[list[float]] = []
    todo = [(x, 0, -1, False)]
    while todo:
        part, depth, parent, is_right = todo.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][3 if is_right else 2] = here
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else np.array([], dtype=int)
        if depth >= limit or len(part) <= 1 or len(spread) == 0:
            nodes.append([-1, 0.0, 0, 0, depth + _mean_path(len(part))])
            continue
        f = int(rng.choice(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        nodes.append([f, cut, 0, 0, 0.0])
        low = part[:, f] < cut
        todo += [(part[low], depth + 1, here, False), (part[~low], depth + 1, here, True)]
    table = np.array(nodes, dtype=float)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]


def _forest(rows: DataFrame, features: list[str], key: Sequence[str], trees: int, tree_rows: int, seed: int) -> tuple[list[Tree], int, int]:
    """(trees, rows of each, rows sampled). The trees * tree_rows first rows by a seeded hash are dealt in that order to
    the trees, round and round if there are fewer; each tree grows on the executors, in a group of its own rows."""
    sample = freeze(with_index(bottom_n(rows, trees * tree_rows, key, seed), [F.xxhash64(*key, F.lit(seed)).asc(), *key], name="nth"))
    sampled = sample.count()
    size = min(tree_rows, sampled)
    if not size:
        return [], 0, 0
    slots = F.sequence(F.col("nth"), F.lit(trees * size - 1).cast("long"), F.lit(sampled).cast("long"))
    dealt = sample.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(features)], F.explode(slots).alias("slot"))
    dealt = dealt.withColumn("tree", F.floor(F.col("slot") / size).cast("int"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("slot")
        number = int(ordered["tree"].iloc[0])
        x = ordered[[f"f{i}" for i in range(len(features))]].to_numpy(dtype=float)
        return pd.DataFrame([(number, *[a.tolist() for a in _grow(x, np.random.default_rng([seed, number]))])], columns=["tree", *TREE_FIELDS])

    schema = "tree int, feature array<int>, split array<double>, lower array<int>, upper array<int>, depth array<double>"
    grown = dealt.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()  # trees * 2 * tree_rows nodes at most
    return [tuple(np.array(r[c]) for c in TREE_FIELDS) for r in grown], size, sampled


def _walkable(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature, split, next nodes, path length, steps): a leaf leads to itself, so that all rows take the same steps."""
    feature, split, low, high, depth = tree
    inner, here = feature >= 0, np.arange(len(feature))
    after = np.stack([np.where(inner, high, here), np.where(inner, low, here)], axis=1).ravel()
    steps, at = 0, np.zeros(1, np.int64)
    while inner[at].any():
        at = np.unique(after.reshape(-1, 2)[at])
        steps += 1
    return np.where(inner, feature, 0), split, after, depth, steps


def _mean_depth(trees: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]], x: np.ndarray) -> np.ndarray:
    """Mean path length of the rows over all trees."""
    out = np.zeros(len(x))
    width, flat = x.shape[1], np.ascontiguousarray(x).ravel()
    for start in range(0, len(x), 4096):
        stop = min(start + 4096, len(x))
        first, total = np.arange(start, stop) * width, out[start:stop]
        for feature, split, after, depth, steps in trees:
            at = np.zeros(stop - start, np.int64)
            for _ in range(steps):
                below = flat.take(first + feature.take(at)) < split.take(at)
                at = after.take(2 * at + below)
            total += depth.take(at)
    return out / max(len(trees), 1)


TREE_FIELDS = ("feature", "split", "lower", "upper", "depth")


def isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    contamination: float | None = 0.1,
    seed: int = 42,
    nulls: str = "median",
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Score every row (1 = isolated at once) and flag the share ``contamination``; ``None`` flags
    scores above 0.5. Nulls take the column median, or their rows are dropped (``nulls="drop"``).

    Each of ``trees`` grows on ``tree_rows`` sampled rows, which is the method's own sample, on the executors; what is
    broadcast has at most 2 * trees * tree_rows nodes. The table is scored where it lies."""
    features = list(features)
    rows = df.select(*key, *[F.col(c).cast("double").alias(c) for c in features])
    if nulls == "drop":
        rows = rows.dropna(subset=features)
    else:
        medians = quantiles(long_form(rows, features, "double"), "value", {"median": 0.5}, ["column"])
        rows = _filled(rows, features, per_column(medians, features, "median"))
    schema = rows.select(*key, *features).schema.add("score", "double").add("is_anomaly", "boolean")
    forest, size, sampled = _forest(rows, features, key, trees, tree_rows, seed)
    if not sampled or (sampled < 10 and nulls == "drop"):
        return df.sparkSession.createDataFrame([], schema)
    expected = _mean_path(size) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walked = [_walkable(tree) for tree in shared.value]
        for batch in batches:
            depth = _mean_depth(walked, batch[features].to_numpy(dtype=float))
            yield batch.assign(score=2.0 ** (-depth / expected))

    scored = rows.mapInPandas(score, rows.select(*key, *features).schema.add("score", "double"))
    if contamination is None:
        return scored.withColumn("is_anomaly", F.col("score") > 0.5)
    scored = freeze(scored)
    cut = quantiles(scored, "score", {"cut": 1.0 - contamination}).select("cut").scalar()
    return scored.withColumn("is_anomaly", F.col("score") > cut)


def isolation_summary(scored: DataFrame, top: int = 20, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Totals with the anomalous share in percent, and the ``top`` rows by score, ties by ``key``."""
    totals = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        (F.count_if("is_anomaly") * 100 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("anomaly_pct"),
    )
    return totals, scored.where("is_anomaly").orderBy(F.desc("score"), *key).limit(top)
