"""Exact vector search that leaves out the parts of a corpus that cannot hold a result.

The corpus is parted by the nearest of a bounded number of centres. Every part knows the widest angle between its
centre and one of its rows, so no row of it can be nearer to a query than the query's angle to the centre less that.
A query first searches the parts of its nearest centres until they hold k rows; of the others only those whose
bound reaches its k-th best score so far. Clustered vectors skip most parts; where vectors have no clusters nothing is skipped, and the result
is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.order import leading
from millrace.operators.text import CORPUS_BLOCK, QUERY_BLOCK, _matching, _numbers, _top_k_pair, _units

CENTRES = 64
#: The part of zero vectors, whose score is 0 for every query.
ZERO = -1
#: Cosines of angles near 0 are known to about this.
SLACK = 1e-6


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, part, angle): each row with its nearest centre and the angle to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            near = _product(_units(frame["v"]), centres)
            part, best = near.argmax(axis=1), near.max(axis=1)
            zero = np.array([not np.any(np.asarray(v, float)) for v in frame["v"]])
            yield frame.assign(part=np.where(zero, ZERO, part).astype("int32"), angle=np.where(zero, 0.0, np.arccos(np.clip(best, -1, 1))))

    return rows.mapInPandas(run, f"{_schema(rows)}, part int, angle double")


def _bounded(asked: DataFrame, centres: np.ndarray, widest: Mapping[int, float], sizes: Mapping[int, int], k: int) -> DataFrame:
    """(query_id, v, first, bounds): the nearest parts that hold ``k`` rows together, to be searched first, and the
    best score each part (in the order of ``widest``) can hold."""
    parts = np.array(list(widest))
    held = np.array([sizes[p] for p in widest])
    real = [i for i, p in enumerate(parts) if p != ZERO]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            units = _units(frame["v"])
            bounds = np.zeros((len(frame), len(parts)))
            closeness = np.full(bounds.shape, -np.inf)
            if real:
                closeness[:, real] = _product(units, centres[parts[real]])
                angle = np.arccos(np.clip(closeness[:, real], -1, 1)) - np.array([widest[p] for p in parts[real]])
                bounds[:, real] = np.cos(np.maximum(angle, 0))
                bounds[~units.any(axis=1)] = 0.0
            order = np.argsort(-closeness, axis=1, kind="stable")
            enough = 1 + (np.cumsum(held[order], axis=1) < k).sum(axis=1)
            yield frame.assign(first=[parts[o[:n]] for o, n in zip(order, enough, strict=True)], bounds=list(bounds))

    return asked.mapInPandas(run, f"{_schema(asked)}, first array<int>, bounds array<double>")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _product(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if units.shape[1] != centres.shape[1]:
        raise ValueError("vectors differ in length")
    return units @ centres.T


def _by_part(values: Mapping[int, int]) -> Column:
    """The value of a row's part; null for a part that has none."""
    return _looked_up(values, F.col("part"))


def _looked_up(values: Mapping[int, int], key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("int")


def _bins(sizes: Mapping[int, int], corpus_block: int) -> tuple[dict[int, int], dict[int, int]]:
    """(first bin, number of bins) of each part. Small parts share a bin of about ``corpus_block`` rows, so that a query
    travels once for all of them; a larger part has several bins to itself."""
    first, count, at, held = {}, {}, 0, 0
    for part, n in sizes.items():
        if held and held + n > corpus_block:
            at, held = at + 1, 0
        first[part], count[part] = at, -(-n // corpus_block)
        held += n
        if count[part] > 1:
            at, held = at + count[part], 0
    return first, count


def _search(rows: DataFrame, sizes: Mapping[int, int], wanted: DataFrame, k: int, query_block: int, corpus_block: int, schema: str) -> DataFrame:
    """The best k rows per query and block, of the wanted (query_id, v, parts, least) alone. Rows of parts that nobody
    wants stay where they are; bins of parts and their queries are dealt by hash into blocks."""
    first, count = _bins(sizes, corpus_block)
    bins = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.sequence(_looked_up(first, p), _looked_up(first, p) + _looked_up(count, p) - 1))))
    sought = wanted.select("query_id", "v", "parts", "least", F.explode(bins).alias("_cb"))
    asked = {r["_cb"]: -(-r.n // query_block) for r in sought.groupBy("_cb").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = _looked_up(asked, F.col("_cb"))
    placed = rows.withColumn("_cb", (_by_part(first) + F.pmod(F.xxhash64("id"), _by_part(count))).cast("int")).where(blocks.isNotNull())
    left = placed.select("id", "v", "part", "_cb", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_qb"))
    right = sought.withColumn("_qb", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    by = ["_cb", "_qb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_top_k_pair(k), schema)


def top_k_pruned(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_key: str = "query_id",
    query_vector: str = "vector",
    key: str = "id",
    vector: str = "vector",
    filters: Mapping[str, object] | None = None,
    centres: int = CENTRES,
    query_block: int = QUERY_BLOCK,
    corpus_block: int = CORPUS_BLOCK,
) -> DataFrame:
    """(query_id, id, score, rank, parts_searched, parts): the k most similar corpus rows of every query by cosine,
    ties by id, the same as ``top_k_similar``.

    ``centres`` corpus vectors (those of the smallest hash) and one row per part come to the driver; all else stays
    on the executors. Query keys must be unique; null vectors take no part; vectors of unequal lengths are an error."""
    rows = _matching(corpus, filters).select(F.col(key).alias("id"), _numbers(corpus, vector).alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col(query_key).alias("query_id"), _numbers(queries, query_vector).alias("v")).where("v IS NOT NULL")
    kinds = {**dict(rows.dtypes), **dict(asked.dtypes)}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    first = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "v").limit(centres).select("v").toPandas()
    if first.empty:
        first = rows.limit(1).select("v").toPandas()
    if first.empty:
        return rows.sparkSession.createDataFrame([], f"{schema}, rank int, parts_searched int, parts int")
    middle = _units(first["v"])
    placed = freeze(_placed(rows, middle))
    known = placed.groupBy("part").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    sizes, widest = {r.part: r.n for r in known}, {r.part: r.widest for r in known}
    bounded = freeze(_bounded(asked, middle, widest, sizes, k))
    near = freeze(_search(placed, sizes, bounded.select("query_id", "v", F.col("first").alias("parts"), F.lit(None).cast("double").alias("least")), k, query_block, corpus_block, schema))
    best = leading(near, ["query_id"], [F.desc("score"), "id"], k, "rank").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    best = best.select(F.col("query_id").alias("_of"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    told = bounded.join(best, F.col("query_id").eqNullSafe(F.col("_of")), "left")
    entries = F.arrays_zip(F.array(*[F.lit(p) for p in widest]).alias("part"), F.col("bounds").alias("bound"))
    open_ = F.filter(entries, lambda e: ~F.array_contains("first", e["part"]) & (F.col("least").isNull() | (e["bound"] >= F.col("least") - SLACK)))
    told = freeze(told.select("query_id", "v", "first", "least", F.transform(open_, lambda e: e["part"]).alias("open")))
    far = _search(placed, sizes, told.where(F.size("open") > 0).select("query_id", "v", F.col("open").alias("parts"), "least"), k, query_block, corpus_block, schema)
    ranked = leading(near.union(far), ["query_id"], [F.desc("score"), "id"], k, "rank")
    counts = told.select(F.col("query_id").alias("_of"), (F.size("open") + F.size("first")).alias("parts_searched"), F.lit(len(widest)).alias("parts"))
    return ranked.join(counts, F.col("query_id").eqNullSafe(F.col("_of"))).drop("_of")
