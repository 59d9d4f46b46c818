"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives every vector a string of 64 bits, the sides of random planes through the mean. Per tree the
strings form a sorted array, so the vectors that share a prefix with a query are one stretch of it, whose ends
are found by bisection. A query descends to its longest matching prefix in each tree and then ascends in all
trees at the same time, a bit per step, until the stretches hold enough candidates together. Candidates are then
compared by the exact distance in double precision.

The sorted arrays are cut by their first bits, fewer bits than any query is expected to ascend to, and a stretch
too large for one task is cut further, rows and queries alike; counts and best lists of the cuts just add up.
A query that finds fewer rows than asked for is compared with all rows, in cuts as well.

Equal vectors are one class, of which the smallest ids are kept, one more than asked for; so a vector that many
rows share costs one row. Repeated rows (equal id and vector) count once. Rows with a null id and vectors that are
null, all zero, of another length than most, or hold null or non-finite components take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze

BITS, TREES = 64, 24
#: Candidates to ascend for, with repeats between trees: at least so many, and this share of all vectors. A share
#: is needed where vectors have no clusters, as in the test tables; a fixed number does where they have.
LEAST, SHARE = 5000, 0.9
CUT_ROWS, CUT_QUERIES = 20_000, 5_000
_DEPTHS = 32
_SALTS = 64


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(key).isNotNull() & v.isNotNull() & sound).select(F.col(key).alias("id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].dim if sizes else 0)).distinct()


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(cls, v, ids): distinct vectors with their k + 1 smallest ids. A vector that many rows share is cut
    down in salted groups first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids"))


def _planes(trees: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def hashed(rows: DataFrame, mean: list[float], trees: int, seed: int) -> DataFrame:
    """Add ``hashes``: a string of bits per tree, as a long."""
    centre = np.array(mean)

    @F.pandas_udf("array<long>")
    def hashes(vectors: pd.Series) -> pd.Series:
        planes, weights = _planes(trees, len(centre), seed), np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        out = []
        for at in range(0, len(vectors), 2000):
            block = np.stack(vectors.iloc[at : at + 2000].to_numpy()).astype(np.float64) - centre
            bits = (block @ planes > 0).reshape(len(block), trees, BITS)
            out += list((bits * weights).sum(axis=2, dtype=np.uint64).view(np.int64))
        return pd.Series(out)

    return rows.withColumn("hashes", hashes("v"))


def _trees(rows: DataFrame, first_bits: int, *columns: str) -> DataFrame:
    """A row per tree, with the block that the first bits of the string name."""
    block = F.shiftrightunsigned("h", BITS - first_bits) if first_bits else F.lit(0).cast("long")
    return rows.select(*columns, F.posexplode("hashes").alias("tree", "h")).withColumn("block", block)


_GROUP = ["tree", "block", "cut", "qcut"]


def _cuts(rows: DataFrame, queries: DataFrame, cut_rows: int, cut_queries: int) -> tuple[DataFrame, DataFrame]:
    """Deal the rows and queries of every block over groups of bounded size, each pair of cuts once."""
    pieces = lambda n, most: F.greatest(F.ceil(F.col(n) / F.lit(most)), F.lit(1)).cast("int")
    sizes = rows.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.groupBy("tree", "block").agg(F.count(F.lit(1)).alias("q"))
    blocks = freeze(sizes.join(asked, ["tree", "block"]).select("tree", "block", pieces("n", cut_rows).alias("cuts"), pieces("q", cut_queries).alias("qcuts")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_rows = rows.join(blocks, ["tree", "block"]).withColumn("cut", F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")).withColumn("qcut", every("qcuts"))
    dealt_queries = queries.join(blocks, ["tree", "block"]).withColumn("qcut", F.pmod(F.xxhash64("query_id"), F.col("qcuts")).cast("int")).withColumn("cut", every("cuts"))
    return dealt_rows.drop("cuts", "qcuts"), dealt_queries.drop("cuts", "qcuts")


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _stretch(array: np.ndarray, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the stretches of a sorted array that share ``depth`` bits with each string."""
    if depth == 0:
        return np.zeros(len(strings), np.int64), np.full(len(strings), len(array))
    rest = np.uint64((1 << (BITS - depth)) - 1)
    return np.searchsorted(array, strings & ~rest), np.searchsorted(array, strings | rest, side="right")


def _counts(first_bits: int):
    def count(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        array, strings = np.sort(_unsigned(rows["h"])), _unsigned(queries["h"])
        depths = range(first_bits, min(first_bits + _DEPTHS, BITS) + 1)
        table = np.stack([np.subtract(*_stretch(array, strings, d)[::-1]) for d in depths], axis=1)
        return pd.DataFrame({"query_id": queries["query_id"], "counts": list(table.astype(np.int64))})

    return count


def _best(k: int):
    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            order = np.argsort(_unsigned(rows["h"]), kind="stable")
            array = _unsigned(rows["h"])[order]
            ids = rows["cls"].to_numpy()[order]
            matrix = np.stack(rows["v"].to_numpy()).astype(np.float64)[order]
            norms = np.einsum("ij,ij->i", matrix, matrix)
            for depth, some in queries.groupby("depth"):
                for at in range(0, len(some), 128):
                    part = some.iloc[at : at + 128]
                    asked = np.stack(part["v"].to_numpy()).astype(np.float64)
                    rough = norms - 2 * (asked @ matrix.T) + np.einsum("ij,ij->i", asked, asked)[:, None]
                    low, high = _stretch(array, _unsigned(part["h"]), int(depth))
                    for i, query in enumerate(part["query_id"]):
                        near = rough[i, low[i] : high[i]]
                        if len(near) > k:
                            # The rough distances only choose; what rounding could hide is chosen as well.
                            edge = np.partition(near, k)[k] + 1e-9 * (1 + norms.max())
                            chosen = low[i] + np.flatnonzero(near <= edge)
                        else:
                            chosen = np.arange(low[i], high[i])
                        exact = np.sqrt(((matrix[chosen] - asked[i]) ** 2).sum(axis=1))
                        first = np.lexsort((ids[chosen], exact))[: k + 1]
                        out.append(pd.DataFrame({"query_id": query, "cls": ids[chosen][first], "score": exact[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "cls": [], "score": []})

    return best


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    least: int = LEAST,
    share: float = SHARE,
    seed: int = 42,
    cut_rows: int = CUT_ROWS,
    cut_queries: int = CUT_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row of ``queries``, which is a
    part of ``vectors``; nearest first, ties to the smaller id; a row is no neighbour of its own."""
    rows = freeze(valid_vectors(vectors, key, vector))
    asked = rows.join(queries.select(F.col(key).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("v"))
    classes = freeze(classes_of(rows, k))
    # One row per dimension reaches the driver.
    mean = [r.x for r in classes.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("x")).orderBy("pos").collect()]
    count = classes.count()
    enough = max(least, int(share * count))
    first_bits = max(0, int(math.log2(max(count * trees / enough, 1))) - 3)
    held = freeze(hashed(classes.select("cls", "v"), mean, trees, seed))
    wanted = freeze(hashed(asked, mean, trees, seed))

    strings, questions = _cuts(_trees(held, first_bits, "cls"), _trees(wanted, first_bits, "query_id"), cut_rows, cut_queries)
    counted = strings.groupBy(*_GROUP).cogroup(questions.groupBy(*_GROUP)).applyInPandas(_counts(first_bits), "query_id long, counts array<long>")
    sums = counted.select("query_id", F.posexplode("counts").alias("depth", "n")).groupBy("query_id", "depth").agg(F.sum("n").alias("n"))
    deepest = F.max(F.when(F.col("n") >= enough, F.col("depth") + first_bits))
    depths = freeze(sums.groupBy("query_id").agg(F.coalesce(deepest, F.lit(first_bits)).cast("int").alias("depth")))

    full_rows, full_questions = _cuts(
        _trees(held, first_bits, "cls", "v"), _trees(wanted, first_bits, "query_id", "v").join(depths, "query_id"), cut_rows, cut_queries
    )
    pairs = "query_id long, cls long, score double"
    found = full_rows.groupBy(*_GROUP).cogroup(full_questions.groupBy(*_GROUP)).applyInPandas(_best(k), pairs)
    found = freeze(found.groupBy("query_id", "cls").agg(F.min("score").alias("score")))

    others = F.least(F.lit(k), F.lit(rows.count() - 1))
    names = found.join(classes.select("cls", "ids"), "cls").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    enough_found = names.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= others).select("query_id")
    short = freeze(asked.join(enough_found, "query_id", "left_anti").withColumns({"tree": F.lit(-1), "block": F.lit(0).cast("long"), "h": F.lit(0).cast("long"), "depth": F.lit(0)}))
    if not short.isEmpty():
        whole = classes.select("cls", "v").withColumns({"tree": F.lit(-1), "block": F.lit(0).cast("long"), "h": F.lit(0).cast("long")})
        all_rows, all_short = _cuts(whole, short, cut_rows, cut_queries)
        exact = all_rows.groupBy(*_GROUP).cogroup(all_short.groupBy(*_GROUP)).applyInPandas(_best(k), pairs)
        found = freeze(found.join(short.select("query_id"), "query_id", "left_anti").union(exact.select("query_id", "cls", "score")))
        names = found.join(classes.select("cls", "ids"), "cls").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    ranked = names.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
