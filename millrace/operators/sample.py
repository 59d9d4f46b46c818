"""Sampling. The choice depends on a seeded hash of the key, so it is the same for any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.functions.numbers import z_of
from millrace.functions.order import join_totals, lay_out, running_sum, with_index

_HASH_BITS = 60


def seeded(key: Sequence[str], seed: int) -> Column:
    """The first 15 hexadecimal digits of the MD5 of seed and key, joined by ``|``, as a number: any engine
    can repeat the draw. Nulls count as empty."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), 1, 15), 16, 10).cast("long")


def _margin(n):
    """Rows taken beyond the n expected below a hash cut, as a number or column function of n."""
    root = F.sqrt(n) if isinstance(n, Column) else math.sqrt(n)
    return root * 6 + 100


def _below(share) -> Column:
    """Whether the hash lies in the lowest ``share`` of its range."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.col("_h").cast("double") < share * 2.0**_HASH_BITS


def bottom_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """The n rows with the smallest seeded hash: a uniform sample that merges across parts and batches.

    The table is cut at the hash below which little more than n rows should lie, and what is left is ranked;
    if fewer than n are left, all rows are ranked."""
    hashed = df.withColumn("_h", seeded(key, seed))
    total = df.count()
    if n >= total:
        return df
    likely = freeze(hashed.where(_below((n + _margin(n)) / total)))
    pool = likely if likely.count() >= n else hashed
    return with_index(pool, ["_h", *key], (), "_i").where(F.col("_i") < n).drop("_h", "_i")


def random_sample(df: DataFrame, n: int, key: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return bottom_n(df, n, key or df.columns, seed)


def reservoir_sample(df: DataFrame, n: int, key: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Uniform sample in a single pass; see ``millrace.streaming`` for the stream form."""
    return bottom_n(df, n, key or df.columns, seed)


def systematic_sample(df: DataFrame, n: int, order: Sequence[str], seed: int | None = None) -> DataFrame:
    """Every k-th row in the given order, k = rows // n; a seed picks a start below k, none means 0."""
    total = df.count()
    if n >= total:
        return df
    k = total // n
    start = 0 if seed is None or k <= 1 else hash((seed, 0x9E3779B9)) % k
    indexed = with_index(df, list(order), (), "_i")
    step = F.col("_i") - start
    return indexed.where((step >= 0) & (step % k == 0) & (F.floor(step / k) < n)).drop("_i")


def strata_quota(df: DataFrame, n: int, stratum: str) -> DataFrame:
    """Rows to draw per stratum: its share of n, at least one, at most all; the total is cut to n."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    total = df.select(F.count(F.lit(1))).scalar()
    share = F.bround((F.lit(n) * F.col("_size")).cast("double") / total).cast("long")
    wanted = sizes.withColumn("_want", F.least(F.greatest(F.lit(1), share), "_size"))
    run = running_sum(lay_out(wanted, [stratum]), "_want", "_upto")
    left = F.greatest(F.lit(0), F.lit(n) - (F.col("_upto") - F.col("_want")))
    return run.select(stratum, F.least("_want", left).alias("_quota"), "_size")


def stratified_sample(df: DataFrame, n: int, stratum: str, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Draw from every stratum in proportion. A stratum of any size is ranked by range, not in one task.

    Rows are cut at the hash below which little more than the quota of their stratum should lie; if a
    stratum has fewer there, all rows are ranked."""
    quota = freeze(strata_quota(df, n, stratum))
    hashed = join_totals(df.withColumn("_h", seeded(key, seed)), quota, [stratum])
    share = (F.col("_quota") + _margin(F.col("_quota"))) / F.col("_size")
    likely = freeze(hashed.where(_below(share)))
    counts = likely.groupBy(stratum).agg(F.count(F.lit(1)).alias("_found"))
    short = join_totals(quota, counts, [stratum]).where("_found >= _quota").count() < quota.where("_quota > 0").count()
    ranked = with_index(hashed if short else likely, ["_h", *key], [stratum], "_i")
    return ranked.where("_i < _quota").select(*df.columns)


def md5_bucket(key: str) -> Column:
    """MD5 of the key's text as a 128-bit number modulo 10,000.

    2^64 mod 10000 = 1616 joins the two halves."""
    digest = F.md5(F.col(key).cast("string"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % 10_000
    return ((half(1) * 1616 + half(17)) % 10_000).cast("int")


def deterministic_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """Rows whose key hashes below n / rows: the same keys on every run. At most n, lowest hash first."""
    total = df.select(F.count(F.lit(1))).scalar()
    low = df.withColumn("_b", md5_bucket(key)).where(F.col("_b") / F.lit(10_000.0) < F.lit(float(n)) / total)
    return with_index(low, ["_b", key], (), "_i").where(F.col("_i") < n).drop("_b", "_i")


def sample_size(total: int, confidence: float = 0.95, margin: float = 0.03, proportion: float = 0.5) -> int:
    """Cochran's sample size with finite population correction, 100 at least."""
    z = z_of(confidence)
    n0 = z * z * proportion * (1 - proportion) / margin**2
    n = n0 / (1 + (n0 - 1) / total) if total > 0 else n0
    return min(max(100, math.ceil(n)), total)


def margin_of_error(n: int, total: int, confidence: float = 0.95) -> float:
    if n == 0:
        return 0.0
    z = z_of(confidence)
    correction = math.sqrt((total - n) / (total - 1)) if total > 1 else 1.0
    return z * math.sqrt(0.25 / n) * correction


def choose_strategy(
    total: int, strata: bool = False, streaming: bool = False, reproducible: bool = False, strata_from: int = 1_000, steps_from: int = 100_000
) -> str:
    """Strata are drawn from tables of more than ``strata_from`` rows, every k-th row of more than ``steps_from``."""
    if reproducible:
        return "deterministic"
    if streaming:
        return "reservoir"
    if strata and total > strata_from:
        return "stratified"
    return "systematic" if total > steps_from else "random"


def adaptive_sample(
    df: DataFrame,
    order: Sequence[str],
    n: int | None = None,
    strategy: str = "adaptive",
    stratum: str | None = None,
    key: str | None = None,
    seed: int = 0,
    confidence: float = 0.95,
    margin: float = 0.03,
    streaming: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Pick a strategy and a size for the table; returns the sample and one row of statistics.

    ``order`` is a unique key of the rows; naming ``key`` asks for a reproducible choice by content."""
    total = df.count()
    n = sample_size(total, confidence, margin) if n is None else n
    if strategy == "adaptive":
        strategy = choose_strategy(total, stratum is not None, streaming, key is not None)
    if n >= total:
        sample = df
    elif strategy == "systematic":
        sample = systematic_sample(df, n, order, seed)
    elif strategy == "stratified" and stratum:
        sample = stratified_sample(df, n, stratum, order, seed)
    elif strategy == "deterministic" and key:
        sample = deterministic_sample(df, n, key)
    else:
        sample = bottom_n(df, n, order, seed)
    drawn = sample.count()
    stats = df.sparkSession.range(1).select(
        F.lit(total).cast("long").alias("total_rows"),
        F.lit(drawn).cast("long").alias("sample_size"),
        F.lit(drawn / total if total else 0.0).alias("sampling_rate"),
        F.lit(strategy).alias("strategy"),
        F.lit(confidence).alias("confidence_level"),
        F.lit(margin_of_error(drawn, total, confidence)).alias("margin_of_error"),
    )
    return sample, stats
