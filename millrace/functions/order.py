"""Global and per-group order on data of any size.

A window without ``partitionBy`` moves every row to one task, and a window over a hot group moves
the whole group there. These helpers range-partition the rows by (group, order) instead, so a group
of any size is spread over as many partitions as it needs, work inside each partition, and carry a
small state from one partition into the next. The carried table has at most one row per partition,
which is why it may be broadcast.

The layout is checkpointed: the partition number of a row must not change between the pass that
computes the carried state and the pass that uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze

PART, POS = "_part", "_pos"
_POS_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def as_key(order: str | Column) -> Column:
    return F.col(order).asc_nulls_last() if isinstance(order, str) else order


def lay_out(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = ()) -> DataFrame:
    """Range-partition and sort by (group, order); add the partition and the row's place in it.

    End ``order`` with a unique key, or equal rows all land in one partition. The number of ranges is
    ``spark.sql.shuffle.partitions``, of which AQE merges neighbours that are small; the merge comes
    before the partition is numbered and written, so it is part of the layout."""
    keys = [F.col(g).asc_nulls_first() for g in group] + [as_key(o) for o in order]
    row_id = F.col("_row_id")
    laid = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row_id", F.monotonically_increasing_id())
        .withColumn(PART, F.shiftright(row_id, _POS_BITS))
        .withColumn(POS, row_id.bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop("_row_id")
    )
    return freeze(laid)


def within(group: Sequence[str] = ()):
    """Window over the rows of one group inside one partition, in layout order."""
    return Window.partitionBy(PART, *group).orderBy(POS)


def carry(
    laid: DataFrame,
    group: Sequence[str],
    states: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """Join onto every row the state its group has reached in earlier partitions (else null).

    ``states`` maps a name to (aggregate over one partition, function that folds the aggregates of
    earlier partitions). Only the first group of a partition can have begun earlier, so the joined
    table has one row per partition."""
    parts = laid.groupBy(PART, *group).agg(
        F.min(POS).alias("_lo"),
        F.max(POS).alias("_hi"),
        *[agg.alias(name) for name, (agg, _) in states.items()],
    )
    if group:
        ends = laid.groupBy(PART).agg(F.max(POS).alias("_end"))
        parts = parts.join(F.broadcast(ends), PART).where("_lo = 0 OR _hi = _end")
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        parts.select(
            PART, "_lo", "_hi", *[fold(F.col(name)).over(earlier).alias(name) for name, (_, fold) in states.items()]
        )
        .where("_lo = 0")
        .drop("_lo")
    )
    joined = laid.join(F.broadcast(carried), PART, "left")
    reached = F.col(POS) <= F.col("_hi")
    return joined.withColumns({name: F.when(reached, F.col(name)) for name in states}).drop("_hi")


def _last_known(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def running_sum(laid: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sum over a layout."""
    return running_sums(laid, {name: value}, group)


def running_sums(laid: DataFrame, sums: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Several inclusive running sums (name: column) in one pass."""
    frame = within(group).rowsBetween(Window.unboundedPreceding, 0)
    df = laid.withColumns({f"_local_{name}": F.sum(value).over(frame) for name, value in sums.items()})
    df = carry(df, group, {f"_before_{name}": (F.sum(value), F.sum) for name, value in sums.items()})
    done = {name: F.col(f"_local_{name}") + F.coalesce(f"_before_{name}", F.lit(0)) for name in sums}
    return df.withColumns(done).drop(*[f"{side}_{name}" for name in sums for side in ("_local", "_before")])


def previous(laid: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Value of the row before, within the group."""
    local = within(group)
    df = laid.withColumn("_local", F.lag(value).over(local)).withColumn("_nth", F.row_number().over(local))
    df = carry(df, group, {"_before": (F.max_by(value, POS), F.last)})
    return df.withColumn(name, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_local"))).drop(
        "_local", "_nth", "_before"
    )


def fill_forward(laid: DataFrame, value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Last non-null value up to and including the row."""
    local = _last_known(F.col(value)).over(within(group).rowsBetween(Window.unboundedPreceding, 0))
    df = laid.withColumn("_local", local)
    known = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(POS)))
    df = carry(df, group, {"_before": (known, _last_known)})
    return df.withColumn(name, F.coalesce("_local", "_before")).drop("_local", "_before")


def with_index(
    df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Number the rows 0, 1, 2, … in the given order, per group if one is named."""
    laid = lay_out(df, order, group)
    local = F.row_number().over(within(group)) - 1 if group else F.col(POS)
    indexed = laid.withColumn("_local", local.cast("long"))
    indexed = carry(indexed, group, {"_before": (F.count(F.lit(1)), F.sum)})
    return indexed.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).drop(
        "_local", "_before", PART, POS
    )


def value_counts(df: DataFrame, value: str | Column, group: Sequence[str] = (), name: str = "_v") -> DataFrame:
    """Distinct non-null values with their counts. A hot value becomes one row."""
    column = F.col(value) if isinstance(value, str) else value
    return (
        df.select(*group, column.alias(name)).where(F.col(name).isNotNull()).groupBy(*group, name).agg(
            F.count(F.lit(1)).alias("_c")
        )
    )


def join_totals(df: DataFrame, totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach per-group totals (null groups match); Spark picks the join by measured size."""
    if not group:
        total = totals.select(F.struct(*totals.columns).alias("t")).scalar()
        return df.withColumn("_total", total).select(*df.columns, "_total.*")
    renamed = totals
    for g in group:
        renamed = renamed.withColumnRenamed(g, f"_t_{g}")
    match = None
    for g in group:
        same = F.col(g).eqNullSafe(F.col(f"_t_{g}"))
        match = same if match is None else match & same
    return df.join(renamed, match).drop(*[f"_t_{g}" for g in group])


def order_stats(
    df: DataFrame, value: str | Column, picks: dict[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """Exact order statistics: per group ``n`` and, for each pick, the value at a 0-based position.

    A pick is a column over ``n``. Works on value counts, so ties cost one row, and never holds a
    group in one task."""
    return order_stats_of_counts(value_counts(df, value, group), picks, group)


def order_stats_of_counts(counts: DataFrame, picks: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """``order_stats`` on (group, _v, _c) rows."""
    laid = lay_out(counts, ["_v"], group)
    run = running_sum(laid, "_c", "_upto", group)
    n = laid.groupBy(*group).agg(F.sum("_c").alias("n"))
    run = join_totals(run, n, group)
    at = {
        name: (F.col("_upto") - F.col("_c") <= pick) & (pick < F.col("_upto")) for name, pick in picks.items()
    }
    hit = None
    for test in at.values():
        hit = test if hit is None else hit | test
    return (
        run.where(hit)
        .groupBy(*group)
        .agg(F.max("n").alias("n"), *[F.max(F.when(test, F.col("_v"))).alias(name) for name, test in at.items()])
    )


def quantiles(
    df: DataFrame, value: str | Column, points: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles (position (n-1)·p) per group, with ``n``."""
    return quantiles_of_counts(value_counts(df, value, group), points, group)


def quantiles_of_counts(counts: DataFrame, points: dict[str, float], group: Sequence[str] = ()) -> DataFrame:
    n = F.col("n")
    place = {name: (n - 1) * F.lit(float(p)) for name, p in points.items()}
    picks: dict[str, Column] = {}
    for name, position in place.items():
        picks[f"_lo_{name}"] = F.floor(position)
        picks[f"_hi_{name}"] = F.ceil(position)
    found = order_stats_of_counts(counts, picks, group)
    out = []
    for name, position in place.items():
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return found.select(*group, "n", *out)


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their count and average rank (1-based, ties share)."""
    laid = lay_out(value_counts(df, value), ["_v"])
    run = running_sum(laid, "_c", "_upto")
    return run.select(
        F.col("_v").alias(value),
        F.col("_c").alias("n"),
        (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias("rank"),
    )


def trailing(
    df: DataFrame,
    order: Sequence[str | Column],
    rows: int,
    outputs: Callable[[object], dict[str, Column]],
    group: Sequence[str] = (),
) -> DataFrame:
    """Window expressions over ``rows`` preceding rows and the current one, without one-task windows.

    Rows are numbered and cut into blocks; the last ``rows`` rows of a block are copied to the next
    block as its halo and dropped after the window. ``outputs`` gets the window."""
    block = max(rows, 50_000)
    indexed = with_index(df, order, group, "_idx")
    number = F.floor(F.col("_idx") / block)
    copies = F.when(
        F.col("_idx") % block >= block - rows,
        F.array(F.struct(number.alias("b"), F.lit(False).alias("halo")), F.struct((number + 1).alias("b"), F.lit(True).alias("halo"))),
    ).otherwise(F.array(F.struct(number.alias("b"), F.lit(False).alias("halo"))))
    spread = indexed.withColumn("_copy", F.explode(copies)).withColumn("_block", F.col("_copy.b"))
    frame = Window.partitionBy(*group, "_block").orderBy("_idx").rowsBetween(-rows, 0)
    return spread.withColumns(outputs(frame)).where(~F.col("_copy.halo")).drop("_copy", "_block", "_idx")


#: Values that the ranges of a ``trailing_mean`` may hand on in all (8 MB); beyond, rows go to blocks by a second shuffle.
HALO_VALUES = 1 << 20


def trailing_mean(df: DataFrame, order: Sequence[str | Column], value: str, rows: int, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean of the value over ``rows`` preceding rows and the current one, nulls left out, in one shuffle of the rows.

    Each range of the layout hands the last ``rows`` values of its last group to the ranges after it, and works
    on its rows in order. What is handed on is at most ranges * ``rows`` values; above ``HALO_VALUES``, and for
    decimals, ``trailing`` does the work."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges * rows > HALO_VALUES or dict(df.dtypes)[value].startswith("decimal"):
        return trailing(df, order, rows, lambda frame: {name: F.avg(value).over(frame)}, group)
    same = F.xxhash64(*[c for g in group for c in (F.col(g), F.col(g).isNull())]) if group else F.lit(0).cast("long")
    laid = lay_out(df.withColumns({"_same": same, "_value": F.col(value).cast("double")}), order, group)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row of a range: whether it is all of one group, that of its first and last row, its last values."""
        part = first = last = None
        single, tail = True, np.empty(0, object)
        for batch in batches:
            if len(batch):
                numbers, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                part = int(numbers[0])
                first = int(groups[0]) if first is None else first
                new = np.flatnonzero(groups[1:] != groups[:-1]) + 1
                single = single and not len(new) and groups[0] == first
                start = new[-1] if len(new) else 0
                values = np.array(batch.column(2)[max(start, len(groups) - rows) :].to_pylist(), object)
                tail = np.concatenate([tail if not len(new) and groups[0] == last else tail[:0], values])[-rows:] if rows else tail
                last = int(groups[-1])
        if part is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "single": bool(single), "tail": tail.tolist()}], schema)

    schema = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("single", pa.bool_()), ("tail", pa.list_(pa.float64()))])
    parts = laid.select(PART, "_same", "_value").mapInArrow(ends, "part long, first long, last long, single boolean, tail array<double>").orderBy("part").collect()
    halos = df.sparkSession.sparkContext.broadcast(_halos(parts, rows))
    kept = [f for f in laid.schema.fields if f.name not in (PART, POS, "_same", "_value", name)]
    return_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` double"

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            groups = batch.column("_same").to_numpy()
            values = batch.column("_value").to_numpy(zero_copy_only=False)
            missing = batch.column("_value").is_null().to_numpy(zero_copy_only=False)
            if before is None:
                handed = halos.value.get(batch.column(PART)[0].as_py(), [])
                before, last = (np.array(handed, float), np.array([x is None for x in handed], bool)), groups[0]
            out, valid = np.empty(len(values)), np.empty(len(values), bool)
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1), len(groups)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start or groups[0] != last:
                    before = (np.empty(0), np.empty(0, bool))
                run, gone = np.concatenate([before[0], values[start:end]]), np.concatenate([before[1], missing[start:end]])
                totals, counts = _window_sums(np.where(gone, 0.0, run), rows + 1), _window_sums((~gone).astype(float), rows + 1)
                own = slice(len(before[0]), None)
                valid[start:end] = counts[own] > 0
                out[start:end] = totals[own] / np.maximum(counts[own], 1)
                before = (run[-rows:], gone[-rows:]) if rows else (run[:0], gone[:0])
            last = groups[-1]
            means = pa.array(out, pa.float64(), mask=~valid)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), means], [*(f.name for f in kept), name])

    return laid.mapInArrow(mean, return_schema)


def _halos(parts: Sequence[Row], rows: int) -> dict[int, list[float | None]]:
    """For each range the values before it, at most ``rows``, in its first row's group."""
    found = {}
    for i, part in enumerate(parts):
        tails, held, at = [], 0, i - 1
        while at >= 0 and held < rows and parts[at].last == part.first:
            tails.insert(0, parts[at].tail)
            held += len(parts[at].tail)
            at = at - 1 if parts[at].single else -1
        if held:
            found[part.part] = [x for tail in tails for x in tail][-rows:]
    return found


def _window_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Sum of each value and the ``width`` - 1 before it, added from the oldest on, as Spark's own window does."""
    totals = np.zeros(len(values))
    for back in range(min(width, len(values)) - 1, -1, -1):
        totals[back:] += values[: len(values) - back]
    return totals


GROUP_LIMIT = 1_000  # Spark keeps only the leading rows of each group before the shuffle up to this rank


def leading(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], rows: int, name: str = "_nth"
) -> DataFrame:
    """The first ``rows`` rows of each group with their 1-based rank.

    Small ranks use Spark's group limit, which cuts every group to ``rows`` on the map side; large ones
    the range index."""
    keys = [as_key(o) for o in order]
    if rows <= GROUP_LIMIT and group:
        ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*keys)))
        return ranked.where(F.col(name) <= rows)
    ranked = with_index(df, keys, group, name).withColumn(name, F.col(name) + 1)
    return ranked.where(F.col(name) <= rows)
