"""Business KPIs: growth, segments, margins, customers, quality rates, series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import ratio, round_to
from millrace.functions.order import lay_out, previous, running_sum, trailing_mean


def grand_total(df: DataFrame, agg: Column) -> Column:
    """One-row aggregate as a scalar subquery, instead of SUM() OVER () in a single task."""
    return df.select(agg.alias("total")).scalar()


def total(amount: str | Column) -> Column:
    """Sum as a double. A decimal amount is summed exactly, whatever the order of the rows."""
    return F.sum(amount).cast("double")


def percent(part: Column, whole: Column) -> Column:
    return round_to(ratio(part * 100, whole), 2)


def change_percent(now: Column, before: Column) -> Column:
    return round_to(ratio(now - before, before) * 100, 2)


def revenue_growth(df: DataFrame, date: str, amount: str) -> DataFrame:
    """Revenue per period, the period before and growth in percent."""
    periods = df.groupBy(F.col(date).alias("period")).agg(total(amount).alias("revenue"))
    periods = previous(lay_out(periods, ["period"]), "revenue", "prev_revenue")
    return periods.select(
        "period", "revenue", "prev_revenue", change_percent(F.col("revenue"), F.col("prev_revenue")).alias("growth_pct")
    )


def revenue_by_segment(df: DataFrame, segment: str, amount: str) -> DataFrame:
    """Revenue per segment and its share of the grand total."""
    whole = grand_total(df, total(amount))
    return (
        df.groupBy(F.col(segment).alias("segment"))
        .agg(total(amount).alias("revenue"))
        .withColumn("pct_of_total", percent(F.col("revenue"), whole))
    )


def profit_margin(df: DataFrame, segment: str, revenue: str, cost: str) -> DataFrame:
    profit = F.col("revenue") - F.col("cost")
    return (
        df.groupBy(F.col(segment).alias("segment"))
        .agg(total(revenue).alias("revenue"), total(cost).alias("cost"))
        .withColumn("profit", profit)
        .withColumn("margin_pct", round_to(ratio(profit, "revenue") * 100, 2))
    )


def average_order_value(df: DataFrame, date: str, order_id: str, amount: str) -> DataFrame:
    revenue, orders = F.col("total_revenue"), F.col("order_count")
    return (
        df.groupBy(F.col(date).alias("period"))
        .agg(F.count_distinct(order_id).alias("order_count"), total(amount).alias("total_revenue"))
        .withColumn("aov", round_to(ratio(revenue, orders), 2))
    )


def customer_count_by_period(df: DataFrame, date: str, customer: str) -> DataFrame:
    periods = df.groupBy(F.col(date).alias("period")).agg(F.count_distinct(customer).alias("unique_customers"))
    periods = previous(lay_out(periods, ["period"]), "unique_customers", "prev_customers")
    return periods.select(
        "period",
        "unique_customers",
        "prev_customers",
        (F.col("unique_customers") - F.coalesce("prev_customers", F.lit(0))).alias("net_new"),
    )


def customer_revenue_distribution(df: DataFrame, customer: str, amount: str) -> DataFrame:
    """Revenue of the top 10, 11-50, 51-100 customers and of all others. Equal revenue ranks by customer.

    Only the 101 boundary customers are ranked: tiers are told apart by comparing with the 10th,
    50th and 100th, so no global row number and no join back is needed."""
    totals = df.groupBy(F.col(customer).alias("customer_id")).agg(total(amount).alias("total_revenue"))
    totals = totals.withColumn("rank_key", F.struct(-F.coalesce("total_revenue", F.lit(float("-inf"))), "customer_id"))
    top = totals.orderBy("rank_key").limit(100)
    edges = top.agg(F.array_sort(F.collect_list("rank_key"))).scalar()  # 100 entries at most
    within = lambda n: F.col("rank_key") <= F.coalesce(F.get("edges", F.lit(n - 1)), F.element_at("edges", -1))
    tier = (
        F.when(within(10), "Top 10").when(within(50), "Top 11-50").when(within(100), "Top 51-100").otherwise("Others")
    )
    return (
        totals.withColumn("edges", edges)
        .groupBy(tier.alias("customer_tier"))
        .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("total_revenue").alias("tier_revenue"))
        .withColumn("pct_of_total", percent(F.col("tier_revenue"), grand_total(df, total(amount))))
    )


def rfm_segments(df: DataFrame, customer: str, order_id: str, date: str, amount: str, as_of: dt.date) -> DataFrame:
    """Recency, frequency, monetary value and the segment of each customer on the day ``as_of``."""
    recency, frequency, monetary = F.col("recency_days"), F.col("frequency"), F.col("monetary")
    segment = (
        F.when((recency <= 30) & (frequency >= 5) & (monetary >= 1000), "Champions")
        .when((recency <= 60) & (frequency >= 3), "Loyal")
        .when(recency <= 30, "Recent")
        .when((recency > 90) & (frequency >= 3), "At Risk")
        .otherwise("Other")
    )
    return (
        df.groupBy(F.col(customer).alias("customer_id"))
        .agg(
            F.datediff(F.lit(as_of), F.to_date(F.max(date))).alias("recency_days"),
            F.count_distinct(order_id).alias("frequency"),
            total(amount).alias("monetary"),
        )
        .withColumn("segment", segment)
    )


def null_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls and null percentage of each column, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("null_count")) for c in columns]
        ).alias("per_column"),
    )
    return counts.select("total_rows", F.inline("per_column")).select(
        "column_name", "total_rows", "null_count", percent(F.col("null_count"), F.col("total_rows")).alias("null_pct")
    )


def duplicate_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that repeat, the rows in them and the rows in excess of one per group."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.sum("n").alias("total_duplicate_rows"),
        F.sum(F.col("n") - 1).alias("excess_rows"),
    )


def value_distribution(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Most frequent values as text, with their share of all rows."""
    rows = grand_total(df, F.count(F.lit(1)))
    return (
        df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NULL")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(limit)
        .withColumn("pct", percent(F.col("count"), rows))
    )


def inventory_turnover(df: DataFrame, product: str, sold: str, stock: str) -> DataFrame:
    return (
        df.groupBy(F.col(product).alias("product_id"))
        .agg(total(sold).alias("units_sold"), F.avg(stock).alias("avg_stock"))
        .withColumn("turnover_rate", round_to(ratio("units_sold", "avg_stock"), 2))
    )


def lead_time_analysis(df: DataFrame, segment: str, ordered: str, delivered: str) -> DataFrame:
    """Days from order to delivery (midnights passed), per segment; undelivered rows are left out."""
    days = F.datediff(F.to_date(delivered), F.to_date(ordered))
    return (
        df.where(F.col(delivered).isNotNull())
        .groupBy(F.col(segment).alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.avg(days).alias("avg_lead_days"),
            F.min(days).alias("min_lead_days"),
            F.max(days).alias("max_lead_days"),
        )
    )


def moving_average(
    df: DataFrame, order: Sequence[str], value: str, window: int = 7, partition: Sequence[str] = ()
) -> DataFrame:
    """Mean of the row and the ``window`` rows before it (window + 1 rows in all).

    ``order`` should end in a unique key, which makes the result well defined."""
    kept = df.select(*dict.fromkeys([*partition, *order, value]))
    return trailing_mean(kept, list(order), value, window, "moving_avg", partition)


def year_over_year(df: DataFrame, date: str, value: str, as_of: dt.date) -> DataFrame:
    """Monthly sums of the year of ``as_of`` against the year before, in one pass."""
    year = F.year(date)
    now, before = F.col("current_value"), F.col("previous_value")
    return (
        df.where(year.isin(as_of.year, as_of.year - 1))
        .groupBy(F.month(date).alias("month"))
        .agg(
            total(F.when(year == as_of.year, F.col(value))).alias("current_value"),
            total(F.when(year == as_of.year - 1, F.col(value))).alias("previous_value"),
            F.count_if(year == as_of.year).alias("rows_now"),
        )
        .where("rows_now > 0")
        .select(
            "month",
            "current_value",
            "previous_value",
            change_percent(now, F.coalesce(before, F.lit(0))).alias("yoy_change_pct"),
        )
    )


def cumulative_sum(df: DataFrame, order: str, value: str, partition: Sequence[str] = ()) -> DataFrame:
    """Running sum in the order of ``order``; equal order values share one sum."""
    steps = df.groupBy(*partition, order).agg(F.sum(value).alias("_step"))
    sums = running_sum(lay_out(steps, [order], partition), "_step", "_sum", partition)
    keys = [*partition, order]
    match = None
    for k in keys:
        sums = sums.withColumnRenamed(k, f"_s_{k}")
        same = F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        match = same if match is None else match & same
    joined = df.join(sums, match)
    return joined.select(
        *partition, F.col(order).alias("period"), F.col(value).alias("value"), F.col("_sum").alias("cumulative_sum")
    )


@dataclass(frozen=True)
class Kpi:
    name: str
    category: str
    build: Callable[..., DataFrame]
    required: tuple[str, ...]
    outputs: tuple[str, ...]
    optional: dict[str, object] = field(default_factory=dict)

    def render(self, df: DataFrame, **arguments: object) -> DataFrame:
        missing = [name for name in self.required if name not in arguments]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        return self.build(df, **{**self.optional, **arguments})


KPIS: dict[str, Kpi] = {
    kpi.name: kpi
    for kpi in (
        Kpi("revenue_growth", "financial", revenue_growth, ("date", "amount"), ("period", "revenue", "prev_revenue", "growth_pct")),
        Kpi("revenue_by_segment", "financial", revenue_by_segment, ("segment", "amount"), ("segment", "revenue", "pct_of_total")),
        Kpi("profit_margin", "financial", profit_margin, ("segment", "revenue", "cost"), ("segment", "revenue", "cost", "profit", "margin_pct")),
        Kpi("average_order_value", "financial", average_order_value, ("date", "order_id", "amount"), ("period", "order_count", "total_revenue", "aov")),
        Kpi("customer_count_by_period", "customer", customer_count_by_period, ("date", "customer"), ("period", "unique_customers", "prev_customers", "net_new")),
        Kpi("customer_revenue_distribution", "customer", customer_revenue_distribution, ("customer", "amount"), ("customer_tier", "customer_count", "tier_revenue", "pct_of_total")),
        Kpi("rfm_segments", "customer", rfm_segments, ("customer", "order_id", "date", "amount", "as_of"), ("customer_id", "recency_days", "frequency", "monetary", "segment")),
        Kpi("null_rate", "quality", null_rate, ("columns",), ("column_name", "total_rows", "null_count", "null_pct")),
        Kpi("duplicate_rate", "quality", duplicate_rate, ("keys",), ("duplicate_groups", "total_duplicate_rows", "excess_rows")),
        Kpi("value_distribution", "quality", value_distribution, ("column",), ("value", "count", "pct"), {"limit": 20}),
        Kpi("inventory_turnover", "operations", inventory_turnover, ("product", "sold", "stock"), ("product_id", "units_sold", "avg_stock", "turnover_rate")),
        Kpi("lead_time_analysis", "operations", lead_time_analysis, ("segment", "ordered", "delivered"), ("segment", "order_count", "avg_lead_days", "min_lead_days", "max_lead_days")),
        Kpi("moving_average", "timeseries", moving_average, ("order", "value"), ("moving_avg",), {"window": 7}),
        Kpi("year_over_year", "timeseries", year_over_year, ("date", "value", "as_of"), ("month", "current_value", "previous_value", "yoy_change_pct")),
        Kpi("cumulative_sum", "timeseries", cumulative_sum, ("order", "value"), ("period", "value", "cumulative_sum")),
    )
}


def list_kpis(category: str | None = None) -> list[Kpi]:
    return [kpi for kpi in KPIS.values() if category in (None, kpi.category)]
