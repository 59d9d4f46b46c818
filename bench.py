"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once to warm up and once
for the clock, written to the noop sink. The ``million_*`` queries repeat the reference bounds of
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import registry
from millrace.operators import kpi
from millrace.session import build_session
from pyspark.sql import functions as F

HEADLINE = (
    "revenue_by_segment revenue_growth customer_revenue_distribution rfm_segments lead_time_analysis moving_average"
    " cumulative_sum profile_table quality_checks fix_data_quality winsorize anomalies_zscore anomalies_iqr anomalies_mad"
    " forecast_ema forecast_linear resample_fill segment_profile segment_column_profile correlation_pearson"
    " correlation_spearman correlation_kendall t_test train_regression embed_chars embed_tfidf semantic_search top_k_similar page_links"
    " page_text classify_columns lineage_downstream latency_stats quota_usage alert_intervals validate_events stream_kpi"
).split()


def million(spark):
    rows = 1_000_000
    sales = spark.range(rows).select(
        F.concat(F.lit("seg_"), F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("segment_id"),
        (F.rand(1) * 1000).alias("amount"),
    )
    log = spark.range(rows).select("id", F.date_add(F.lit("2014-01-01").cast("date"), (F.col("id") % 3650).cast("int")).alias("log_date"), (F.rand(2) * 100).alias("value"))
    customers = spark.range(rows).select(
        F.concat(F.lit("c_"), F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("customer_id"), (F.rand(3) * 500).alias("amount")
    )
    return {
        "million_revenue_by_segment": lambda: kpi.revenue_by_segment(sales, "segment_id", "amount"),
        "million_moving_average_30": lambda: kpi.moving_average(log, ["log_date", "id"], "value", 30),
        "million_customer_revenue_distribution": lambda: kpi.customer_revenue_distribution(customers, "customer_id", "amount"),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    jobs = {name: (lambda build=registry.QUERIES[name]: build(spark, folder)) for name in HEADLINE}
    jobs.update(million(spark))
    only = set(sys.argv[1:])
    timings = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        for _ in range(2):
            begin = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - begin, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": folder.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
