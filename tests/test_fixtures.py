"""Small tables with results worked out by hand."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.numbers import z_of
from millrace.functions.pvalues import f_upper, t_two_sided
from millrace.operators import anomaly, clean, contracts, kpi, lineage, logs, ml, pages, privacy, profile, sample, segment, series, stats, text
from millrace.plans import flow, sql
from millrace.sources import io


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def values(df, column, order):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


SPIKE = [10.0, 12.0, 11.0, 13.0, 12.0, 100.0, 11.0, 12.0]


def test_spike_is_found(spark):
    df = frame(spark, key=list(range(8)), value=SPIKE)
    assert values(anomaly.anomalies_zscore(df, "value", ["key"], threshold=2.0), "value", "key") == [100.0]
    assert anomaly.anomalies_zscore(df, "value", ["key"]).count() == 0
    assert 100.0 in values(anomaly.anomalies_iqr(df, "value", ["key"]), "value", "key")
    assert values(anomaly.anomalies_mad(df, "value", ["key"]), "value", "key") == [100.0]


def test_clean_vector_has_none(spark):
    df = frame(spark, key=list(range(8)), value=[10.0, 11.0] * 4)
    assert anomaly.anomalies_mad(df, "value", ["key"]).count() == 0


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(42)
    df = frame(spark, id=list(range(105)), value=np.concatenate([rng.normal(100, 5, 100), rng.normal(200, 5, 5)]))
    scored = anomaly.isolation_forest(df, ["value"], ["id"], 0.1)
    top = {r.id for r in scored.orderBy(F.desc("score")).limit(20).collect()}
    assert set(range(100, 105)) <= top
    assert 9 <= scored.where("is_anomaly").count() <= 12
    assert anomaly.isolation_forest(df.limit(3), ["value"], ["id"], None, nulls="drop").count() == 0


def test_isolation_trees_are_dealt_alike(spark):
    rows = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"))
    one, two = (
        {r.id: r.score for r in anomaly.isolation_forest(rows.repartition(n), ["x"], ["id"], None, trees=8, tree_rows=40).collect()} for n in (1, 7)
    )
    assert one == two and len(set(one.values())) > 20
    assert anomaly.isolation_forest(rows.where("false"), ["x"], ["id"], 0.1).count() == 0


def test_forecasts(spark):
    line = frame(spark, idx=list(range(5)), value=[10.0, 11.0, 12.0, 13.0, 14.0])
    ahead = series.forecast_linear(line, ["idx"], "value", 3)
    assert values(ahead, "forecast", "period") == pytest.approx([15, 16, 17])
    assert ahead.where("lower_bound < forecast AND forecast < upper_bound").count() == 3
    ema = frame(spark, idx=list(range(5)), value=[10.0, 12.0, 14.0, 13.0, 15.0])
    level = 10.0
    for v in (12.0, 14.0, 13.0, 15.0):
        level = 0.3 * v + 0.7 * level
    assert values(series.forecast_ema(ema, ["idx"], "value", 5), "forecast", "period") == pytest.approx([level] * 5)
    assert values(series.forecast_sma(ema, ["idx"], "value", 2, 3), "forecast", "period") == pytest.approx([14.0] * 2)
    assert series.forecast_sma(ema.limit(1), ["idx"], "value", 2).count() == 0


def test_trends(spark):
    up = frame(spark, idx=list(range(5)), value=[10.0, 12.0, 14.0, 16.0, 18.0])
    assert series.detect_trend(up, ["idx"], "value").first().direction == "up"
    assert series.detect_trend(up.withColumn("value", -F.col("value")), ["idx"], "value").first().direction == "down"
    assert series.detect_trend(up.limit(2), ["idx"], "value").first().direction == "flat"


def test_calendar_forecast_of_a_line(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    df = frame(spark, date=days, value=[2.0 * i for i in range(100)])
    ahead = values(series.forecast_calendar(df, "date", "value", 10), "forecast", "ts")
    assert len(ahead) == 10 and 199 <= ahead[0] <= 201 and 217 <= ahead[9] <= 219


def test_calendar_forecast_with_gaps(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(20) if i not in (5, 6, 7)]
    df = frame(spark, date=days, value=[float(i) for i in range(17)])
    filled = series.resample_fill(df, "date", "value")
    assert filled.count() == 20
    assert values(filled, "value", "ts")[4:9] == [4.0, 4.0, 4.0, 4.0, 5.0]
    assert series.forecast_calendar(df, "date", "value", 5).count() == 5
    for few in (df.limit(5), df.limit(0)):
        (row,) = series.forecast_calendar(few, "date", "value", 5).collect()
        assert row.forecast is None and row.reason == "fewer than 10 periods"


@pytest.mark.parametrize("freq,count,last", [("W", 3, "2023-01-22"), ("M", 1, "2023-01-31")])
def test_resample_labels(spark, freq, count, last):
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(20)]
    filled = series.resample_fill(frame(spark, date=days, value=[1.0] * 20), "date", "value", freq)
    assert filled.count() == count
    assert str(values(filled, "ts", "ts")[-1])[:10] == last


def region_sales(spark):
    return frame(spark, region=["US", "US", "EU", "EU", "APAC"], sales=[100, 120, 80, 90, 150], quantity=[10, 12, 8, 9, 15])


def test_segments(spark):
    done = segment.segment_profile(region_sales(spark), "region")
    us = done.where("segment = 'US' AND column_name = 'sales'").first()
    assert done.select("segment").distinct().count() == 3
    assert (us.row_count, us["mean"], us.median) == (2, 110.0, 110.0)
    new = frame(spark, region=["US", "US", "US", "EU"])
    drift = {r.segment: r for r in segment.segment_drift(region_sales(spark), new, "region").collect()}
    assert drift["US"].absolute_change == 35.0 and drift["APAC"].new_percentage == 0.0


def test_imputation(spark):
    df = frame(spark, k=[0, 1, 2, 3, 4], revenue=[100.0, None, 200.0, None, 150.0], category=["A", None, "A", None, "B"])
    assert values(clean.impute(df, "median"), "revenue", "k")[1] == 150.0
    assert values(clean.impute(df, "mean"), "revenue", "k")[1] == 150.0
    assert values(clean.impute(df, "median"), "category", "k") == ["A", "A", "A", "A", "B"]
    filled = clean.impute(df.withColumn("revenue", F.when(F.col("k") > 1, F.col("revenue"))), "ffill", ["revenue"], [], ["k"])
    assert values(filled, "revenue", "k") == [200.0, 200.0, 200.0, 200.0, 150.0]


def test_outliers(spark):
    df = frame(spark, value=[100.0, 110.0, 105.0, 1000.0, 95.0, -500.0, 108.0])
    capped, removed = clean.treat_outliers(df, "cap", ["value"], 2.0), clean.treat_outliers(df, "remove", ["value"], 2.0)
    assert capped.treated > 0 and capped.df.count() == 7
    assert removed.treated > 0 and removed.df.count() < 7
    assert clean.treat_outliers(frame(spark, constant=[5] * 10), "cap").treated == 0
    cut = clean.winsorize(spark.range(1, 101).select(F.col("id").alias("value")), ["value"]).df
    assert cut.agg(F.min("value"), F.max("value")).first() == (5, 95)


def test_quality_report(spark):
    df = frame(spark, a=[1.0, None, 3.0, None, 5.0], b=[None, 2.0, 3.0, None, 5.0])
    _, report = clean.fix_data_quality(df, "median", "none")
    row = report.first()
    assert (row.quality_score_before, row.quality_score_after, round(row.improvement, 6)) == (0.6, 1.0, 0.4)


def test_quality_rules(spark):
    dirty = frame(spark, id=[1, 2, 2, 4, 5], score=[10.0, None, 150.0, -10.0, 50.0], category=list("abcde"))
    rules = [profile.Check("unique", "id"), profile.Check("range", "score", low=0, high=100), profile.Check("null", "score", 0.1), profile.Check("null", "no")]
    rows = {(r.rule, r.column_name): r for r in profile.quality_checks(dirty, rules).collect()}
    assert rows["unique", "id"].failures == 1 and rows["range", "score"].failures == 2
    assert rows["null", "score"].failure_rate == pytest.approx(0.2) and not rows["null", "no"].passed
    assert profile.quality_summary(profile.quality_checks(dirty.limit(0))).first().is_valid
    with pytest.raises(TypeError):
        profile.quality_checks(dirty, ["null"])


def test_samples(spark):
    df = spark.range(5000).withColumn("s", F.col("id") % 3)
    for drawn in (sample.random_sample(df, 200, ["id"], 1), sample.reservoir_sample(df.repartition(9), 200, ["id"], 1)):
        assert drawn.count() == 200 and drawn.join(df, "id", "left_anti").count() == 0
    one = {r.id for r in sample.random_sample(df.repartition(1), 50, ["id"], 1).collect()}
    assert one == {r.id for r in sample.random_sample(df.repartition(7), 50, ["id"], 1).collect()}
    assert sample.stratified_sample(df, 300, "s", ["id"]).groupBy("s").count().where("count = 100").count() == 3
    assert sample.systematic_sample(df, 100, ["id"], 3).count() == 100
    assert sample.sample_size(1_000_000) == 1066 and sample.sample_size(50) == 50
    wide = spark.range(60_000).withColumn("s", F.col("id") % 3)
    hashed = wide.withColumn("h", sample.seeded(["id"], 4)).orderBy("h", "id")
    for n in (5_000, 50_000):
        many = sample.bottom_n(wide, n, ["id"], 4)
        assert {r.id for r in many.collect()} == {r.id for r in hashed.limit(n).collect()}
    assert sample.stratified_sample(wide, 6_000, "s", ["id"]).distinct().count() == 6_000


def test_sample_when_the_hash_cut_is_short(spark, monkeypatch):
    """The exact way takes over when the rows below the cut are too few."""
    wide = spark.range(20_000).withColumn("s", F.col("id") % 2)
    want = {r.id for r in sample.bottom_n(wide, 3_000, ["id"], 4).collect()}
    drawn = {r.id for r in sample.stratified_sample(wide, 3_000, "s", ["id"], 4).collect()}
    monkeypatch.setattr(sample, "_margin", lambda n: -n / 2)
    assert {r.id for r in sample.bottom_n(wide, 3_000, ["id"], 4).collect()} == want
    assert {r.id for r in sample.stratified_sample(wide, 3_000, "s", ["id"], 4).collect()} == drawn


def test_md5_bucket(spark):
    import hashlib

    df = spark.range(50)
    for row in df.select("id", sample.md5_bucket("id").alias("b")).collect():
        assert row.b == int(hashlib.md5(str(row.id).encode()).hexdigest(), 16) % 10_000


def test_p_values():
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)


def test_tests_refuse_bad_input(spark):
    df = frame(spark, val=[1.0, 2.0, 3.0], group=["A", "B", "C"])
    with pytest.raises(ValueError):
        stats.t_test(df, "group", "val")
    with pytest.raises(Exception):
        stats.anova(df.where("group = 'A'"), "val", "group").collect()
    with pytest.raises(ValueError):
        stats.market_share(df, df.limit(0), "val")


def test_kendall_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 9, 150)
    got = stats.correlation(frame(spark, x=x, y=y), ["x", "y"], "kendall").first().r
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert got == pytest.approx((sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum()))


def test_spearman(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.integers(0, 20, 300), "y": rng.normal(size=300)})
    assert stats.correlation(spark.createDataFrame(pdf), ["x", "y"], "spearman").first().r == pytest.approx(
        pdf.x.rank().corr(pdf.y.rank())
    )


def test_gamma_fit(spark):
    draws = np.random.default_rng(1).gamma(3.0, 1 / 2.0, 20_000)
    fit = {r.parameter: r.value for r in stats.fit_distribution(frame(spark, v=draws), "v", "gamma").collect()}
    assert fit["shape"] == pytest.approx(3.0, rel=0.05) and fit["rate"] == pytest.approx(2.0, rel=0.05)


def test_lognormal_fit_leaves_no_row_out(spark):
    def fit(*values):
        found = stats.fit_distribution(spark.createDataFrame([(v,) for v in values], "v double"), "v", "lognormal").collect()
        return {r.parameter: r.value for r in found}

    assert fit(1.0, math.e**2, None) == {"meanlog": pytest.approx(1.0), "sdlog": pytest.approx(1.0)}
    with_zero = fit(0.0, 1.0, 2.0)
    assert with_zero["meanlog"] == -math.inf and math.isnan(with_zero["sdlog"])
    assert math.isnan(fit(-1.0, 1.0, 2.0)["meanlog"])


def test_clusters_and_models(spark):
    blobs = frame(spark, x=[1.0, 1.5, 0.8, 10.0, 10.5, 9.8], y=[1.0, 1.2, 0.9, 10.0, 9.9, 10.2])
    fit = ml.kmeans(blobs, ["x", "y"], 2)
    assert fit.silhouette > 0.5 and fit.rows.groupBy("cluster").count().where("count = 3").count() == 2
    line = frame(spark, x=[float(i) for i in range(10)], y=[2.0 * i + 1 for i in range(10)])
    row = ml.train_regression(line, "y", ["x"]).first()
    assert row.coefficient == pytest.approx(2) and row.intercept == pytest.approx(1) and row.fit == "excellent"
    steps = line.select("x", (F.col("x") > 5).cast("int").alias("target"))
    model = ml.train_classifier(steps, "target", ["x", "target"], trees=20)
    assert model.accuracy >= 0.8 and model.classes == ["0", "1"]


def test_text_vectors(spark):
    docs = frame(spark, id=[0, 1, 2], text=["the quick brown fox", "a quick brown fox jumps", "pizza with cheese"])
    vectors = text.embed_chars(docs, "text", 32).select("id", "embedding")
    assert vectors.where(F.size("embedding") == 32).count() == 3
    found = {r.id: r.score for r in text.top_k_similar(vectors.where("id = 0"), vectors, 3, "id", "embedding", "id", "embedding").collect()}
    assert found[0] == pytest.approx(1.0) and found[1] > found[2]
    hits = text.semantic_search(docs, "id", "text", "quick fox", 3).collect()
    assert {h.id for h in hits} == {0, 1}
    assert text.tokenize(docs, "text").where("id = 2").first().tokens == ["pizza", "with", "cheese"]


def test_search_in_blocks(spark):
    rng = np.random.default_rng(2)
    data = frame(spark, id=list(range(60)), v=[list(map(float, row)) for row in rng.normal(size=(60, 8))])
    whole = text.top_k_similar(data, data, 4, "id", "v", "id", "v").orderBy("query_id", "rank").collect()
    cut = text.top_k_similar(data, data.repartition(5), 4, "id", "v", "id", "v", query_block=25, corpus_block=30)
    assert cut.orderBy("query_id", "rank").collect() == whole
    rare = frame(spark, id=list(range(200)), text=[f"common word{i % 97}" for i in range(198)] + ["common zebra", "a zebra"])
    assert {r.id for r in text.semantic_search(rare, "id", "text", "zebra", None).collect()} == {198, 199}


def test_top_variance(spark):
    df = frame(spark, id=[0, 1, 2], v=[[0.1, 0.2, 0.3, 0.4], [0.2, 0.9, 0.3, 0.5], [0.3, 0.1, 0.3, 0.6]])
    assert text.top_variance_dims(df, "id", "v", 2).orderBy("id").first().v == [0.2, 0.1]


COMPANIES = """<html><head><title>Empresas Ecuador</title></head><body><h1>Lista</h1>
<div class="company" data-ruc="1234567890001"><h2 class="name">Acme S.A.</h2><p class="address">Quito, Ecuador</p><span class="status active">Activo</span></div>
<div class="company" data-ruc="0987654321001"><h2 class="name">TechStart Cia. Ltda.</h2><p class="address">Guayaquil</p></div></body></html>"""


def test_fields_of_a_page(spark):
    rules = {
        "title": "title::text",
        "names": ".name",
        "codes": "div.company::attr(data-ruc)",
        "paths": "//h2",
        "items": {"root": ".company", "fields": {"name": ".name::text", "status": ".status::text"}},
    }
    row = pages.extract_fields(frame(spark, id=[1], html=[COMPANIES]), "id", "html", rules).first()
    assert row.title == ["Empresas Ecuador"] and row.names == row.paths == ["Acme S.A.", "TechStart Cia. Ltda."]
    assert row.codes == ["1234567890001", "0987654321001"]
    assert row["items"] == [{"name": "Acme S.A.", "status": "Activo"}, {"name": "TechStart Cia. Ltda.", "status": None}]
    with pytest.raises(ValueError):
        pages.parse_selector("a > b:hover")


def test_unknown_specs_are_named_and_stop_nothing(spark):
    good = '{"openapi": "3.0", "info": {"title": "t"}, "paths": {"/a": {"get": {}}}}'
    specs = frame(spark, id=[1, 2, 3, 4, 5, 6], spec=['{"raml": 1}', "not { json", None, good, "[1]", '{"swagger": "2.0"}'])
    assert [(r.id, r.path, r.method) for r in pages.spec_endpoints(specs, "id", "spec").collect()] == [(4, "/a", "GET")]
    errors = {r.id: r.error for r in pages.spec_errors(specs, "id", "spec").collect()}
    assert errors == {1: "unknown API description format", 2: "no JSON object", 3: "no text", 5: "no JSON object", 6: "no paths"}


def test_contract(spark):
    df = spark.createDataFrame([(1, 2.0)], "id bigint, amount double")
    contract = contracts.Contract("orders", (contracts.ColumnSpec("id", "integer", nullable=False), contracts.ColumnSpec("amount", "float")))
    assert contracts.validate_schema(df, contract).count() == 0
    assert contract.json_schema()["required"] == ["id"]
    assert contract.read_schema().simpleString() == "struct<id:bigint,amount:double>"


def test_activation(spark):
    store = spark.createDataFrame(
        [("t", "s", "k", "1.0.0", "active"), ("t", "s", "k", "1.0.1", "draft")], "tenant_id string, source_id string, baseline_type string, version string, status string"
    )
    after = {r.version: r.status for r in contracts.baseline_activate(store, "t", "s", "k", "1.0.1").collect()}
    assert after == {"1.0.0": "deprecated", "1.0.1": "active"}
    same = {r.version: r.status for r in contracts.baseline_activate(store, "t", "s", "k", "9.9.9").collect()}
    assert same == {"1.0.0": "active", "1.0.1": "draft"}


def test_lineage_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    assert {r.node_id: r.depth for r in lineage.lineage_downstream(edges, "a", -1).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.node_id for r in lineage.lineage_upstream(edges, "d", 2).collect()} == {"c", "b"}
    nodes, links = lineage.record_job_lineage(spark, "job", ["t1", "t2"], ["art"], "x")
    assert nodes.count() == 4 and lineage.lineage_downstream(links, "t1", -1).count() == 2


def test_personal_data(spark):
    rows = spark.createDataFrame(
        [("note", "fine"), ("E-mail", "x"), ("note", "mail a.b@example.com"), ("note", "call +593 99 123 4567"), ("note", "12345")], "k string, v string"
    )
    assert [r.v for r in privacy.drop_personal(rows, "k", "v").orderBy("v").collect()] == ["12345", "fine"]


@pytest.mark.parametrize("text_", ["SELECT 1", " with x as (select 1) select * from x", "SHOW TABLES", "EXPLAIN SELECT 1", "SELECT 'drop it' AS a", "SELECT 1 -- delete from"])
def test_guard_lets_reads_pass(text_):
    sql.check_sql(text_)


@pytest.mark.parametrize("text_", ["DROP TABLE x", "INSERT INTO x VALUES (1)", "SELECT 1; DROP TABLE x", "SELECT 1; delete from x", "CREATE TABLE x (a int)", "", "with x as (select 1) update t set a = 1", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect`('a', 'b')", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM `csv`.`file:/tmp/x`", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "DESCRIBEX t"])
def test_guard_stops_writes(text_):
    with pytest.raises(sql.RejectedSql):
        sql.check_sql(text_)


def test_row_cap(spark):
    spark.range(30_000).createOrReplaceTempView("many")
    assert sql.guarded_sql(spark, "SELECT * FROM many LIMIT 20000").count() == 20_000
    assert sql.guarded_sql(spark, "SELECT * FROM many", 10).count() == 10
    kpis = sql.run_kpis(spark, [{"name": "all", "sql": "SELECT * FROM many"}])
    assert [(r.row_count, r.truncated) for r in sql.kpi_summary(kpis, limit=1000).collect()] == [(30_000, True)]
    assert sql.is_truncated(spark, "SELECT * FROM many", 100) and not sql.is_truncated(spark, "SELECT * FROM many LIMIT 5", 100)
    with pytest.raises(ValueError):
        sql.run_kpis(spark, [{"name": "x"}])


def test_guard_knows_a_command_by_its_plan(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    with pytest.raises(sql.RejectedSql):
        sql.guarded_sql(spark, "WITH x AS (SELECT 1 AS id) MERGE INTO three_rows USING x ON three_rows.id = x.id WHEN MATCHED THEN UPDATE SET id = 2")
    assert sql.guarded_sql(spark, "SELECT 'parquet./tmp' AS text, id FROM three_rows").count() == 3


def test_kpi_registry(spark):
    assert len(kpi.KPIS) == 15 and {k.category for k in kpi.list_kpis()} == {"customer", "financial", "operations", "quality", "timeseries"}
    with pytest.raises(ValueError, match="amount"):
        kpi.KPIS["revenue_by_segment"].render(region_sales(spark), segment="region")
    done = kpi.KPIS["revenue_by_segment"].render(region_sales(spark), segment="region", amount="sales")
    assert set(done.columns) == set(kpi.KPIS["revenue_by_segment"].outputs)


def test_small_customer_table_has_only_the_top(spark):
    df = frame(spark, c=list(range(25)), amount=[float(i) for i in range(25)])
    tiers = {r.customer_tier: r.customer_count for r in kpi.customer_revenue_distribution(df, "c", "amount").collect()}
    assert tiers == {"Top 10": 10, "Top 11-50": 15}


def test_core_analyzer_stops(spark):
    known = flow.Registry()
    known.register("bad", core=True)(lambda df, ctx: df.select("nope"))
    spark.range(3).createOrReplaceTempView("three")
    with pytest.raises(RuntimeError):
        flow.analyze(spark, "three", profile=False, registry=known)


def test_many_periods_and_rows_after_the_present(spark):
    now = dt.datetime(2024, 1, 2)
    points = spark.range(500).select((F.col("id") % 5).alias("sli"), F.timestamp_seconds(1704067200 + F.col("id") * 170).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3 != 0).cast("int").alias("good"))
    slos = spark.range(6).select(F.concat(F.lit("s"), "id").alias("slo"), F.col("id").alias("sli"), F.lit(0.9).alias("target"), (F.col("id") + 1).alias("window_hours"))
    log = points.select(F.col("sli").alias("tenant_id"), F.lit("r").alias("resource"), "ts", F.col("good").cast("double").alias("amount"))
    limits = spark.range(6).select(F.col("id").alias("tenant_id"), F.lit("r").alias("resource"), F.lit(9.0).alias("limit"), (F.col("id") * 3600).alias("period_seconds"))
    rows = [(i % 5, 1704067200 + i * 170, int(i % 3 != 0)) for i in range(500)]
    end = 1704153600
    got = {r.slo: r for r in logs.slo_status(points, slos, now).collect()}
    used = {r.tenant_id: r.current_usage for r in logs.quota_usage(log, limits, now).collect()}
    for k in range(6):
        good = [g for s, t, g in rows if s == k and 0 <= end - t <= (k + 1) * 3600]
        assert (got[f"s{k}"].data_points, got[f"s{k}"].current_value) == (len(good), sum(good) / len(good) if good else 1.0)
        assert used[k] == sum(g for s, t, g in rows if s == k and 0 <= end - t <= (k * 3600 or 300))
    later = points.select("sli", (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), "good")
    assert {r.slo: r.data_points for r in logs.slo_status(points.union(later), slos, now).collect()} == {k: r.data_points for k, r in got.items()}


def test_many_segments_are_kept_or_pooled(spark):
    df = frame(spark, s=[i % 150 for i in range(600)], x=[float(i) for i in range(600)], t=["v"] * 600)
    assert segment.segment_profile(df, "s", ["x"]).count() == 150
    pooled = {r.segment: r for r in segment.segment_profile(df, "s", ["x"], max_segments=100).collect()}
    assert len(pooled) == 101 and pooled["other"].row_count == 200 and sum(r.row_count for r in pooled.values()) == 600
    assert segment.segment_categories(df, "s", ["t"]).count() == 150


def test_bars_sum_to_the_whole(spark):
    df = frame(spark, k=[None] + [f"k{i}" for i in range(70)], y=[1.0] + [float(i) for i in range(70)])
    bars = flow.bar_chart(df, "k", "y", limit=10).collect()
    assert len(bars) == 11 and bars[-1].x == "other" and sum(b.y for b in bars) == 1 + sum(range(70))


def test_redaction_reaches_every_depth(spark):
    row = spark.sql(
        "SELECT map('password', 1, 'n', 2) AS m, array(named_struct('password', 'x', 'ok', 'y')) AS a,"
        " map('k', array(map('token', 'x', 'z', 'y'))) AS deep, map(1, named_struct('secret', 's')) AS by_number"
    )
    got = privacy.redact(row).first()
    assert got.m == {"password": None, "n": 2}
    assert got.a[0].password == privacy.REDACTED and got.a[0].ok == "y"
    assert got.deep == {"k": [{"token": privacy.REDACTED, "z": "y"}]} and got.by_number[1].secret == privacy.REDACTED


def test_incremental_load_is_idempotent_with_null_keys(spark, tmp_path):
    source = spark.createDataFrame([(None, "b", 2), (None, "a", 1), (1, "c", 3)], "k long, v string, n int")
    loads = [io.ingest_table(source, str(tmp_path / "t"), "incremental", ["k"], order=["n"]).first().rows_ingested for _ in range(3)]
    assert loads == [2, 0, 0]
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(None, "a"), (1, "c")}


def test_contract_types_are_compared_as_types(spark):
    spec = lambda kind: contracts.Contract("c", (contracts.ColumnSpec("x", kind),))
    level = lambda kind, text: [r.code for r in contracts.validate_schema(spark.sql(f"SELECT CAST(NULL AS {text}) AS x"), spec(kind)).collect()]
    assert level("object", "map<string,string>") == level("object", "struct<a:int>") == level("array", "array<string>") == []
    assert level("string", "array<string>") == level("integer", "array<int>") == level("date", "timestamp") == ["type_mismatch"]
    for kind in contracts.READ_AS:
        own = spec(kind)
        assert contracts.validate_schema(spark.createDataFrame([], own.read_schema()), own).count() == 0


def test_any_confidence():
    assert z_of(0.95) == 1.96 and abs(z_of(0.8) - 1.2816) < 1e-4
    with pytest.raises(ValueError, match="confidence"):
        z_of(1.0)


def test_mode_keeps_whole_numbers(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1.5), (big, 1.5), (None, None), (3, 2.0)], "n long, x double")
    got = clean.impute(df, "mode")
    assert got.dtypes == df.dtypes
    assert sorted(tuple(r) for r in got.collect()) == [(3, 2.0), (big, 1.5), (big, 1.5), (big, 1.5)]


def test_walks_end_where_the_trees_do():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    x[5] = np.nan
    trees = [anomaly._grow(rng.normal(size=(64, 2)), rng) for _ in range(7)]

    def plain(tree, row):
        feature, split, low, high, depth = tree
        at = 0
        while feature[at] >= 0:
            at = low[at] if row[feature[at]] < split[at] else high[at]
        return depth[at]

    got = anomaly._mean_depth([anomaly._walkable(t) for t in trees], x)
    assert got == pytest.approx([np.mean([plain(t, row) for t in trees]) for row in x], abs=1e-12)
