"""Clustering, classification and regression on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze
from millrace.operators.clean import numeric_columns


def _numeric(df: DataFrame, features: Sequence[str]) -> list[str]:
    known = [c for c in features if c in numeric_columns(df)]
    if not known:
        raise ValueError("no numeric features")
    return known


def _imputed(df: DataFrame, features: list[str]) -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in features})
    return Imputer(strategy="mean", inputCols=features, outputCols=features).fit(doubles).transform(doubles)


@dataclass(frozen=True)
class Clusters:
    rows: DataFrame
    centers: DataFrame
    silhouette: float


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, seed: int = 42) -> Clusters:
    """k-means on standardized features: rows with their cluster, centres in the original scale, and
    the silhouette (-1 unless there are more rows than clusters)."""
    features = _numeric(df, features)
    plain = df.withColumns({c: F.col(c).cast("double") for c in features}).dropna(subset=features)
    assembled = VectorAssembler(inputCols=features, outputCol="_raw").transform(plain)
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled)
    model = KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster", maxIter=50).fit(scaled)
    labelled = model.transform(scaled)
    silhouette = -1.0
    if labelled.limit(k + 1).count() > k and model.summary.k > 1:
        evaluator = ClusteringEvaluator(featuresCol="_scaled", predictionCol="cluster")
        silhouette = float(evaluator.evaluate(labelled))
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    centers = [(i, *[float(v) for v in c * std + mean]) for i, c in enumerate(model.clusterCenters())]
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in features)
    return Clusters(labelled.drop("_raw", "_scaled"), df.sparkSession.createDataFrame(centers, schema), silhouette)


def segment_customers(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """Size, share in percent and mean features of each cluster."""
    clusters = kmeans(df, features, k)
    total = clusters.rows.select(F.count(F.lit(1))).scalar()
    return (
        clusters.rows.groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in features])
        .withColumn("pct", F.col("size") * 100 / total)
    )


@dataclass(frozen=True)
class Classifier:
    predictions: DataFrame
    importances: DataFrame
    accuracy: float
    classes: list[str]


@contextmanager
def plain_projections(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside generate no code for whole stages. Models convert rows by functions that stage code has
    to send along with itself, which late in a long session cannot always be serialized."""
    before = spark.conf.get(_STAGE_CODE)
    spark.conf.set(_STAGE_CODE, "false")
    try:
        yield
    finally:
        spark.conf.set(_STAGE_CODE, before)


_STAGE_CODE = "spark.sql.codegen.wholeStage"


def train_classifier(
    df: DataFrame, target: str, features: Sequence[str], trees: int = 100, seed: int = 42
) -> Classifier:
    """Random forest on the numeric features (means for missing values), scored on its own rows."""
    features = [c for c in _numeric(df, features) if c != target]
    ready = _imputed(df.where(F.col(target).isNotNull()), features).withColumn("_target", F.col(target).cast("string"))
    forest = RandomForestClassifier(
        labelCol="_label", featuresCol="_features", predictionCol="_predicted", numTrees=trees, seed=seed
    )
    with plain_projections(df.sparkSession):
        indexer = StringIndexer(inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc").fit(ready)
        assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(indexer.transform(ready))
        model = forest.fit(assembled)
        classes = list(indexer.labels)
        names = F.array(*[F.lit(c) for c in classes])
        probability = F.array_max(vector_to_array("probability")).alias("_sure")
        scored = freeze(model.transform(assembled).select(*df.columns, "_label", "_predicted", probability))
    predictions = scored.select(*df.columns, F.get(names, F.col("_predicted").cast("int")).alias("predicted"), F.col("_sure").alias("probability"))
    accuracy = scored.agg(F.avg((F.col("_predicted") == F.col("_label")).cast("double"))).first()[0]
    weights = list(zip(features, [float(w) for w in model.featureImportances.toArray()], strict=True))
    importances = df.sparkSession.createDataFrame(weights, "feature string, importance double")
    return Classifier(predictions, importances, float(accuracy), classes)


def train_regression(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Least squares with an intercept; one row per feature plus the fit on every row."""
    features = [c for c in _numeric(df, features) if c != target]
    ready = _imputed(df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double")), features)
    assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(ready)
    model = LinearRegression(
        featuresCol="_features", labelCol=target, solver="normal", regParam=0.0, standardization=False
    ).fit(assembled)
    summary = model.summary
    weights = [float(w) for w in model.coefficients]
    r2 = float(summary.r2)
    grade = "excellent" if r2 >= 0.9 else "good" if r2 >= 0.7 else "moderate" if r2 >= 0.5 else "poor"
    terms = " ".join(f"{'+' if w >= 0 else '-'} {abs(w):.4f}*{c}" for c, w in zip(features, weights, strict=True))
    equation = f"{target} = {model.intercept:.4f} {terms}"
    rows = [
        (c, w, abs(w), float(model.intercept), r2, float(summary.rootMeanSquaredError), int(summary.numInstances), grade, equation)
        for c, w in zip(features, weights, strict=True)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "feature string, coefficient double, importance double, intercept double, r_squared double, rmse double,"
        " n long, fit string, equation string",
    )


def simple_regression(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Least squares on one feature, in one aggregation."""
    y, x = F.col(target).cast("double"), F.col(feature).cast("double")
    return df.agg(
        F.regr_slope(y, x).alias("coefficient"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
        F.regr_count(y, x).alias("n"),
    )
