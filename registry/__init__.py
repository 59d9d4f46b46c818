"""Registered queries: each runs an operator over whole test tables; most have an oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.freeze import shared_folder
from millrace.functions.numbers import round_to

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/run-{uuid4().hex}"


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round the double columns, so that the order of summation does not show."""
    return df.select(
        *[
            round_to(c, special.get(c, digits)).alias(c) if kind in ("double", "float") else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def load_all() -> None:
    from registry import anomalies, governance, kpis, oplogs, quality, segments, series, statistics, surface, texts  # noqa: F401
