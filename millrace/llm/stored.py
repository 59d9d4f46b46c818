"""Cutting lineage by written tables.

A checkpoint keeps the size that its plan was thought to have, and joins multiply sizes: in a long chain of
joins the number itself outgrows the driver. A table that is written and read again has its real size."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from millrace.functions.freeze import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
