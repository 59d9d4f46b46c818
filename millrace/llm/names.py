"""Names of helper columns that no column of the user bears."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *tables: DataFrame) -> str:
    """``_name``, with as many further underscores as it takes to differ from all columns, in whatever case."""
    taken = {c.lower() for table in tables for c in table.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name
