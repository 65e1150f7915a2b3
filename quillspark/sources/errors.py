"""Rows that cannot be processed: they go to a side table with what is wrong with them, the rest goes on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divided(rows: DataFrame, faults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and those that have one, with the name of the first in ``error``; an unknown condition is a fault."""
    first = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in faults.items()])
    marked = rows.withColumn("error", first)
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())


def missing(columns: Sequence[str]) -> dict[str, Column]:
    """Faults of rows in which a column is null."""
    return {f"no {c}": F.col(c).isNull() for c in columns}
