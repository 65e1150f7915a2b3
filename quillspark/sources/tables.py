"""Incremental table writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def not_done(rows: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``done``; rows with a null key count as new."""
    return rows if done is None else rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append rows with new keys to the table at ``path``, which is never overwritten, and return the table."""
    new = not_done(rows, read_or_none(rows.sparkSession, path), keys)
    new.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)
