"""Incremental runs over a growing folder of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.tables import append_new


def run_available(spark: SparkSession, folder: str, schema: StructType, step: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], checkpoint: str) -> None:
    """Apply ``step`` to files that arrived since the last run and append rows with new keys to ``path``.

    A batch that is run again adds nothing, as its keys are there already.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda df, _: append_new(step(df), path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
