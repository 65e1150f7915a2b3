"""Event-time streams: duplicates removed by state, and tumbling, sliding and session windows, with what comes too late.

State is bounded by the watermark: a key is remembered, and a window stays open, until the greatest time seen is ``delay`` beyond
it. Rows older than that are late and are dropped; ``run`` says how many. Results are committed by batch number, so a batch that is
run again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import commits


def distinct_events(rows: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; in a stream a key that comes again later than ``delay`` after its first counts as new.

    In a batch one row of each key is kept.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def windowed(rows: DataFrame, by: Sequence[str], time: str, window: Column, aggregates: Sequence[Column], delay: str) -> DataFrame:
    """(by..., start, end, aggregates...) for every window that has rows; rows without a time take no part.

    ``window``: tumbling, sliding or session, as ``tumbling`` and its kin make them. In a stream a window comes once, when it is closed.
    """
    own = rows.where(F.col(time).isNotNull())
    own = own.withWatermark(time, delay) if rows.isStreaming else own
    out = own.groupBy(*by, window.alias("_w")).agg(*aggregates)
    return out.select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c not in (*by, "_w")])


def tumbling(time: str, length: str) -> Column:
    return F.window(time, length)


def sliding(time: str, length: str, every: str) -> Column:
    return F.window(time, length, every)


def session(time: str, gap: str) -> Column:
    """Rows of a key that follow each other within ``gap``; a session ends ``gap`` after its last row."""
    return F.session_window(time, gap)


def run(spark: SparkSession, folder: str, schema: StructType, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, files: int = 1) -> int:
    """Apply the stateful ``step`` to files of ``folder`` that arrived since the last run, ``files`` to a batch, and commit its rows to ``path``.

    Returns how many rows came too late. State, and windows that are still open, stay in ``checkpoint`` for the next run.
    """
    def commit(df: DataFrame, batch: int) -> None:
        commits.append(df, path, batch=f"{checkpoint}#{batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    running = step(stream).writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in running.recentProgress for s in p.stateOperators)
