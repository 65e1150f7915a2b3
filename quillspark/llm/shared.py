"""Folders and tables that every executor can reach, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import discard, new_path, shared_dir
from ..sources.stage import staged as table

__all__ = ["Sample", "bounded_batches", "discard", "fresh", "least_of_each", "new_path", "numbers", "shared_dir", "slices", "table"]

#: Rows in an Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand at most ``rows`` rows at once to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever its columns are called; case does not tell names apart."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
        have.add(name.lower())
    return out


def least_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A row of each ``key``, one of those with the least ``order``. Keys have to be few: every partition holds a row of each.

    A partition passes on one row a key, so a key that very many rows have does not travel with all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        schema = None
        for b in batches:
            schema = b.schema
            for i, (k, o) in enumerate(zip(b.column(key).to_pylist(), b.column(order).to_pylist())):
                if k not in best or o < best[k][0]:
                    best[k] = o, b.slice(i, 1).to_pylist()[0]
        if best:
            yield pa.RecordBatch.from_pylist([row for _, row in best.values()], schema)

    one = rows.mapInArrow(run, rows.schema).groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("row"))
    return one.select(key, "row.*").select(*rows.columns)


#: Characters of a sample in one of its files, which is what the driver reads at once.
FILE_CHARS = 16 << 20


class Sample:
    """A bounded table of rows that the driver reads again and again, a file at a time; whole texts, however long."""

    def __init__(self, rows: DataFrame, text: str, place: str) -> None:
        held = table(rows, "picked")
        self.size, chars = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
        files = 1 + chars // FILE_CHARS
        self.rows = table(held.repartitionByRange(files, place).sortWithinPartitions(place), "sample")
        discard(held)

    def __iter__(self):  # noqa: ANN204
        return iter(self.rows.toLocalIterator())

    def discard(self) -> None:
        discard(self.rows)
