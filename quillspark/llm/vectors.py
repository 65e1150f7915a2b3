"""Columns of vectors: which are sound, and their integer form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * component) + shift for each component, which is widened to double first."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)) + shift)


def shape(rows: DataFrame, vector_col: str) -> tuple[int, int, int]:
    """Number of rows, their common length, and the greatest magnitude of a component; raises where lengths differ."""
    size = F.size(vector_col)
    most = F.max(F.greatest(F.coalesce(F.array_max(vector_col), F.lit(0)), -F.coalesce(F.array_min(vector_col), F.lit(0))))
    n, least, greatest, top = rows.agg(F.count(F.lit(1)), F.min(size), F.max(size), most).first()
    if n and least != greatest:
        raise ValueError(f"vectors of {least} to {greatest} components")
    return n, greatest or 0, top or 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The rows of an Arrow column of lists of ``length`` numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], slots: int) -> np.ndarray:
    """Sum over all rows of an array of ``slots`` whole numbers that ``partial`` makes of a batch.

    Every partition adds up its own and passes on what is not zero; sums over partitions are Spark's. The driver gets one
    number a slot.
    """

    def add(batches):  # noqa: ANN001, ANN202
        total = np.zeros(slots, np.int64)
        for b in batches:
            if b.num_rows:
                total += partial(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])

    got = rows.mapInArrow(add, "slot int, value long").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = np.zeros(slots, object)
    for slot, value in got.collect():
        out[slot] = int(value)
    return out
