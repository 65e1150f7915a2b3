"""Whitening of embeddings: principal axes of exactly centred rows, each scaled to unit variance.

Components become whole numbers, so sums and centring are exact. MLlib's RowMatrix adds up the Gramian of the centred rows
on the executors; its eigenvectors, a matrix of the vectors' length, are found on the driver and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, table
from .vectors import matrix, shape, sound, summed, whole_numbers

#: A component's whole number is floor(SCALE * component) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Axes whose variance is at most so much of the greatest have no spread but that of rounding.
FLAT = 1e-12


def _gramian(rows: DataFrame, column: str, length: int) -> np.ndarray:
    """Sum of the outer products of the vectors in ``column`` (arrays of double), added up on the executors."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, numCols=length).computeGramianMatrix().toArray()


def _axes(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest eigenvalues of ``v``, falling, and their unit eigenvectors as columns, the greatest entry of each positive."""
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    turn = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return np.maximum(value, 0), vector * turn


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each sound vector and leading component.

    Vectors that are null or hold null or non-finite components are left out; all others have to be of one length.
    ``deviation`` is decimal: the sum of (n * x - S) squared. An axis without spread has ``whitened`` 0 and takes no part in
    ``identity_error``; equal eigenvalues leave the choice of axes open. Repeated rows and null ids count as rows of their
    own; an empty table gives no row.
    """
    spark = df.sparkSession
    # ids travel as text: pandas would make floats of numbers among which is a null
    rows = table(df.where(sound(F.col(vector_col))).select(F.col(id_col).cast("string").alias("id"), whole_numbers(F.col(vector_col), SCALE, SHIFT).alias("x")), "whole")
    n, length, _ = shape(rows, "x")
    kind = df.schema[id_col].dataType.simpleString()
    if not n or not length:
        return spark.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    sums = summed(rows.select("x"), lambda b: matrix(b.column("x"), length).sum(0), length)
    # n * x - S as (x - S div n) * n - S mod n: whole numbers that stay small
    near, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (lambda s, n: s // n, lambda s, n: s % n))
    parts = F.array(*[F.struct(F.lit(int(q)).alias("q"), F.lit(int(r)).alias("r")) for q, r in zip(near, rest)])
    centred = F.zip_with("x", parts, lambda x, s: (x - s["q"]) * F.lit(n) - s["r"])
    v = _gramian(rows.select(F.transform(centred, lambda d: d.cast("double") / float(n)).alias("c")), "c", length) / n
    value, axes = _axes(v, components)
    flat = value <= FLAT * max(value[0], 1e-300)
    scale = np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, value)))
    shared = spark.sparkContext.broadcast((near, rest, axes * scale))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, rest, onto = shared.value
        for f in frames:
            if f.empty:
                continue
            d = (np.stack(f["x"].to_numpy()) - near) * n - rest
            # squares beyond a long are added up as Python's integers
            own = d.astype(object) if int(np.abs(d).max()) ** 2 * length >= 1 << 63 else d
            yield pd.DataFrame({"id": f["id"], "deviation": [str(s) for s in (own * own).sum(1)], "w": list(d / n @ onto)})

    bounded_batches(spark)
    made = table(rows.mapInPandas(project, "id string, deviation string, w array<double>"), "white")
    discard(rows)
    k = len(value)
    means = made.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first()
    steps = F.array(*[F.lit(float(m)) for m in means])
    cov = _gramian(made.select(F.zip_with("w", steps, lambda x, m: x - m).alias("c")), "c", k) / n
    error = np.abs(cov - np.eye(k))[np.ix_(~flat, ~flat)]
    explained = F.array(*[F.lit(float(e)) for e in value / max(np.trace(v), 1e-300)])
    long = made.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("id").cast(kind).alias("id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(error.max()) if error.size else 0.0).alias("identity_error"),
    )
