"""Summaries that are stored for each increment of a table and merged later: distinct counts and quantiles, approximate by choice.

The exact statistics are in ``stats``; these are for tables whose increments are summarised once and never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count (2 to this power) and size of a quantile summary. Relative error of a count some
#: 1.04 / sqrt(registers); of a rank some 1.7 / size.
REGISTERS, SIZE = 14, 400


def summarise(rows: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """(by..., n, distinct_<c>, quantiles_<c>): a summary row for each group; nulls count in n alone."""
    counts = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)).alias(f"distinct_{c}") for c in distinct]
    ranks = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SIZE)).alias(f"quantiles_{c}") for c in numeric]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts, *ranks)


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One summary for each group of ``by`` from those of any number of increments."""
    columns = [c for c in parts.columns if c.startswith(("distinct_", "quantiles_"))]
    both = [(F.hll_union_agg(c) if c.startswith("distinct_") else F.kll_merge_agg_double(c)).alias(c) for c in columns]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *both)


def estimates(summaries: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``summaries`` with their numbers: distinct_<c> counts and quantiles_<c>, an array for ``shares``."""
    new = {}
    for c in summaries.columns:
        if c.startswith("distinct_"):
            new[c] = F.hll_sketch_estimate(c)
        elif c.startswith("quantiles_"):
            new[c] = F.when(F.kll_sketch_get_n_double(c) > 0, F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(float(q))) for q in shares]))
    return summaries.withColumns(new)
