"""Cross-sectional statistics by group: order statistics, ranks, buckets, z-scores, winsorising, rank correlation.

Values are first counted by (group, value), which combines on the map side. Distinct values are then put in order over the
whole table by range partitions, whose bounds Spark takes from a sample, so tasks are alike however narrow the values lie
and however few groups there are. Each partition counts what precedes a value in it; the partitions' totals by
group give what precedes the partition. Null groups and null values take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import scope, staged

#: Rows of offsets (one for every group, and for every further partition that a group reaches into) that are broadcast at most.
BROADCAST_OFFSETS = 500_000


def _running(group: str):  # noqa: ANN202
    """From a partition sorted by (group, value): its number, and how many rows of the group precede each value in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0  # the group of the last row, and its rows so far
        for b in batches:
            if not b.num_rows:
                continue
            g, n = b.column(group), b.column("n").to_numpy()
            new = np.concatenate([[g[0] != last], pc.not_equal(g.slice(1), g.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)]).astype(bool)
            total = np.cumsum(n)
            first = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            carried = np.where(first < 0, before, -(total - n)[np.maximum(first, 0)])
            upto = total + carried
            last, before = g[-1], int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - n)], [*b.schema.names, "_inside"])

    return run


def value_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, below, m): how many rows have the value, how many a lesser one, and how many there are."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    # NaN comes last in Spark's order; zeros of either sign are one group already
    ranges = counts.repartitionByRange(group, value).sortWithinPartitions(group, value).withColumn("_part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema)
    placed = staged(ranges.mapInArrow(_running(group), kinds + ", _inside long"), "ranges")
    totals = placed.groupBy(group, "_part").agg(F.sum("n").alias("_n"))
    of_group = Window.partitionBy(group)
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = staged(totals.select(F.col(group).alias("_og"), F.col("_part").alias("_op"), before.alias("_before"), F.sum("_n").over(of_group).alias("m")), "offsets")
    small = offsets.count() <= BROADCAST_OFFSETS
    ranked = placed.join(F.broadcast(offsets) if small else offsets, (F.col(group) == F.col("_og")) & (F.col("_part") == F.col("_op")))
    return ranked.select(group, value, "n", (F.col("_before") + F.col("_inside")).alias("below"), "m")


def average_ranks(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``df`` with the rank of each value in its group, ties sharing their mean; null where group or value is."""
    ranks = value_ranks(df, group, value).select(F.col(group).alias("_g"), F.col(value).alias("_v"), (F.col("below") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, (F.col(group) == F.col("_g")) & (F.col(value) == F.col("_v")), "left").drop("_g", "_v")


def quantiles(ranks: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, m, edges): the linear quantiles of every group of ``value_ranks``, interpolated as numpy does."""
    out = []
    for k, q in enumerate(shares):
        pos = (F.col("m") - 1) * F.lit(float(q))
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("m") - 1)
        at = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col(value)))
        out += [at(lo).alias(f"lo{k}"), at(hi).alias(f"hi{k}"), F.max(pos - lo).alias(f"t{k}")]
    rows = ranks.groupBy(group).agg(F.max("m").alias("m"), *out)
    lerp = lambda a, b, t: F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)
    edges = [lerp(F.col(f"lo{k}"), F.col(f"hi{k}"), F.col(f"t{k}")).alias(f"e{k}") for k in range(len(shares))]
    return rows.select(group, "m", F.array(*edges).alias("edges"))


def buckets(df: DataFrame, group: str, value: str, n: int, row_id: Sequence[str], out: str) -> DataFrame:
    """``df`` with quantile buckets 1..n of each group.

    Right-closed at the group's quantiles; where those are not all distinct, equal widths of the rank in order of value
    and ``row_id``. Null values and groups get null. Only tied values of groups without distinct quantiles need an order of
    rows: their rows are counted by the first of ``row_id`` before they are put in order.
    """
    ranks = value_ranks(df, group, value)
    edges = quantiles(ranks, group, value, [float(q) for q in np.linspace(0, 1, n + 1) * 100 / 100]).withColumn("distinct", F.size(F.array_distinct("edges")) == n + 1)
    edges = edges.select(F.col(group).alias("_g"), F.col("edges").alias("_edges"), F.col("distinct").alias("_distinct"))
    below = ranks.select(F.col(group).alias("_rg"), F.col(value).alias("_rv"), F.col("below").alias("_below"), F.col("m").alias("_m"))
    x, lead = F.col(value), row_id[0]
    joined = df.join(edges, F.col(group) == F.col("_g"), "left")
    tied = F.coalesce(~F.col("_distinct"), F.lit(False)) & x.isNotNull()
    by_edge = F.lit(1) + sum(((x > F.get("_edges", F.lit(k))).cast("int") for k in range(1, n)), F.lit(0))
    plain = joined.where(~tied).withColumn(out, F.when(x.isNotNull() & F.col("_g").isNotNull(), by_edge).cast("int"))
    rows = joined.where(tied).join(below, (F.col(group) == F.col("_rg")) & (x == F.col("_rv")))
    leads = rows.groupBy(F.col("_rg").alias("_lg"), F.col("_rv").alias("_lv"), F.col(lead).alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_lg", "_lv").orderBy("_lead").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    leads = leads.select("_lg", "_lv", "_lead", before.alias("_before"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_rg", "_rv", lead).orderBy(*row_id)))
    rows = rows.join(leads, (F.col("_rg") == F.col("_lg")) & (F.col("_rv") == F.col("_lv")) & F.col(lead).eqNullSafe(F.col("_lead")))
    rank = F.col("_below") + F.col("_before") + F.col("_turn")
    by_rank = F.greatest(F.lit(1), F.ceil((rank - 1) * n / F.nullif(F.col("_m") - 1, F.lit(0)))).cast("int")
    ranked = rows.withColumn(out, F.when(F.col("_m") == 1, (n + 1) // 2).otherwise(by_rank).cast("int"))
    names = [c for c in df.columns if c != out] + [out]
    return plain.select(*names).unionByName(ranked.select(*names))


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def zscore(df: DataFrame, group: str, columns: Sequence[str], suffix_in: str = "", suffix_out: str = "_z", digits: int | None = None) -> DataFrame:
    """``df`` with (x - mean) / sample deviation in each group; 0 where the deviation is null or under 1e-8.

    A null group gives null; a null x stays null unless its group has no spread.
    """
    aggs = [f(F.col(c + suffix_in)).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    stats = df.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs).withColumnRenamed(group, "_g")
    joined = df.join(stats, F.col(group) == F.col("_g"), "left")
    new = {}
    for c in columns:
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        z = F.when(F.col("_g").isNull(), None).when(s.isNull() | (s < 1e-8), 0.0).otherwise((F.col(c + suffix_in) - m) / s)
        new[c + suffix_out] = rounded(z, digits)
    return joined.withColumns(new).drop("_g", *[f"_{k}_{c}" for c in columns for k in "ms"])


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.025, high: float = 0.975, suffix: str = "_w", digits: int | None = None) -> DataFrame:
    """``df`` with columns clipped to quantiles of the whole table; columns that it lacks are skipped, nulls stay.

    ``df`` is written first, as it is read once for the quantiles and once to be clipped.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    df = staged(df, "unclipped")
    long = df.select(*columns).unpivot([], columns, "_column", "_value")
    with scope() as own:
        found = quantiles(value_ranks(long, "_column", "_value"), "_column", "_value", [low, high])
        bounds = staged(found.agg(*[F.max(F.when(F.col("_column") == c, F.col("edges"))).alias(f"_b_{c}") for c in columns]), "bounds")
        own.keep(bounds)
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    new = {}
    for c in columns:
        lo, hi = F.col(f"_b_{c}")[0], F.col(f"_b_{c}")[1]
        new[c + suffix] = rounded(F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo), hi)), digits)
    return joined.withColumns(new).drop(*[f"_b_{c}" for c in columns])


def rank_correlation(df: DataFrame, group: str, x: str, y: str, least: int, null_if_constant: bool = True) -> DataFrame:
    """(group, ic, n): Spearman's correlation of complete rows; null under ``least`` rows or without spread.

    A group without a complete row is kept, with null.
    """
    with scope() as own:
        every = df.where(F.col(group).isNotNull()).select(group).distinct()
        full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, y)
        ranked = average_ranks(average_ranks(full, group, x, "_rx"), group, y, "_ry")
        found = ranked.groupBy(group).agg(
            F.count(F.lit(1)).alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy")
        )
        r = F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide("c", F.col("sx") * F.col("sy")))
        out = staged(every.join(found.select(group, r.alias("ic"), "n"), group, "left").withColumn("n", F.coalesce("n", F.lit(0))), "ic")
        own.keep(out)
    return out


#: Steps of the rule that integrates, and standard deviations beyond which nothing is left.
STEPS, TAIL = 1024, 9.0


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation ``r`` of ``n`` independent pairs; null for under three pairs, 0 for a perfect one.

    Under independence a correlation is the sine of an angle whose density goes as its cosine to the power n - 3. Both
    integrals, of the tail and of the whole, are a fold of STEPS terms by Simpson's rule.
    """
    k = n.cast("double") - 3

    def integral(begin: Column) -> Column:
        end = F.least(F.lit(np.pi / 2), begin + TAIL / F.sqrt(F.greatest(k, F.lit(1e-9))))
        step = (end - begin) / STEPS
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        terms = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(F.greatest(F.cos(begin + i * step), F.lit(0.0)), k))
        return terms * step / 3

    size = F.least(F.abs(r), F.lit(1.0))
    return F.when(r.isNull() | n.isNull() | (n < 3), None).when(size >= 1, 0.0).otherwise(F.least(F.lit(1.0), integral(F.asin(size)) / integral(F.lit(0.0))))
