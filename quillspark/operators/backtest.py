"""Evaluation of a signal against forward returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.stage import scope, staged

#: Quarters in a year.
YEAR = 4


def valid_rows(signals: DataFrame, signal: str = "composite_z") -> DataFrame:
    """Rows with a signal that is not zero."""
    return signals.where(F.col(signal).isNotNull() & (F.abs(signal) > 1e-10))


def tertiles(signals: DataFrame, n: int = 3, signal: str = "composite_z", row_id: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Valid rows with their bucket of ``n`` by quarter, in the column ``quintile`` for compatibility."""
    with scope() as own:
        rows = valid_rows(signals, signal).drop("quintile")
        out = staged(stats.buckets(rows, "quarter", signal, n, list(row_id), "quintile"), "tertiles")
        own.keep(out)
    return out


def bucket_distribution(rows: DataFrame, n: int = 3) -> DataFrame:
    """(quarter, b1..bn): rows in every bucket."""
    counts = [F.count(F.when(F.col("quintile") == k, 1)).alias(f"b{k}") for k in range(1, n + 1)]
    return rows.where(F.col("quarter").isNotNull()).groupBy("quarter").agg(*counts)


def ic_by_quarter(rows: DataFrame, ret: str, signal: str = "composite_z", least: int = 4) -> DataFrame:
    """(quarter, ic, n) with null for quarters of under four complete rows or without spread."""
    return stats.rank_correlation(rows, "quarter", signal, ret, least)


def icir(series: DataFrame, digits: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, ratio, t and number of the non-null information coefficients."""
    ic = F.when(F.col("ic").isNotNull(), F.col("ic"))
    stats_ = series.groupBy(*by).agg(F.avg(ic).alias("m"), F.stddev_samp(ic).alias("s"), F.count(ic).alias("n_quarters"))
    m, s, n = F.col("m"), F.col("s"), F.col("n_quarters")
    return stats_.select(
        *by, F.round(m, digits).alias("mean_ic"), F.round(s, digits).alias("std_ic"), F.round(m / (s + 1e-8), digits).alias("icir"),
        F.round(F.when(n > 0, m / (s / F.sqrt(n) + 1e-8)), digits).alias("t_stat"), "n_quarters",
    )


def bucket_returns(rows: DataFrame, ret: str) -> DataFrame:
    """(quintile, mean, std, n) of rows with a return."""
    full = rows.where(F.col("quintile").isNotNull() & F.col(ret).isNotNull())
    return full.groupBy("quintile").agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("std"), F.count(ret).alias("n"))


def factor_decay(rows: DataFrame, returns: Sequence[str], signal: str = "composite_z") -> DataFrame:
    """The ICIR line of every return column that the table has, from one pass over all horizons."""
    returns = [c for c in returns if c in rows.columns]
    long = rows.where(F.col("quarter").isNotNull()).select("quarter", signal, *returns).unpivot(["quarter", signal], list(returns), "horizon", "ret")
    keyed = long.withColumn("group", F.concat_ws("|", "horizon", "quarter"))
    series = stats.rank_correlation(keyed, "group", signal, "ret", 4).withColumn("horizon", F.split("group", r"\|")[0])
    return icir(series, by=["horizon"])


def long_short_series(rows: DataFrame, ret: str) -> DataFrame:
    """(quarter, ls): mean return of a quarter's highest bucket less that of its lowest, among rows with a return.

    Sums by quarter and bucket come first, so a quarter's extremes are found among its few buckets.
    """
    full = rows.where(F.col("quarter").isNotNull() & F.col("quintile").isNotNull() & F.col(ret).isNotNull())
    means = full.groupBy("quarter", "quintile").agg(F.avg(ret).alias("r"))
    return means.groupBy("quarter").agg((F.max_by("r", "quintile") - F.min_by("r", "quintile")).alias("ls"))


def long_short(rows: DataFrame, ret: str, digits: int = 4) -> DataFrame:
    """Mean, annualised return, population deviation a year and Sharpe ratio; null without quarters."""
    return _yearly(long_short_series(rows, ret), digits)


def _yearly(series: DataFrame, digits: int, by: Sequence[str] = ()) -> DataFrame:
    s = series.groupBy(*by).agg(F.avg("ls").alias("m"), F.stddev_pop("ls").alias("d"), F.count("ls").alias("n_quarters"))
    year, spread = F.col("m") * YEAR, F.col("d") * YEAR**0.5
    return s.select(
        *by, F.round("m", digits).alias("mean_ls"), F.round(year, digits).alias("ann_return"), F.round(spread, digits).alias("ann_std"),
        F.round(year / (spread + 1e-8), digits).alias("sharpe"), "n_quarters",
    )


def bucket_spread(rows: DataFrame, ret: str, digits: int = 4) -> DataFrame:
    """Mean of the highest bucket less that of the lowest; null for one bucket, and for exactly zero."""
    b = bucket_returns(rows, ret).agg(F.max_by("mean", "quintile").alias("hi"), F.min_by("mean", "quintile").alias("lo"), F.count(F.lit(1)).alias("n"))
    return b.select(F.round(F.when(F.col("n") >= 2, F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), digits).alias("spread"))


def backtest(signals: DataFrame, ret: str, n: int = 3) -> DataFrame:
    """One row: horizon, IC statistics, spread and long-short statistics."""
    return evaluate(tertiles(signals, n), [ret])


def evaluate(rows: DataFrame, returns: Sequence[str], signal: str = "composite_z", digits: int = 4) -> DataFrame:
    """The line of a backtest for every return column, for rows that have their bucket: one pass over all horizons.

    A horizon without any complete row keeps its line, with nulls.
    """
    long = rows.select("quarter", "quintile", signal, *returns).unpivot(["quarter", "quintile", signal], list(returns), "horizon", "ret")
    lines = factor_decay(rows, returns, signal)
    full = long.where(F.col("quintile").isNotNull() & F.col("ret").isNotNull())
    # sums by quarter and bucket serve both the spread and the long-short series
    cells = full.groupBy("horizon", "quarter", "quintile").agg(F.sum("ret").alias("s"), F.count(F.lit(1)).alias("n"))
    by_bucket = cells.groupBy("horizon", "quintile").agg((F.sum("s") / F.sum("n")).alias("r"))
    extremes = by_bucket.groupBy("horizon").agg(F.max_by("r", "quintile").alias("hi"), F.min_by("r", "quintile").alias("lo"), F.count(F.lit(1)).alias("n"))
    spread = extremes.select("horizon", F.round(F.when(F.col("n") >= 2, F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), digits).alias("spread"))
    means = cells.where(F.col("quarter").isNotNull()).withColumn("r", F.col("s") / F.col("n"))
    series = means.groupBy("horizon", "quarter").agg((F.max_by("r", "quintile") - F.min_by("r", "quintile")).alias("ls"))
    gains = _yearly(series, digits, ["horizon"]).drop("n_quarters")
    every = rows.sparkSession.createDataFrame([(c,) for c in returns], "horizon string")
    out = every.join(lines, "horizon", "left").join(spread, "horizon", "left").join(gains, "horizon", "left")
    return out.withColumn("n_quarters", F.coalesce("n_quarters", F.lit(0)))


def horizon_sweep(signals: DataFrame, returns: Sequence[str] = ("fwd_1d", "fwd_5d", "fwd_20d"), n: int = 3) -> DataFrame:
    """A backtest row for each return column."""
    return evaluate(tertiles(signals, n), list(returns))


def quarters_by_ticker(signals: DataFrame) -> DataFrame:
    """(ticker, quarters): the sorted quarters of every ticker."""
    return signals.groupBy("ticker").agg(F.array_sort(F.collect_set("quarter")).alias("quarters"))
