"""Construction of the cross-sectional signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SECTORS, SignalConfig
from ..functions import stats
from ..functions.text import weighted_sum
from ..sources.stage import staged
from .returns import forward_returns, with_returns


def add_sector(df: DataFrame, sectors: dict[str, str] | DataFrame = SECTORS, default: str = "Unknown") -> DataFrame:
    """``df`` with its ticker's sector; a map of constants, or a table (ticker, sector) with unique tickers."""
    if isinstance(sectors, dict):
        pairs = [F.lit(x) for kv in sectors.items() for x in kv]
        found = F.element_at(F.create_map(*pairs), F.col("ticker")) if pairs else F.lit(None).cast("string")
        return df.withColumn("sector", F.coalesce(found, F.lit(default)))
    return df.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def composite(df: DataFrame, config: SignalConfig) -> DataFrame:
    """``df`` with raw_signal, the weighted z-scores that the table has, and composite_z, its z-score over all rows."""
    terms = [(w, F.col(f"{c}_z")) for c, w in config.weights.items() if f"{c}_z" in df.columns]
    raw = df.withColumn("raw_signal", weighted_sum(terms))
    whole = raw.agg(F.avg("raw_signal").alias("_m"), F.stddev_samp("raw_signal").alias("_s"))
    z = stats.rounded((F.col("raw_signal") - F.col("_m")) / (F.col("_s") + 1e-8), config.digits)
    return raw.crossJoin(F.broadcast(whole)).withColumn("composite_z", z).drop("_m", "_s")  # one row


def standardize(df: DataFrame, config: SignalConfig) -> DataFrame:
    """Winsorised over the whole table, then z-scored by quarter."""
    columns = [c for c in config.columns if c in df.columns]
    df = stats.winsorize(df, columns, *config.winsor, digits=config.digits)
    return stats.zscore(df, "quarter", columns, suffix_in="_w", digits=config.digits)


def build_signals(scores: DataFrame, prices: DataFrame, config: SignalConfig | None = None, sectors: dict[str, str] | DataFrame = SECTORS) -> DataFrame:
    """Scores (ticker, date, quarter, ...) with sector, forward returns, clipped and standardised columns, composite and quintile.

    Ranks that tie fall to the lesser (ticker, date).
    """
    config = config or SignalConfig()
    rows = with_returns(add_sector(scores, sectors), forward_returns(scores, prices, config.horizons))
    rows = staged(composite(staged(standardize(rows, config), "standard"), config), "composite")
    return stats.buckets(rows, "quarter", "composite_z", config.buckets, ["ticker", "date"], "quintile")


def pooled_ic(signals: DataFrame, returns: list[str], signal: str = "composite_z", digits: int = 4) -> DataFrame:
    """(horizon, ic, p, n) of all rows together; null under five complete rows. One pass for all horizons."""
    long = signals.select(signal, *returns).unpivot([signal], returns, "horizon", "ret")
    found = stats.rank_correlation(long, "horizon", signal, "ret", 5)
    exact = found.withColumn("p", stats.correlation_p(F.col("ic"), F.col("n")))
    return exact.select("horizon", F.round("ic", digits).alias("ic"), F.round("p", digits).alias("p"), "n")


def summary(signals: DataFrame, ret: str = "fwd_5d", digits: int = 4) -> DataFrame:
    """Mean return of every bucket."""
    return signals.where(F.col("quintile").isNotNull()).groupBy("quintile").agg(F.round(F.avg(ret), digits).alias("mean_ret"))


def describe(signals: DataFrame, column: str = "composite_z", digits: int = 4) -> DataFrame:
    """Number, mean, sample deviation, extremes and quartiles of a column."""
    own = signals.select(F.lit(1).alias("all"), column)
    edges = stats.quantiles(stats.value_ranks(own, "all", column), "all", column, [0.25, 0.5, 0.75])
    c = F.col(column)
    whole = signals.agg(F.count(c).alias("n"), *[F.round(f(c), digits).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    q = edges.agg(*[F.round(F.max(F.col("edges")[k]), digits).alias(name) for k, name in enumerate(("q1", "median", "q3"))])
    return whole.crossJoin(F.broadcast(q))  # one row


def head(signals: DataFrame, n: int = 5, signal: str = "composite_z") -> DataFrame:
    """The ``n`` rows of the greatest signal; ties by ticker and date."""
    return signals.orderBy(F.col(signal).desc_nulls_last(), "ticker", "date").limit(n)
