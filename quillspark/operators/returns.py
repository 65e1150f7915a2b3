"""Prices and forward returns by a strict forward as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SignalConfig

HORIZONS = SignalConfig().horizons


def long_prices(wide: DataFrame, date_col: str = "date") -> DataFrame:
    """(ticker, date, close) from a table with a column of closes for each ticker; nulls are kept."""
    tickers = [c for c in wide.columns if c != date_col]
    return wide.unpivot(date_col, tickers, "ticker", "close").select("ticker", F.col(date_col).alias("date"), F.col("close").cast("double").alias("close"))


def by_ticker(df: DataFrame, *more: str) -> DataFrame:
    """``df`` dealt out by ticker, and ``more``, in as many parts as the session's exchanges have: what follows makes many rows
    of one, so parts that look small must not be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker", *more)


def fill_forward(prices: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One close for every ticker and day of the union calendar from the ticker's first close on.

    Of repeated rows of a ticker and day the greatest close counts. The calendar is one row with an array, bounded by the
    number of trading days; ``days`` (date), where given, are the dates of ``prices``, repeated or not. A close stands for
    the days up to the ticker's next one, so prices travel once, by ticker, and the filled rows not at all.
    """
    dates = prices.select("date") if days is None else days.select("date")
    calendar = dates.where("date is not null").distinct().agg(F.array_sort(F.collect_set("date")).alias("_days"))
    places = calendar.select(F.posexplode("_days").alias("_at", "_day"))
    known = by_ticker(prices.where(F.col("ticker").isNotNull() & F.col("close").isNotNull())).groupBy("ticker", "date").agg(F.max("close").alias("close"))
    placed = known.join(F.broadcast(places), F.col("date") == F.col("_day")).crossJoin(F.broadcast(calendar))
    upto = F.coalesce(F.lead("_at").over(Window.partitionBy("ticker").orderBy("date")), F.size("_days"))
    return placed.withColumn("_n", upto - F.col("_at")).select("ticker", F.explode(F.slice("_days", F.col("_at") + 1, F.col("_n"))).alias("date"), "close")


def call_date(c: F.Column) -> F.Column:
    """A date from a string; null for an empty or unreadable one."""
    return F.try_to_timestamp(c).cast("date")


def forward_returns(calls: DataFrame, prices: DataFrame, horizons: Sequence[int] = HORIZONS, digits: int = 6) -> DataFrame:
    """(ticker, date, t1, fwd_<n>d) for every distinct call, in trading days after the first day after the call.

    Unknown tickers, null dates and calls after the last price have null returns. Prices without a close are dropped
    before days are counted. Both sides of a ticker are bounded by its calendar, as calls are made distinct first; one
    sort of their union finds the day, and returns ahead come from the same order.
    """
    own = Window.partitionBy("ticker").orderBy("date")
    known = prices.where(F.col("close").isNotNull() & F.col("date").isNotNull())
    ahead = [F.round(F.try_divide(F.lead("close", n).over(own), "close") - 1, digits).alias(f"fwd_{n}d") for n in horizons]
    days = known.select("ticker", "date", *ahead)
    names = [f"fwd_{n}d" for n in horizons]
    day = days.select("ticker", "date", F.struct(F.col("date").alias("t1"), *names).alias("p"), F.lit(0).alias("call"))
    # by ticker as the prices are, so that their union needs no exchange
    call = by_ticker(calls.select("ticker", "date")).distinct().withColumns({"p": F.lit(None).cast(day.schema["p"].dataType), "call": F.lit(1)})
    # latest first, calls before prices of their day: what precedes a call is strictly later
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("call").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = day.unionByName(call).withColumn("next", F.last("p", ignorenulls=True).over(w)).where("call = 1")
    hit = F.when(F.col("date").isNotNull(), F.col("next"))
    return found.select("ticker", "date", hit["t1"].alias("t1"), *[hit[c].alias(c) for c in names])


#: Days of a slice.
SLICE = 90


def _slice(date: F.Column, days: int) -> F.Column:
    return F.floor(F.unix_date(date) / days)


def sliced_returns(calls: DataFrame, prices: DataFrame, horizons: Sequence[int] = HORIZONS, digits: int = 6, days: int = SLICE) -> DataFrame:
    """The rows of ``forward_returns``, with a ticker's time cut into slices, so that one ticker is many tasks.

    A slice needs a few rows of what comes after it: the closes up to the farthest horizon, and the first price after the
    slice's calls. The former come from numbering a ticker's prices through its slices and repeating the first rows of each
    block of numbers in the block before; the latter from a table of the slices' first prices. What one task orders is a
    block, a slice, or a ticker's slices.
    """
    far = max(horizons)
    known = by_ticker(prices.where(F.col("close").isNotNull() & F.col("date").isNotNull()).select("ticker", "date", "close", _slice(F.col("date"), days).alias("s")), "s")
    upto = lambda *order: Window.partitionBy("ticker").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = known.groupBy("ticker", "s").agg(F.count(F.lit(1)).alias("size"))
    begins = sizes.select("ticker", "s", (F.sum("size").over(upto("s")) - F.col("size")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("ticker", "s").orderBy("date", "close"))
    placed = known.withColumn("i", inside).join(begins, ["ticker", "s"]).withColumn("i", F.col("begin") + F.col("i") - 1)
    # a block holds as many numbers as the farthest horizon at least, so what it lacks is in the next one
    size = max(far, days)
    block = F.floor(F.col("i") / size)
    own = by_ticker(placed.select("ticker", "date", "close", "s", "i", F.explode(F.when((F.col("i") % size < far) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block")), "block")
    ahead = Window.partitionBy("ticker", "block").orderBy("i")
    names = [f"fwd_{n}d" for n in horizons]
    days_of = own.withColumns({c: F.round(F.try_divide(F.lead("close", n).over(ahead), "close") - 1, digits) for c, n in zip(names, horizons)})
    day = days_of.where(F.floor(F.col("i") / size) == F.col("block")).select("ticker", "date", "s", F.struct(F.col("date").alias("t1"), *names).alias("p"), F.lit(0).alias("call"))
    call = calls.select("ticker", "date").distinct().withColumn("s", _slice(F.col("date"), days)).withColumns({"p": F.lit(None).cast(day.schema["p"].dataType), "call": F.lit(1)})
    call = call.select("ticker", "date", "s", "p", "call")
    rows = by_ticker(day.unionByName(call), "s")
    firsts = rows.groupBy("ticker", "s").agg(F.min_by("p", F.when(F.col("call") == 0, F.col("date"))).alias("first"))
    after = Window.partitionBy("ticker").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(F.col("ticker").alias("_t"), F.col("s").alias("_s"), F.last("first", ignorenulls=True).over(after).alias("carried"))
    w = Window.partitionBy("ticker", "s").orderBy(F.col("date").desc(), F.col("call").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("next", F.last("p", ignorenulls=True).over(w)).where("call = 1")
    found = found.join(carried, F.col("ticker").eqNullSafe(F.col("_t")) & F.col("s").eqNullSafe(F.col("_s")), "left")
    hit = F.when(F.col("date").isNotNull(), F.coalesce("next", "carried"))
    return found.select("ticker", "date", hit["t1"].alias("t1"), *[hit[c].alias(c) for c in names])


def sliced_filled_returns(calls: DataFrame, prices: DataFrame, dates: DataFrame, horizons: Sequence[int] = HORIZONS, digits: int = 6, days: int = SLICE) -> DataFrame:
    """The rows of ``forward_returns`` over ``fill_forward(prices, dates)``, with a ticker's time cut into slices of so many
    trading days, and no filled row made.

    A close on a day of the calendar is the ticker's last one up to it, so each call asks for those of its first day and of the
    horizons, by the day's number. ``prices`` may repeat a ticker's day, as in ``fill_forward``, and travel once, by ticker and
    slice; a slice passes on its last close. What one task orders is a slice, or a ticker's questions and slices' last closes.
    """
    calendar = dates.where("date is not null").select("date").distinct().agg(F.array_sort(F.collect_set("date")).alias("_days"))
    places = calendar.select(F.posexplode("_days").alias("_at", "_day"))
    known = prices.where(F.col("ticker").isNotNull() & F.col("close").isNotNull() & F.col("date").isNotNull()).select("ticker", "date", "close")
    placed = known.join(F.broadcast(places), F.col("date") == F.col("_day")).select("ticker", F.floor(F.col("_at") / days).alias("s"), F.col("_at").alias("at"), "close")
    close = by_ticker(placed, "s").groupBy("ticker", "s", "at").agg(F.max("close").alias("close"))
    firsts = known.groupBy(F.col("ticker").alias("_t")).agg(F.min("date").alias("_first"))
    # the number of the first trading day after a date: of every date from the first trading day to the one before the last
    inner = F.greatest(F.size("_days") - 1, F.lit(0))
    gaps = calendar.select(F.posexplode(F.arrays_zip(F.slice("_days", 1, inner).alias("a"), F.slice("_days", 2, inner).alias("b"))).alias("_k", "_gap"))
    later = gaps.select((F.col("_k") + 1).alias("_next"), F.explode(F.sequence("_gap.a", F.date_sub("_gap.b", 1))).alias("_from"))
    # a call before the ticker's first close waits for that
    own = calls.select("ticker", "date").distinct().join(firsts, F.col("ticker") == F.col("_t"), "left")
    own = own.join(F.broadcast(later), F.greatest("date", F.date_sub("_first", 1)) == F.col("_from"), "left")
    own = own.crossJoin(F.broadcast(calendar.select(F.get("_days", F.lit(0)).alias("_begin"), F.size("_days").alias("_size"))))
    start = F.when(F.col("date").isNotNull() & F.col("_first").isNotNull(), F.when(F.greatest("date", F.date_sub("_first", 1)) < F.col("_begin"), F.lit(0)).otherwise(F.col("_next")))
    own = own.withColumn("start", start)
    # a call without a first day stays, with one question that nothing answers
    asked = F.filter(F.array(*[F.lit(n) for n in (0, *horizons)]), lambda n: (n == 0) | (F.col("start") + n < F.col("_size")))
    questions = own.select("ticker", "date", "start", F.explode(asked).alias("n")).withColumn("at", F.col("start") + F.col("n"))
    questions = by_ticker(questions.select("ticker", F.floor(F.col("at") / days).alias("s"), "at", F.lit(None).cast("double").alias("close"), "n", "date", "start"), "s")
    rows = close.withColumns({"n": F.lit(-1), "date": F.lit(None).cast(calls.schema["date"].dataType), "start": F.lit(None).cast("int")}).unionByName(questions)
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closes = F.when(F.col("n") == -1, F.col("close"))
    last = F.max(F.when(F.col("n") == -1, F.col("at"))).over(Window.partitionBy("ticker", "s"))
    found = rows.withColumns({"found": F.last(closes, ignorenulls=True).over(upto("ticker", "s")), "last": last}).where("n >= 0 or at = last")
    carried = F.last(closes, ignorenulls=True).over(upto("ticker"))
    answers = by_ticker(found.drop("s", "last")).withColumn("found", F.coalesce("found", carried)).where("n >= 0")
    of = {n: F.max(F.when(F.col("n") == n, F.col("found"))).alias(f"_{n}") for n in (0, *horizons)}
    got = answers.groupBy("ticker", "date").agg(F.max("start").alias("start"), *of.values())
    got = got.join(F.broadcast(places), F.col("start") == F.col("_at"), "left")
    return got.select("ticker", "date", F.col("_day").alias("t1"), *[F.round(F.try_divide(f"_{n}", "_0") - 1, digits).alias(f"fwd_{n}d") for n in horizons])


def with_returns(rows: DataFrame, returns: DataFrame) -> DataFrame:
    """``rows`` with the returns of their (ticker, date), null where there are none; nothing fans out."""
    return rows.join(returns.drop("t1"), ["ticker", "date"], "left")
