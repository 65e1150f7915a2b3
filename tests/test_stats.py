import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.config import LEGACY_WEIGHTS, SignalConfig
from quillspark.functions import stats, summaries
from quillspark.operators import backtest, returns, signals
from quillspark.plans import registry


def groups(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        values = rng.choice([[0.0], [1.0, 2.0], [round(rng.gauss(0, 1), 6) for _ in range(30)], [None]])
        for i in range(rng.choice([1, 2, 3, 5, 9, 20])):
            x = rng.choice(values + ([None] if rng.random() < 0.2 else []))
            rows.append((f"g{g:02d}", i, x, round(rng.gauss(0, 1), 2) if rng.random() < 0.9 else None))
    return rows


def pandas_buckets(x, n):
    x = x.astype(float)
    if x.notna().sum() == 0:
        return x
    try:
        return pd.qcut(x, n, labels=range(1, n + 1)).astype(float)
    except ValueError:
        return pd.cut(x.rank(method="first"), n, labels=range(1, n + 1)).astype(float)


@pytest.mark.parametrize("n", [3, 5])
def test_buckets_are_pandas(spark, n):
    rows = groups(n)
    df = spark.createDataFrame([*rows, (None, 0, 1.0, 1.0)], "q string, i int, x double, y double")
    got = stats.buckets(df, "q", "x", n, ["i"], "b").toPandas()
    assert len(got) == len(rows) + 1 and got[got.q.isna()].b.isna().all()
    pdf = pd.DataFrame(rows, columns=["q", "i", "x", "y"])
    pdf["want"] = pdf.groupby("q", group_keys=False).x.apply(lambda s: pandas_buckets(s, n))
    both = pdf.merge(got, on=["q", "i"])
    assert (both.want.fillna(-1) == both.b.fillna(-1)).all(), both[both.want.fillna(-1) != both.b.fillna(-1)].head()


def test_rank_correlation_is_spearman(spark):
    rows = groups(9, 40)
    df = spark.createDataFrame(rows, "q string, i int, x double, y double")
    got = {r.q: (r.ic, r.n) for r in stats.rank_correlation(df, "q", "x", "y", 4).collect()}
    for q, g in pd.DataFrame(rows, columns=["q", "i", "x", "y"]).groupby("q"):
        g = g.dropna()
        want = g.x.astype(float).rank().corr(g.y.astype(float).rank()) if len(g) >= 4 and g.x.nunique() > 1 and g.y.nunique() > 1 else None
        ic, n = got[q]
        assert n == len(g) and ((ic is None) == (want is None)) and (ic is None or abs(ic - want) < 1e-9)


def test_correlation_p(spark):
    # reference values of the t distribution: t = 2.306 at 8 degrees leaves 5 percent
    t, v = 2.3060041, 8
    cases = [(t / math.sqrt(v + t * t), v + 2, 0.05), (0.0, 12, 1.0), (1.0, 5, 0.0), (None, 5, None), (0.5, 2, None), (0.5, None, None)]
    # at 2 degrees of freedom p is 1 - |r|; of very many pairs it is that of a normal deviate
    cases += [(r, 4, 1 - abs(r)) for r in (0.1, -0.5, 0.9)] + [(1.959964 / 1e4, 100_000_003, 0.05), (0.0, 3, 1.0), (0.5, 3, 2 / 3)]
    df = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(cases)], "i int, r double, n long")
    got = {x.i: x.p for x in df.select("i", stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-6), (cases[i], got[i])


@pytest.mark.parametrize("values", ["narrow", "one group", "many groups", "tied"])
def test_ranks_by_range_partitions(spark, values):
    rng = random.Random(4)
    n = 6000
    x = {"narrow": lambda i: 1_000_000 + rng.random(), "one group": lambda i: rng.gauss(0, 1), "many groups": lambda i: rng.gauss(0, 1e-3), "tied": lambda i: float(rng.randrange(3))}[values]
    rows = [(f"g{i % (900 if values == 'many groups' else 1)}", x(i)) for i in range(n)] + [("g0", None), (None, 1.0), ("n", float("nan")), ("n", -0.0), ("n", 0.0), ("n", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with much data
    try:
        got = stats.value_ranks(df.repartition(7), "g", "v").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    of = {}
    for g, v in rows:
        if g is not None and v is not None:
            of.setdefault(g, []).append(math.inf if v != v else v)
    assert len(got) == sum(len(set(vs)) for vs in of.values())
    for g, vs in of.items():
        vs.sort()
    for r in got:
        vs, v = of[r.g], math.inf if r.v != r.v else r.v
        assert (r.n, r.below, r.m) == (vs.count(v), vs.index(v), len(vs))


def test_narrow_values_spread_over_tasks(spark):
    """No partition has more than twice the rows of the median, though all values lie within a thousandth."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.lit(1e6) + F.rand(3)).alias("v"))
    counts = df.groupBy("g", "v").count()
    parts = [r["count"] for r in counts.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 8 and max(parts) <= 2 * sorted(parts)[4]


def test_winsorize_and_zscore(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 1, 2, 3, 100)] + [("b", None), ("c", 7.0), (None, 5.0)], "q string, x double")
    w = stats.winsorize(df.where("q = 'a'"), ["x", "absent"]).toPandas().x_w
    assert w.max() < 100 and w.min() > 0
    z = stats.zscore(df, "q", ["x"]).toPandas()
    a = z[z.q == "a"].x_z
    assert abs(a.mean()) < 1e-9 and abs(a.std() - 1) < 1e-9
    assert z[z.q.isin(["b", "c"])].x_z.tolist() == [0.0, 0.0] and z[z.q.isna()].x_z.isna().all()


def prices_and_calls(seed=1):
    rng = random.Random(seed)
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(60)]
    prices = {(t, d): round(rng.uniform(5, 50), 2) for t in "ABC" for d in rng.sample(days, 40)}
    calls = [(t, rng.choice(days)) for t in "ABCD" for _ in range(12)] + [("A", dt.date(2030, 1, 1)), ("A", None)]
    return prices, calls


def test_forward_returns_are_brute_force(spark):
    prices, calls = prices_and_calls()
    p = spark.createDataFrame([(*k, v) for k, v in prices.items()], "ticker string, date date, close double")
    c = spark.createDataFrame(calls + calls[:3], "ticker string, date date")
    calendar = sorted({d for _, d in prices})
    filled = {}
    for t in "ABC":
        last = None
        for d in calendar:
            last = prices.get((t, d), last)
            if last is not None:
                filled.setdefault(t, []).append((d, last))
    got = {(r.ticker, r.date): (r.t1, r.fwd_1d, r.fwd_5d, r.fwd_20d) for r in returns.forward_returns(c, returns.fill_forward(p)).collect()}
    assert set(got) == set(calls)
    for t, d in set(calls):
        later = [k for k, (x, _) in enumerate(filled.get(t, [])) if d and x > d]
        own = filled.get(t, [])
        want = (own[later[0]][0],) if later else (None,)
        for n in (1, 5, 20):
            want += (own[later[0] + n][1] / own[later[0]][1] - 1 if later and later[0] + n < len(own) else None,)
        assert got[t, d][0] == want[0]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in zip(got[t, d][1:], want[1:]))
    assert returns.forward_returns(c, p.limit(0)).where("t1 is not null").count() == 0


def test_sliced_returns_are_those_of_whole_tickers(spark):
    prices, calls = prices_and_calls(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(d * d % 1900) for d in range(900)]
    prices |= {("HOT", d): 10.0 + k % 17 for k, d in enumerate(days)}
    calls += [("HOT", d + dt.timedelta(1)) for d in days[::7]] + [("HOT", dt.date(2019, 1, 1)), ("HOT", dt.date(2031, 1, 1)), (None, days[0])]
    p = spark.createDataFrame([(*k, v) for k, v in prices.items()] + [("HOT", None, 1.0), ("HOT", days[0], None)], "ticker string, date date, close double")
    c = spark.createDataFrame(calls, "ticker string, date date")
    want = sorted(map(str, returns.forward_returns(c, p).collect()))
    for width in (30, 7, 1, 100_000):
        assert sorted(map(str, returns.sliced_returns(c, p, days=width).collect())) == want
    assert sorted(map(str, returns.sliced_returns(c, p, horizons=(3,), days=5).collect())) == sorted(map(str, returns.forward_returns(c, p, horizons=(3,)).collect()))


def test_sliced_returns_need_no_filled_rows(spark, monkeypatch):
    """Closes are looked up by the day's number; the rows are those over filled prices, and the query makes no such price."""
    prices, calls = prices_and_calls(6)
    days = [dt.date(2020, 1, 1) + dt.timedelta(d * d % 1900) for d in range(300)]
    prices |= {("HOT", d): 10.0 + k % 17 for k, d in enumerate(days)} | {("LATE", dt.date(2024, 2, 20)): 3.0, ("ZERO", dt.date(2024, 1, 3)): 0.0, ("ZERO", dt.date(2024, 1, 9)): 1.0}
    calls += [("HOT", d + dt.timedelta(k % 3)) for k, d in enumerate(days[::5])] + [("HOT", dt.date(2019, 1, 1)), ("HOT", dt.date(2031, 1, 1)), (None, days[0]), ("HOT", None), ("NONE", days[3])]
    calls += [(t, dt.date(2024, 1, d)) for t in ("LATE", "ZERO") for d in (1, 2, 3, 8, 9)] + [("LATE", dt.date(2024, 2, 19)), ("LATE", dt.date(2024, 2, 20))]
    more = [("HOT", None, 1.0), ("HOT", days[0], None), (None, days[2], 4.0), ("HOT", days[4], 1.0), ("HOT", days[4], 99.0)]
    p = spark.createDataFrame([(*k, v) for k, v in prices.items()] + more, "ticker string, date date, close double")
    c = spark.createDataFrame(calls + calls[:9], "ticker string, date date")
    for width, horizons in ((90, (1, 5, 20)), (7, (1, 5, 20)), (1, (3,)), (100_000, (400, 1))):
        want = sorted(map(str, returns.forward_returns(c, returns.fill_forward(p), horizons).collect()))
        assert sorted(map(str, returns.sliced_filled_returns(c, p, p, horizons, days=width).collect())) == want
    none = returns.sliced_filled_returns(c, p.limit(0), p.limit(0))
    assert none.count() == len(set(calls)) and none.where("t1 is not null or fwd_1d is not null").count() == 0
    monkeypatch.setattr(returns, "fill_forward", None)
    assert registry.sliced_returns(spark, "/root/testdata/sf0.001").count() > 0


def test_repeated_prices_are_one(spark):
    p = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 1), 2.0), ("B", dt.date(2024, 1, 2), 3.0)], "ticker string, date date, close double")
    assert sorted(map(tuple, returns.fill_forward(p).collect())) == [("A", dt.date(2024, 1, 1), 2.0), ("A", dt.date(2024, 1, 2), 2.0), ("B", dt.date(2024, 1, 2), 3.0)]


def test_summaries_merge(spark):
    rng = random.Random(8)
    rows = [(f"q{i % 2}", str(rng.randrange(3000)), rng.gauss(0, 1)) for i in range(20_000)] + [("q0", None, None), ("q2", None, None)]
    df = spark.createDataFrame(rows, "q string, k string, x double")
    parts = [summaries.summarise(df.where(f"abs(hash(k, x)) % 4 = {i}"), ["q"], ["k"], ["x"]) for i in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r.q: r for r in summaries.estimates(summaries.merged(every, ["q"]), (0.1, 0.5, 0.9)).collect()}
    for q in ("q0", "q1"):
        own = [r for r in rows if r[0] == q]
        xs = sorted(r[2] for r in own if r[2] is not None)
        assert got[q].n == len(own) and abs(got[q].distinct_k - len({r[1] for r in own if r[1]})) < 0.04 * 3000
        for share, x in zip((0.1, 0.5, 0.9), got[q].quantiles_x):
            assert abs(np.searchsorted(xs, x) / len(xs) - share) < 0.02
    assert (got["q2"].n, got["q2"].distinct_k, got["q2"].quantiles_x) == (1, 0, None)


def test_long_prices(spark):
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None)], "date date, A double, B double")
    assert sorted(map(tuple, returns.long_prices(wide).collect())) == [("A", dt.date(2024, 1, 1), 1.0), ("B", dt.date(2024, 1, 1), None)]
    dates = spark.createDataFrame([("2024-02-01",), ("",), ("junk",)], "s string").select(returns.call_date(F.col("s"))).collect()
    assert [r[0] for r in dates] == [dt.date(2024, 2, 1), None, None]


def test_build_signals(spark):
    prices, _ = prices_and_calls(3)
    p = spark.createDataFrame([(*k, v) for k, v in prices.items()], "ticker string, date date, close double")
    rows = [(t, dt.date(2024, 1, 5 + k), "Q1-2024", 0.1 * k, 0.2 * k * k, 0.0, 0.01 * (k % 3)) for k, t in enumerate("ABCAB")]
    scores = spark.createDataFrame(rows, "ticker string, date date, quarter string, guidance_net double, qa_ceo_net double, prep_net double, lm_uncertainty double")
    out = signals.build_signals(scores, returns.fill_forward(p), SignalConfig(weights=LEGACY_WEIGHTS), {"A": "Tech"}).toPandas()
    assert len(out) == 5 and set(out.quintile) == {1, 2, 3, 4, 5} and set(out.sector) == {"Tech", "Unknown"}
    assert abs(out.composite_z.mean()) < 1e-9
    default = signals.build_signals(scores, p).toPandas()
    assert np.allclose(default.raw_signal, -0.25 * default.lm_uncertainty_z)


def frame(spark, hole=False):
    rows = [(q, f"T{i}", dt.date(2024, 1, i + 1), z, i + 1, None if hole and i == 2 else 0.01 * (i + k / 7)) for k, q in enumerate(("Q1-2024", "Q2-2024")) for i, z in enumerate((-2.0, -1.0, 0.5, 1.0, 2.0))]
    return spark.createDataFrame(rows, "quarter string, ticker string, date date, composite_z double, quintile int, fwd_5d double")


def test_backtest(spark):
    for hole in (False, True):
        df = frame(spark, hole)
        assert all(r.ic > 0.99 for r in backtest.ic_by_quarter(df, "fwd_5d").collect())
        line = backtest.backtest(df, "fwd_5d").first()
        assert line.mean_ic == 1.0 and line.icir > 0 and line.n_quarters == 2 and line.sharpe > 0 and line.spread > 0
        b = {r.quintile: r.mean for r in backtest.bucket_returns(df, "fwd_5d").collect()}
        assert b[5] > b[1]
    empty = backtest.backtest(df.limit(0), "fwd_5d").first()
    assert empty.n_quarters == 0 and empty.sharpe is None and empty.mean_ic is None
    constant = df.withColumn("fwd_5d", F.lit(0.5))
    assert all(r.ic is None for r in backtest.ic_by_quarter(constant, "fwd_5d").collect())
    assert backtest.bucket_spread(constant, "fwd_5d").first().spread is None
    assert [r.horizon for r in backtest.factor_decay(df, ["fwd_5d", "fwd_10d"]).collect()] == ["fwd_5d"]
    assert {tuple(r) for r in backtest.bucket_distribution(backtest.tertiles(df)).collect()} == {("Q1-2024", 2, 1, 2), ("Q2-2024", 2, 1, 2)}
