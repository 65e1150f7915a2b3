"""What travels: filled prices do not, and a table that is read several times is made once."""

import random
import re
from datetime import date, timedelta

from quillspark.functions import stats
from quillspark.operators import returns
from quillspark.plans import registry, stand_ins


def plain_filled(rows):
    days = sorted({d for _, d, _ in rows if d is not None})
    out = []
    for t in {t for t, _, _ in rows if t is not None}:
        last = None
        for d in days:
            found = [c for u, e, c in rows if (u, e) == (t, d) and c is not None]
            last = max(found) if found else last
            if last is not None:
                out.append((t, d, last))
    return sorted(out)


def test_filled_prices(spark):
    rng = random.Random(1)
    days = [date(2020, 1, 1) + timedelta(k) for k in range(12)]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*days, None]), rng.choice([None, 1.0, 2.5, 4.0])) for _ in range(60)] + [(9, days[5], None), (8, days[-1], 3.0)]
    df = spark.createDataFrame(rows, "ticker long, date date, close double")
    for given in (None, df):
        assert sorted(tuple(r) for r in returns.fill_forward(df, given).collect()) == plain_filled(rows)


def test_filled_prices_do_not_travel(spark):
    """Between the prices' exchange by ticker and the returns there is no other, though each price becomes many rows."""
    d = "/root/testdata/sf0.001"
    df = returns.forward_returns(stand_ins.scores(spark, d), returns.fill_forward(stand_ins.prices(spark, d), stand_ins.days(spark, d)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above
    assert len(re.findall(r"Exchange hashpartitioning\(ticker#\d+L?, \d+\)", plan)) == 2


def test_tables_are_made_once(spark, monkeypatch):
    """Scores are made once, then read: once for a query's quantiles or increments and once for its rows."""
    made = []
    for module in (stats, registry):
        monkeypatch.setattr(module, "staged", lambda df, name, own=module.staged: made.append(name) or own(df, name))
    d = "/root/testdata/sf0.001"
    for name in ("winsorized", "merged_summaries"):
        plan = registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan, name
    assert {"unclipped", "calls"} <= set(made)
