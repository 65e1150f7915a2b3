import os
import re

import pytest
from pyspark.sql import functions as F

from quillspark.plans import stand_ins

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_large_tables_are_joined_in_parts_of_a_size(spark, monkeypatch):
    """More bytes make more parts of the join, so that a task has no more rows; the calls are the same."""
    want = sorted(map(tuple, stand_ins.scores(spark, SF).collect()))
    read = lambda: [stand_ins.read(spark, SF, name) for name in ("orders", "lineitem")]
    whole = sum(os.path.getsize(f.removeprefix("file://")) for df in read() for f in df.inputFiles())
    for parts in (20, 40):
        monkeypatch.setattr(stand_ins, "PART_BYTES", whole // parts, raising=False)
        rows = stand_ins._sales(spark, SF)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        made = [int(x) for x in re.findall(r"RepartitionByExpression \[l_orderkey#\d+L?\], (\d+)", plan)]
        assert len(made) == 2 and all(n in (parts, parts + 1) for n in made), plan
        assert sorted(map(tuple, stand_ins.scores(spark, SF).collect())) == want
    assert len(want) > 10 and rows.where(F.col("d").isNull()).isEmpty()
