import datetime as dt

from pyspark.sql import functions as F

from quillspark.sources import commits
from quillspark.streaming import events

KIND = "k string, ts timestamp, v int"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def stream(spark, tmp_path, parts, step):
    late = []
    for rows in parts:
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(f"{tmp_path}/in")
        late.append(events.run(spark, f"{tmp_path}/in", spark.createDataFrame([], KIND).schema, step, f"{tmp_path}/out", f"{tmp_path}/state", files=100))
    out = commits.read_table(spark, f"{tmp_path}/out")
    return late, sorted(map(tuple, out.collect()), key=str)


def test_distinct_events(spark, tmp_path):
    step = lambda rows: events.distinct_events(rows, ["k"], "ts", "10 minutes")
    parts = [[("a", at(0), 1), ("b", at(1), 1)], [("a", at(5), 2), ("c", at(40), 1)], [("c", at(41), 2), ("d", at(2), 1), ("e", at(39), 1)]]
    late, got = stream(spark, tmp_path, parts, step)
    assert got == [("a", at(0), 1), ("b", at(1), 1), ("c", at(40), 1), ("e", at(39), 1)]
    assert late == [0, 0, 1]  # d is older than the watermark of 30 minutes
    # a run without new files adds nothing, and neither does one that starts anew from the same state
    assert events.run(spark, f"{tmp_path}/in", spark.createDataFrame([], KIND).schema, step, f"{tmp_path}/out", f"{tmp_path}/state") == 0
    assert commits.read_table(spark, f"{tmp_path}/out").count() == 4


def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [(k, at(m * 7 % 600 + len(k)), m) for m in range(120) for k in ("a", "bb")] + [(None, at(50), 1), ("a", None, 5)]
    rows.sort(key=lambda r: r[1] or at(0))
    parts = [rows[i : i + 50] for i in range(0, len(rows), 50)] + [[("end", at(5000), 0)]]
    kinds = {"tumbling": events.tumbling("ts", "30 minutes"), "sliding": events.sliding("ts", "1 hour", "20 minutes"), "session": events.session("ts", "6 minutes")}
    for name, window in kinds.items():
        step = lambda df, w=window: events.windowed(df, ["k"], "ts", w, [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")], "5 minutes")
        late, got = stream(spark, tmp_path / name, parts, step)
        want = sorted(map(tuple, step(spark.createDataFrame(rows, KIND)).collect()), key=str)
        assert sorted(got, key=str) == want and sum(late) == 0
