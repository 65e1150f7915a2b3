import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import scoring
from quillspark.plans import pipeline

from .test_transcripts import PAGE


def test_pages_to_backtest(spark, tmp_path):
    names = [f"{t}_2024-0{m}-15_Q{(m + 2) // 3}-2024_site.html" for t in ("AB", "CD", "EF", "GH", "IJ") for m in (1, 4)]
    raw = spark.createDataFrame([(n, PAGE.replace("grew", f"grew may {'could ' * k}")) for k, n in enumerate(names)] + [("X_2024-01-01_Q1-2024_site.html", None)], "name string, html string")
    meta = spark.createDataFrame([(names[0], "http://u")], "name string, url string")
    at = f"{tmp_path}/transcripts"
    found = pipeline.parse_all(raw.limit(4), at, suffix="_site", metadata=meta)
    assert found.count() == 4
    found = pipeline.parse_all(raw, at, suffix="_site", metadata=meta)
    assert found.count() == 10 and found.where("source_url = 'http://u'").count() == 1
    assert found.select("ticker", "date", "quarter").distinct().count() == 10
    assert pipeline.parse_all(raw, at, suffix="_site").count() == 10
    pipeline.export_json(found, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 10

    scorer = scoring.lexicon_scorer(["growth"], ["less"])
    scores = pipeline.score_all(found, scorer, f"{tmp_path}/scores")
    assert scores.count() == 10 and pipeline.score_all(found, scorer, f"{tmp_path}/scores").count() == 10
    days = [(t, dt.date(2024, 1, 1) + dt.timedelta(d), 10.0 + d * (k + 1) + d % 7) for k, t in enumerate(("AB", "CD", "EF", "GH", "IJ")) for d in range(160)]
    prices = spark.createDataFrame(days, "ticker string, date date, close double")
    table = pipeline.signals_table(spark, scores, prices, f"{tmp_path}/signals")
    assert len(table.columns) == 39 and table.count() == 10 and table.where("fwd_20d is null").count() == 0
    assert pipeline.signals_table(spark, scores.limit(0), prices, f"{tmp_path}/signals").count() == 10
    got = pipeline.evaluate_all(table)
    assert [r.horizon for r in got["results"].orderBy("horizon").collect()] == ["fwd_1d", "fwd_20d", "fwd_5d"]
    assert got["distribution"].count() == 2 and got["ic_fwd_5d"].count() == 2 and got["quarters"].count() == 5


def test_land(spark):
    raw = spark.createDataFrame([("https://h/a/b/c/01/02/03/x", "<p>Question time</p>"), ("https://h/a/b/c/05/02/03/x", "<p>nothing</p>")], "url string, html string")
    urls = spark.createDataFrame([("AB", ["https://h/a/b/c/01/02/03/x", "https://h/a/b/c/05/02/03/x"])], "ticker string, urls array<string>")
    assert [(r.ticker, r.date, r.word_count) for r in pipeline.land(raw, urls).collect()] == [("AB", "01-02-03", 2)]
    assert pipeline.land(raw, urls, start="02").count() == 0
    assert pipeline.land(raw, urls, end="02").select(F.max("date")).first()[0] == "01-02-03"
