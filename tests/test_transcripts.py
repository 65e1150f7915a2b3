import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import config
from quillspark.operators import scoring, turns
from quillspark.sources import pages, tables
from quillspark.plans import pipeline as stages
from quillspark.streaming import incremental

PAGE = """<html><body><div><h2>Prepared Remarks</h2><strong>Jane Doe -- Acme -- Chief Executive Officer</strong>
<p>Revenue grew by a tenth compared with last year. We expect further growth in the next quarter.</p><p>short</p>
<h2>Questions and Answers</h2><div><p><strong>Sam Poe</strong><em>Analyst at a bank</em></p><p>Could you say more about the outlook for margins?</p>
<p><strong>Jane Doe</strong></p><p>Margins depend on many things. We anticipate a stable level for the year.</p></div><p><strong>Operator</strong></p><p>Ladies and gentlemen, this concludes the call.</p>
<h2>Call Participants</h2><ul><li>Jane Doe -- Acme -- Chief Executive Officer</li><li>Sam Poe -- Big Securities -- Analyst</li></ul></div></body></html>"""


def sequential_lookup(lines):
    out = {}
    for line in lines:
        line = line.strip()
        if len(line) < 3:
            continue
        low = line.lower()
        role = "operator" if "operator" in low else "executive" if any(k in low for k in config.EXECUTIVE_KEYWORDS) else "analyst" if any(k in low for k in config.ANALYST_KEYWORDS) else "unknown"
        name = line.split("--")[0].strip()
        if name:
            out[name.lower()] = role
            out.setdefault(name.split()[0].lower(), role)
    return out


def test_role_lookup_is_the_sequential_one(spark):
    rng = random.Random(2)
    names, ends = ["Ann", "Ann Lee", "Bob", "Bob Ray", "Ann Day", "x", "-- y"], ["", " -- CEO", " -- Analyst", " -- Operator", " -- nobody"]
    docs = {d: [rng.choice(names) + rng.choice(ends) for _ in range(rng.randint(0, 9))] for d in range(40)}
    df = spark.createDataFrame([(d, k, x) for d, lines in docs.items() for k, x in enumerate(lines)], "doc_id int, pos int, line string")
    got = {}
    for r in turns.role_lookup(df).collect():
        got.setdefault(r.doc_id, {})[r.key] = r.role
    assert got == {d: found for d, lines in docs.items() if (found := sequential_lookup(lines))}


def parsed(spark, page=PAGE):
    got = pages.page_parts(spark.createDataFrame([("d", page)], "doc_id string, html string")).select("doc_id", "parts.*").cache()
    elements = got.select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*")
    lines = got.select("doc_id", F.posexplode("participants").alias("pos", "line"))
    lookup = turns.role_lookup(lines)
    return got, turns.speaker_turns(elements, lookup), lookup


def test_page(spark):
    got, said, lookup = parsed(spark)
    roles = {r.key: r.role for r in lookup.collect()}
    assert roles["jane doe"] == "executive" and roles["sam poe"] == "analyst"
    rows = said.orderBy("section", "turn").collect()
    assert [(r.section, r.speaker_name, r.role) for r in rows] == [("prepared_remarks", "Jane Doe", "executive"), ("qa", "Sam Poe", "analyst"), ("qa", "Jane Doe", "executive")]
    assert rows[0].speaker_title == "Chief Executive Officer" and rows[0].text.endswith("next quarter.")
    assert rows[1].text.startswith("Analyst at a bank")
    whole = turns.assemble(got, said, lookup).first()
    assert len(whole.prepared_remarks) == 2 and len(whole.qa_ceo) == 2 and len(whole.guidance_sentences) == 2 and whole.parse_errors == []
    assert whole.sentence_count == 5


def test_page_without_anything(spark):
    for page in ("", "<p>x", None):
        got, said, lookup = parsed(spark, page)
        whole = turns.assemble(got, said, lookup).first()
        assert whole.parse_errors == ["empty_role_lookup", "no_prepared_remarks", "no_qa_section", "no_executive_sentences"] and whole.word_count == 0


@pytest.mark.parametrize(("raw", "want"), [("Tim Low -- Acme -- CEO", "unknown"), ("Kay Roe -- Jefferies -- Analyst", "analyst"), ("operator", "operator"), ("Pat Moe -- Acme -- CFO", "executive"), ("Tim Other", "unknown")])
def test_resolve(spark, raw, want):
    lookup = spark.createDataFrame([("d", "tim low", "unknown"), ("d", "tim", "unknown")], "doc_id string, key string, role string")
    assert turns.resolve_roles(spark.createDataFrame([("d", raw)], "doc_id string, speaker_raw string"), lookup).first().role == want


def test_gate_and_metadata(spark):
    df = spark.createDataFrame([(1, "<p>Prepared <b>Remarks</b> two</p>"), (2, "<script>question</script>none"), (3, None)], "doc_id int, html string")
    assert [(r.doc_id, r.word_count) for r in pages.gate(df).collect()] == [(1, 3)]
    saved = spark.createDataFrame([("a", "T", "2020", "u")], "doc_id string, ticker string, date string, url string")
    named = spark.createDataFrame([("a", "T", ""), ("b", "U", "1")], "doc_id string, ticker string, date string")
    assert sorted(map(tuple, pages.merge_metadata(saved, named).collect())) == [("a", "T", "", "u"), ("b", "U", "1", None)]


def transcripts(spark, **over):
    base = {"ticker": "T", "date": "d", "quarter": "q", "source": "s", "word_count": 1, "sentence_count": 2, "prepared_remarks": ["good day to all", "bad"], "qa_ceo": [], "qa_analyst": ["fine"], "guidance_sentences": []} | over
    kind = T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if isinstance(v, list) else T.IntegerType() if isinstance(v, int) else T.StringType()) for k, v in base.items()])
    return spark.createDataFrame([tuple(base.values())], kind)


def load_constant():
    return lambda texts: [{"positive": 0.7, "negative": 0.1, "neutral": 0.2} for _ in texts]


def load_failing():
    def model(texts):
        if any("bad" in x for x in texts):
            raise RuntimeError
        return [{"positive": 1.0} for _ in texts]

    return model


def test_scores(spark):
    row = scoring.score_transcripts(transcripts(spark), scoring.model_scorer(load_constant)).first()
    assert (row.prep_pos, row.prep_neg, row.prep_net, row.prep_n_sents) == (0.7, 0.1, 0.6, 2)
    assert (row.qa_ceo_net, row.qa_ceo_n_sents, row.qa_delta) == (0.0, 0, -0.6) and len(row) == 24
    row = scoring.score_transcripts(transcripts(spark), scoring.model_scorer(load_failing, batch=1)).first()
    assert (row.prep_pos, row.prep_neg) == (0.8, 0.0) and row.qa_anal_pos == 1.0
    row = scoring.score_transcripts(transcripts(spark, qa_analyst=[]), scoring.model_scorer(load_failing)).first()
    assert (row.prep_pos, row.prep_neg) == (0.0, 0.0)
    row = scoring.score_transcripts(transcripts(spark), scoring.lexicon_scorer(["good"], ["bad"])).first()
    assert (row.prep_pos, row.prep_neg, row.prep_net) == (0.2, 0.2, 0.0)


def test_append_new_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    at = f"{tmp_path}/t"
    tables.append_new(rows, at, ["k"])
    assert tables.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), at, ["k"]).count() == 3
    assert {tuple(r) for r in spark.read.parquet(at).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    for part in (rows, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        incremental.run_available(spark, f"{tmp_path}/in", rows.schema, lambda df: df.where("v > 1"), f"{tmp_path}/out", ["k"], f"{tmp_path}/cp")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("b", 2), ("c", 3)}


def test_read_pages(spark, tmp_path):
    (tmp_path / "A_2022-01-27_Q1-2022_site.html").write_text(PAGE)
    (tmp_path / "A_meta.json").write_text('{"ticker": "A", "url": "u", "word_count": 3}')
    assert pages.read_pages(spark, str(tmp_path)).first().name == "A_2022-01-27_Q1-2022_site.html"
    assert pages.read_metadata(spark, str(tmp_path)).first().url == "u"
    (tmp_path / "B_2022-01-27_Q1-2022_site_meta.json").write_text("{}")
    (tmp_path / "B_2022-01-27_Q1-2022_site.html").write_text(PAGE)
    for name in ("B_2022-01-27_Q1-2022_site_meta.json", "B_2022-01-27_Q1-2022_site.html"):
        row = stages.load(spark, f"{tmp_path}/{name}", suffix="_site").first()
        assert (row.ticker, row.quarter, len(row.prepared_remarks)) == ("B", "Q1-2022", 2)
    at = tmp_path / "t.json"
    at.write_text('{"ticker": "C", "prepared_remarks": ["x"],\n "speaker_turns": [{"role": "analyst"}]}')
    row = stages.load(spark, str(at)).first()
    assert (row.ticker, row.prepared_remarks, row.speaker_turns[0].role, row.qa_ceo) == ("C", ["x"], "analyst", None)
