import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.functions import text as t
from quillspark.sources import filings


def one(spark, column, **values):
    kinds = {str: "string", list: "array<string>", int: "int"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_clean_and_sentences(spark):
    assert one(spark, t.clean(F.col("x")), x="  a  b\n\tc ") == "a b c"
    text = "This is the first long sentence. Short. And here\n comes another long sentence! Is this the third one, perhaps?"
    assert one(spark, t.sentences(F.col("x")), x=text) == ["This is the first long sentence.", "And here comes another long sentence!", "Is this the third one, perhaps?"]
    assert one(spark, t.sentences(F.col("x")), x="") == []
    assert one(spark, t.sentences(F.col("x")), x=None) == []


@pytest.mark.parametrize(("text", "want"), [("We expect growth.", True), ("An UNEXPECTED event.", True), ("Going Forward we stay.", True), ("Revenue was flat.", False)])
def test_guidance(spark, text, want):
    assert one(spark, t.is_guidance(F.col("x")), x=text) is want


def test_uncertainty(spark):
    share = t.lexicon_share(F.col("x"))
    assert one(spark, share, x=["We may see risk and it could possibly depend.", "Perhaps not"]) > 0.05
    assert one(spark, share, x=["Revenue grew strongly this year and margins did too"]) < 0.02
    assert one(spark, share, x=["MAY RISK"]) == 1.0
    assert one(spark, share, x=["risk, may."]) == 0.0
    assert one(spark, share, x=[]) == 0.0
    assert one(spark, share, x=["subject to it"]) == 0.0


def test_words_roles_and_tags(spark):
    assert one(spark, t.word_count(F.col("x")), x=["a b  c", "", " d "]) == 4
    roles = {"Operator": "operator", "Jo -- X -- CEO": "executive", "Ann -- Bank of America -- Analyst": "analyst", "Cook": "executive", "Bob": "unknown"}
    for line, role in roles.items():
        assert one(spark, t.described_role(F.col("x")), x=line) == role
    assert one(spark, t.described_role(F.col("x"), whole_words=True), x="Cook") == "unknown"
    assert one(spark, t.error_tags({"a": F.lit(True), "b": F.lit(False), "c": F.lit(True)}), x="") == ["a", "c"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("AB_2022-01-27_Q1-2022_site.html", ("AB", "2022-01-27", "Q1-2022")),
        ("AB_01-28-name-ab-q1-2022-earnings_site.html", ("AB", "2022-01-28", "Q1-2022")),
        ("AB_01-28-name_site.html", ("AB", "", "")),
        ("ab_x_y_z_site.html", ("ab", "x", "y")),
        ("plain", ("plain", "", "")),
    ],
)
def test_file_names(spark, name, want):
    assert tuple(one(spark, t.file_name_fields(F.col("x"), "_site"), x=name)) == want


def test_url_date(spark):
    assert one(spark, t.url_date(F.col("x")), x="https://h/a/b/2024/02/01/slug/") == "02-01-slug"
    assert one(spark, t.url_date(F.col("x")), x="https://h/a") == "unknown"


def test_filings(spark):
    assert one(spark, filings.padded_cik(F.col("x")), x="320193") == "0000320193"
    assert one(spark, filings.index_url("https://h/d/", F.lit("0000320193"), F.col("x")), x="00-1-2") == "https://h/d/320193/0012/0012-index.htm"
    companies = spark.createDataFrame([("AB", 12)], "ticker string, cik int")
    assert filings.company_key(companies, "ab") == "0000000012"
    with pytest.raises(ValueError):
        filings.company_key(companies, "zz")
    rows = [("1", ((["8-K", "8-K/A", "10-K"], ["d1", "d2", "d3"], ["a1", "a2", "a3"], ["p1", "p2", "p3"]),))]
    from quillspark import schemas

    assert [tuple(r) for r in filings.filings(spark.createDataFrame(rows, schemas.FILINGS)).collect()] == [("1", "8-K", "d1", "a1", "p1")]


def test_weights():
    for w in (config.WEIGHTS, config.LEGACY_WEIGHTS):
        assert abs(sum(map(abs, w.values())) - 1) < 1e-9
    assert len(config.UNCERTAINTY_WORDS) == 36 and len(config.EXECUTIVE_KEYWORDS) == 16 and len(config.ANALYST_KEYWORDS) == 30 and len(config.GUIDANCE_KEYWORDS) == 17


def test_sentences_keep_their_numbers(spark):
    """A digit at the edge of a sentence is not taken off, whatever the sentence's number."""
    df = spark.createDataFrame([("0 is the first of them all. 1 is what comes after it 1. 2 follows that one in turn 2.",)], "s string")
    assert df.select(t.sentences(F.col("s"), 0)).first()[0] == ["0 is the first of them all.", "1 is what comes after it 1.", "2 follows that one in turn 2."]
