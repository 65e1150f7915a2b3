"""The page walk by scans and arrays against one over a tree, element by element."""

import html as entities
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import pages

from . import plain_pages as plain
from .test_transcripts import PAGE

SF = "/root/testdata/sf0.001"
HEADS = dict(prepared="Prepared", qa="Question", participants="Call participant")


def want(page, header_tag="h2", label_tag="strong", **heads):
    root = plain.tree(page)
    found = {"prepared_remarks": plain.section_elements(root, heads["prepared"], header_tag), "qa": plain.section_elements(root, heads["qa"], header_tag)}
    rows = [(s, k, *x) for s, els in found.items() for k, x in enumerate(plain.labelled_elements(els, label_tag))]
    return plain.participant_lines(plain.section_elements(root, heads["participants"], header_tag)), bool(found["prepared_remarks"]), bool(found["qa"]), rows


def got(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, html string")
    rows = pages.page_parts(df, **options).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"i", "html", "parts"}
    return {r.i: (r.parts.participants, r.parts.has_prepared, r.parts.has_qa, [tuple(e) for e in r.parts.elements]) for r in rows}


def piece(rng, depth=0):
    word = lambda: rng.choice(["growth", "A. B.", "Tim Cook -- Apple -- CEO", "x", "we may &amp; could", "caf&eacute; &#233; &#x41;", "a < b", "", "long " * rng.randint(1, 60)])
    kind = rng.randrange(12 if depth < 3 else 6)
    if kind == 0:
        return f"<p><strong>{word()}</strong> {word()}</p>"
    if kind == 1:
        return f"<p>{word()}"  # ends where the next block begins
    if kind == 2:
        return f"<p class='a>b'>{word()}<em>{word()}</em><br>{word()}</p>"
    if kind == 3:
        return f"<strong>{word()}</strong>"
    if kind == 4:
        return "<ul>" + "".join(f"<li>{word()}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(0, 3))) + "</ul>"
    if kind == 5:
        return word() + rng.choice(["<!-- <p>no -->", "<script>if (a < b) '<p>'</script>", "<img src=x>", "<STYLE>p {}</STYLE>", "</i>"])
    if kind == 6:
        return f"<h2>{rng.choice(['Prepared Remarks', 'Questions and <b>Answers</b>', 'Call Participants:', 'Other'])}</h2>"
    if kind == 7:
        return "<table><tr><td>" + piece(rng, depth + 1) + rng.choice(["<td>", "</td><td>"]) + word() + "</table>"
    if kind == 8:
        return f"<span>{word()}<b>{word()}</b></span>"
    tag = rng.choice(["div", "section", "article", "main", "blockquote"])
    return f"<{tag}>" + "".join(piece(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


def test_made_pages(spark):
    rng = random.Random(12)
    texts = ["<html><body>" + "<h2>Prepared Remarks</h2>" * (i % 2) + "".join(piece(rng) for _ in range(rng.randint(0, 14))) + "</body></html>" for i in range(300)]
    texts += [PAGE, "", "no tags at all", "<h2>Prepared</h2><p>open to the end", "<h2>Prepared</h2>", texts[3], texts[3]]
    found = got(spark, texts, **HEADS)
    for i, page in enumerate(texts):
        assert found[i] == want(page, **HEADS), page
    assert sum(len(x[3]) for x in found.values()) > 300 and sum(len(x[0]) for x in found.values()) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("tags", [("h1", "b"), ("p", "a"), ("title", "em")])
def test_pages_of_a_table(spark, tags):
    texts = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    options = dict(prepared="", qa="e", participants="", header_tag=tags[0], label_tag=tags[1])
    found = got(spark, texts, **options)
    for i, page in enumerate(texts):
        assert found[i] == want(page, **options), page


def test_null_pages_and_other_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "k"), (1, None, "k"), (None, PAGE, None)], "h1 long, html string, _h2 string")
    rows = pages.page_parts(df).collect()
    assert sorted((r.parts.error or "", len(r.parts.elements) > 0) for r in rows) == [("", True), ("", True), ("no page", False)]
    assert pages.page_parts(df.limit(0)).count() == 0


def test_the_walk_runs_no_python(spark):
    df = spark.createDataFrame([(1, PAGE)], "i long, html string")
    assert "Python" not in pages.page_parts(df)._jdf.queryExecution().executedPlan().toString().replace("existing", "")


def test_unescape(spark):
    texts = ["a &amp; b", "&lt;p&gt;", "&#233;&#xe9;&#X1F600;", "&nbsp;|", "&nosuch; & &amp", "&#0; &#xD800; &#1114112;", "&NotEqualTilde;", None, "", "&&amp;;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = {r.i: r.u for r in df.select("i", pages.unescape(F.col("t")).alias("u")).collect()}
    for i, x in enumerate(texts):
        if i not in (4, 5):  # names without a semicolon and numbers that are no characters stay as they are
            assert found[i] == (None if x is None else entities.unescape(x)), x
    assert found[4] == "&nosuch; & &amp" and found[5] == texts[5]
