"""Every registered query over nulls in any column, empty and long texts, repeats, clashing names and empty tables."""

import corpus_pipeline
import pytest

from quillspark.llm import queries

LONG = "word " * 60_000 + "x" * 40_000 + "\nanother line of it\n" + "é" * 30_000
TEXTS = [None, "", " ", "\n\n", "a", "mail a@b.co now", LONG, LONG, "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "\x00\x01�", "日本語 テキスト"]
DOCS = [(i, t, ["en", None, "fr"][i % 3], ["s", None][i % 2], None if i % 4 == 0 else 3, "k") for i, t in enumerate(TEXTS)]
DOCS += [(None, "no id here at all", None, None, None, None), (None, None, None, None, None, None), DOCS[4], DOCS[8]]
PAGES = [(1, "http://a.net/", "<p>x"), (None, None, None), (2, "http://a.net/", None), (2, "u", "<article><p>" + LONG + "</p></article>"), (2, "u", "<article><p>" + LONG + "</p></article>"), (5, None, "y" * 200), (4, "://", "y" * 200)]
ITEMS = [(1, "three four five six seven eight nine"), (1, "three four five six seven eight nine"), (None, None), (2, ""), (None, "word word")]
VECTORS = [(i, [((i * 7 + k * k) % 11 - 5) / 4 for k in range(32)], i % 2 or None, 1, "a") for i in range(20)]
VECTORS += [(None, [0.5] * 32, None, 1, "a"), (3, [0.5] * 32, 1, None, None), VECTORS[4], VECTORS[4], (30, None, 1, 1, "a"), (31, [None] * 32, 2, 1, "a"), (32, [float("nan")] * 32, 2, 1, "a"), (33, [float("inf")] + [0.0] * 31, 2, 1, "a")]
LABELS = [(1, 1, None, "a"), (1, 1, 0, "a"), (2, 0, 1, None), (4, None, 1, "a"), (None, 1, 1, "a"), (6, 5, 1, "a"), (8, 0, 0, "a"), (8, 1, 0, "a"), (9, 0, 1, "a"), (99, 1, 1, "a")]
QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}


def write(spark, at, docs, pages, items, vectors, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, component int, code string").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, q string").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, PAGES, ITEMS, VECTORS, LABELS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


ROWS = {"op1_url_filter": len(PAGES), "op5_warc": len(PAGES), "op9_html": len(PAGES), "op8_decontamination": 2, "op12_vector_codes": 24, "op13_whitening": 8 * 24}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name != "pipeline":
        assert len(rows) == ROWS.get(name, len(DOCS))
    else:
        assert 0 < len(rows) < len(DOCS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
