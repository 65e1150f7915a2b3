"""Registered queries against their SQL twins, and against plain versions, on the smallest tables."""

import hashlib
import os

import duckdb
import pytest

from quillspark.llm import queries

from .test_pii import plain as plain_spans
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def documents(spark):
    return {r.doc_id: r.text for r in queries.read(spark, SF, "documents").collect()}


def test_op2_is_the_library(spark):
    from tokenizers import Tokenizer

    t, docs = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), documents(spark)
    rows = queries.op2_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = t.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op3_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in queries.read(spark, SF, "documents").collect()}
    held = [r for r in queries.op3_language_id(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def test_op4_is_the_plain_patterns(spark):
    docs = documents(spark)
    for r in queries.op4_pii(spark, SF).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_op6_round_trip(spark):
    docs = documents(spark)
    by_text = {}
    for r in queries.op6_audio(spark, SF).collect():
        data = (docs[r.doc_id] or "").encode()
        payload = data + b" " * (192 - len(data) if len(data) < 192 else -len(data) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert by_text.setdefault(payload, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)


def test_op7_is_every_pair(spark):
    docs = sorted(documents(spark).items())
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {docs[i][0]: (f"{f:016x}", docs[c][0]) for i, (f, c) in enumerate(zip(fps, plain_components(fps, 4)))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, SF).collect()} == want


def test_op10_keeps_one_of_each_line(spark):
    docs = documents(spark)
    rows = queries.op10_line_dedup(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        lines, gone = (docs[r.doc_id] or "").split("\n"), {int(x) for x in r.removed_lines.split(",") if x}
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert (r.n_lines, r.n_removed, r.n_chars_left, r.text_sha256) == (len(lines), len(gone), len(left), hashlib.sha256(left.encode()).hexdigest())


def test_op11_held_out_labels(spark):
    truth = {r.doc_id: r.quality for r in queries.read(spark, SF, "labels").collect()}
    rows = queries.op11_quality(spark, SF).collect()
    assert {r.held_out for r in rows} == {False, True} and all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.85 * len(held) > 0
