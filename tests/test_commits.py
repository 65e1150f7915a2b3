import threading

import pytest

from quillspark.sources import commits, errors, stage
from quillspark.sources.transcripts import read_or_errors


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def tuples(df):
    return sorted(map(tuple, df.collect()))


def test_append_reads_only_what_is_committed(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    assert commits.read_table(spark, at) is None and commits.version(spark, at) == 0
    assert tuples(commits.append(rows(spark, ("a", 1), ("b", 2)), at, ["k"])) == [("a", 1), ("b", 2)]
    assert tuples(commits.append(rows(spark, ("b", 9), ("c", 3)), at, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits._Files, "put", killed)
        with pytest.raises(KeyboardInterrupt):
            commits.append(rows(spark, ("d", 4)), at, ["k"])
    assert len(list(tmp_path.glob("t/data-*"))) == 3
    assert tuples(commits.read_table(spark, at)) == [("a", 1), ("b", 2), ("c", 3)] and commits.version(spark, at) == 2
    assert commits.clean(spark, at) == 0 and commits.clean(spark, at, older_than=-1) == 1
    assert tuples(commits.append(rows(spark, ("d", 4)), at, ["k"])) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert commits.append(rows(spark, ("d", 5)), at, ["k"]).count() == 4 and commits.version(spark, at) == 3


def test_two_runs_at_once_add_no_key_twice(spark, tmp_path, monkeypatch):
    at, meet = f"{tmp_path}/t", threading.Barrier(2)
    write, met = commits._write, set()

    def together(df, path, batch):
        out = write(df, path, batch)
        if threading.get_ident() not in met:
            met.add(threading.get_ident())
            meet.wait(60)  # both have looked at the table before either commits
        return out

    monkeypatch.setattr(commits, "_write", together)
    failed = []

    def run(*pairs):
        try:
            commits.append(rows(spark, *pairs), at, ["k"])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=a) for a in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)])]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    got = tuples(commits.read_table(spark, at))
    assert not failed and [k for k, _ in got] == ["a", "b", "c"] and commits.version(spark, at) == 2


def test_batches_count_once_and_null_keys_are_new(spark, tmp_path):
    at = f"{tmp_path}/t"
    for _ in range(2):
        commits.append(rows(spark, ("a", 1)), at, batch="7")
    assert tuples(commits.append(rows(spark, ("a", 1)), at, batch="8")) == [("a", 1), ("a", 1)]
    commits.append(rows(spark, (None, 1)), at, ["k"])
    assert commits.append(rows(spark, (None, 1)), at, ["k"]).count() == 4
    assert commits.append(rows(spark, ("a", 1)).limit(0), at, batch="9").count() == 4


def test_replace_compact_and_new_columns(spark, tmp_path):
    at = f"{tmp_path}/t"
    commits.append(rows(spark, ("a", 1)), at, ["k"], batch="x")
    commits.append(rows(spark, ("b", 1)).withColumnRenamed("v", "w"), at, ["k"])
    assert sorted(map(str, commits.read_table(spark, at).select("k", "v", "w").collect())) == ["Row(k='a', v=1, w=None)", "Row(k='b', v=None, w=1)"]
    assert commits.compact(spark, at).count() == 2 and commits.append(rows(spark, ("z", 1)), at, batch="x").count() == 2
    assert tuples(commits.replace(rows(spark, ("c", 3)), at)) == [("c", 3)] and tuples(commits.read_table(spark, at)) == [("c", 3)]
    assert commits.append(rows(spark).limit(0), f"{tmp_path}/empty", ["k"]).columns == ["k", "v"]


def test_faults(spark):
    good, bad = errors.divided(rows(spark, ("a", 1), (None, 2), ("c", None), (None, None)), errors.missing(["k", "v"]))
    assert tuples(good) == [("a", 1)] and sorted(r.error for r in bad.collect()) == ["no k", "no k", "no v"]


def test_unreadable_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ticker": "C", "qa_ceo": ["x"]}')
    (tmp_path / "b.json").write_text('{"ticker": "D", ')
    good, bad = read_or_errors(spark, str(tmp_path))
    assert [r.ticker for r in good.collect()] == ["C"] and "_corrupt" not in good.columns
    assert [(r.path.split("/")[-1], r.record, r.error) for r in bad.collect()] == [("b.json", '{"ticker": "D", ', "unreadable JSON")]


def test_scopes_delete_what_is_not_kept(spark):
    with stage.scope() as outer:
        with stage.scope() as own:
            a, b = stage.staged(spark.range(3), "a"), stage.staged(spark.range(4), "b")
            own.keep(b)
        assert b.count() == 4
        with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST"):
            a.count()
    with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST"):
        b.count()
    assert spark.conf.get(stage.CLEANUP, "false") == "false" and not outer.tables[1:]
