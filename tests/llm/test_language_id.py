import random
import subprocess
import sys
import zlib

import numpy as np

from quillspark.llm import language_id as li

WORDS = {"xx": "alpha beta gamma delta omega sigma theta", "yy": "über straße größe schön müde käse", "zz": "привет мир слово город река"}


def table():
    rows = []
    for i in range(240):
        lang = list(WORDS)[i % 3]
        own = WORDS[lang].split()
        rows.append((i, " ".join(own[(i * k) % len(own)] for k in range(1, 3 + i % 40)), lang, "clash", 1.0))
    return rows + [(1000, None, "xx", "", 0.0), (1001, "", "xx", "", 0.0), (1002, "123 ... 456", "yy", "", 0.0), (None, "größe schön über", None, "", 0.0), (6, "alpha beta gamma", "xx", "", 0.0), (6, "alpha beta gamma", "xx", "", 0.0)]


def test_held_out_accuracy(spark):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = li.train(df)
    got = li.identify(df, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.id if r.id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (truth[r.id] or "yy")
    kept = li.identify(df, model, keep="language")
    assert kept.columns == [*df.columns, "language"]
    assert sorted((str(r.doc_id), r.language.lang_pred) for r in kept.collect()) == sorted((str(r.id), r.lang_pred) for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "..", "xx")], "doc_id long, text string, lang string")
    for d in (df, df.limit(0)):
        assert all(r.lang_pred == "und" for r in li.identify(d, li.train(d)).collect())


def test_kernel_is_shared_ngrams():
    texts = ["Abc ab", "bca! ab..", "--x", "aaaa"]
    p = li.Presence()

    def grams(t):
        folded = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in t.lower()).split())} "
        return {folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)}

    codes = [set(p.codes(t).tolist()) for t in texts]
    for a in range(4):
        for b in range(4):
            assert len(codes[a] & codes[b]) == len(grams(texts[a]) & grams(texts[b])) and len(codes[a]) == len(grams(texts[a]))


def made(rng, letters, words=60):
    own = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(words)]
    return lambda n: " ".join(rng.choices(own, k=n))


def test_languages_of_one_block_of_letters():
    """Two languages whose letters lie in one block of ideographs are told apart, beside six that have alphabets."""
    rng = random.Random(3)
    speak = {f"a{k}": made(rng, "abcdefghijklmnopqrstuvwxyzäöüßéèñ") for k in range(6)}
    speak |= {"x1": made(rng, [chr(0x4E00 + k) for k in range(0, 120, 2)]), "x2": made(rng, [chr(0x4E00 + k) for k in range(1, 120, 2)])}
    rows = [(f(rng.randint(2, 60)), lang) for lang, f in speak.items() for _ in range(60)]
    model = li.fit([t for t, _ in rows], [lang for _, lang in rows])
    p = li.Presence()
    tried = [(f(rng.randint(3, 30)), lang) for lang, f in speak.items() for _ in range(25)]
    found, n = zip(*(p.row(p.codes(t), model.among) for t, _ in tried))
    got = model.scores(np.array(found), np.array(n)).argmax(1)
    right = [model.languages[k] == lang for k, (_, lang) in zip(got, tried)]
    assert sum(right[-50:]) == 50 and sum(right) >= 0.97 * len(right)


def test_many_languages_in_bounded_memory():
    """A hundred languages, with as many rows and characters as a sample may have, are learned in under a GB."""
    code = """
import random, resource
from tests.llm.test_language_id import li, made
rng = random.Random(1)
rows = [(f(20)[:3000], str(k)) for k in range(100) for f in [made(rng, [chr(0x61 + i) for i in range(26)] + [chr(0x400 + k + i) for i in range(9)])] for _ in range(60)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model = li.fit([t for t, _ in rows], [x for _, x in rows])
assert len(model.languages) == 100
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 800


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    """Rows that repeat are one, however many there are; texts come whole."""
    monkeypatch.setattr(li, "ROWS", 3 * 40)
    words = {k: v.split() for k, v in WORDS.items()}
    rows = [(i, " ".join(words[lang][(i + k) % len(words[lang])] for k in range(300)), lang) for i in range(600) for lang in [list(WORDS)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = df.unionByName(df.where("doc_id in (1, 4)").crossJoin(spark.range(200_000)).drop("id"))
    got = [(r["lang"], r["text"]) for r in li.sampled(many, "doc_id", "text", "lang", 300)]
    assert {lang: sum(x == lang for x, _ in got) for lang in WORDS} == dict.fromkeys(WORDS, 40)
    assert {t for _, t in got} <= {t for _, t, _ in rows} and len(set(got)) > 10
    assert li.sampled(df.limit(0), "doc_id", "text", "lang", 300) is None


def test_a_row_repeated_a_million_times(spark):
    few = spark.createDataFrame([(i, f"alpha beta {i}", "xx") for i in range(2000)], "doc_id long, text string, lang string")
    many = few.unionByName(spark.range(1_000_000).selectExpr("7L as doc_id", "'gamma delta' as text", "'xx' as lang"))
    got = [r["text"] for r in li.sampled(many, "doc_id", "text", "lang", 300)]
    assert len(got) == 300 and got.count("gamma delta") <= 1


def test_many_languages_take_part_by_size(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 5)
    df = spark.createDataFrame([(k * 100 + i, f"{chr(97 + k) * 3} {i}", f"l{k}") for k in range(8) for i in range(10 + 5 * k)], "doc_id long, text string, lang string")
    assert {r["lang"] for r in li.sampled(df, "doc_id", "text", "lang", 300)} == {f"l{k}" for k in range(3, 8)}
    assert li.train(df).languages == [f"l{k}" for k in range(3, 8)]
