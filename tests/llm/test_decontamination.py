import random
import time

from quillspark.llm import decontamination as dec


def plain(items, text):
    """Every item against every passage, by shingles alone."""
    words, out = dec.words_of(text), {}
    size = max((len(dec.words_of(t)) for _, t in items), default=1)
    for i, t in items:
        own = dec.words_of(t)
        if not own:
            continue
        grams = dec.shingles(own)
        question, answer = dec.question_and_answer(t)
        best = 0.0
        for start in range(0, len(words), size):
            part = words[start : start + 3 * size]
            share = len(grams & dec.shingles(part)) / len(grams)
            have = set(part)
            if share >= 0.8 and len(question & have) >= 0.5 * len(question) and len(answer & have) >= 0.5 * len(answer):
                best = max(best, share)
        if best:
            out[i] = best
    return out


def cases(rng, n_items=60, n_docs=150):
    vocab = ["w%d" % i for i in range(40)] + ["rare%d" % i for i in range(900)]
    word = lambda: vocab[int(len(vocab) * rng.random() ** 3)]
    items = [(i, " ".join(word() + rng.choice(["", "", "", ".", "\n"]) for _ in range(rng.choice([1, 3, 6, 25, 50])))) for i in range(n_items)]
    docs = []
    for _ in range(n_docs):
        text = [word() for _ in range(rng.choice([0, 4, 200, 700]))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["x"], [part[k], "y"]])
                part = part or ["z"]
            at = rng.randint(0, len(text))
            text[at:at] = [p.upper() for p in part]
        docs.append(" ".join(text))
    return items, docs


def test_search_finds_what_every_pair_would():
    rng = random.Random(6)
    hits = 0
    for _ in range(3):
        items, docs = cases(rng)
        index = dec.Index(items)
        for text, got in zip(docs, index.search(docs)):
            want = plain(items, text)
            assert {index.items[k].item_id: x for k, x in got.items()} == want
            hits += len(want)
    assert hits > 100


def test_tables(spark):
    items, docs = cases(random.Random(8), 30, 60)
    rows = [(i, t, 0) for i, t in enumerate(docs)] + [(0, docs[0], 1), (None, docs[1], 1), (900, None, 1), (901, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items + [(500, None), (501, "..."), (None, "a b c d e f")], "item_id long, text string")
    want = sorted(((d, i, x) for d, t, _ in rows for i, x in plain(items, t).items()), key=str)
    for chars in (dec.INDEX_CHARS, 900):
        got = dec.contaminated(df, bench, chars=chars)
        if chars == dec.INDEX_CHARS:
            assert sorted(((r.doc_id, r.item_id, r.overlap) for r in got.collect()), key=str) == want
        clean = dec.clean(df, bench, chars=chars)
        if chars == dec.INDEX_CHARS:
            assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(d) for d, t, _ in rows if not plain(items, t))
            assert clean.columns == df.columns
        else:
            assert got.count() > 0 and clean.count() < len(rows)
    assert dec.contaminated(df, bench.limit(0)).count() == 0
    assert dec.contaminated(df.limit(0), bench).count() == 0
    assert dec.clean(df, bench.limit(0)).count() == len(rows)


def test_any_batches_find_the_same(monkeypatch):
    """Postings walked a few at a time, and texts searched one by one, give the same."""
    items, docs = cases(random.Random(11), 80, 60)
    want = dec.Index(items).search(docs)
    for postings, words, rest in ((1, 1, 0.8), (40, 700, 0.3), (1 << 20, 1, 0.99), (300, 200_000, 0.8)):
        monkeypatch.setattr(dec, "POSTINGS", postings)
        monkeypatch.setattr(dec, "WORDS", words)
        monkeypatch.setattr(dec, "REST", rest)
        assert dec.Index(items).search(docs) == want


def test_time_by_items_is_sublinear():
    """A hundred times the items take a few times as long: lists of frequent terms are skipped."""
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(30_000)]
    word = lambda: vocab[int(len(vocab) * rng.random() ** 4)]
    docs = [" ".join(word() for _ in range(400)) for _ in range(300)]
    took = []
    for n in (100, 10_000):
        index = dec.Index([(i, " ".join(word() for _ in range(30))) for i in range(n)])
        begun = time.perf_counter()
        index.search(docs)
        took.append(time.perf_counter() - begun)
    assert took[1] < 20 * took[0] + 0.2, took
