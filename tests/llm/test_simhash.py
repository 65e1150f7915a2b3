import random

import numpy as np
import xxhash

from quillspark.llm import buckets, simhash_dedup


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] if word else words, ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, bits):
    parent = {i: i for i in range(len(fps))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    for k in range(60):
        text = "".join(rng.choices("aAbBé \n\x0b\u00a0", k=rng.randint(0, 90)))
        assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)
    assert simhash_dedup.fingerprint(None) == 0


def fixture(rng, n=220):
    words = ["w%d" % i for i in range(50)]
    out = [None, "", "  ", "one", "one two three"]
    while len(out) < n:
        base = rng.choices(words, k=rng.choice([3, 30, 120]))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 5])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_near_duplicates(spark):
    texts = fixture(random.Random(2))
    fps = [plain_fingerprint(t) for t in texts]
    rows = [(i, t, 0, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, fp string")
    got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, plain_components(fps, 4)))}


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (5, None)], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in simhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (None, None), (5, 5)], key=str)
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_links_through_rows_without_an_id(spark, monkeypatch):
    """Two documents that only a row without an id joins are one group."""
    prints = [(1, 0b0), (None, 0b1111), (2, 0b11111111), (None, 1 << 60 | 0b1111), (None, 0xFFFF << 40)]
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, i, t: docs)
    got = sorted(((r.fp, r.component_id) for r in simhash_dedup.near_duplicates(spark.createDataFrame(prints, "id long, fp long")).collect()))
    assert got == [(0b0, 1), (0b1111, 1), (0b11111111, 1), (0xFFFF << 40, None), (1 << 60 | 0b1111, 1)]


def test_one_row_of_each_group(spark):
    """By row: repeated ids with other texts, repeated rows and rows without an id are judged like any other."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "some quite other words stand in this text", "and a third one that is like neither of them")
    rows = [(5, a, "x"), (2, b, "x"), (5, b, "y"), (5, a, "z"), (None, a, "n"), (None, c, "n"), (None, c, "m"), (9, None, "p"), (9, None, "p"), (None, "", "q")]
    got = simhash_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string, _id string"))
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert got.columns == ["doc_id", "text", "_id"]
    assert found == sorted([(2, b), (5, a), (None, c), (9, None)], key=str)
    assert simhash_dedup.dedup_documents(got.limit(0)).count() == 0


def test_large_buckets_and_all_plans(spark, monkeypatch):
    """Dense balls of fingerprints, with chunks so small that buckets are dealt out as pairs of chunks."""
    rng = random.Random(5)
    fps = {0}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        base = rng.getrandbits(64)
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(base)
    fps = sorted(fps)
    want = plain_components(fps, 4)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    from quillspark.llm.components import components

    for chunk, n, sampled in ((buckets.CHUNK, len(fps), 64), (10, len(fps), 64), (10, len(fps), 1), (20, len(fps), 4), (buckets.CHUNK, 10**7, 64), (buckets.CHUNK, 10**13, 64)):
        monkeypatch.setattr(buckets, "SAMPLED", sampled)
        found = {r.node: r.component for r in components(buckets.near_links(df, 4, n, chunk)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want


def test_whole_keys(monkeypatch):
    """Keys stay together however batches fall, and large ones are passed on in any number of parts."""
    import pyarrow as pa

    rng = random.Random(7)
    for _ in range(200):
        monkeypatch.setattr(buckets, "HELD", rng.choice([1, 5, 20]))
        chunk = rng.choice([None, 2, 6])
        keys = [k * 1000 for k in range(12) for _ in range(rng.choice([1, 1, 3, 9, 40]))]
        keys = sorted((k & ~buckets.TILE) | (buckets.TILE if k // 1000 % 3 == 0 else 0) for k in keys)
        batches, i = [], 0
        while i < len(keys):
            n = rng.randint(0, 8)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[i : i + n], pa.int64()), pa.array(range(i, min(i + n, len(keys))), pa.int64())], ["key", "id"]))
            i += n
        seen, ids, flags = {}, [], {}
        for part, (t, large) in enumerate(buckets.whole_keys(iter(batches), chunk)):
            assert t.num_rows
            ids += t.column("id").to_pylist()
            for k in t.column("key").to_pylist():
                flags.setdefault(k, large)
                assert flags[k] == large and (large or seen.setdefault(k, part) == part)
        assert sorted(ids) == list(range(len(keys)))
        for k, large in flags.items():
            assert large == (chunk is not None and keys.count(k) > chunk and not k & buckets.TILE)
