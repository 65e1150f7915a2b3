import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import vector_codes as vc
from quillspark.llm import whitening
from quillspark.llm.vectors import sound

KIND = "vec_id long, embedding array<float>, label int, id string, x double"


def vectors(n, size, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)).astype(np.float32) / 4 + rng.integers(0, 5, (n, 1)) / 8
    x[n // 3 :][: n // 3] = x[n // 3]  # a third are copies
    return [(i, [float(v) for v in x[i]], i % 4 or None, "clash", 0.0) for i in range(n)]


def plain_codes(rows, parts, entries, rounds):
    """Every distance of every round."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = np.array([[int(np.floor(256 * v)) for v in r[1]] for r in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    nearest = lambda p: ((x[:, p, None] - books[p]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p).argmin(1)
            for e in range(books.shape[1]):
                if (own == e).any():
                    books[p, e] = x[own == e, p].sum(0) // (own == e).sum()
    d = [nearest(p) for p in range(parts)]
    codes, error = np.stack([m.argmin(1) for m in d], 1), sum(m.min(1) for m in d)
    of = {}
    for r, e in zip(rows, error):
        of[r[2]] = of.get(r[2], 0) + int(e)
    return sorted((r[0], bytes(c.tolist()).hex(), int(e), of[r[2]]) for r, c, e in zip(rows, codes, error)), books


@pytest.mark.parametrize("n, size, parts, entries, rounds", [(700, 32, 16, 64, 2), (400, 12, 4, 30, 5), (9, 16, 16, 64, 2), (1, 16, 16, 64, 2), (300, 8, 2, 5, 3)])
def test_codes_are_those_of_all_distances(spark, n, size, parts, entries, rounds):
    rows = vectors(n, size)
    df = spark.createDataFrame(rows + [(10_000, None, 1, "", 0.0), (10_001, [float("nan")] * size, 1, "", 0.0)], KIND)
    done, books = vc.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, plain = plain_codes(rows, parts, entries, rounds)
    assert sorted((r.id, bytes(r.code).hex(), r.error, r.label_error) for r in done.collect()) == want
    assert (books == plain).all()
    assert vc.books_digest(books) == hashlib.sha256(",".join(str(v) for v in plain.ravel()).encode()).hexdigest()


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 4)) * 40 + rng.integers(0, 6, (3000, 1)) * 60)
    book = x[:64].copy()
    group = vc.groups_of(book.astype(np.int64))
    code, low, _, every = vc.assign(x, book, group, None, None, None)
    assert every == 3000 * 64
    for _ in range(3):
        new = np.stack([np.floor(x[code == e].mean(0)) if (code == e).any() else book[e] for e in range(64)])
        moved, book = np.sqrt(((new - book) ** 2).sum(1)), new
        code, low, d, computed = vc.assign(x, book, group, code, low, moved)
        every = ((x[:, None] - book) ** 2).sum(2)
        assert (code == every.argmin(1)).all() and (d == every.min(1)).all() and computed < 3000 * 64 * 0.7
        others = np.where(np.arange(64) == code[:, None], np.inf, every)
        for g in range(group.max() + 1):
            assert (low[:, g].astype(np.float64) <= np.sqrt(others[:, group == g].min(1)) + 1e-9).all()


def test_many_labels_sum_the_same(spark):
    rows = spark.createDataFrame([(i, [None, 1, 1, 1, 2][i % 5], bytes([i % 7]), i) for i in range(200)], "id long, label int, code binary, error long")
    got = [sorted(map(str, vc.label_sums(rows, n).collect())) for n in (100, 0)]
    assert got[0] == got[1] and len(got[0]) == 200


def test_unequal_lengths_raise(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], "vec_id long, embedding array<float>, label int")
    for f in (vc.compress, whitening.whiten):
        with pytest.raises(ValueError):
            f(df)
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id long, embedding array<float>, label int"))


def plain_whitening(rows, k):
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return ((n * x - s) ** 2).sum(1), e, c @ u[:, :k], np.trace(v)


@pytest.mark.parametrize("size", [12, 5])
def test_whitening_is_numpys(spark, size):
    rows = vectors(500, size)
    df = spark.createDataFrame([*rows, (None, None, 1, "", 0.0), (10_001, [float("inf")] * size, 1, "", 0.0)], KIND).repartition(5)
    k = min(8, size)
    deviation, e, onto, trace = plain_whitening(rows, k)
    got = whitening.whiten(df).collect()
    assert len(got) == 500 * k
    for r in got:
        i, c = r.id, r.component - 1
        assert int(r.deviation) == deviation[i] and r.n == 500 and r.identity_error < 1e-6
        assert abs(abs(r.whitened) - abs(onto[i, c]) / np.sqrt(e[c])) < 1e-8
        assert abs(r.explained - e[c] / trace) < 1e-10
    signs = {}
    for r in got:
        if abs(r.whitened) > 1e-6:
            signs.setdefault(r.component, set()).add(bool(r.whitened * onto[r.id, r.component - 1] > 0))
    assert all(len(s) == 1 for s in signs.values())


def test_axes_without_spread(spark):
    flat = [(i, [float(i), 1.0, 2.0, 2.0 * i], 1, "", 0.0) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(flat, KIND)).collect()
    assert {r.component: r.whitened for r in got if r.id == 3}[2] == 0.0 and all(abs(r.identity_error) < 1e-9 for r in got)
    same = whitening.whiten(spark.createDataFrame([flat[0]] * 4, KIND)).collect()
    assert len(same) == 16 and all((r.whitened, r.explained, r.identity_error, int(r.deviation)) == (0.0, 0.0, 0.0, 0) for r in same)


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(i % 2) * 2e6] * 4, 1, "", 0.0) for i in range(3)]
    x = np.array([[int(v * 1024) + 100_000 for v in r[1]] for r in rows], object)
    want = (((3 * x - x.sum(0)) ** 2).sum(1)).tolist()
    got = whitening.whiten(spark.createDataFrame(rows, KIND), components=1).collect()
    assert max(want) > 2**63 and sorted(int(r.deviation) for r in got) == sorted(want)


def test_sound(spark):
    df = spark.createDataFrame([([1.0],), ([],), (None,), ([None],), ([float("nan")],), ([float("-inf"), 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(sound(F.col("v"))).collect()] == [True, True, False, False, False, False]
