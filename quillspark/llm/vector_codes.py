"""Vector compression by product quantisation, with Yinyang's bounds in place of most distances.

Vectors of whole numbers are cut into PARTS parts, and every part position has a codebook of ENTRIES entries. A round of
Lloyd's algorithm assigns each part to its nearest entry and moves entries to the means of their parts. The entries of a
codebook are clustered into groups. A row keeps, for every part and group, one lower bound of the distance to the group's
entries other than its own; when entries move, the bound falls by the farthest that one of the group drifted. Only groups whose bound no longer
exceeds the distance to the row's own entry are scanned. Distances are whole numbers, exact in a double, so ties are
decided by whole numbers too: the lower entry wins. Bounds are rounded down.

Rounds read and write tables, so a lost executor repeats no earlier round. The driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, table
from .vectors import matrix, shape, sound, summed, whole_numbers

#: A component's whole number is floor(SCALE * component).
SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a group on average.
GROUP = 10
#: Different labels whose sums are broadcast at most; more are joined by shuffles, rows of a label dealt out by SALT.
LABELS, SALT = 100_000, 64
#: Most that a stored bound can be.
MOST = float(np.finfo(np.float16).max)


def groups_of(book: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each entry of a codebook: clusters around entries that lie far apart."""
    n = max(1, len(book) // GROUP)
    centres = [book[0]]
    for _ in range(n - 1):
        centres.append(book[((book[:, None] - np.array(centres)) ** 2).sum(2).min(1).argmax()])
    centres = np.array(centres, np.float64)
    for _ in range(rounds):
        own = ((book[:, None] - centres) ** 2).sum(2).argmin(1)
        for g in np.unique(own):
            centres[g] = book[own == g].mean(0)
    return own


def _down(distance: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are no greater."""
    low = np.clip(distance * (1 - 1e-9), 0, MOST)
    half = low.astype(np.float16)
    return np.where(half > low, np.nextafter(half, np.float16(-np.inf)), half)


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, code: np.ndarray | None, bound: np.ndarray | None, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entries, lower bounds by group, squared distances, distances computed) of parts ``x``, whole numbers in doubles.

    ``code`` and ``bound`` are those of the round before, ``moved`` how far each entry has moved since; None at first.
    """
    n, entries, k = len(x), len(book), int(group.max()) + 1
    at = np.arange(n)
    if code is None:
        best, low, scans = np.full(n, np.iinfo(np.int64).max), np.zeros((n, k)), np.ones((n, k), bool)
    else:
        drift = np.array([moved[group == g].max() for g in range(k)])
        own = ((x - book[code]) ** 2).sum(1)
        best = own.astype(np.int64) * entries + code  # a distance and its entry: the least is the nearest, ties to the lower entry
        low = bound.astype(np.float64) - drift * (1 + 1e-9)
        scans = low <= (np.sqrt(own) * (1 + 1e-9))[:, None]
    first, second = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.iinfo(np.int64).max)
    for g in range(k):
        rows, mine = np.flatnonzero(scans[:, g]), np.flatnonzero(group == g)
        if rows.size:
            some, of = x[rows], book[mine]
            d = (some * some).sum(1)[:, None] - 2 * (some @ of.T) + (of * of).sum(1)
            keys = d.astype(np.int64) * entries + mine
            nearest = keys.argmin(1)
            first[rows, g] = keys[np.arange(len(rows)), nearest]
            keys[np.arange(len(rows)), nearest] = np.iinfo(np.int64).max
            second[rows, g] = keys.min(1)
    best = np.minimum(best, first.min(1))
    new = (best % entries).astype(np.int64)
    # of the own entry's group the bound is that of the others
    own_first = first[at, group[new]] == best
    first[at[own_first], group[new[own_first]]] = second[at[own_first], group[new[own_first]]]
    exact = np.where(first == np.iinfo(np.int64).max, np.inf, np.sqrt((first // entries).astype(np.float64)))
    low = np.where(scans, exact, low)
    if code is not None:  # the entry that was left is now one of its group's others
        low[at, group[code]] = np.where(new != code, np.minimum(low[at, group[code]], np.sqrt(own)), low[at, group[code]])
    return new, _down(low), best // entries, int((scans.sum(0) * np.bincount(group, minlength=k)).sum())


def _assigned(rows: DataFrame, books: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None, last: bool) -> DataFrame:
    """``rows`` (id, label, x, and from the second round code and bounds) with new codes; at ``last`` the error, else x and new bounds."""
    parts, entries, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, groups, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, groups, moved = shared.value
        of = [int(g.max()) + 1 for g in groups]
        begin = np.cumsum([0, *of])
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = matrix(b.column("x"), parts * size).astype(np.float64)
            codes, bounds, error = np.zeros((n, parts), np.uint8), np.zeros((n, begin[-1]), np.float16), np.zeros(n, np.int64)
            old = None if moved is None else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
            low = None if moved is None else np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.float16).reshape(n, begin[-1])
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                before = (None,) * 3 if moved is None else (old[:, p].astype(np.int64), low[:, begin[p] : begin[p + 1]], moved[p])
                codes[:, p], bounds[:, begin[p] : begin[p + 1]], d, _ = assign(own, books[p], groups[p], *before)
                error += d
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            more = [pa.array(error)] if last else [pa.array([c.tobytes() for c in bounds], pa.binary()), b.column("x")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), code, *more], ["id", "label", "code", *(["error"] if last else ["bounds", "x"])])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    tail = "error long" if last else f"bounds binary, x {kinds['x']}"
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, {tail}")


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the mean of its parts, unused ones as they are."""
    parts, entries, size = books.shape

    def partial(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column("x"), parts * size).reshape(-1, parts, size)
        codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
        total = np.zeros((parts * entries, size + 1), np.int64)
        at = (codes + np.arange(parts) * entries).ravel()
        np.add.at(total, at, np.concatenate([x.reshape(-1, size), np.ones((len(at), 1), np.int64)], 1))
        return total.ravel()

    total = summed(rows.select("x", "code"), partial, parts * entries * (size + 1)).reshape(parts, entries, size + 1)
    out = books.copy()
    for p, e in zip(*np.nonzero(total[:, :, size])):
        out[p, e] = [s // total[p, e, size] for s in total[p, e, :size]]
    return out


def label_sums(rows: DataFrame, labels: int = LABELS) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over rows of the same label; nulls are one label."""
    sums = table(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "sums")
    other = sums.select(F.col("label").alias("other"), "label_error")
    if sums.count() <= labels:
        return rows.join(F.broadcast(other), F.col("label").eqNullSafe(F.col("other"))).drop("other")
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = rows.withColumn("_turn", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int"))
    return own.join(salted, F.col("label").eqNullSafe(F.col("other")) & (F.col("_turn") == F.col("_salt"))).drop("other", "_salt", "_turn")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of each sound vector, and the codebooks (parts x entries x components).

    Vectors that are null or hold null or non-finite components are left out; all others have to be of one length, a
    multiple of ``parts``. Codebooks begin as the vectors of the ``entries`` least ids (equal ids by vector, null ids
    last); of fewer vectors all are entries. A code is one byte a part, so there are at most 256 entries. Repeated rows
    count each; an empty table gives no row. Raises where squared distances of parts do not fit in a double.
    """
    spark = df.sparkSession
    x = whole_numbers(F.col(vector_col), SCALE)
    rows = table(df.where(sound(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")), "whole")
    n, length, top = shape(rows, "x")
    if length % parts:
        raise ValueError(f"{length} components are no multiple of {parts}")
    size = length // parts
    if not n or not size:
        empty = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
        return spark.createDataFrame([], f"{empty}, code binary, error long, label_error long"), np.zeros((parts, 0, size), np.int64)
    if 4 * size * top * top * entries >= 1 << 53:
        raise ValueError(f"components of up to {top / SCALE} are too great")
    least = rows.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([r["x"] for r in least], np.int64).reshape(-1, parts, size).transpose(1, 0, 2)
    groups = [groups_of(b) for b in books]
    bounded_batches(spark)
    moved = None
    for k in range(rounds):
        now = table(_assigned(rows, books, groups, moved, False), f"round{k}")
        discard(rows)
        new = _moved(now, books)
        moved = np.sqrt(((new - books) ** 2).sum(2).astype(np.float64))
        rows, books = now, new
    done = table(_assigned(rows, books, groups, moved, True), "codes")
    discard(rows)
    return label_sums(done), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
