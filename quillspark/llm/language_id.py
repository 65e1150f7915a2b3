"""Language identification with string kernels.

The blended spectrum of a text is the set of all 1- to 3-grams of its letters, each hashed from its code points. The kernel
of two texts is the number of n-grams that both have, over the root of the product of their numbers. Nyström landmarks
give a finite feature map, one-versus-rest ridge regression the classifier, and texts are scored in batches: presence rows
times landmark rows, times coefficients. Learning goes over a bounded sample of whole texts in the same batches, so the
driver holds the landmarks' n-grams and one batch.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Sample, bounded_batches, least_of_each, slices

#: Labelled rows of each language to learn from and of all together (a bounded sample of whole texts), languages in the
#: sample at most (those with most rows), landmarks at least, and ridge.
SAMPLE, ROWS, LANGUAGES, LANDMARKS, RIDGE = 300, 12_000, 512, 192, 1e-3
#: Bits of an n-gram's hash.
BITS = 20
#: Lengths of the pieces of sampled texts that are learned beside the whole, so short texts are known too.
PIECES = (25, 80, 300)
SCORED = 256
#: Landmark n-grams that are multiplied at once.
COLUMNS = 1 << 13


@functools.cache
def is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


class Presence:
    """The n-grams of a text as flags."""

    def __init__(self) -> None:
        self.flags = np.zeros(1 << BITS, bool)

    def codes(self, text: str) -> np.ndarray | None:
        """Hashes of all 1- to 3-grams, repeats included; what is no letter is one gap. None without a letter."""
        c = points(text)
        c = np.where(is_letter()[c], c, 0)
        gap = c == 0
        if gap.all():
            return None
        c = c[~(gap & np.concatenate([[True], gap[:-1]]))]
        c = np.concatenate([[0], c[:-1] if c[-1] == 0 else c, [0]]).astype(np.uint32)
        odd, shift = np.uint32(0x9E3779B1), np.uint32(32 - BITS)
        one = (c + np.uint32(1)) * odd
        two = (one[:-1] ^ one[:-1] >> np.uint32(15)) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ two[:-1] >> np.uint32(13)) * np.uint32(0xC2B2AE3D) + one[2:]
        return np.concatenate([(x ^ x >> np.uint32(16)) * odd >> shift for x in (one, two, three)])

    def row(self, codes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, int]:
        """Which n-grams of ``among`` there are, and how many n-grams in all."""
        self.flags[codes] = True
        found, n = self.flags[among], int(np.count_nonzero(self.flags))
        self.flags[codes] = False
        return found, n


@dataclass
class Model:
    languages: list[str]
    among: np.ndarray  # the landmarks' n-grams
    landmarks: np.ndarray  # presence of each in each landmark
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks x languages

    def kernel(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        both = np.zeros((len(rows), len(self.landmarks)), np.float32)
        for i in range(0, len(self.among), COLUMNS):
            both += rows[:, i : i + COLUMNS].astype(np.float32) @ self.landmarks[:, i : i + COLUMNS].T.astype(np.float32)
        return both / np.sqrt(np.maximum(n, 1)).astype(np.float32)[:, None] / np.sqrt(self.sizes).astype(np.float32)

    def scores(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.kernel(rows, n) @ self.weights


def _pieces(rows: Iterable[tuple[str, str]], seed: int) -> Iterator[tuple[str, str]]:
    """Whole texts and pieces of them that have a letter, the same each time."""
    rng = np.random.default_rng(seed)
    for t, lang in rows:
        own = [t]
        for size in PIECES:
            if len(t) > size:
                at = int(rng.integers(0, len(t) - size + 1))
                own.append(t[at : at + size])
        for x in own:
            if is_letter()[points(x)].any():
                yield x, lang


def _batches(rows: Iterable[tuple[str, str]], size: int) -> Iterator[list[tuple[str, str]]]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def fit(texts: Iterable[str], languages: Iterable[str], seed: int = 11, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Learn from whole texts and pieces of them; None without any text that has a letter."""
    return learn(list(zip(texts, languages)), seed, landmarks, ridge)


def learn(rows: Iterable[tuple[str, str]], seed: int = 11, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Learn from ``rows`` (text, language), which are gone through three times: languages, landmarks, equations."""
    presence = Presence()
    said = [lang for _, lang in _pieces(rows, seed)]
    if not said:
        return None
    names = sorted(set(said))
    number = {name: k for k, name in enumerate(names)}
    y = np.array([number[lang] for lang in said])
    picked = np.random.default_rng(seed + 1).permutation(len(y))[:landmarks]
    missing = np.setdiff1d(np.arange(len(names)), y[picked])  # every language has a landmark
    picked = {*picked.tolist(), *(int(np.argmax(y == k)) for k in missing)}
    own = [np.unique(presence.codes(t)) for i, (t, _) in enumerate(_pieces(rows, seed)) if i in picked]
    among = np.unique(np.concatenate(own))
    held = np.stack([np.isin(among, x, assume_unique=True) for x in own])
    model = Model(names, among, held, np.array([len(x) for x in own]), np.zeros(0))
    k_mm = model.kernel(held, model.sizes).astype(np.float64)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    share = 1 / np.bincount(y, minlength=len(names))
    left, right = ridge * np.eye(int(keep.sum())), np.zeros((int(keep.sum()), len(names)))
    for batch in _batches(_pieces(rows, seed), SCORED):
        found, n = zip(*(presence.row(presence.codes(t), among) for t, _ in batch))
        k = np.array([number[lang] for _, lang in batch])
        phi = model.kernel(np.array(found), np.array(n)).astype(np.float64) @ root
        weighed = (phi * share[k, None]).T
        left += weighed @ phi
        right += weighed @ (k[:, None] == np.arange(len(names)))
    model.weights = (root @ np.linalg.solve(left, right)).astype(np.float32)
    return model


def held_out(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> Sample | None:
    """(lang, text) of at most ``sample`` different rows of each language that are not held out, and ROWS in all.

    Rows that repeat language, id and text are one. Places come from a hash; how far it may go for a language follows from
    its approximate number of different rows, and what is then too many is cut exactly.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    keyed = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(lang_col), F.col(id_col), F.col(text_col), F.lit(5)).alias("h"), F.col(text_col).alias("text"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    counts = {r["lang"]: r["n"] for r in sizes.orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, min(sample, ROWS // len(counts)))
    place = F.pmod("h", F.lit(1 << 30))
    far = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.3 * each + 20) / n) * (1 << 30))])
    some = least_of_each(keyed.where(place < far[F.col("lang")]), "h", "h")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    return Sample(some.withColumn("turn", turn).where(F.col("turn") <= each).select("lang", "h", "text"), "text", "h")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model learned from the ``sampled`` rows; None without any. Texts are learned whole."""
    rows = sampled(docs, id_col, text_col, lang_col, sample)
    if rows is None:
        return None
    model = learn(_Pairs(rows))
    rows.discard()
    return model


class _Pairs:
    """A sample as pairs (text, language)."""

    def __init__(self, rows: Sample) -> None:
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return ((r["text"], r["lang"]) for r in self.rows)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) per row, or ``docs`` with a struct (lang_pred, score) in the column ``keep``.

    Null texts and texts without a letter, and all texts without a model, get ``und`` and 0. Repeated rows and null ids
    are returned as they come.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        m = shared.value
        names, score = ["und"] * len(texts), [0.0] * len(texts)
        if m is None:
            return names, score
        presence, at, rows, counts = Presence(), [], [], []
        for i, t in enumerate(texts):
            codes = presence.codes(t) if t else None
            if codes is not None:
                row, n = presence.row(codes, m.among)
                at.append(i)
                rows.append(row)
                counts.append(n)
        if at:
            s = m.scores(np.array(rows), np.array(counts))
            for i, k, x in zip(at, s.argmax(1), np.clip(s.max(1), 0, 1)):
                names[i], score[i] = m.languages[k], float(x)
        return names, score

    if keep:

        @F.pandas_udf("lang_pred string, score double")
        def language(s: pd.Series) -> pd.DataFrame:
            parts = [predict(s.iloc[i : i + SCORED].tolist()) for i in range(0, len(s), SCORED)]
            return pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

        return docs.withColumn(keep, language(F.col(text_col)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SCORED):
            names, score = predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        rows, f"id {kind}, held_out boolean, lang_pred string, score double"
    )
