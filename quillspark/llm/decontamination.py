"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

Items' term weights are divided by the least score that a passage can have which passes verification, so one threshold,
1, retrieves every passage and item that verification could accept. Block-max WAND, for many passages at a time: an item's
terms are ordered by how many items have them, and its pivot is where those that are left no longer sum to REST. Only
postings before the pivot are walked, so the lists of frequent terms are skipped but for the items that have nothing
rarer. A block that they do not lift to the threshold, with all else that it could have, is skipped; of the others the
other terms are looked up by bisection, with the block's greatest weights. What is left is scored in full and verified
by its 5-word shingles and by question and answer words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Words of a shingle, share of an item's shingles, and share of the words of its question and of its answer.
SHINGLE, SIMILARITY, PART_OVERLAP = 5, 0.8, 0.5
K1, B, BLOCK = 1.2, 0.75, 2
#: Test items that are broadcast at once; a larger benchmark is applied in parts.
INDEX_CHARS = 16 << 20
#: What the terms from an item's pivot on may sum to, of the threshold of 1.
REST = 0.8
#: Words of texts that are searched together, and postings walked at once.
WORDS, POSTINGS = 200_000, 1 << 20
_WORD = re.compile(r"\w+")
_STOP = re.compile(r"[\n.!?]+\s*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list) -> set[tuple]:
    """Distinct shingles; a shorter text is one shingle, one without words has none."""
    return set(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)} - {()}


def question_and_answer(text: str) -> tuple[set[str], set[str]]:
    """Words before and in the last sentence or line; of a single one, all words are both."""
    parts = [p for p in _STOP.split(text) if words_of(p)]
    return set(words_of(" ".join(parts[:-1]) or text)), set(words_of(parts[-1] if parts else ""))


@dataclass(slots=True)
class Item:
    item_id: int | None
    words: list[int]  # numbers of its terms, in order
    question: list[int]
    answer: list[int]
    terms: list[int]
    weights: list[float]


class Index:
    """Items without words are left out: nothing can contain them.

    An item of fewer than five words is one shingle, and so found where a passage's words are the item's and no more.
    """

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        found = [(i, t, w) for i, t in items if (w := words_of(t))]
        found.sort(key=lambda x: (str(x[0]), x[1]))
        df: Counter[str] = Counter(w for _, _, ws in found for w in set(ws))
        self.vocabulary = {w: k for k, w in enumerate(sorted(df))}
        n, mean = len(found), sum(len(w) for *_, w in found) / max(1, len(found))
        self.longest = max((len(w) for *_, w in found), default=1)
        number = self.vocabulary.__getitem__
        self.items: list[Item] = []
        for i, t, ws in found:
            tf, grams = Counter(ws), shingles(ws)
            idf = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) for w in tf}
            own = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in tf.items()}
            # a shingle that is missing takes one word at most with it
            lost = len(grams) - math.ceil(SIMILARITY * len(grams) - 1e-9)
            least = sum(sorted(own.values())[: len(own) - lost]) if lost < len(own) else 0.0
            scale = (1 + 1e-9) / max(least, 1e-9)
            question, answer = ([number(w) for w in p] for p in question_and_answer(t))
            self.items.append(Item(i, [number(w) for w in ws], question, answer, [number(w) for w in own], [x * scale for x in own.values()]))
        self._blocks(np.array([df[w] for w in self.vocabulary]))

    def _blocks(self, df: np.ndarray) -> None:
        """Lists of (block, greatest weight there) of every term before its items' pivots, and of all terms by block."""
        self.blocks, size = max(1, -(-len(self.items) // BLOCK)), len(self.vocabulary)
        before, self.rest = [], np.zeros(self.blocks)
        for k, x in enumerate(self.items):
            left = sum(x.weights)
            for t, w in sorted(zip(x.terms, x.weights), key=lambda z: (df[z[0]], z[0])):
                if left < REST:
                    break
                left -= w
                before.append((t, k // BLOCK, w))
            # what one item can have beside the terms that were counted for its block
            self.rest[k // BLOCK] = max(self.rest[k // BLOCK], left + 1e-9)
        term = np.array([t for t, *_ in before], np.int64)
        key, at = np.unique(term * self.blocks + np.array([b for _, b, _ in before], np.int64), return_inverse=True)
        self.walk_weight = np.zeros(len(key))
        np.maximum.at(self.walk_weight, at, np.array([w for *_, w in before]))
        term, self.walk_block = np.divmod(key, self.blocks)
        self.first = np.searchsorted(term, np.arange(size + 1))
        self.length = np.diff(self.first)
        term = np.array([t for x in self.items for t in x.terms], np.int64)
        block = np.repeat(np.arange(len(self.items)) // BLOCK, [len(x.terms) for x in self.items])
        key, at = np.unique(block * max(1, size) + term, return_inverse=True)
        self.weight = np.zeros(len(key))
        np.maximum.at(self.weight, at, np.array([w for x in self.items for w in x.weights]))
        block, self.term = np.divmod(key, max(1, size))
        self.begin = np.searchsorted(block, np.arange(self.blocks + 1))

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, first word, block) whose bound reaches the threshold; texts are term numbers, -1 for others.

        A passage is three stretches of the longest item's length, and one begins at every stretch.
        """
        size, n = self.longest, np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(-(-n // size) + 2)])
        if not self.items or not n.sum():
            return []
        cell = np.concatenate([f + np.arange(len(t)) // size for f, t in zip(first.tolist(), texts)])
        term = np.concatenate(texts)
        cell, term = cell[term >= 0], term[term >= 0]
        walked = self.length[term] > 0
        found = list(self._walked(cell[walked], term[walked]))
        if not found:
            return []
        passage, block = np.divmod(np.unique(np.concatenate(found)), self.blocks)
        text = np.searchsorted(first, passage, "right") - 1
        start = (passage - first[text]) * size
        real = (passage >= 0) & (start < n[text])
        passage, block, text, start = passage[real], block[real], text[real], start[real]
        high = self._bounds(cell, term, passage, block) >= 1
        return list(zip(text[high].tolist(), start[high].tolist(), block[high].tolist()))

    def _walked(self, cell: np.ndarray, term: np.ndarray) -> Iterator[np.ndarray]:
        """Keys (passage, block) that terms before the pivots lift high enough; cells rise, and some POSTINGS are walked at once."""
        cost = np.cumsum(self.length[term])
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + POSTINGS, "right")))
            stop = int(np.searchsorted(cell, cell[stop - 1], "right"))
            # a passage has the two cells after its own too
            lo, hi = (int(np.searchsorted(cell, cell[i] + d, "left")) for i, d in ((at, 0), (stop - 1, 3)))
            n = self.length[term[lo:hi]]
            posting = np.repeat(self.first[term[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place, block, weight = np.repeat(cell[lo:hi], n), self.walk_block[posting], self.walk_weight[posting]
            # passages that begin in the cells from the first one's two before to the last one's own
            base, end = int(cell[at]) - 2, int(cell[stop - 1]) + 1
            key = np.concatenate([(place - k - base) * self.blocks + block for k in range(3)])
            keep = (key >= 0) & (key < (end - base) * self.blocks)
            key, weight = key[keep], np.tile(weight, 3)[keep]
            if (end - base) * self.blocks <= 4 * len(key):
                sums = np.bincount(key, weight, (end - base) * self.blocks)
                own = np.flatnonzero(sums)
                sums = sums[own]
            else:
                own, place = np.unique(key, return_inverse=True)
                sums = np.bincount(place, weight, len(own))
            high = own[sums + self.rest[own % self.blocks] >= 1]
            yield high + base * self.blocks
            at = stop

    def _bounds(self, cell: np.ndarray, term: np.ndarray, passage: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The greatest score that an item of each block can have in the passage: the block's weights of terms that it has."""
        some = np.unique(passage)
        size = len(self.vocabulary)
        have = []
        for k in range(3):
            at = np.searchsorted(some, cell - k)
            own = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == cell - k) if len(some) else np.zeros(len(cell), bool)
            have.append(at[own] * size + term[own])
        have = np.unique(np.concatenate(have))
        n = self.begin[block + 1] - self.begin[block]
        which = np.repeat(self.begin[block] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = np.repeat(np.arange(len(passage)), n)
        wanted = np.searchsorted(some, passage)[own] * size + self.term[which]
        at = np.searchsorted(have, wanted)
        hit = (at < len(have)) & (have[np.minimum(at, max(0, len(have) - 1))] == wanted) if len(have) else np.zeros(len(wanted), bool)
        return np.bincount(own[hit], self.weight[which[hit]], len(passage))

    def verify(self, item: Item, passage: list[int], have: set[int]) -> float:
        """Share of the item's shingles in the passage, if question and answer overlap too; else 0."""
        if min(sum(t in have for t in p) / len(p) for p in (item.question, item.answer)) < PART_OVERLAP:
            return 0.0
        grams = shingles(item.words)
        share = len(grams & shingles(passage)) / len(grams)
        return share if share >= SIMILARITY else 0.0

    def search(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text the verified items by their number, with the greatest share of shingles."""
        out: list[dict[int, float]] = [{} for _ in texts]
        held: list[tuple[int, list[int]]] = []
        n, get = 0, self.vocabulary.get
        for k, text in enumerate(texts):
            held.append((k, [get(w, -1) for w in words_of(text)]))
            n += len(held[-1][1])
            if n >= WORDS:
                self._search(held, out)
                held, n = [], 0
        if held:
            self._search(held, out)
        return out

    def _search(self, held: list[tuple[int, list[int]]], out: list[dict[int, float]]) -> None:
        seen: dict[tuple[int, int], set[int]] = {}
        for j, start, block in self.candidates([np.array(t, np.int64) for _, t in held]):
            k, terms = held[j]
            part = terms[start : start + 3 * self.longest]
            have = seen.get((j, start))
            if have is None:
                have = seen[j, start] = set(part)
            for i in range(block * BLOCK, min(len(self.items), (block + 1) * BLOCK)):
                item = self.items[i]
                if sum(x for t, x in zip(item.terms, item.weights) if t in have) >= 1:
                    share = self.verify(item, part, have)
                    if share > out[k].get(i, 0.0):
                        out[k][i] = share


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes of about ``chars`` characters at most, one at a time, that together have every item."""
    total = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    parts = 1 + int(total) // chars
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items
        yield Index([(r["i"], r["t"]) for r in part.toArrow().to_pylist()])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, overlap) for every row and item that it contains; nothing for null and empty texts.

    Repeated rows give repeated pairs, null ids stay null, and repeated items count once for each row of theirs. Ids of
    documents and items have to be numbers that fit in a long; others raise.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 512)
    found = None
    for index in indexes(benchmark, item_col, chars=chars):
        shared = spark.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                hits = shared.value.search(b.column("text").to_pylist())
                flat = [(d, shared.value.items[i].item_id, x) for d, h in zip(b.column("doc_id").to_pylist(), hits) for i, x in sorted(h.items())]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat), (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "overlap"])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, item_id long, overlap double")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars: int = INDEX_CHARS) -> DataFrame:
    """``docs`` without the rows whose text contains an item; null texts stay."""
    spark = docs.sparkSession
    bounded_batches(spark, 512)
    for index in indexes(benchmark, chars=chars):
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def hit(s, shared=shared):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series([bool(h) for h in shared.value.search(s.tolist())], dtype=bool)

        docs = docs.where(~hit(F.col(text_col)))
    return docs
