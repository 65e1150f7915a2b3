"""Text quality by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Every byte has a learned vector; learned
filters slide over the bytes of a chunk, and the greatest response of each within the chunk is kept. The mean and the
maximum over a text's chunks are combined into one probability. The network is learned on the driver by gradient descent
from a bounded sample of labelled rows, which it reads row by row in every epoch; texts are scored in batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sample, bounded_batches, discard, least_of_each, slices, table

#: Bytes of a chunk, and from one chunk's start to the next.
CHUNK, STEP = 1024, 960
#: Components of a byte's vector, bytes from one place of the filters to the next, such strides in a filter, and filters.
SIZE, STRIDE, STRIDES, FILTERS = 8, 4, 3, 32
PLACES = CHUNK // STRIDE - STRIDES + 1
#: Labelled rows of either label to learn from at most (a bounded sample of whole texts).
SAMPLE = 1500
#: Steps of the descent at least (whole epochs), rows of a step, its rate, and how weights shrink.
STEPS, BATCH, RATE, DECAY = 900, 32, 4e-3, 3e-4
#: Score from which a text is good.
GOOD = 0.7
#: Chunks multiplied at once, and texts of a slice.
AT_ONCE, SCORED = 64, 256


@dataclass
class Network:
    vectors: np.ndarray  # 256 x SIZE
    filters: np.ndarray  # STRIDES * STRIDE * SIZE x FILTERS
    bias: np.ndarray  # FILTERS
    head: np.ndarray  # 2 * FILTERS + 1: means, maxima, constant

    def weights(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.head]

    def pooled(self, chunks: np.ndarray, places: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest response of each filter in each chunk, of whose places so many are text; and where it is."""
        n = len(chunks)
        blocks = self.vectors[chunks].reshape(n * (CHUNK // STRIDE), STRIDE * SIZE)
        # a filter is STRIDES matrices over consecutive blocks, so no window is copied
        parts = (blocks @ self.filters.reshape(STRIDES, STRIDE * SIZE, FILTERS).transpose(1, 0, 2).reshape(STRIDE * SIZE, -1)).reshape(n, -1, STRIDES, FILTERS)
        found = sum(parts[:, k : k + PLACES, k] for k in range(STRIDES))
        found = np.where((np.arange(PLACES) < places[:, None])[:, :, None], found, -np.inf)
        return found.max(1) + self.bias, found.argmax(1) if where else None

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.head[:-1] + self.head[-1]


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of a text, padded with zeros, and how many places of the filters in each begin inside it (one at least)."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.frombuffer(data.ljust((n - 1) * STEP + CHUNK, b"\0"), np.uint8)
    begin = STEP * np.arange(n)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1), writeable=False), np.clip(-(-(len(data) - begin) // STRIDE), 1, PLACES)


def features(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means and maxima of the positive responses over the chunks of each text, which begin at ``first``."""
    kept = np.maximum(pooled, 0)
    size = np.diff(first, append=len(kept))
    return np.concatenate([np.add.reduceat(kept, first) / size[:, None], np.maximum.reduceat(kept, first)], 1)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of the texts in order, some AT_ONCE at a time, whatever the texts' lengths."""
    held, n = [], 0
    for text in texts:
        chunks, places = chunks_of(text)
        for i in range(0, len(chunks), AT_ONCE):
            held.append((chunks[i : i + AT_ONCE], places[i : i + AT_ONCE]))
            n += len(held[-1][0])
            if n >= AT_ONCE:
                yield np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held])
                held, n = [], 0
    if held:
        yield np.concatenate([c for c, _ in held]), np.concatenate([p for _, p in held])


def _firsts(texts: list[str | None]) -> np.ndarray:
    size = [max(1, -(-(len((t or "").encode("utf-8", "replace")) - (CHUNK - STEP)) // STEP)) for t in texts]
    return np.cumsum(size) - size


def probabilities(network: Network, texts: list[str | None]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    pooled = np.concatenate([network.pooled(c, p)[0] for c, p in _blocks(texts)])
    return 1 / (1 + np.exp(-np.clip(network.logits(features(pooled, _firsts(texts))), -50, 50)))


def _gradients(network: Network, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Of the weighted cross entropy of a batch. Only each filter's best place in a chunk has a share."""
    width = STRIDES * STRIDE
    pooled, windows = [], []
    for chunks, places in _blocks(texts):
        found, at = network.pooled(chunks, places, where=True)
        pooled.append(found)
        windows.append(chunks[np.arange(len(chunks))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(width)])
    pooled, windows, first = np.concatenate(pooled), np.concatenate(windows), _firsts(texts)
    x = features(pooled, first)
    p = 1 / (1 + np.exp(-np.clip(network.logits(x), -50, 50)))
    g = ((p - labels) * weights / len(labels)).astype(np.float32)
    head = np.append(g @ x, g.sum()).astype(np.float32) + DECAY * network.head
    size = np.diff(first, append=len(pooled))
    text = np.repeat(np.arange(len(first)), size)
    by_mean = (g / size)[:, None] * network.head[:FILTERS]
    by_most = g[:, None] * network.head[FILTERS:-1]
    top = np.maximum(pooled, 0) == x[text, FILTERS:]
    share = np.where(pooled > 0, by_mean[text] + np.where(top, by_most[text] / np.maximum(1, np.add.reduceat(top, first, dtype=np.int64))[text], 0), 0).astype(np.float32)
    seen = network.vectors[windows].reshape(len(pooled), FILTERS, -1)
    filters = np.einsum("nf,nfk->kf", share, seen, optimize=True) + DECAY * network.filters
    back = (share[:, :, None] * network.filters.T).reshape(-1, SIZE)
    vectors = np.stack([np.bincount(windows.ravel(), back[:, k], 256) for k in range(SIZE)], 1).astype(np.float32) + DECAY * network.vectors
    return [vectors, filters.astype(np.float32), share.sum(0), head]


def fit(rows: Iterable[Iterable[tuple[str, int, float]]], seed: int = 5) -> Network:
    """Learn from epochs of rows (text, label, weight) by gradient descent with adaptive moments."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
    network = Network(draw(256, SIZE) / 2, draw(STRIDES * STRIDE * SIZE, FILTERS) / 5, np.zeros(FILTERS, np.float32), np.append(draw(2 * FILTERS) / 10, 0).astype(np.float32))
    slow, fast, step = [np.zeros_like(w) for w in network.weights()], [np.zeros_like(w) for w in network.weights()], 0

    def learn(batch: list[tuple[str, int, float]]) -> None:
        nonlocal step
        step += 1
        texts, labels, weights = zip(*batch)
        for w, g, m, v in zip(network.weights(), _gradients(network, list(texts), np.array(labels), np.array(weights)), slow, fast):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    for epoch in rows:
        batch = []
        for row in epoch:
            batch.append(row)
            if len(batch) == BATCH:
                learn(batch)
                batch = []
        if batch:
            learn(batch)
    return network


def held_out(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[Sample | None, dict[int, float]]:
    """(text, q) of at most ``sample`` documents of either label, in the order of a hash, and how many each stands for.

    Documents that are held out, that no label or labels of both kinds are for, take no part; of rows that repeat an id the text of
    least hash counts.
    """
    q = F.col(label_col)
    marks = labels.where(q.isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(q).alias("q"), F.max(q).alias("r")).where("q = r")
    known = table(marks.join(docs.select(id_col).distinct(), id_col, "left_semi").select(F.col(id_col).alias("i"), "q", F.xxhash64(F.col(id_col), F.lit(17)).alias("place")), "marks")
    counts = {r[0]: r[1] for r in known.groupBy("q").count().collect()}
    picked = [known.where(F.col("q") == c).orderBy("place", "i").limit(sample) for c in sorted(counts)]
    if not picked:
        return None, {}
    chosen = table(picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1]), "chosen")
    own = docs.select(F.col(id_col).alias("j"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = own.join(F.broadcast(chosen), F.col("i") == F.col("j")).select("i", "h", "q", "place", "text")
    rows = Sample(least_of_each(found, "i", "h"), "text", "place")
    discard(known, chosen)
    return rows, {c: n / min(n, sample) for c, n in counts.items()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """A network learned from labelled rows that are not held out; None without any. ``sample``: rows of either label at most.

    Rows of the two labels weigh as all labelled documents do, so scores are probabilities among documents as they come.
    """
    rows, stands = labelled(docs, labels, id_col, text_col, label_col, sample)
    if not stands:
        return None
    mean = sum(stands.values()) / len(stands)
    epochs = -(-steps // max(1, -(-rows.size // BATCH)))
    network = fit(((r["text"], r["q"], stands[r["q"]] / mean) for r in rows) for _ in range(epochs))
    rows.discard()
    return network


def judge(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """(id, held_out, score, predicted) for each row: the probability that the text is good, and whether it is ``good`` at least.

    Empty and null texts are scored as no bytes. Without a network every score is 0.5. Repeated rows and null ids are
    returned as they come.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches, SCORED):
            texts = b.column("text").to_pylist()
            score = np.full(len(texts), 0.5) if net is None else probabilities(net, texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= good).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(rows, f"id {kind}, held_out boolean, score double, predicted int")
