"""Links between fingerprints that differ in few bits, found in buckets of equal bit blocks.

With b blocks and at most k differing bits, at least b - k blocks are equal; a bucket is one choice of b - k blocks
and their bits. Inside a bucket a pivot distance table discards pairs, and only survivors are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbers, table

#: Reference fingerprints of the pivot table.
PIVOTS = 16
#: Rows of a bucket that are compared as they come; larger buckets are dealt out as pairs of chunks, of at least half as
#: many rows each, at most CHUNK_MOST, and otherwise a 64th of the bucket.
CHUNK, CHUNK_MOST = 512, 4096
#: One row in so many is counted to find large buckets beforehand, and the most that are then told by a broadcast. What
#: this misses is set aside as it comes, so results do not depend on it.
SAMPLED, BROADCAST_KEYS = 64, 100_000
#: Rows that a task holds before it compares them.
HELD = 40_000
#: Expected size of a bucket, from which more blocks are used.
EXPECTED = 48
#: Low bits of a key: the number of the choice of blocks, and whether it is a pair of chunks.
CHOICE, TILE = 127, 128


def references(n: int = PIVOTS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def pivot_distances(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, as two columns of eight bytes each."""
    d = np.bitwise_count(fp.view(np.uint64)[:, None] ^ references()[None, :]).astype(np.uint8)
    return np.ascontiguousarray(d).view(np.int64)


def block_masks(k: int, n: int, least: int = 2) -> list[int]:
    """Masks of the blocks to be equal: ``least`` at least, and as few choices as keep buckets of ``n`` random fingerprints near EXPECTED.

    Two equal blocks of 64 / (k + 2) bits serve 100 million fingerprints for k = 4, so the rows made for one
    fingerprint are the same at all ordinary sizes. Any choice finds all links; only the work differs.
    """
    for b in range(k + least, k + 5):
        edges = [64 * i // b for i in range(b + 1)]
        blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
        if n >> (64 * (b - k) // b) <= EXPECTED:
            break
    return [sum(c) for c in combinations(blocks, b - k)]


def bucket_rows(masks: list[int], pivots: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    mix, low = np.uint64(0x9E3779B97F4A7C15), np.uint64(CHOICE | TILE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = numbers(batch, "fp").astype(np.int64)
            own, names = list(batch.columns), list(batch.schema.names)
            if pivots:
                p = pivot_distances(fp)
                own, names = own + [pa.array(p[:, 0]), pa.array(p[:, 1])], names + ["p0", "p1"]
            for i, mask in enumerate(masks):
                # the masked bits mixed, and the choice's number; buckets that meet by chance do no harm
                key = ((fp.view(np.uint64) & np.uint64(mask)) * mix) & ~low | np.uint64(i)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *own], ["key", *names])

    return rows


class Forest:
    """Union-find over rows 0..n-1 with labels as an array."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.label = self.parent

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def relabel(self) -> None:
        p = self.parent
        while (p[p] != p).any():
            p = p[p]
        self.parent = p
        self.label = p.copy()


def spanning(key: np.ndarray, fp: np.ndarray, piv: np.ndarray, k: int, masks: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the rows of each key as all links would: a spanning forest, so a dense group of n rows gives n - 1.

    Rows are ordered by the first pivot coordinate; partners further than k in it are never visited, and those further
    than k in any other coordinate are discarded before the exact comparison. With ``masks`` a pair that shares several
    buckets is looked at in that of the first choice only.
    """
    order = np.lexsort((piv[:, 0], key))
    key, fp, piv = key[order], fp.view(np.uint64)[order], piv[order].astype(np.int16)
    n, forest, out = len(key), Forest(len(key)), []
    alive, d = np.arange(n), 0
    while alive.size:
        d += 1
        alive = alive[alive + d < n]
        alive = alive[key[alive] == key[alive + d]]
        alive = alive[piv[alive + d, 0] - piv[alive, 0] <= k]
        c = alive[forest.label[alive] != forest.label[alive + d]]
        for lo in range(1, piv.shape[1], 5):
            c = c[(np.abs(piv[c, lo : lo + 5] - piv[c + d, lo : lo + 5]) <= k).all(1)]
        c = c[np.bitwise_count(fp[c] ^ fp[c + d]) <= k]
        if masks and c.size:
            differ, choice = fp[c] ^ fp[c + d], key[c] & CHOICE
            for j, mask in enumerate(masks):
                fresh = (j >= choice) | ((differ & np.uint64(mask)) != 0)
                c, differ, choice = c[fresh], differ[fresh], choice[fresh]
        joined = False
        for i in c.tolist():
            if forest.union(i, i + d):
                out.append((int(order[i]), int(order[i + d])))
                joined = True
        if joined:
            forest.relabel()
    return out


def whole_keys(batches: Iterator[pa.RecordBatch], chunk: int | None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole keys from sorted batches, and whether the rows belong to a key of over ``chunk`` rows.

    About HELD rows are held at once, however many a key has: one that is found to be large is passed on as it comes.
    """
    held: list[pa.RecordBatch] = []
    large = None
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < HELD:
            continue
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        if large is not None:
            cut = int(np.argmax(key != large)) if (key != large).any() else len(key)
            if cut:
                yield t.slice(0, cut), True
            t, key, held = t.slice(cut), key[cut:], []
            if not len(key):
                continue
            large = None
        first = int(np.argmax(key == key[-1]))
        if first:
            yield from _sorted_out(t.slice(0, first), chunk)
        rest = t.slice(first)
        held = rest.to_batches()
        if chunk is not None and rest.num_rows > chunk and not key[-1] & TILE:
            large, held = key[-1], []
            yield rest, True
    if held:
        t = pa.Table.from_batches(held)
        if large is not None:
            mine = t.column("key").to_numpy() == large
            if mine.any():
                yield t.filter(pa.array(mine)), True
                t = t.filter(pa.array(~mine))
        if t.num_rows:
            yield from _sorted_out(t, chunk)


def _sorted_out(t: pa.Table, chunk: int | None) -> Iterator[tuple[pa.Table, bool]]:
    key = t.column("key").to_numpy()
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    big = (n[at] > chunk) & (key & TILE == 0) if chunk is not None else np.zeros(len(key), bool)
    if big.any():
        yield t.filter(pa.array(big)), True
        t = t.filter(pa.array(~big))
    if t.num_rows:
        yield t, False


def _distances(t: pa.Table) -> np.ndarray:
    """The pivot table if it travels with the rows, else distances to zero."""
    if "p0" in t.column_names:
        return np.ascontiguousarray(np.stack([t.column("p0").to_numpy(), t.column("p1").to_numpy()], 1)).view(np.uint8)
    return np.bitwise_count(t.column("fp").to_numpy().view(np.uint64))[:, None]


Found = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def _group_rows(find: Found, chunk: int | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sorted bucket rows: what ``find`` makes of whole buckets, as a and b; and rows of large buckets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, large in whole_keys(batches, chunk):
            if large:
                own = [pa.nulls(t.num_rows, pa.int64())] * 2 + [t.column(c).combine_chunks() for c in schema.names[2:]]
                yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own], schema=schema)
                continue
            a, b = find(t)
            if len(a):
                rest = [pa.nulls(len(a), schema.field(c).type) for c in schema.names[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *rest], schema=schema)

    return rows


def in_buckets(source: DataFrame, bucketed: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str], find: Found, chunk: int = CHUNK) -> DataFrame:
    """(a, b) that ``find`` gives for the rows of every bucket; ``bucketed`` makes them of the rows of ``source``: a key
    and further columns ``names``, all long, among them id.

    Buckets over ``chunk`` rows are cut into chunks whose pairs are separate groups, so no task holds a whole one and no
    pair is lost.
    """
    names = ["key", *names]
    made = ", ".join(f"{c} long" for c in names)
    schema = pa.schema([(c, pa.int64()) for c in ["a", "b", *names]])
    sort = lambda df: df.repartition("key").sortWithinPartitions("key")
    rows = source.mapInArrow(bucketed, made)
    some = source.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SAMPLED)) == 0).mapInArrow(bucketed, made)
    counts = some.groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("rows"))
    known = table(counts.where(F.col("rows") > chunk), "large")
    if 0 < known.count() <= BROADCAST_KEYS:
        rows = _tiles(rows.join(F.broadcast(known), "key", "left"), chunk, names)
    found = table(sort(rows).mapInArrow(_group_rows(find, chunk, schema), f"a long, b long, {made}"), "found")
    links, large = found.where("a is not null").select("a", "b"), found.where("a is null").drop("a", "b")
    if large.isEmpty():
        return links
    tiles = _tiles(large.join(large.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key"), chunk, names)
    return links.unionByName(sort(tiles).mapInArrow(_group_rows(find, chunk, schema), f"a long, b long, {made}").select("a", "b"))


def near_links(fps: DataFrame, k: int, n: int, chunk: int = CHUNK, least: int = 2) -> DataFrame:
    """Links (a, b) that connect the ids of ``fps`` (id, fp: long) as all pairs within k bits would. ``n``: rows of ``fps``."""
    masks = block_masks(k, n, least)

    def find(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, key, fp = (t.column(c).to_numpy() for c in ("id", "key", "fp"))
        piv = np.ascontiguousarray(np.stack([t.column("p0").to_numpy(), t.column("p1").to_numpy()], 1)).view(np.uint8)
        i = np.array(spanning(key, fp, piv, k, masks), np.int64).reshape(-1, 2)
        return ids[i[:, 0]], ids[i[:, 1]]

    return in_buckets(fps.select("fp", "id"), bucket_rows(masks, True), ["fp", "id", "p0", "p1"], find, chunk)


def _tiles(buckets: DataFrame, chunk: int, names: list[str]) -> DataFrame:
    """Rows of buckets that ``rows`` says are large, once for every pair of chunks that their own is part of; others as they are."""
    size = F.least(F.greatest(F.col("rows") / 64, F.lit(chunk / 2)), F.lit(CHUNK_MOST))
    own = buckets.withColumn("c", F.coalesce(F.ceil(F.col("rows") / size).cast("int"), F.lit(1)))
    own = own.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    tile = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).bitwiseAND(F.lit(~(CHOICE | TILE)))
    tile = tile.bitwiseOR(F.col("key").bitwiseAND(F.lit(CHOICE))).bitwiseOR(F.lit(TILE))
    return own.withColumn("key", F.when(F.col("c") > 1, tile).otherwise(F.col("key"))).select(*names)
