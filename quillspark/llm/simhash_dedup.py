"""SimHash near-duplicates by pivot distance tables.

Distances of every distinct fingerprint to reference fingerprints are computed once and travel with it. Pairs that
meet in a bucket of equal bit blocks are discarded when any coordinate differs by more than the limit (the triangle
inequality), and survivors are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import near_links
from .components import components
from .shared import bounded_batches, fresh, table

SHINGLE, SEED, MAX_BITS = 4, 42, 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PART = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; zero without words or text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _PART):
        h = np.array([hash64(joined[a:b], SEED) for a, b in zip(starts[i : i + _PART], stops[i : i + _PART])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) per row: a hash of the text, and the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fp)], ["id", "th", "fp"])

    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, "id long, th long, fp long")


def _groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, id, group) of every distinct fingerprint: its least id, and the least fingerprint reachable."""
    distinct = table(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    # fingerprints are the nodes, so that those without an id link too
    found = components(near_links(distinct.select("fp", F.col("fp").alias("id")), max_bits, distinct.count()))
    return table(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("group")), "grouped")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``: the least id reachable over links of at most ``max_bits`` bits.

    Null and empty texts have fingerprint zero and link like any other. Rows repeated with one id stay repeated. A row
    with a null id links like any other and gets its group's component, but never names one: only a group without any id
    has a null component. Ids have to be numbers that fit in a long; others raise. Other columns are ignored.
    """
    prints = table(fingerprints(docs, id_col, text_col).select("id", "fp"), "prints")
    grouped = _groups(prints, max_bits)
    least = grouped.groupBy("group").agg(F.min("id").alias("component_id"))
    named = grouped.join(least, "group").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every group: that of the least id, rows without an id last.

    Of rows of that id those whose text has the least hash, and of equal ones one, by a hash of all columns. So rows that
    share an id are judged by their own texts, and null ids and null texts are grouped like any other.
    """
    prints = table(fingerprints(docs, id_col, text_col), "prints")
    grouped = _groups(prints, max_bits)
    rows = prints.join(grouped.select("fp", "group"), "fp").groupBy("id", "th").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("copies"))
    rows = table(rows, "rows")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("first"))
    wins = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.th") == F.col("th"))
    marked = rows.join(first, "group").where(~wins | (F.col("copies") > 1))
    key, th, kept = fresh(docs, "_id", "_th", "_kept")
    marked = table(marked.select(F.col("id").alias(key), F.col("th").alias(th), wins.alias(kept)), "marked")
    joined = docs.join(marked, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(th)), "left")
    out = joined.where(F.col(kept).isNull()).select(*docs.columns)
    if marked.where(F.col(kept)).isEmpty():
        return out
    turn = F.row_number().over(Window.partitionBy(key, th).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    again = joined.where(F.col(kept)).withColumn(kept, turn).where(F.col(kept) == 1)
    return out.unionByName(again.select(*docs.columns))
