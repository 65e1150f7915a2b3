"""Extraction of the main text of pages: fit once on the driver, applied in batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded_batches, slices
from . import boost, dom, layouts, nodes

#: Pages that are scored together.
SCORED = 64


@functools.cache
def model() -> boost.Boosted:
    """Boosted trees over the nodes of generated pages; the same in every run."""
    rows, labels = [], []
    for page, truth in layouts.pages():
        tree = dom.parse(page)
        at, _, x = nodes.features(tree, nodes.scored(tree))
        left = iter(truth)
        known: dict[int, bool] = {}
        want = next(left, None)
        for i in range(1, len(tree.tag)):
            if want is not None and tree.tag[i] == want[0]:
                known[i] = want[1]
                want = next(left, None)
        for k, i in enumerate(at.tolist()):
            if i in known:
                rows.append(x[k])
                labels.append(known[i])
    return boost.fit(np.array(rows, np.float32), np.array(labels, float))


def main_texts(pages: list[str | None], fitted: boost.Boosted) -> list[str]:
    """Blocks of main text in page order, one a line; empty where there is none."""
    trees = [dom.parse(p) for p in pages]
    owners = [nodes.scored(t) for t in trees]
    found = [nodes.features(t, o) for t, o in zip(trees, owners)]
    odds = fitted.odds(np.concatenate([x for *_, x in found])) if found else np.zeros(0)
    out, begin = [], 0
    for tree, owner, (at, parents, x) in zip(trees, owners, found):
        inside = set(at[nodes.decode(parents, odds[begin : begin + len(x)])].tolist())
        begin += len(x)
        blocks: list[list[str]] = []
        last = None
        for element, block, text, _ in tree.runs:
            if owner[element] in inside:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n".join(x for x in lines if x))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages, and pages without main text, give an empty text. Ids and urls may be null or repeated; other
    columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 512)
    fitted = spark.sparkContext.broadcast(model())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SCORED):
            texts = main_texts(b.column("html").to_pylist(), fitted.value)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(rows, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
