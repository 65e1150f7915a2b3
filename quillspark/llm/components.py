"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import scope
from .shared import discard, table


def _star(sym: DataFrame, keep: str) -> DataFrame:
    """Hang the neighbours that ``keep`` selects of every node u on the least of u's neighbourhood.

    The least neighbours are pre-aggregated and written, so the join reads two plain exchanges, which adaptive
    execution can split when a hub has very many links.
    """
    least = table(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return sym.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b, long); a component's name is its least node.

    Alternating large-star and small-star rounds over written tables; only the last round's stays. Null ends and self-links are ignored; repeated
    links and an empty table are fine.
    """
    e = table(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        with scope() as own:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = table(_star(both, "v > u").where("u <> v").distinct(), "large")
            small = _star(large, "v <> m").unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
            last, e = e, table(small.where("u <> v").distinct(), "links")
            own.keep(e)
        discard(last)
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
