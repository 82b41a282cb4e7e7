"""Connected components of a link table, by alternating star operations.

Each round sends a node's larger neighbours to its smallest one (large star), then a node and
its smaller neighbours to the smallest of them (small star).  Both are a grouped minimum and a
join on the node, so no task ever holds a component or a node's neighbours.  The number of
rounds is logarithmic in the size of the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import forget, kept
from pagelake.session import cut


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
        F.col("e.v").alias("u"), F.col("e.m").alias("v")
    ).where("u != v").distinct()


def components(links: DataFrame, left: str = "u", right: str = "v", tidy: bool = False) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Links with a null end or of a node to itself say nothing.  With ``tidy`` a round's links and
    shuffles go from disk once the next round's are written; the result is a kept table.
    """
    keep = kept if tidy else cut
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), (F.col(left).isNotNull() & F.col(right).isNotNull()).alias("ok"))
    edges = keep(edges.where("ok and u != v").select("u", "v").distinct())
    seen = _digest(edges)
    while seen[0]:
        before, edges = edges, keep(_small(_large(edges)))
        if tidy:
            forget(before)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if tidy:
        out.kept_at = edges.kept_at
    return out
