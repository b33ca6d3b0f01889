"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join of the links with those minima; both sides are
tables, so that a node with very many links is split by the adaptive skew join. Nothing is collected but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard


def _star(pairs: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v). Large: every larger neighbour of u moves to the least of u and its neighbours; small: u and its
    smaller neighbours move to the least of them."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    return out.where("u != v").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (src, dst); component is the least node that can be reached.

    Links may repeat, run in either direction or join a node with itself; those with a null end are left out. An empty
    table gives an empty result.
    """
    edges = links.where("src is not null and dst is not null and src != dst")
    edges = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    state = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == state or n == 0:
            break
        state = (n, mark)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger, a = _star(both, large=True)
        larger = cut(larger, "large-star")
        smaller, b = _star(larger, large=False)
        smaller = cut(smaller, "small-star")
        discard(a, b, larger, edges)
        edges = smaller
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
