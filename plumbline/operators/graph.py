"""Reference graphs between numbered threads: edges, maximal chains, one chain for each head."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import references
from plumbline.sources.tables import cut

MOST = 6


def build_graph(threads: DataFrame, number: str = "number", text: str = "text") -> DataFrame:
    """(src, dst) from each thread to the others that its text refers to and that exist; no loops, each edge once."""
    edges = threads.select(F.col(number).alias("src"), F.explode(references(F.col(text))).alias("dst")).distinct().where("src != dst")
    return edges.join(threads.select(F.col(number).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def extract_chains(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """(path): every maximal simple path of at most ``most`` nodes from every node; an isolated node is a path of its own,
    a cycle ends where it would meet itself. Unrolled joins, one for each further node."""
    grown = nodes.select(F.array("number").alias("path"))
    done = None
    for _ in range(most - 1):
        tail = F.element_at("path", -1)
        step = grown.withColumn("src", tail).join(edges, "src", "left").withColumn("ok", F.col("dst").isNotNull() & ~F.array_contains("path", F.coalesce("dst", F.lit(-1))))
        # A path ends if none of its edges leads to a new node.
        ended = step.groupBy("path").agg(F.max("ok").alias("any")).where("not any").select("path")
        done = ended if done is None else done.union(ended)
        grown = step.where("ok").select(F.concat("path", F.array("dst")).alias("path"))
    return done.union(grown).distinct()


def one_per_head(chains: DataFrame) -> DataFrame:
    """(head, path): the longest chain of each head, of equal ones the first in order."""
    rank = F.struct((-F.size("path")).alias("n"), F.col("path"))
    return chains.groupBy(F.col("path")[0].alias("head")).agg(F.min(rank).alias("r")).select("head", "r.path")


def number_rows(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with consecutive numbers from 0 in a global order, without one task for all: rows are dealt to ranges, counted
    and numbered within each, and only one count for each range is summed up."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def document_frequencies(df: DataFrame, tokens: str) -> DataFrame:
    """(token, df): in how many rows each token of an array column occurs."""
    return df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
