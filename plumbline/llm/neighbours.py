"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id. In a shard, points are inserted in blocks: a greedy
search over the graph so far proposes neighbours, and of those a point keeps edges to diverse ones. A candidate is dropped
if ``alpha`` times its distance from one that is kept is no more than its distance from the point; a second pass over all
points with alpha above 1 keeps longer edges. Distance is Euclidean over vectors with one more component, which gives
all the same length, so that the nearest to a query are those of largest inner product. Rows that no path reaches get an
edge. Blocks of queries then search every shard by beam, a pair of graph and block at a time, score what they find exactly,
and a window keeps each query's best.

The work of a search is queries times shards, as every shard answers every query; memory is bounded by a shard and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, mapped
from plumbline.operators.proximity import BLOCK, beam, connect, diverse, half_squares, rescue
from plumbline.operators.vectors import as_bytes, packed

K, EVERY = 20, 20
#: Rows in a shard, on average.
SHARD = 5000
DEGREE, PROPOSED, ALPHAS = 32, 64, (1.0, 1.2)
#: Points that a query's search holds.
WIDTH = 128
#: Queries in a block, and blocks that one task searches a shard for.
QUERIES, TOGETHER = 256, 64


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part, as doubles, one for each id, all of one length."""
    v = df[vector_col]
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    own = df.where(df[id_col].isNotNull() & square.isNotNull() & fine).select(df[id_col].cast("bigint").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("vector"))
    own = cut(own.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    longest = own.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    return own.select("id", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("vector"))).alias("vector"))


def graph_of(x: np.ndarray, degree: int = DEGREE, width: int = PROPOSED, alphas: tuple[float, ...] = ALPHAS) -> tuple[np.ndarray, int]:
    """Edges (rows and one more x degree and one more, padded with the number of rows) and the row that searches start from: the
    one nearest to the mean."""
    n, half = len(x), half_squares(x)
    edges = np.full((n + 1, degree + 1), n, "i4")
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for again, alpha in enumerate(alphas):
        at = 0 if again else 1
        while at < n:
            # The first pass doubles what it has, as points of a block do not see each other.
            points = order[at : at + (BLOCK if again else min(BLOCK, at))]
            found, _ = beam(x, half, edges, x[points], np.full(len(points), start), width)
            connect(x, edges, points, diverse(x, points, np.concatenate([found, edges[points, :degree]], 1), degree, alpha), degree, alpha)
            at += len(points)
    rescue(x, edges, start, width)
    return edges, start


GRAPH = "shard int, ids binary, firsts binary, data binary, edges binary, start int, dims int"


def graphs(rows: DataFrame, shard: int = SHARD, degree: int = DEGREE, width: int = PROPOSED, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """One row for each shard of rows (id, vector), a table: ids, vectors and edges. Equal vectors are one point of the graph with
    all their ids."""
    n = rows.count()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(max(1, round(n / shard)))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        data = table.column("vector").combine_chunks()
        ids = table.column("id").to_numpy()
        all_x = data.flatten().to_numpy().reshape(len(ids), -1)
        x, of = np.unique(all_x, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        firsts = np.searchsorted(of.ravel()[order], np.arange(len(x) + 1))
        square = (x * x).sum(1)
        level = np.sqrt(np.maximum(square.max() - square, 0))
        edges, start = graph_of(np.column_stack([x, level]).astype("f4"), degree, width, alphas)
        one = {"shard": table.column("shard")[:1].to_pylist(), "ids": [ids[order].tobytes()], "firsts": [firsts.astype("i8").tobytes()], "data": [x.tobytes()], "edges": [edges.tobytes()], "start": [start], "dims": [x.shape[1]]}
        return pa.table(one, schema=pa.schema([("shard", pa.int32()), *[(k, pa.binary()) for k in ("ids", "firsts", "data", "edges")], ("start", pa.int32()), ("dims", pa.int32())]))

    return cut(dealt.groupBy("shard").applyInArrow(run, GRAPH), "graphs")


def best_in_shard(row: dict, qids: np.ndarray, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of up to k candidates for each query from one shard; none is the query's own id."""
    x = np.frombuffer(row["data"], "f8").reshape(-1, row["dims"])
    ids, firsts = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["firsts"], "i8")
    edges = np.frombuffer(row["edges"], "i4").reshape(len(x) + 1, -1)
    found, _ = beam(x.astype("f4"), np.zeros(len(x), "f4"), edges, q.astype("f4"), np.full(len(q), row["start"]), max(width, k + 1))
    at, place = np.nonzero(found < len(x))
    point = found[at, place]
    score = np.einsum("ij,ij->i", q[at], x[point])
    # Of equal vectors the least ids, of which one may be the query's own.
    many = np.minimum(firsts[point + 1] - firsts[point], k + 1)
    each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, score, own = np.repeat(at, many), np.repeat(score, many), ids[np.repeat(firsts[point], many) + each]
    other = own != qids[at]
    at, score, own = at[other], score[other], own[other]
    order = np.lexsort((own, -score, at))
    at, score, own = at[order], score[order], own[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], own[first], score[first]


def search(made: DataFrame, queries: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (id, vector) in all graphs of ``made``, nearest first and ties to the smaller id."""
    asked = cut(packed(as_bytes(queries), QUERIES).withColumn("number", F.monotonically_increasing_id()), "query-blocks")
    slices = max(1, -(-asked.count() // TOGETHER))
    # Each graph meets the blocks of one slice in a task: every graph goes to each slice, every block to each graph.
    left = made.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = asked.withColumn("slice", F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int")).select("slice", F.col("ids").alias("qids"), F.col("data").alias("queries"))
    last = made.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    both = left.join(right, ["shard", "slice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "firsts", "data", "edges", "start", "dims", "queries")}
                qids = batch.column("qids")[i].values.to_numpy()
                at, own, score = best_in_shard(row, qids, np.frombuffer(row["queries"], "f8").reshape(len(qids), -1), k, width)
                yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(own), pa.array(score)], ["query_id", "vec_id", "score"])

    found = mapped(both.select("ids", "firsts", "data", "edges", "start", "dims", "qids", "queries"), run, "query_id bigint, vec_id bigint, score double", by=None)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, k: int = K, every: int = EVERY, width: int = WIDTH, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``every``, among all rows but those
    with its id, by inner product in double precision.

    Rows with a null id, and vectors that are null, zero or hold null or non-finite components, take no part. Vectors are
    filled with zeros to the length of the longest. Of rows that share an id the one with the least vector counts; equal
    vectors of different ids are all found, ties to the smaller id; fewer candidates than k give all that are met; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = vectors(df, id_col, vector_col)
    return search(graphs(rows, shard), rows.where(F.col("id") % every == 0), k, width)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
