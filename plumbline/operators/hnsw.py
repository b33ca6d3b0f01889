"""Layered proximity graphs (HNSW) over partitions of the vectors: built by greedy insertion, searched by beam, merged by a window.

Rows are dealt to partitions of about ``PART`` rows by a hash of their id, and each partition is one graph in one row of a
table. A row's number of layers comes from a hash of its id, so that a rebuild gives the same graph. A layer holds all rows
that reach it. They are inserted in falling order of layers, in blocks that see what was inserted before: a row starts
where a greedy walk through the layers above ends, a beam of ``ef`` proposes neighbours, and diverse ones of those become its
edges, M of them, and 2 M in the lowest layer. The most similar by inner product are found as the nearest of vectors that
one more component lifts to equal length.

A search of several widths (``ef``) goes through each graph once for each of them, for all queries of a block together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.proximity import beam, connect, diverse, half_squares
from plumbline.operators.vectors import BLOCK, as_bytes, packed
from plumbline.sources.arrow import mapped, small_batches
from plumbline.sources.tables import cut

#: Rows of a partition on average, edges of a row in the upper layers, points that a search for neighbours holds.
PART, M, EF_BUILD = 8192, 16, 200
#: Rows that are inserted together at most, and pairs of a query and a row that are scored exactly together, about.
TOGETHER, SCORED = 256, 16384
#: Tasks for each graph: enough that few of them get two.
TASKS = 4


def lifted(x: np.ndarray) -> np.ndarray:
    """The vectors with one more component that gives all of them the length of the longest: the order of inner products with a
    query is then that of distances from it."""
    square = (x * x).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))])


def tops(ids: np.ndarray, m: int = M) -> np.ndarray:
    """The highest layer of each row: 0 for all but one in m, 1 for all but one in m of those, and so on, by a hash of the id."""
    h = (ids.astype("i8").view("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    share = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype("f8") / (1 << 53)
    return np.floor(-np.log(np.maximum(share, 2.0**-53)) / np.log(m)).astype("i4")


@dataclass
class Layers:
    """nodes[l] are the rows of layer l in falling order of layers; edges[l] join places among them, padded with their number."""

    nodes: list[np.ndarray]
    edges: list[np.ndarray]


def descend(x: np.ndarray, bias: np.ndarray, graph: Layers, queries: np.ndarray, down_to: int) -> np.ndarray:
    """For each query the row where a greedy walk through the layers above ``down_to`` ends."""
    at = np.full(len(queries), graph.nodes[-1][0])
    for layer in range(len(graph.nodes) - 1, down_to, -1):
        own = graph.nodes[layer]
        place = np.empty(len(x), "i4")
        place[own] = np.arange(len(own))
        found, _ = beam(x[own], bias[own], graph.edges[layer], queries, place[at], 1)
        at = own[found[:, 0]]
    return at


def build(x: np.ndarray, ids: np.ndarray, m: int = M, ef: int = EF_BUILD, together: int = TOGETHER) -> Layers:
    """The layered graph of vectors x, from the top layer down; with ``together`` 1 every row sees all those before it."""
    top, bias = tops(ids, m), half_squares(x)
    order = np.lexsort((ids, -top))
    levels = int(top.max(initial=0)) + 1
    graph = Layers([order[top[order] >= layer] for layer in range(levels)], [np.zeros((0, 0), "i4")] * levels)
    for layer in range(levels - 1, -1, -1):
        own, most = graph.nodes[layer], m if layer else 2 * m
        above = int((top[own] > layer).sum())
        v, b, n, place = x[own], bias[own], len(own), np.zeros(len(x), "i4")
        place[own] = np.arange(n)
        edges = np.full((n + 1, most), n, "i4")
        at = 1
        while at < n:
            # Rows of higher layers come first and start from the first of all; the others start from where a walk ends.
            to = min(at + min(together, at), above if at < above else n)
            points = np.arange(at, to)
            starts = np.zeros(len(points), "i4") if at < above or layer == levels - 1 else place[descend(x, bias, graph, v[points], layer)]
            found, _ = beam(v, b, edges, v[points], starts, ef, 1 if together == 1 else 4)
            connect(v, edges, points, diverse(v, points, found, m), most)
            at = to
        graph.edges[layer] = edges
    return graph


GRAPH = "part int, ids binary, data binary, dims int, nodes array<binary>, edges array<binary>"


def index(rows: DataFrame, m: int = M, ef: int = EF_BUILD, part: int = PART) -> DataFrame:
    """One row for each partition of rows (id: a whole number, vector), as a table. Null ids and vectors are left out."""
    own = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, round(own.count() / part))
    # A stated number of tasks, as graphs are small but take long: by their bytes many would be built in one task.
    dealt = own.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(TASKS * parts, "part")

    small_batches(rows)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        graph = build(lifted(x).astype("f4"), ids, m, ef)
        row = {"part": table.column("part")[:1].to_pylist(), "ids": [ids.tobytes()], "data": [x.tobytes()], "dims": [x.shape[1]], "nodes": [[v.astype("i4").tobytes() for v in graph.nodes]], "edges": [[e.tobytes() for e in graph.edges]]}
        return pa.table(row, schema=pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("dims", pa.int32()), ("nodes", pa.list_(pa.binary())), ("edges", pa.list_(pa.binary()))]))

    return cut(dealt.groupBy("part").applyInArrow(run, GRAPH), "layers")


def best(x: np.ndarray, ids: np.ndarray, base: np.ndarray, nodes: np.ndarray, edges: np.ndarray, q: np.ndarray, starts: np.ndarray, k: int, ef: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the k best rows of each query that a search of width ef through the lowest layer finds, for a bounded
    number of queries at a time. base are the vectors of ``nodes`` as floats; x and q score exactly."""
    some = max(1, SCORED // max(ef, k))
    for low in range(0, len(q), some):
        found, _ = beam(base, np.zeros(len(base), "f4"), edges, q[low : low + some].astype("f4"), starts[low : low + some], max(ef, k))
        at, col = np.nonzero(found < len(x))
        own = nodes[found[at, col]]
        score = np.round(np.einsum("ij,ij->i", q[low + at], x[own]), digits)
        order = np.lexsort((ids[own], -score, at))
        at, own, score = at[order], own[order], score[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield low + at[first], own[first], score[first]


def search(graphs: DataFrame, queries: DataFrame, k: int, efs: list[int], digits: int = 6) -> DataFrame:
    """(ef, qid, rank, id, score): the k best that a search of width ef finds for each of queries (qid, vector). Every graph meets
    every block of queries, in a row of its own; a window over their k best each ends it. Scores are exact, rounded to
    ``digits`` before they are ordered; ties go to the least id."""
    blocks = packed(as_bytes(queries.select(F.col("qid").cast("bigint").alias("id"), "vector")), BLOCK).toDF("qids", "queries")
    last = graphs.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    tasks = TASKS * (last + 1)
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last)))).repartition(tasks, "part")
    both = graphs.repartition(tasks, "part").hint("merge").join(each, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "data", "dims", "nodes", "edges", "queries")}
                ids, qids = np.frombuffer(row["ids"], "i8"), batch.column("qids")[i].values.to_numpy()
                x, q = (np.frombuffer(row[c], "f8").reshape(-1, row["dims"]) for c in ("data", "queries"))
                nodes = [np.frombuffer(v, "i4") for v in row["nodes"]]
                graph = Layers(nodes, [np.frombuffer(e, "i4").reshape(len(v) + 1, -1) for v, e in zip(nodes, row["edges"], strict=True)])
                small, none = x.astype("f4"), np.zeros(len(x), "f4")
                place = np.empty(len(x), "i4")
                place[nodes[0]] = np.arange(len(x))
                starts, base = place[descend(small, none, graph, q.astype("f4"), 0)], small[nodes[0]]
                for ef in efs:
                    for at, own, score in best(x, ids, base, nodes[0], graph.edges[0], q, starts, k, ef, digits):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ef, "i4")), pa.array(qids[at]), pa.array(ids[own]), pa.array(score)], ["ef", "qid", "id", "score"])

    found = mapped(both.select("ids", "data", "dims", "nodes", "edges", "qids", "queries"), run, "ef int, qid bigint, id bigint, score double")
    w = Window.partitionBy("ef", "qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("ef", "qid", "rank", "id", "score")
