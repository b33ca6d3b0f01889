"""Exact and approximate vector search by inner product, quantisation and dimensionality reduction.

Vectors travel as matrices: a pack is one row that holds up to ``PACK`` ids and their matrix, and so are queries, up to
``BLOCK`` in one. A search joins packs with blocks of queries (all of them for an exact search, those of the same cell for
an inverted index), scores each pair with one matrix product and keeps its best k; a window over those candidates ends it.
The plan is the same for any number of queries, nothing of them is on the driver, and no pair of rows is emitted but the
best of each pack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.arrow import mapped, sliced
from plumbline.sources.tables import cut

#: Rows in a pack and queries in a block; with the dimension they bound what a task holds.
PACK, BLOCK = 8192, 1024
#: Queries that are scored against a pack at once, and rows that are compared with all centroids at once; a matrix of that many
#: rows is what a task holds.
TOGETHER = 128
#: Rows of a batch that probes() makes, about: each query is repeated for each of its probes.
PROBES = 8192
#: Rows that centroids, codebooks and rotations are fitted on at most.
FIT_ROWS = 50_000
SEED = 42


def stack(values) -> np.ndarray:
    return np.stack([np.asarray(v, "f8") for v in values]) if len(values) else np.zeros((0, 0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in built-in expressions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def renormalise(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def truncate(v: Column, d: int) -> Column:
    """The first d coordinates at unit length; an error if there are fewer."""
    checked = F.when(F.size(v) >= d, F.slice(v, 1, d)).otherwise(F.raise_error(F.lit(f"fewer than {d} dimensions")).cast("array<double>"))
    return renormalise(checked)


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best columns of each row of scores; ties go to the least id. As a boolean matrix."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return scores >= edge[:, None]


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def packed(df: DataFrame, rows: int, by: str | None = None) -> DataFrame:
    """One row (by, ids, data) for up to ``rows`` rows of df (id, data: binary, and by): ids as an array, data joined. Rows of one
    value of ``by`` are brought together first, large values in several partitions."""
    kind = df.schema["id"].dataType.simpleString()
    names = ([by] if by else []) + ["ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, now = 0, None

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column("id") for b in held])
            data = b"".join(x.as_py() for b in held for x in b.column("data"))
            out = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays([*([pa.array([now], held[0].column(by).type)] if by else []), *out], names)

        for batch in batches:
            values = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(batch.num_rows, "i4")
            at = 0
            while at < batch.num_rows:
                if n and (values[at] != now or n == rows):
                    yield flush()
                    held, n = [], 0
                now = values[at]
                other = np.flatnonzero(values[at:] != now)
                size = min(rows - n, int(other[0]) if len(other) else batch.num_rows - at)
                held.append(batch.slice(at, size))
                n, at = n + size, at + size
        if n:
            yield flush()

    own = df.select(*([by] if by else []), "id", "data")
    own = own.hint("rebalance", by).sortWithinPartitions(by) if by else own
    field = f"`{by}` {own.schema[by].dataType.simpleString()}, " if by else ""
    return mapped(own, run, f"{field}ids array<{kind}>, data binary")


def as_bytes(df: DataFrame, column: str = "vector") -> DataFrame:
    """(id, data) of df (id, column): each vector as its doubles."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in matrix_of(batch.column(column))], pa.binary())], ["id", "data"])

    return mapped(df.where(F.col("id").isNotNull() & F.col(column).isNotNull()).select("id", column), run, f"id {kind}, data binary")


def as_floats(df: DataFrame) -> DataFrame:
    """(id, cell, data) of df (id, cell, vector): rows of an index whose vectors are kept as floats."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cell"), pa.array([r.tobytes() for r in matrix_of(batch.column("vector")).astype("f4")], pa.binary())], ["id", "cell", "data"])

    return mapped(df.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", "cell", "vector"), run, f"id {kind}, cell int, data binary")


def scored(pairs: DataFrame, k: int, digits: int, kind: str, score: Callable[[bytes, int, np.ndarray, object], np.ndarray], by: str | None = None, probed: bool = False) -> DataFrame:
    """(qid, id, score), and probe if ``probed``: the k best rows of each pair of a pack and a block, with ties at the edge, from pairs
    (ids, data, qids, queries, and by); score(data, rows, query matrix, by) gives a matrix query x row. Scores are rounded
    to ``digits``. If probed, the first column of the queries is not theirs but what becomes ``probe``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, qids = (batch.column(c)[i].values for c in ("ids", "qids"))
                block = np.frombuffer(batch.column("queries")[i].as_py(), "f8").reshape(len(qids), -1)
                data, cell = batch.column("data")[i].as_py(), batch.column(by)[i].as_py() if by else None
                for low in range(0, len(block), TOGETHER):
                    q = block[low : low + TOGETHER]
                    probe, q = (q[:, 0], q[:, 1:]) if probed else (None, q)
                    s = np.round(score(data, len(ids), q, cell), digits)
                    one, two = np.nonzero(best_rows(ids, s, k) & np.isfinite(s))
                    columns = [qids.take(pa.array(low + one)), ids.take(pa.array(two)), pa.array(s[one, two])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(probe[one].astype("i4"))] if probed else columns, ["qid", "id", "score"] + ["probe"] * probed)

    return mapped(pairs.select(*([by] if by else []), "ids", "data", "qids", "queries"), run, f"qid bigint, id {kind}, score double{', probe int' if probed else ''}")


def best_of_pairs(pairs: DataFrame, k: int, digits: int, kind: str, score: Callable[[bytes, int, np.ndarray, object], np.ndarray], by: str | None = None) -> DataFrame:
    """(qid, rank, id, score): the k best of what scored() gives for each query, ties to the least id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored(pairs, k, digits, kind, score, by).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def top_k(corpus: DataFrame, queries: DataFrame, k: int, digits: int = 6, pack: int = PACK, block: int = BLOCK) -> DataFrame:
    """(qid, rank, id, score): the k best rows of corpus (id, vector) for each of queries (qid, vector), by exact inner product.

    Scores are rounded to ``digits`` before they are ordered, and ties go to the least id, so that results do not depend
    on the order of additions. Null ids and vectors are left out; fewer rows than k give fewer. A stated set of queries
    meets all rows, so the work is the product of both; packs and blocks are what is paired.
    """
    # Both as tables: a product goes through each side once for every partition of the other.
    rows = cut(packed(as_bytes(corpus), pack), "packs")
    asked = cut(packed(as_bytes(queries.select(F.col("qid").cast("bigint").alias("id"), "vector")), block).toDF("qids", "queries"), "blocks")
    exact = lambda data, n, q, _: q @ np.frombuffer(data, "f8").reshape(n, -1).T
    return best_of_pairs(rows.crossJoin(asked), k, digits, corpus.schema["id"].dataType.simpleString(), exact)


def recall_at_k(pred: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row with the mean share of the k true ids among the first k predicted (both qid, rank, id); 0 without queries."""
    t = truth.where(F.col("rank") <= k).select("qid", "id")
    p = pred.where((F.col("rank") <= k) & (F.col("id") >= 0)).select("qid", "id", F.lit(1).alias("hit")).distinct()
    per = t.join(p, ["qid", "id"], "left").groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("r"))
    return per.agg(F.coalesce(F.round(F.avg("r"), 6), F.lit(0.0)).alias("recall"))


def recall_ids(pred: Column, truth: Column, k: int) -> Column:
    """Share of the first k true ids among the first k predicted, as arrays; -1 pads and never counts."""
    p = F.filter(F.slice(pred, 1, k), lambda x: x >= 0)
    return F.size(F.array_intersect(p, F.slice(truth, 1, k))) / F.lit(k)


def separable(a: Column, b: Column, k: int) -> Column:
    """True if two ordered lists differ in their first k ids, pads stripped."""
    own = lambda x: F.filter(F.slice(x, 1, k), lambda v: v >= 0)
    return own(a) != own(b)


def sample(df: DataFrame, rows: int = FIT_ROWS, column: str = "vector") -> np.ndarray:
    """At most about ``rows`` vectors on the driver, drawn by a hash of id."""
    n = df.count()
    drawn = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30))
    return stack([r[0] for r in df.where(drawn & F.col(column).isNotNull()).select(column, "id").orderBy("id").collect()])


# Principal components


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # row by row, of falling variance
    variance: np.ndarray

    def explained(self) -> np.ndarray:
        return np.cumsum(self.variance) / max(self.variance.sum(), 1e-300)


def fit_pca(df: DataFrame, center: bool = True, column: str = "vector") -> Pca:
    """Principal components of all vectors of df: sums and products are added up on the executors, and only a matrix of
    dimension x dimension comes to the driver. Signs are fixed so that each component's largest entry is positive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = stack(pdf[column])
                x = np.concatenate([np.ones((len(x), 1)), x], 1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(total)), len(total)), "j": np.tile(np.arange(len(total)), len(total)), "s": total.ravel()})

    rows = df.where(F.col(column).isNotNull()).select(column).mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if not len(rows):
        raise ValueError("no vectors to fit on")
    m = np.zeros((rows.i.max() + 1,) * 2)
    m[rows.i, rows.j] = rows.s
    n, mean = m[0, 0], (m[0, 1:] / m[0, 0] if center else np.zeros(len(m) - 1))
    scatter = (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    order = np.argsort(values)[::-1]
    comp = vectors[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return Pca(mean, comp, np.maximum(values[order], 0))


def project(df: DataFrame, model: Pca, d: int, column: str = "vector") -> DataFrame:
    """df with the column as its first d principal coordinates at unit length. The model is dimension squared in size."""
    comp, mean = model.components[:d], model.mean

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = (stack(pdf[column]) - mean) @ comp.T
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
                yield pdf.assign(**{column: list(y)})

    fields = [f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema]
    return df.where(F.col(column).isNotNull()).mapInPandas(run, ", ".join(fields))


# Scalar quantisation, in built-in expressions


def sq8_bounds(df: DataFrame, column: str = "vector") -> tuple[list[float], list[float]]:
    """Least and largest value of each dimension over all rows."""
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.min(F.col("x").cast("double")).alias("a"), F.max(F.col("x").cast("double")).alias("b")).orderBy("i").collect()
    return [r["a"] for r in rows], [r["b"] for r in rows]


def sq8_codes(v: Column, low: list[float], high: list[float]) -> Column:
    """One code of 0 to 255 for each dimension; a dimension without range counts as range 1."""
    a = F.array(*map(F.lit, low))
    width = F.array(*[F.lit(y - x if y > x else 1.0) for x, y in zip(low, high, strict=True)])
    return F.transform(v, lambda x, i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") - F.get(a, i)) / F.get(width, i) * 256))).cast("int"))


def sq8_values(codes: Column, low: list[float], high: list[float]) -> Column:
    """The middle of each code's interval."""
    a = F.array(*map(F.lit, low))
    width = F.array(*[F.lit(y - x if y > x else 1.0) for x, y in zip(low, high, strict=True)])
    return F.transform(codes, lambda x, i: F.get(a, i) + (x + 0.5) * F.get(width, i) / 256)


# Inverted lists, product quantisation and sign codes


def kmeans(x: np.ndarray, n: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Centroids by Lloyd's rounds from random rows; at most one for each 39 rows, so that each cell has enough."""
    n = max(1, min(n, len(x) // 39 or 1))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        for i in range(n):
            own = x[near == i]
            c[i] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


@dataclass
class Index:
    """Inverted lists, and how vectors in them are coded: exact (floats), pq (m codebooks of up to 256, a byte each) or sign
    (rotated sign bits, and two floats)."""

    centroids: np.ndarray
    coding: str = "exact"
    books: np.ndarray | None = None  # m x up to 256 x part
    rotation: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)).argmax(1)

    def near(self, q: np.ndarray, nprobe: int) -> np.ndarray:
        """The nprobe cells whose centroids have the largest inner products with each query."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :nprobe]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> list[bytes]:
        if self.coding == "exact":
            return [r.tobytes() for r in x.astype("f4")]
        rest = x - self.centroids[cell]
        if self.coding == "pq":
            parts = rest.reshape(len(x), len(self.books), -1)
            codes = np.stack([(parts[:, j] @ b.T - 0.5 * (b * b).sum(1)).argmax(1) for j, b in enumerate(self.books)], 1)
            return [r.tobytes() for r in codes.astype("u1")]
        turned = rest @ self.rotation.T
        norm = np.linalg.norm(rest, axis=1)
        # Length of the residual, and its inner product with its own sign vector, make the estimate unbiased.
        along = np.abs(turned).sum(1) / np.sqrt(x.shape[1]) / np.maximum(norm, 1e-300)
        bits, factors = np.packbits(turned > 0, axis=1), np.stack([norm, along], 1).astype("f4")
        return [b.tobytes() + f.tobytes() for b, f in zip(bits, factors, strict=True)]

    def score(self, data: bytes, n: int, q: np.ndarray, cell: int) -> np.ndarray:
        """Estimated inner products, query x row, for n coded rows of one cell."""
        d = q.shape[1]
        if self.coding == "exact":
            return q @ np.frombuffer(data, "f4").reshape(n, d).astype("f8").T
        base = (q @ self.centroids[cell])[:, None]
        codes = np.frombuffer(data, "u1").reshape(n, -1)
        if self.coding == "pq":
            m = len(self.books)
            tables = np.einsum("qmp,mkp->mqk", q.reshape(len(q), m, d // m), self.books)
            return base + sum(tables[j][:, codes[:, j]] for j in range(m))
        signs = (2.0 * np.unpackbits(codes[:, :-8], axis=1, count=d) - 1) / np.sqrt(d)
        factors = np.ascontiguousarray(codes[:, -8:]).view("f4").astype("f8")
        return base + (q @ self.rotation.T) @ signs.T * (factors[:, 0] / np.maximum(factors[:, 1], 1e-9))


def lists_for(n: int) -> int:
    """Cells of an index of n rows: the root of n, so that a probe reads about as much as there are centroids to compare."""
    return max(1, round(n**0.5))


def build_index(df: DataFrame, nlist: int | None = None, coding: str = "exact", m: int = 8, column: str = "vector") -> tuple[Index, DataFrame]:
    """An index fitted on a sample of at most about FIT_ROWS rows, and all rows of df as (id, cell, data)."""
    x = sample(df, column=column)
    index = Index(kmeans(x, nlist or lists_for(df.count())), coding)
    rest = x - index.centroids[index.cells(x)]
    if coding == "pq":
        parts = rest.reshape(len(x), m, -1)
        rng = np.random.default_rng(SEED)
        books = []
        for j in range(m):
            b = kmeans(parts[:, j], 256, seed=SEED + j)
            books.append(np.concatenate([b, parts[rng.integers(0, len(x), 256 - len(b)), j]]))
        index.books = np.stack(books)
    if coding == "sign":
        index.rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(x.shape[1],) * 2))[0]
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8 * TOGETHER):
            v = matrix_of(batch.column(column))
            cell = index.cells(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype("i4")), pa.array(index.encode(v, cell), pa.binary())], ["id", "cell", "data"])

    return index, mapped(df.where(F.col("id").isNotNull() & F.col(column).isNotNull()).select("id", column), run, f"id {kind}, cell int, data binary")


def probes(index: Index, queries: DataFrame, nprobe: int, ranked: bool = False) -> DataFrame:
    """(cell, id, probe, data): each of queries (qid, vector) once for each of its nprobe nearest cells, the nearest as probe 0; data are
    the vector's doubles, if ``ranked`` after the probe's number as one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max(1, PROBES // max(1, min(nprobe, len(index.centroids))))):
            q = np.stack([np.frombuffer(x.as_py(), "f8") for x in batch.column("data")])
            near = index.near(q, nprobe)
            at, probe = np.repeat(np.arange(len(q)), near.shape[1]), np.tile(np.arange(near.shape[1]), len(q))
            data = np.column_stack([probe.astype("f8"), q[at]]) if ranked else q[at]
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype("i4")), batch.column("id").take(pa.array(at)), pa.array(probe.astype("i4")), pa.array([r.tobytes() for r in data], pa.binary())], ["cell", "id", "probe", "data"])

    return mapped(as_bytes(queries.select(F.col("qid").cast("bigint").alias("id"), "vector")), run, "cell int, id bigint, probe int, data binary")


def search_index(index: Index, rows: DataFrame, queries: DataFrame, k: int, nprobe: int, digits: int = 6) -> DataFrame:
    """(qid, rank, id, score) from the nprobe cells whose centroids are nearest to each query. Packs of a cell meet the blocks
    of queries that probe it, and no others: cells that nobody probes are not read beyond the join."""
    blocks = packed(probes(index, queries, nprobe), BLOCK, "cell").toDF("cell", "qids", "queries")
    return best_of_pairs(packed(rows, PACK, "cell").join(blocks, "cell"), k, digits, rows.schema["id"].dataType.simpleString(), index.score, "cell")


def sweep_index(index: Index, rows: DataFrame, queries: DataFrame, k: int, nprobes: list[int], digits: int = 6) -> DataFrame:
    """(nprobe, qid, rank, id, score): what search_index() finds for each of the nprobes, from one pass over the cells.

    Each candidate carries the probe at which its cell comes, and a search of fewer probes is the best k of those that come
    earlier; a cell gives its own k best to a query, so a query has k rows for each of its probes at most.
    """
    blocks = packed(probes(index, queries, max(nprobes), ranked=True), BLOCK, "cell").toDF("cell", "qids", "queries")
    found = scored(packed(rows, PACK, "cell").join(blocks, "cell"), k, digits, rows.schema["id"].dataType.simpleString(), index.score, "cell", probed=True)
    each = found.withColumn("nprobe", F.explode(F.filter(F.array(*map(F.lit, nprobes)), lambda n: n > F.col("probe"))))
    w = Window.partitionBy("nprobe", "qid").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("nprobe", "qid", "rank", "id", "score")


def shares_read(index: Index, rows: DataFrame, queries: DataFrame, nprobes: list[int]) -> DataFrame:
    """(nprobe, share): the share of all rows that lie in the cells which a search of nprobe cells reads, over all queries."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    asked = probes(index, queries, max(nprobes)).groupBy("cell", "probe").agg(F.count("*").alias("asked"))
    each = asked.join(sizes, "cell", "left").withColumn("nprobe", F.explode(F.filter(F.array(*map(F.lit, nprobes)), lambda n: n > F.col("probe"))))
    read = each.groupBy("nprobe").agg(F.sum(F.col("asked") * F.coalesce("n", F.lit(0))).alias("read"), F.sum(F.when(F.col("probe") == 0, F.col("asked"))).alias("asked"))
    whole = F.greatest(F.lit(rows.count()), F.lit(1))
    return read.select("nprobe", F.round(F.col("read") / (F.col("asked") * whole), 6).alias("share"))


def refined_sweep(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, factors: list[int]) -> DataFrame:
    """(nprobe, factor, qid, rank, id, score): of the best factor * k candidates of each nprobe by their estimates, the k best by exact
    inner product. found is sweep_index() with k times the largest factor; each pair is scored once for all points."""
    pairs = found.select("qid", "id").distinct()
    both = pairs.join(corpus.select("id", F.col("vector").alias("v")), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    exact = both.select("qid", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("exact"))
    each = found.join(exact, ["qid", "id"]).withColumn("factor", F.explode(F.filter(F.array(*map(F.lit, factors)), lambda n: n * k >= F.col("rank"))))
    w = Window.partitionBy("nprobe", "factor", "qid").orderBy(F.desc("exact"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("nprobe", "factor", "qid", "rank", "id", F.col("exact").alias("score"))


def recalls(pred: DataFrame, truth: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, recall): recall_at_k() of each group of pred (by, qid, rank, id); groups without a row for a query count it as none."""
    t = truth.where(F.col("rank") <= k).select("qid", "id")
    hits = pred.where(F.col("rank") <= k).join(t, ["qid", "id"]).groupBy(*by, "qid").agg(F.count("*").alias("hits"))
    per = hits.join(t.groupBy("qid").agg(F.count("*").alias("n")), "qid").groupBy(*by).agg(F.sum(F.col("hits") / F.col("n")).alias("sum"))
    asked = F.greatest(F.lit(t.select("qid").distinct().count()), F.lit(1))
    return pred.select(*by).distinct().join(per, by, "left").select(*by, F.round(F.coalesce(F.col("sum") / asked, F.lit(0.0)), 6).alias("recall"))


def refine(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of given candidates (qid, id) by exact inner product; each query has a bounded number of them."""
    both = candidates.select("qid", "id").join(corpus.select("id", F.col("vector").alias("v")), "id").join(queries.select("qid", F.col("vector").alias("q")), "qid")
    scored = both.select("qid", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def payload_bytes(coding: str, dim: int, m: int = 8) -> int:
    """Bytes of a coded vector as they are stored: floats, a byte a dimension, a byte a codebook, or sign bits and two floats."""
    return {"exact": 4 * dim, "sq8": dim, "pq": m, "sign": -(-dim // 8) + 8}[coding]


def stored_bytes(rows: DataFrame) -> DataFrame:
    """(bytes, n): the sizes of coded vectors (data) and how many have each."""
    return rows.groupBy(F.length("data").alias("bytes")).agg(F.count("*").alias("n"))
