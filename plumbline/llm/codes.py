"""Vector codes: product quantisation in whole numbers, by rounds of assignment with exponion search.

A part of a vector starts at the entry that it had in the round before, at a squared distance u from it. An entry that is
as near lies within twice that distance of the one before (triangle inequality), so the other entries, sorted by their
distance from it, are compared only while their squared distance is at most 4 u. All distances are exact integers, and of
entries at one distance the first wins.

The codebooks are small (parts x entries x width) and travel with the task; a round adds up sums and counts for each
entry on the executors, and only those come to the driver. A task finds what a part had in the round before by going through
the codebooks of all rounds so far, so no table of the vectors is written again, and a lost executor costs its own tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, mapped

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors (times SCALE) that are shorter than this have squared distances that fit 64 bits, four times over.
LONGEST = 1 << 29
#: Rows that a worker holds as a matrix at a time; a memory bound.
ROWS = 8192
#: Shares that a label's total is dealt to, so that a frequent label is not one task.
SALT = 64


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the others by their distance from it, ties by number, and those squared distances, both n x (n - 1)."""
    apart = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    order = order[order != np.arange(len(book))[:, None]].reshape(len(book), len(book) - 1)
    return order, np.take_along_axis(apart, order, 1)


def nearest(x: np.ndarray, book: np.ndarray, before: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x, the first of equals, and its squared distance; ``before`` is where each starts."""
    order, apart = near
    best, least = before.copy(), ((x - book[before]) ** 2).sum(1)
    for entry in range(len(book)):
        own = np.flatnonzero(before == entry)
        # How many neighbours of the entry lie inside each row's radius.
        reach = np.searchsorted(apart[entry], 4 * least[own], side="right")
        for k in range(len(book) - 1):
            own, reach = own[reach > k], reach[reach > k]
            if not len(own):
                break
            other = order[entry, k]
            d = ((x[own] - book[other]) ** 2).sum(1)
            better = (d < least[own]) | ((d == least[own]) & (other < best[own]))
            best[own[better]], least[own[better]] = other, d[better]
    return best, least


def assigned(x: np.ndarray, history: list[tuple[np.ndarray, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows x parts) of parts x (rows x parts x width) after the rounds of the history: codebooks
    (parts x entries x width) and their neighbours."""
    code = np.zeros(x.shape[:2], "i8")
    error = np.zeros(x.shape[:2], "i8")
    for books, near in history:
        for p, book in enumerate(books):
            code[:, p], error[:, p] = nearest(x[:, p], book, code[:, p], near[p])
    return code, error


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of up to PARTS x width integers as rows x parts x width, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), PARTS * width), "i8")
    out[np.arange(PARTS * width) < sizes[:, None]] = column.flatten().to_numpy()
    return out.reshape(len(column), PARTS, width)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def summed(rows: DataFrame, history: list, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, sums by place) of each part's entries, by (part, entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_entries = history[-1][0].shape[1]
        for batch in blocks(batches):
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), width)
            flat = (assigned(x, history)[0] + np.arange(PARTS) * n_entries).ravel()
            count = np.bincount(flat, minlength=PARTS * n_entries)
            total = np.zeros((PARTS * n_entries, width), "i8")
            np.add.at(total, flat, x.reshape(-1, width))
            at, place = np.repeat(np.arange(PARTS * n_entries), width), np.tile(np.arange(width), PARTS * n_entries)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place), pa.array(np.repeat(count, width)), pa.array(total.ravel())], ["at", "place", "n", "total"])

    sums = mapped(rows.select("v"), run, "at bigint, place bigint, n bigint, total bigint", by=None)
    sums = sums.groupBy("at", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).where("n > 0")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    n_entries = history[-1][0].shape[1]
    for r in sums.collect():  # parts x entries x width rows
        out.setdefault(divmod(r["at"], n_entries), (r["n"], [0] * width))[1][r["place"]] = int(r["total"])
    return out


def whole(x: Column) -> Column:
    return F.floor(x.cast("double") * F.lit(float(SCALE))).cast("bigint")


def kept(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that have codes, v as whole numbers."""
    v = df[vector_col]
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))  # null, NaN or infinite like a component
    return df.where((square < F.lit(float(LONGEST // SCALE) ** 2)) & ~F.isnan(square)).select(df[id_col].alias("vec_id"), df[label_col].alias("label"), F.transform(v, whole).alias("v"))


def trained(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, list]], int]:
    """The codebooks of all rounds with their neighbours, from rows (vec_id, v), and the width of a part."""
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()]
    width = max(1, -(-rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0] // PARTS))
    if not first:
        return [], width
    start = np.zeros((len(first), PARTS * width), "i8")
    for row, v in zip(start, first, strict=True):
        row[: len(v)] = v
    books = start.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    history = [(books, [neighbours(b) for b in books])]
    for _ in range(rounds):
        books = books.copy()
        for (part, entry), (n, total) in summed(rows, history, width).items():
            books[part, entry] = [t // n for t in total]
        history.append((books, [neighbours(b) for b in books]))
    return history, width


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(df: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for every row with a vector.

    Rows whose vector is null or holds null or non-finite components are left out, and so are vectors of a length (the root
    of the sum of squares) of 131,072 or more, whose squared distances would not fit 64 bits. Vectors are filled with zeros to the longest one's
    length, rounded up to parts of one width, so none is too short. Fewer rows than entries give as many entries; equal
    ids are told apart by their vectors, null ids come last; repeated rows count as often as they are there; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = cut(kept(df, id_col, vector_col, label_col), "whole-vectors")
    history, width = trained(rows, rounds)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            if batch.num_rows and history:
                code, error = assigned(matrix(batch.column("v"), width), history)
                texts = [r.tobytes().hex() for r in code.astype("u1")]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    out = cut(mapped(rows, run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint", by=None), "codes")
    discard(rows)
    totals = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    # A frequent label's rows are dealt to SALT keys, each with the label's total.
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    both = dealt.alias("a").join(totals.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return both.select("a.vec_id", "a.code", "a.error", "b.label_error", F.lit(digest(history[-1][0]) if history else None).cast("string").alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
