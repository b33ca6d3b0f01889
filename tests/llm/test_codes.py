import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import codes
from plumbline.llm.codes import coded, nearest, neighbours, op13_vector_codes

SMALL = "/root/testdata/sf0.001"


def brute(rows, rounds=6):
    """The contract in plain whole numbers, every entry compared. rows: (vec_id, vector, label)."""
    rows = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in rows) // 8))
    rows = [(i, v + [0] * (8 * width - len(v)), lab) for i, v, lab in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for _, v, _ in rows:
                groups[find(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out, total = [], defaultdict(int)
    for i, v, lab in rows:
        found = [find(cut(v, p), books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        total[lab] += error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, lab])
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=str)


def told(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{SMALL}/embeddings.parquet").to_pydict()
    assert told(op13_vector_codes(spark, SMALL)) == brute(zip(t["vec_id"], t["embedding"], t["label"], strict=True))


def test_nulls_ties_and_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 16) / 8], int(i) % 3) for i in rng.permutation(60)]
    rows += [(5, rows[0][1], None), (5, rows[0][1], None), (None, rows[1][1], 1), (None, [0.5] * 16, None), (70, [0.25] * 9, 2), (71, [], 2), (72, [0.0] * 16, 0)]
    bad = [(80, None, 1), (81, [1.0, None] + [0.0] * 14, 1), (82, [float("nan")] * 16, 1), (83, [float("inf")] + [0.0] * 15, None), (84, [float("-inf")] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "V": F.lit("x"), "salt": F.lit(2)})
    assert told(coded(df.repartition(5))) == brute(rows + bad)


@pytest.mark.parametrize("n", [1, 3, 16, 17])
def test_few_rows(spark, n):
    rows = [(i, [i / 7, -i / 3, 1.0], i % 2) for i in range(n)]
    assert told(coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == brute(rows)


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert coded(df).count() == 0
    rows = [(1, [70_000.0] * 8, 0), (2, [40_000.0] * 8, 0), (3, [-40_000.0] * 8, 0)]
    got = told(coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert got == brute(rows[1:])


def test_radius_loses_no_tie():
    rng = np.random.default_rng(1)
    for _ in range(30):
        book, x = rng.integers(-4, 5, (16, 3)), rng.integers(-6, 7, (500, 3))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        best, least = nearest(x, book, rng.integers(0, 16, 500), neighbours(book))
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_one_entry():
    best, least = nearest(np.array([[1, 2]]), np.array([[0, 0]]), np.zeros(1, "i8"), neighbours(np.array([[0, 0]])))
    assert best.tolist() == [0] and least.tolist() == [5] and codes.digest(np.zeros((1, 1, 2), "i8")) == hashlib.sha256(b"0,0").hexdigest()
