import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.neighbours import best_in_shard, graph_of, graphs, neighbours, op11_neighbours, vectors
from plumbline.operators.proximity import reached


def exact(rows, k=20, every=20):
    """Every candidate compared in plain Python. rows: (id, vector)."""
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own[i] = min(own.get(i, tuple(v)), tuple(v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = {}
    for q, v in own.items():
        if q % every == 0:
            best = sorted(((-dot(v, w), i) for i, w in own.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in own}) for q, own in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_finds_the_nearest(spark, size):
    folder = f"/root/testdata/{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = told(op11_neighbours(spark, folder)), exact(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.97
    by_id = dict(rows)
    for q, own in got.items():
        assert all(q != i and abs(s - sum(x * y for x, y in zip(by_id[q], by_id[i]))) < 1e-12 for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_several_shards_near_copies_and_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1, 24))
    x = np.concatenate([rng.normal(size=(1200, 24)) * rng.uniform(0.2, 3, (1200, 1)), base + rng.normal(size=(400, 24)) * 0.02])
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(1600), x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert graphs(vectors(df), 300).count() == 5
    assert recall(told(neighbours(df, shard=300)), exact(rows)) >= 0.97


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, float(i % 7), 0.5]) for i in range(90)] + [(i, [1.0, 2.0, 3.0]) for i in range(100, 150)]
    rows += [(3, [0.0, 0.0, -1.0]), (3, [0.0, 0.0, -1.0]), (20, [9.0, 9.0, 9.0]), (200, [2.0, 1.0]), (201, [5.0])]
    bad = [(None, [1.0, 1.0, 1.0]), (300, None), (320, [0.0, 0.0, 0.0]), (340, [None, 1.0, 1.0]), (360, [float("nan"), 1.0, 1.0]), (380, [float("inf"), 1.0, 1.0]), (400, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "SHARD": F.lit(2), "id": F.lit(3), "vector": F.lit("x")})
    got, want = told(neighbours(df.repartition(3), width=200)), exact(rows + bad)
    assert got == want and [i for i, _ in got[100]] != sorted(i for i, _ in got[100])[::-1]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (40, [0.0, 1.0]), (41, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert told(neighbours(df)) == exact([(20, [1.0, 0.0]), (40, [0.0, 1.0]), (41, [1.0, 1.0])])
    assert told(neighbours(df.where("vec_id = 20"))) == {} and told(neighbours(df.limit(0))) == {}


def test_every_point_can_be_reached():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(300, 8)) * 1e-3 + 20, rng.normal(size=(1, 8)) + 500]).astype("f4")
    edges, start = graph_of(x, degree=4, width=8)
    assert reached(edges, start).all() and edges.shape == (602, 5) and edges.max() == 601
    row = {"data": x.astype("f8").tobytes(), "ids": np.arange(601).tobytes(), "firsts": np.arange(602).tobytes(), "edges": edges.tobytes(), "start": start, "dims": 8}
    at, own, _ = best_in_shard(row, np.array([-1]), x[600:].astype("f8"), 5, 601)  # holds every point that it meets
    assert own[0] == 600 and len(own) == 5 and (at == 0).all()
