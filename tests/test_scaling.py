"""Work that grows no faster than the input: sentences in chunks (sentence_places, placed_items), gaps of a ladder (gate_table), matrices of
vector searches (ivf_recall, rendered_results, mrl_recall, separable_lists)."""

import time

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import gates as G
from plumbline.operators import containment as C
from plumbline.operators import vectors as V
from plumbline.sources.arrow import sliced


def test_chunks_come_once_for_their_sentences(spark, monkeypatch):
    monkeypatch.setattr(C, "TOGETHER", 3)
    monkeypatch.setattr(C, "KNOWN", 2)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words, n))
    able = C.prepared(spark.createDataFrame([(i, text(4)) for i in range(9)], "sid long, text string"), "sid", "text")
    chunks = C.prepared(spark.createDataFrame([(i, text(15)) for i in range(20)], "cid long, text string"), "cid", "text")
    pairs = able.select("sid").crossJoin(chunks.select("cid"))
    got = {(r.sid, r.cid): (r.is_strict, r.is_quoted, round(r.share, 9)) for r in C.compared(pairs, able, chunks, 0.75).collect()}
    want = {}
    for a in able.collect():
        for c in chunks.collect():
            share = len(set(a.tokens) & set(c.tokens)) / len(a.tokens)
            if share >= 0.75 - 1e-9 or a.strict in c.strict or a.quoted in c.quoted:
                want[a.sid, c.cid] = (a.strict in c.strict, a.quoted in c.quoted, round(share, 9))
    assert got == want and want
    found = {(r.sid, r.cid) for r in C.candidates(able.select("sid", "tokens"), chunks.select("cid", "tokens"), 0.75).collect()}
    assert set(want) <= found


def test_ladder_gap_of_many(spark):
    rows = spark.range(30_000).select((0.8 + F.col("id") * 5e-6).alias("r")).union(spark.createDataFrame([(0.96,), (0.5,)], "r double"))
    start = time.time()
    got = rows.agg(F.collect_list("r").alias("r")).select(G.ladder_gap(F.col("r"))).first()[0]
    assert abs(got - (0.96 - (0.8 + 29_999 * 5e-6))) < 1e-12
    assert time.time() - start < 20


def test_probes_come_in_small_batches(spark, monkeypatch):
    """One query for each of its cells: a batch of queries must not be multiplied in one piece."""
    monkeypatch.setattr(V, "PROBES", 8)
    index = V.Index(np.eye(4))
    asked = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.5, float(i)]) for i in range(30)], "qid long, vector array<double>").coalesce(1)
    assert V.probes(index, asked, 3).groupBy("id").count().where("count != 3").count() == 0
    import pyarrow as pa

    assert [b.num_rows for b in sliced(iter([pa.record_batch({"x": list(range(7))}), pa.record_batch({"x": pa.array([], pa.int64())})]), 3)] == [3, 3, 1]


def test_blocks_are_scored_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "id long, vector array<double>")
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("qid"), "vector")
    whole = sorted(map(tuple, V.top_k(rows, asked, 5).collect()))
    monkeypatch.setattr(V, "TOGETHER", 3)
    assert sorted(map(tuple, V.top_k(rows, asked, 5).collect())) == whole
