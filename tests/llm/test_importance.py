import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import importance as I


def test_threshold(spark):
    rng = random.Random(2)
    xs = [rng.randrange(-(2**62), 2**62) for _ in range(150)] + [0, -1, 1, 5, 5, 5, -(2**40)]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x long").repartition(3)
    order = sorted(xs, reverse=True)
    for k in (1, 2, 77, 80, len(xs)):
        assert I.threshold(df, "x", k) == order[k - 1]
    assert I.threshold(df, "x", len(xs) + 1) is None and I.threshold(df.limit(0), "x", 1) is None


def test_weights_equal_brute_force_and_selection(spark):
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(50)], [f"### b{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(60)), "z") for i in range(80)]
    rows += [(200, None, "z"), (201, "", "z"), (None, "g1 g2", "z"), (7, rows[7][1], "z"), (300, "g1 g2 " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    target = spark.createDataFrame([(i,) for i in range(80) if i % 4 and i < 60], "doc_id long")
    got = I.resample(df, target, k=64).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 64
    hasher = I.Hasher()
    bags = [np.bincount(hasher.buckets(t or ""), minlength=I.BUCKETS) for _, t, _ in rows]
    wanted = {i for i in range(80) if i % 4 and i < 60}
    p = sum((b for b, r in zip(bags, rows) if r[0] in wanted), np.ones(I.BUCKETS))
    q = sum(bags, np.ones(I.BUCKETS))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    want = {i: float((b * ratio).sum()) for (i, _, _), b in zip(rows, bags)}
    assert all(abs(want[r.doc_id] - r.log_weight) < 1e-6 * max(1, abs(want[r.doc_id])) for r in got)
    edge = min(r.gumbel_key for r in got if r.kept)
    assert all(r.gumbel_key <= edge for r in got if not r.kept)
    noise = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(I.SEED)).alias("h")).collect()}
    for r in got:  # the Gumbel draw, by hand
        u = (noise[r.doc_id] % 2**52 + 0.5) / 2**52
        assert abs(r.gumbel_key - (r.log_weight - math.log(-math.log(u)))) < 1e-9
    assert len({(noise[r.doc_id] % 2**52) for r in got}) == len({r.doc_id for r in got})
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i in range(80) if i % 4} <= kept and not {i for i in range(80) if i % 4 == 0} & kept
    assert I.resample(df.limit(0), target, share=0.5).count() == 0
    assert all(r.kept for r in I.resample(df, target, share=1.0).collect())
    even = spark.createDataFrame([(i, "") for i in range(9)] + [(3, "")], "doc_id long, text string")
    assert sum(r.kept for r in I.resample(even, target.limit(0), k=4).collect()) == 4


def test_exactly_k_of_equal_rows_and_ids_of_any_type(spark):
    rows = [("same", "a b c")] * 10 + [("x", "a b"), (None, "a"), (None, "a"), ("y", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    target = spark.createDataFrame([("same",)], "doc_id string")
    for k in range(len(rows) + 1):
        assert sum(r.kept for r in I.resample(df, target, k=k).collect()) == k


def test_ordered_integers_follow_the_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    got = I.ordered(x)
    assert (np.diff(got) >= 0).all() and got[4] == got[5] and len(set(got.tolist())) == len(x) - 1


def test_gumbel_keys_sample_in_proportion(spark):
    """Of many draws with one row each, documents of twice the weight win about twice as often."""
    rng = np.random.default_rng(1)
    u = rng.random((20_000, 3))
    keys = np.log([1.0, 2.0, 4.0]) - np.log(-np.log(u))
    share = np.bincount(keys.argmax(1), minlength=3) / len(u)
    assert np.allclose(share, [1 / 7, 2 / 7, 4 / 7], atol=0.02)
