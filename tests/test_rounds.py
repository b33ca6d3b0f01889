"""Greedy choices in rounds (disjoint_questions), manifests with repeated paths (manifest_status), wanted keys without any event
(checkpoint_missing)."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import selection as S
from plumbline.plans import checks
from plumbline.sources import tables as T


def plain_quota(rows, quotas, order):
    out = set()
    for stratum, quota in quotas.items():
        taken, seen = [], set()
        for key, evidence in sorted(((k, e) for s, k, e in rows if s == stratum), key=lambda r: (order[r[0]], r[0])):
            if len(taken) < quota and not seen & set(evidence):
                taken.append(key)
                seen |= set(evidence)
        out |= {(stratum, k) for k in taken}
    return out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_quota_in_rounds(spark, block):
    rows = [("ab"[i % 2], i, [i % 5, 10 + i % 7] if i % 9 else []) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, k long, e array<int>")
    order = {r.k: r.at for r in df.select("k", S.shuffled(7, F.col("k")).alias("at")).collect()}
    got = {(r.s, r.k) for r in S.disjoint_quota(df, "s", "k", "e", {"a": 9, "b": 4}, 7, block).collect()}
    assert got == plain_quota(rows, {"a": 9, "b": 4}, order) and len(got) == 13


def test_quota_of_a_large_stratum(spark):
    df = spark.range(S.MOST + 10).select(F.lit("a").alias("s"), F.col("id").alias("k"), F.array(F.col("id") % 3).alias("e"))
    assert S.disjoint_quota(df, "s", "k", "e", {"a": 3}, 1).count() == 3


def test_quota_that_cannot_be_filled(spark):
    df = spark.range(50).select(F.lit("a").alias("s"), F.col("id").alias("k"), F.array(F.col("id") % 3).alias("e"))
    with pytest.raises(Exception, match="stratum not filled"):
        S.disjoint_quota(df, "s", "k", "e", {"a": 4}, 1, 2).collect()


def test_a_path_with_several_files(spark):
    found = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1")], "path string, sha256 string")
    manifest = spark.createDataFrame([("p", "2"), ("p", "1"), ("p", "0"), ("q", "2"), ("r", "1")], "path string, sha256 string")
    got = sorted(tuple(r) for r in T.verify(found, manifest).collect())
    assert got == [("p", "HASH MISMATCH"), ("p", "verified"), ("p", "verified"), ("q", "HASH MISMATCH"), ("r", "MISSING")]


def test_status_of_repeated_pages(spark, tmp_path):
    """Pages 10, 20, 30, ... are gone, 7, 14, ... changed: a url that two pages share has both of their statuses."""
    spark.createDataFrame([(1, "u", "x"), (7, "u", "x"), (2, "v", "y"), (3, "v", "y"), (10, "w", "z")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.status: r.n for r in checks.manifest_status(spark, str(tmp_path)).collect()} == {"verified": 2, "HASH MISMATCH": 1, "MISSING": 1}


def test_customers_without_events_are_missing(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 1, "click", 0.5), (2, 9, "view", 0.5)], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in checks.checkpoint_missing(spark, str(tmp_path)).collect())
    assert got == [(1, "absent"), (2, "absent"), (2, "click"), (9, "absent"), (9, "click")]
