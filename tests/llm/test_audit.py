import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm.audit import FILTERS, audit, carried, failures, masks

GOOD = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", GOOD, GOOD + " #", "one two " * 40, "A" + "b" * 19, "A" + "b" * 18, GOOD.upper(), "a\x0bb\x0cc\rd\te\x85f g", " ".join(f"é{i}" for i in range(50)), "x|y", "w " * 20_000, GOOD.replace(" ", "\n")]


def brute(rows, labels):
    """Every order applied document by document."""
    fails = []
    for id_, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = id_ is not None and any(i is not None and i < id_ and (u or "") == t for i, u, _ in rows)
        marks = [(q, x) for i, q, x in labels if i == id_ and i is not None]
        fails.append((part or "", {f for f in own if own[f]}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out, totals = {}, Counter()
    for order in itertools.permutations(FILTERS):
        for part in {p for p, *_ in fails}:
            left = [x for x in fails if x[0] == part]
            away = []
            for k, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                totals[part, f] += len(here)
                out[part, "".join(order), k] = [len(left), len(here), sum(f in x[1] for x in away), sum(x[0] == part and x[1] == {f} for x in fails), sum(x[2] for x in here), sum(x[3] for x in here)]
                away += here
    return {key: (*value, totals[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_every_order_applied_document_by_document(spark):
    rows = [(i * 3, t, f"s{i % 2}") for i, t in enumerate(TEXTS)]
    # Copies of smaller and larger ids, equal ids, null ids and parts.
    rows += [(1, GOOD, "s0"), (1, GOOD, "s0"), (100, GOOD, None), (100, GOOD, ""), (None, GOOD, "s1"), (None, "x|y", "s1"), (200, "x|y", "s1"), (200, "new # text", "s1"), (201, "new # text", "s2")]
    labels = [(0, 1, 0), (3, 0, 1), (6, 1, None), (6, 0, 1), (100, 1, 1), (200, None, 1), (None, 1, 1), (999, 1, 1), (1, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit(5), "mask": F.lit("x"), "PID": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(9))
    got = told(audit(df, marks))
    assert got == brute(rows, labels) and len(got) == 4 * 600


def test_runs_that_cross_partitions(spark):
    rows = [(i, "the same text", "a") for i in range(4000)] + [(i, f"own {i % 1500}", "b") for i in range(4000, 8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(7)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        own = masks(df).cache()
        edges = own.where("mask is null")
        went_on = carried(edges.select("pid", "head", "tail", "least")).collect()
        assert len({r["from"] for r in went_on}) > 1 and max(Counter(r["from"] for r in went_on).values()) >= 5  # the hot run fills partitions
        got = told(audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), part_col="part"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["a", "EABCD", 1][:3] == (1, 3999, 0) and got["b", "EABCD", 1][:3] == (1500, 2500, 0)
    assert got["a", "ABCDE", 5][2] == 3999


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(df, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    rows = told(audit(one, labels))
    assert len(rows) == 600 and rows["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and rows["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_failures_at_their_limits():
    assert failures(" ".join(f"w{i}" for i in range(50))) == 0
    assert failures("A" + "b" * 19) & 4 == 0 and failures("A" + "b" * 18) & 4
    assert failures(" ".join(f"w{i % 65}" for i in range(100))) == 0 and failures(" ".join(f"w{i % 64}" for i in range(100))) == 2
