import pytest
from pyspark.sql import functions as F

from plumbline.operators import provenance as P

NESTED = "output array<struct<provenance array<struct<title string>>>>"


def schema(text):
    """A schema with types written as name type, for nested ones."""
    return text.replace("struct<provenance ", "struct<provenance:").replace("struct<title ", "struct<title:")


def test_titles_and_keys(spark):
    rows = [("Who  wrote É-mile?", [([("B",), ("A",), (None,), ("",)],), (None,), ([("A",)],)]), ("none", []), ("null", None)]
    df = spark.createDataFrame(rows, schema(f"input string, {NESTED}"))
    got = df.select("input", P.titles(F.col("output")).alias("t"), P.question_key(F.col("input")).alias("k")).collect()
    assert [(r.t, r.k) for r in got] == [(["A", "B"], "who wrote e mile"), ([], "none"), ([], "null")]


def test_questions_find_their_titles(spark):
    known = spark.createDataFrame([("what is it?", [([("A",), ("B",)],)]), ("WHAT is it", [([("Z",)],)]), ("other", [([("C",)],)])], schema(f"input string, {NESTED}"))
    asked = spark.createDataFrame([(1, " What -- is it?! "), (2, "other"), (3, "unknown"), (4, None)], "qid int, question string")
    found = P.usable(P.annotated(asked, known), spark.createDataFrame([("A",), ("A",), (None,)], "title string"))
    assert {r.qid: (r.titles, r.used, r.dropped) for r in found.collect()} == {1: (["A", "B"], ["A"], 1), 2: (["C"], [], 1)}


@pytest.mark.parametrize("left,right,want", [([], [], (0, 0, 0, 0)), ([(1, "a"), (1, "a")], [(1, "a")], (2, 1, 1, 0)), ([(1, None)], [(1, "null")], (1, 1, 1, 1)), ([(1, "a"), (2, "b")], [(2, "b"), (3, "a")], (2, 2, 1, 1))])
def test_both_ways(spark, left, right, want):
    a, b = (spark.createDataFrame(x, "x int, y string") for x in (left, right))
    assert tuple(P.differing(a, b, ["x", "y"]).first()) == want


def test_gates(spark):
    found = spark.createDataFrame([(1, ["A", "B"], ["A"], 1), (2, ["C"], ["C"], 0)], "qid int, titles array<string>, used array<string>, dropped int")
    frozen = spark.createDataFrame([(1, "A|B"), (2, "C")], "qid int, titles string")
    assert tuple(P.reproduced(found, frozen, 2).first()) == ("K0", 2, True, True, True)
    assert not P.reproduced(found, frozen, 3).first().passed
    changed = P.reproduced(found, frozen.withColumn("titles", F.upper(F.reverse("titles")))).first()
    assert changed.same_ids and not changed.same_titles and not changed.passed
    rows = spark.createDataFrame([(0, "x"), (1, "y")], "row int, title string")
    assert tuple(P.titles_agree(found, rows, rows).first()) == ("K1", 2, 1, 0, 0, True)
    assert P.titles_agree(found, rows.union(rows.selectExpr("row + 9", "title")), rows).first().mismatches == 2
    pairs = spark.createDataFrame([(True, True), (None, None), (True, None)], "a boolean, b boolean")
    assert tuple(P.recomputed(pairs, "a", "b").first()) == ("K2", 3, 1, False) and P.recomputed(pairs.limit(2), "a", "b", 2).first().passed


def test_changes_of_an_index(spark):
    def state(docs):
        rows = [(d, i, t) for d, own in docs.items() for i, t in enumerate(own)]
        return P.identified(spark.createDataFrame(rows, "doc_id string, chunk int, text string"))

    def changes(before, after):
        rows = ((r.doc_id, r.was, r.now, r.change) for r in P.merged(state(before), state(after)).collect() if r.change != "keep")
        return sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2] or 0))

    was = {"d": ["a", "b", "c", "d", "e", "f"], "e": ["x", "x", "x", "x"]}
    assert changes(was, was) == []
    # An edit gives the chunk and those beside it other identities.
    assert [c[1:] for c in changes({"d": list("abcdef")}, {"d": list("abCdef")}) if c[3] == "delete"] == [(1, None, "delete"), (2, None, "delete"), (3, None, "delete")]
    # What only moves keeps its row: all but the first, whose neighbour is new.
    moved = changes({"d": list("abcdef")}, {"d": list("zabcdef")})
    assert [(c[1], c[2]) for c in moved if c[3] == "move"] == [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)] and sum(c[3] == "insert" for c in moved) == 2
    # A document goes; equal chunks are told apart.
    assert {c[3] for c in changes(was, {"e": ["x"] * 4})} == {"delete"}
    assert [c[3] for c in changes({"e": ["x"] * 4}, {"e": ["x"] * 5})] == ["move", "insert"]
