"""Hand-worked cases of the functions and operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cost as C
from plumbline.functions import decisions as D
from plumbline.functions import text as X
from plumbline.operators import graph as G
from plumbline.operators import runs as R
from plumbline.operators import stats as S
from plumbline.operators import vectors as V
from plumbline.plans.corpus import regime
from plumbline.sources import tables as A
from plumbline.streaming import checkpoints as K


def one(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items()] or [F.lit(1).alias("_")])
    return row.select(column).first()[0]


def test_text(spark):
    assert one(spark, X.normalise_answer(F.col("t")), t="The  Cat's, an (old) hat!") == "cats old hat"
    assert one(spark, X.norm_text("t"), t="Élan, naïve ß") == "e lan  nai ve  "
    assert one(spark, X.references(F.col("t")), t="Fixed by #34 and #7.") == [34, 7]
    assert one(spark, X.references(F.col("t")), t="see other/repo#9") == []
    assert one(spark, X.references(F.col("t")), t="#5 then #5 then #2 `#8` ```\n#9") == [5, 2]
    assert one(spark, X.f1(F.col("p"), F.col("g")), p="a cat sat", g=["the cat", "dog"]) == pytest.approx(2 / 3)
    assert one(spark, X.exact_match(F.col("p"), F.col("g")), p="The Cat.", g=["dog", "cat"]) == 1
    assert one(spark, X.is_decline(F.col("p")), p="I don’t know.") is True and one(spark, X.is_decline(F.col("p")), p="\n I DON'T KNOW!. ") is True
    assert not any(one(spark, X.is_decline(F.col("p")), p=x) for x in ("idk", "I do not know", "I don't know why", ""))
    assert one(spark, X.is_decline_prefix(F.col("p")), p="I don't know\nbut maybe") is True
    assert one(spark, X.parse_golds(F.col("g")), g='["a", "b"]') == ["a", "b"] and one(spark, X.parse_golds(F.col("g")), g="plain") == ["plain"]
    assert one(spark, X.split_field(F.col("g")), g=" a ; ;b") == ["a", "b"]
    assert one(spark, X.first_sentence(F.col("t")), t="# Head\n> quote\n\nOne two. Three.") == "One two."
    assert one(spark, X.normalise_path(F.col("t")), t="`.\\src\\a.py`") == "src/a.py"
    assert one(spark, X.whole_words(F.lit("cat"), F.lit("a cat sat"))) and not one(spark, X.whole_words(F.lit("at"), F.lit("a cat sat")))
    for n, want in ((0, 1), (1800, 1), (1801, 2), (3400, 2), (3401, 3)):
        assert one(spark, F.size(X.chunks(F.col("t"))), t="x" * n) == want == one(spark, X.chunk_count(F.col("t")), t="x" * n)


def test_cost(spark):
    r = regime()
    live = lambda prefix: one(spark, C.live_query_cost(r, F.lit(float(prefix)), 20.0, 30.0, 0.9))
    assert live(100_000) == pytest.approx((100_000 * 0.58 + 20 * 2 + 30 * 10) / 1e6)
    assert live(1_000_001) is None
    at = lambda n: tuple(one(spark, C.rates(r, F.lit(float(n)))))
    assert at(272_000) == (2, 4, 0.2, 10) and at(272_001) == (4, 4, 0.4, 12)
    be = lambda a, b: one(spark, C.break_even(F.lit(a).cast("double"), F.lit(b), F.lit(3.0)))
    assert be(0.02, 0.01) == pytest.approx(300) and be(0.01, 0.02) == math.inf and be(None, 0.02) is None
    assert one(spark, C.stretch_hit_rate(0.9, 2.0)) == pytest.approx(0.8)
    assert one(spark, C.infra_monthly(40 * C.GIB, "dedicated", 1.0, 16.0, 1.0, 1.0)) == pytest.approx(3 * 730.5)


def test_decisions(spark):
    assert [one(spark, D.classify_delta(F.lit(a), F.lit(b))) for a, b in ((0.01, 0.02), (-0.01, 0.04), (-0.1, 0.06))] == ["DROP", "PLATEAU", "INCONCLUSIVE"]
    assert one(spark, D.is_matched(F.lit(0.93), F.lit(0.90))) and not one(spark, D.is_matched(F.lit(0.94), F.lit(0.90)))
    knee = lambda low, high, a, b: one(spark, D.knee_width_branch(*map(F.lit, (low, high, 0.1, 0.9, a, b))))
    assert [knee(0.5, 0.52, 0.1, 0.2), knee(0.5, 0.7, 0.1, 0.2), knee(0.102, 0.12, 0.1, 0.2), knee(0.5, 0.52, -0.1, 0.2)] == ["N1", "N2", "N2", "N3"]
    assert [one(spark, D.parametric_reading(F.lit(a))) for a in (0.1, 0.3, 0.31)] == ["holds", "partial_leak", "does_not_ground"]
    assert [one(spark, D.resolve_branch(F.lit(x), F.lit(m), "p", "n", "0")) for x, m in ((True, 1.0), (True, -1.0), (True, 0.0), (False, 1.0))] == ["p", "n", "n", "0"]
    assert [one(spark, D.hop_branch(F.lit(a), F.lit(b), F.lit(h))) for a, b, h in ((0.1, 0.2, True), (-0.1, 0.2, False), (-0.2, -0.1, False), (0.1, 0.2, False))] == ["H4-confounded", "H2", "H1", "H3"]
    assert [one(spark, D.gate_verdict(F.lit(a))) for a in (0.05, 0.1, 0.11)] == ["pass", "investigate", "fail"]
    label = lambda a, b: tuple(one(spark, D.adjudicate(F.lit(a), F.lit(b))))
    assert label("eligible", "ambiguous") == ("eligible", "eligible") and label("ambiguous", "ambiguous") == ("ineligible", "ambiguous") and label("ambiguous", "stale_gold") == ("ineligible", D.DISPUTED)
    with pytest.raises(Exception, match="unknown label"):
        label("eligible", "other")
    assert one(spark, D.decline_gate(F.lit(0), F.lit(0))) is False


def test_stats(spark):
    p = lambda k, n: one(spark, S.sign_test_p(F.lit(k), F.lit(n)))
    assert p(20, 20) == pytest.approx(2 * 0.5**20) and p(10, 20) == 1.0 and p(0, 0) == 1.0 and p(26, 40) == pytest.approx(0.0806904677519924)
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.2)], "arm string, p double")
    assert {r.arm: round(r.adjusted, 9) for r in S.step_up(tests).collect()} == {"a": 0.04, "b": 0.08, "c": 0.08, "d": 0.2}
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert S.kappa(same, "a", "b").first().kappa == 1.0
    assert S.draws(spark, 5, 3).agg(F.sum("weight")).first()[0] == 15
    with pytest.raises(ValueError):
        S.bonferroni(0.05, 0)


def test_runs(spark):
    runs = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 5.0)], "qid long, arm string, v double")
    with pytest.raises(Exception, match="unpaired key 2"):
        R.paired_deltas(runs, "v", "a", "b").collect()
    assert R.paired_deltas(runs.where("qid = 1"), "v", "a", "b").first().delta == 2.0
    assert {tuple(r) for r in R.incomplete(runs, spark.createDataFrame([(1,), (2,)], "qid long"), ["a", "b"]).collect()} == {(2, "b", 0)}
    sweep = spark.createDataFrame([("arm_a", 4, 0.85, 90.0), ("arm_a", 8, 0.92, 50.0), ("arm_a", 16, 0.95, 30.0), ("arm_b", 64, 0.97, 10.0), ("arm_b", 32, 0.96, 20.0)], "arm string, sweep_value int, recall double, qps double")
    got = {(r.arm, r.target): (r.sweep_value, r.met) for r in R.best_points(sweep, [0.90, 0.99]).collect()}
    assert got["arm_a", 0.90] == (8, True) and got["arm_b", 0.99] == (64, False)
    assert one(spark, R.greedy_prefix(F.array(*map(F.lit, [60, 50, 30, 20, 10])), 100)) == [0, 2, 4]


def test_graph(spark):
    nodes = spark.createDataFrame([(12,), (34,), (56,), (99,)], "number long")
    edges = spark.createDataFrame([(12, 34), (34, 56), (56, 34)], "src long, dst long")
    paths = {tuple(r.path) for r in G.extract_chains(nodes, edges).collect()}
    assert (12, 34, 56) in paths and (99,) in paths and (34, 56) in paths and (56, 34) in paths and len(paths) == 4
    heads = {r.head: tuple(r.path) for r in G.one_per_head(G.extract_chains(nodes, edges)).collect()}
    assert heads[12] == (12, 34, 56)


def test_vectors(spark):
    pred, gt = F.array(*map(F.lit, [1, 2, 9, 8, 3])), F.array(*map(F.lit, [1, 2, 3, 4, 5]))
    assert one(spark, V.recall_ids(pred, gt, 2)) == 1.0 and one(spark, V.recall_ids(pred, gt, 4)) == 0.5
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (999, None)], "id long, vector array<double>").repartition(3)
    q = df.where("id < 7").select(F.col("id").alias("qid"), "vector")
    got = {}
    for r in V.top_k(df, q, 5, block=3).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    s = np.round(x @ x.T, 6)
    for i in range(7):
        assert [got[i][k] for k in range(1, 6)] == sorted(range(300), key=lambda j: (-s[i, j], j))[:5]
    assert V.top_k(df, q.limit(0), 5).count() == 0
    model = V.fit_pca(df.where("id is not null"))
    c = np.cov(x.T)
    assert np.allclose(model.variance, np.linalg.eigvalsh(c)[::-1]) and np.allclose(model.components @ c @ model.components.T, np.diag(model.variance), atol=1e-8)
    with pytest.raises(Exception, match="fewer than 9 dimensions"):
        df.where("vector is not null").select(V.truncate(F.col("vector"), 9)).collect()
    for coding in ("exact", "pq", "sign"):
        index, rows = V.build_index(df.where("id is not null"), 4, coding, m=4)
        assert rows.count() == 300
        found = V.search_index(index, rows, q, 60 if coding != "exact" else 5, 7)
        found = found if coding == "exact" else V.refine(found, df, q, 5)
        assert V.recall_at_k(found, V.top_k(df, q, 5), 5).first().recall >= 0.9


def test_checkpoints(spark, tmp_path):
    lines = [{"qid": "q1", "arm": "a", "cost_total_billed": 1.0}, {"qid": "q1", "arm": "a", "cost_total_billed": 2.0}, {"qid": "q2", "arm": "a", "cost_total_billed": 4.0}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"qid": "q3", "ar')
    got = A.json_lines(spark, str(tmp_path / "c.jsonl"))
    assert A.spent(got).first()[0] == 6.0 and A.spent(got, every_line=True).first()[0] == 7.0
    assert {r.qid: r.cost_total_billed for r in A.latest(got, first=True).collect()} == {"q1": 1.0, "q2": 4.0}
    wanted = spark.createDataFrame([("q1", "a"), ("q3", "a")], "qid string, arm string")
    assert [r.qid for r in A.missing(got, wanted).collect()] == ["q3"]
    with pytest.raises(Exception, match="malformed line"):
        A.json_lines(spark, str(tmp_path / "c.jsonl"), strict=True).collect()
    files = A.digests(spark, str(tmp_path))
    manifest = files.select("path", "sha256").union(spark.createDataFrame([("gone", "00")], "path string, sha256 string"))
    assert sorted(r.status for r in A.verify(files, manifest).collect()) == ["MISSING", "verified"]


def test_stream(spark, tmp_path):
    rng = random.Random(1)
    schema = T.StructType.fromDDL("qid string, arm string, at bigint, v double")
    rows = [{"qid": f"q{rng.randrange(9)}", "arm": "a", "at": i, "v": float(i)} for i in range(60)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows[20 * k : 20 * k + 20])))
    stream = K.read_stream(spark, str(source), schema, files=1)
    K.upsert_to(stream, str(tmp_path / "out"), ["qid", "arm"], "at", str(tmp_path / "state")).awaitTermination(120)
    got = {r.qid: r.v for r in K.current(spark, str(tmp_path / "out"), ["qid", "arm"], "at").collect()}
    assert got == {r["qid"]: r["v"] for r in rows}


def test_titles(spark):
    from plumbline.functions import titles as B

    assert B.title_words("Élan  vital!") == "e lan vital" or B.title_words("Élan  vital!") == "elan vital"
    assert B.nested("new york", "new york city") and not B.nested("york", "newyork")
    assert B.bridges_of("He saw the Eiffel Tower near New York City.", "Paris", {"eiffel tower", "new york city"}) == ["eiffel tower", "new york city"]
    long, loud = "abc This is a long verbatim stretch xyz", "zz THIS IS A LONG VERBATIM STRETCH zz"
    assert B.redact_verbatim(long, loud, fold=True) == "abc" + B.PLACEHOLDER + "xyz" and B.redact_verbatim(long, loud) == long
    assert B.redact_verbatim(long, "is a long verbatim stretch") == "abc This " + B.PLACEHOLDER + " xyz"
    assert B.redact_verbatim(None, "x") is None and B.redact_verbatim("short", "short") == "short"


def test_longest_common_by_brute_force():
    import random

    from plumbline.functions import titles as B

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        least = rng.randrange(1, 4)
        common = [(i, n) for i in range(len(a)) for n in range(least, len(a) - i + 1) if a[i : i + n] in b]
        size = max((n for _, n in common), default=0)
        got = B.longest_common(a, b, least)
        assert got[1] == size and (not size or a[got[0] : got[0] + size] in b)


def test_fits(spark):
    from plumbline.operators import fits as P

    x = np.linspace(0, 1, 12)
    y = np.minimum(x, 0.5)
    got = P.changepoint(x, y)
    assert abs(got["tau"] - 0.5) < 0.01 and abs(got["left"] - 1) < 0.02 and abs(got["right"]) < 0.02 and abs(got["intercept"]) < 0.02
    assert any(abs(got["tau"] - t) < 1e-12 for t in np.linspace(1e-6, 1 - 1e-6, P.GRID))
    assert P.knee_of(np.array([0.9, 0.8, 0.95]), ["PLATEAU", "DROP", "PLATEAU"]) == 0.9 and P.knee_of(np.array([0.9]), ["DROP"]) is None
    rng = np.random.default_rng(1)
    r, q = rng.random((30, 5)), rng.random((30, 5))
    a, b = P.bootstrap_changepoint(spark, r, q, 6, grid=5).collect(), P.bootstrap_changepoint(spark, r, q, 6, grid=5).collect()
    assert sorted(a) == sorted(b) and len(a) == 6
    assert P.leave_k_out(spark, [1.0, 2.0, 3.0, 4.0, 5.0], 2, 20).count() == 10
    assert 0 <= P.false_positive_rate(spark, [1.0, 2.0, 5.0, 9.0], 8, 20, 20).first().rate <= 1


def test_depth(spark):
    from plumbline.operators import depth as Q

    cube = spark.createDataFrame([(a, k, q, q % 2 == 0, False, (q + (a == "x") * k) % 3 == 0) for a in "xy" for k in (1, 3) for q in range(6)], "arm string, k int, qid long, presence boolean, em boolean, judge boolean")
    found = Q.buckets(cube)
    by = {(r.k, r.qid): r.bucket for r in found.collect()}
    assert by[3, 0] == "always" and by[3, 1] == "never" and by[1, 0] == "discriminating"
    sep = cube.select("k", "qid", (F.col("qid") > 2).alias("separable")).distinct()
    got = {r.k: r for r in Q.decompose(found, sep).collect()}
    assert got[3].always == 2 and got[3].signal == 0.0
    assert Q.mediators(cube).where("arm = 'y' and k = 1").first().conversion == pytest.approx(1 / 3)
    assert {r.arm for r in Q.composition(cube, 1, 3).collect()} == {"x", "y"}
    assert Q.monotone(found, "always").first().holds is True
    with pytest.raises(Exception, match="ragged arms"):
        Q.buckets(cube.where("not (arm = 'x' and qid = 2)")).collect()


def test_gates_and_threads(spark):
    from plumbline.functions import gates as Y
    from plumbline.functions import threads as Z

    arr = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    assert one(spark, Y.apply_verdict(F.lit("augment"), arr("a"), arr("a", "b"))) == ["a", "b"]
    assert one(spark, Y.apply_verdict(F.lit("replace"), arr("a"), arr("b"))) == ["b"] and one(spark, Y.changed(F.lit("keep"), arr("a"), arr("b"))) == "unchanged"
    with pytest.raises(Exception, match="replace without golds"):
        one(spark, Y.apply_verdict(F.lit("replace"), arr("a"), none))
    assert one(spark, Y.membership(arr("a", "b"), arr("b", "c"))) == "partial" and one(spark, Y.membership(arr("a"), arr("a"))) == "all"
    assert [one(spark, Y.uphold_gate(F.lit(n), F.lit(k))) for n, k in ((5, 5), (10, 9), (10, 10))] == [True, True, False] and one(spark, Y.concordance_gate(F.lit(0), F.lit(0), 0.9))
    assert one(spark, Y.descending_scores(arr(0.9, 0.5, 0.5), 3)) and not one(spark, Y.descending_scores(arr(0.5, 0.9), 2))
    assert one(spark, Y.forbidden_terms([F.lit("a Foo.bar b")], ["Foo", "foo", "bar"])) == ["Foo", "bar"]
    assert [one(spark, Y.knee_branch(F.lit(r), F.lit(p))) for r, p in ((0.9, True), (0.99, True), (0.9, False))] == ["K1", "K3", "K2"]
    author = F.struct(F.lit("CI-helper").alias("login"), F.lit("User").alias("type"))
    assert one(spark, Z.is_bot(author, ("ci-HELPER",))) and not one(spark, Z.is_bot(author))
    assert one(spark, Z.file_name(F.lit("a/b"), F.lit(7))) == "a_b__0007.md"
    assert one(spark, Z.tier(F.lit("src/x.py"), ("docs/", "src/"))) == 1 and one(spark, Z.tier(F.lit("y"), ("docs/",))) == 1
    assert one(spark, Z.in_subset(F.lit("src/x.py"), ("src/",), ("src/y",))) and one(spark, Z.in_subset(F.lit("q"), ()))
    assert one(spark, Z.visible(F.lit("src/x.py"), ("py",))) and not one(spark, Z.visible(F.lit(".git/x.py"), ("py",)))
    thread = F.struct(F.lit("T").alias("title"), F.lit("B ").alias("body"), F.array(F.struct(author.alias("user"), F.lit("hi\n ").alias("body"))).alias("comments"))
    assert one(spark, Z.document(thread)) == "# T\n\nB \n\n## CI-helper\n\nhi\n"


def test_index_search_by_brute_force(spark):
    """Each coding against plain numpy with the same centroids, codebooks and rotation, few probes, packs of a few rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)).astype("f4").astype("f8")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4)
    q = df.where("id % 23 = 0").select(F.col("id").alias("qid"), "vector")
    for coding in ("exact", "pq", "sign"):
        index, rows = V.build_index(df, 9, coding, m=4)
        assert {r.id for r in rows.collect()} == set(range(400)) and [r.bytes for r in V.stored_bytes(rows).collect()] == [V.payload_bytes(coding, 12, 4)]
        cell = index.cells(x)
        rest = x - index.centroids[cell]
        if coding == "exact":
            near = x
        elif coding == "pq":
            near = index.centroids[cell].copy()
            for j, b in enumerate(index.books):
                part = rest[:, 3 * j : 3 * j + 3]
                near[:, 3 * j : 3 * j + 3] += b[((part[:, None] - b[None]) ** 2).sum(2).argmin(1)]
        else:
            turned = rest @ index.rotation.T
            norm = np.linalg.norm(rest, axis=1)
            along = np.abs(turned).sum(1) / np.sqrt(12) / norm
            near = index.centroids[cell] + (np.where(turned > 0, 1, -1) / np.sqrt(12) * (norm / along)[:, None]) @ index.rotation
        got = {}
        for r in V.search_index(index, rows, q, 6, 3).collect():
            got.setdefault(r.qid, {})[r["rank"]] = (r.id, r.score)
        for i in range(0, 400, 23):
            probed = np.argsort(-(x[i] @ index.centroids.T), kind="stable")[:3]
            own = [j for j in range(400) if cell[j] in probed]
            want = sorted(((-float(x[i] @ near[j]), j) for j in own))[:6]
            assert [got[i][k][0] for k in range(1, 7)] == [j for _, j in want] or np.allclose([got[i][k][1] for k in range(1, 7)], [-s for s, _ in want], atol=2e-5)
            assert np.allclose([got[i][k][1] for k in range(1, 7)], [-s for s, _ in want], atol=2e-5)


def test_packs_hold_every_row_once(spark):
    rows = [(i, bytes([i % 7]) * 3, i % 5 if i % 3 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, data binary, cell int").repartition(6)
    for size in (1, 7, 1000):
        got = V.packed(df, size, "cell").collect()
        assert sorted(i for r in got for i in r.ids) == list(range(200)) and max(len(r.ids) for r in got) <= size
        for r in got:
            assert all(rows[i][2] == r.cell for i in r.ids) and bytes(r.data) == b"".join(rows[i][1] for i in r.ids)
    assert sum(len(r.ids) for r in V.packed(df.select("id", "data"), 50).collect()) == 200
    assert V.packed(df.limit(0), 5, "cell").count() == 0
