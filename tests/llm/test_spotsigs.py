import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import spotsigs as S


def brute_signatures(text, chain=2):
    own = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    if not own:
        return {(text.strip(" "),)} if text.strip(" ") else set()
    kept = [w for w in own if w not in S.COMMON]
    out, before = set(), 0
    for w in own:
        if w in S.COMMON:
            out.add((w, *(kept[before : before + chain])))
        else:
            before += 1
    return out or {tuple(own[i : i + chain + 1]) for i in range(len(own))}


TEXTS = ["", " ", "The cat sat on the mat, and the dog ran.", "no anchors here whatever", "the", "the of and", "!!! ???", "Das Haus ist groß und der Hund läuft", "the cat " * 4000, None, "The cat sat on the mat, and the dog ran."]


def test_signature_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", S.signatures(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert len(got[i]) == len(brute_signatures(t or "")) and got[i] == sorted(set(got[i])), t
    assert got[2] == got[10]


@pytest.mark.parametrize("bucket", [3, 10**6])
def test_next(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(bucket)
    ids = rng.sample(range(-50, 10**12), 40)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.next_text) for r in S.with_next(df).collect()}
    order = [*sorted(ids, reverse=True), None]
    text = {i: f"t{i}" for i in ids} | {None: "none"}
    assert got == {a: (text[a], text[b]) for a, b in zip(order, order[1:] + order[:1])}
    same = S.with_next(spark.createDataFrame([(7, "b"), (7, "a"), (3, "c")], "doc_id long, text string")).collect()
    assert sorted((r.text, r.next_text) for r in same) == [("a", "b"), ("b", "c"), ("c", "a")]
    assert [r.next_text for r in S.with_next(spark.createDataFrame([(7, "b")], "doc_id long, text string")).collect()] == ["b"]
    assert S.with_next(df.limit(0)).count() == 0


def test_similar_sets_and_components_equal_brute_force(spark):
    rng = random.Random(4)
    sets = []
    for _ in range(25):
        base = rng.sample(range(400), rng.randrange(3, 60))
        for _ in range(4):
            own = set(base)
            for _ in range(rng.randrange(0, 6)):
                own.discard(rng.choice(base))
                own.add(rng.randrange(400))
            sets.append(sorted(own))
    sets.append([])
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sigs array<bigint>")
    got = {(r.a, r.b): round(r.similarity, 9) for r in S.similar_sets(df, 0.7).collect()}
    want = {}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            u = len(set(a) | set(sets[j]))
            if u and len(set(a) & set(sets[j])) / u >= 0.7:
                want[i, j] = round(len(set(a) & set(sets[j])) / u, 9)
    assert got == want and len(want) > 20


def test_near_duplicates(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(["the", "of", "cat", "dog", "is", *[f"w{i}" for i in range(200)]]) for _ in range(300))
    rows = [(9, text), (4, text + " end of it"), (4, text), (7, "the other one is not like that"), (1, ""), (2, None), (None, text)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, set_id int")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {(9, 4), (4, 4), (7, 7), (1, 1), (2, 1), (None, 4)}
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    small = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    df = S.op5_spotsigs(spark, small)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    order = sorted(text, reverse=True)
    rows = {r.doc_id: r for r in df.collect()}
    assert set(rows) == set(text)
    by_text = {}
    for a, b in zip(order, order[1:] + order[:1]):
        r, t = rows[a], text[a]
        k = len(t) // 3
        edited = t[: len(t) - k] + text[b][:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = (set(f.split(",")) - {""} for f in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in rows.values()) >= 0.95 * len(rows)
