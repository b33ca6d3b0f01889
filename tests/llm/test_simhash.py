import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash as S
from plumbline.llm.components import components


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == brute_components(real, {x for p in real for x in p})
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fingerprint_by_hand():
    text = "One two\tTHREE four\x0b one two three four é É"
    own = text.encode().decode().split()
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in own]
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert S.fingerprint(S.shingle_hashes(S.split_words(text), 3)) == want
    assert S.fingerprint(S.shingle_hashes(S.split_words("a b"), 3)) == xxhash.xxh64_intdigest(b"a b", 42)
    assert S.fingerprint(S.shingle_hashes([], 3)) == 0


def test_allocation_is_the_least_by_brute_force():
    import itertools

    rng = random.Random(1)
    costs = [[0.0, *sorted(rng.random() * 10 for _ in range(4))] for _ in range(3)]
    for total in range(-1, 4):
        best = min((sum(c[t + 1] for c, t in zip(costs, ts)), list(ts)) for ts in itertools.product(range(-1, 4), repeat=3) if sum(ts) == total)
        got = S.allocate(costs, total)
        assert abs(got[0] - best[0]) < 1e-9


@pytest.mark.parametrize("most,limit", [(2, 4096), (2, 8), (1, 4096), (3, 10**9), (4, 10**9)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, most, limit):
    monkeypatch.setattr(S, "PAIRS", limit)
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {base[0] ^ (1 << b) ^ (1 << c) for b in range(8) for c in range(8)}
    fps = sorted(S.signed(x) for x in fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").select(F.col("fp").alias("id"), "fp")
    want = brute_components([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b) & (2**64 - 1) and bin((a ^ b) & (2**64 - 1)).count("1") <= most], fps)
    found = S.links(nodes, most).collect()
    assert all(bin((r.src ^ r.dst) & (2**64 - 1)).count("1") <= most for r in found)
    assert brute_components([(r.src, r.dst) for r in found], fps) == want


def test_full_buckets_are_compared_whole(spark, monkeypatch):
    """Every pair within six bits, not only those near a bucket's first member or two bits apart."""
    monkeypatch.setattr(S, "PAIRS", 16)
    rng = random.Random(9)
    fps = set()
    for b in (0, 2**64 - 1, rng.getrandbits(64)):
        for _ in range(25):
            x = b
            for bit in rng.sample(range(64), rng.randrange(0, 9)):
                x ^= 1 << bit
            fps.add(S.signed(x))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").select(F.col("fp").alias("id"), "fp")
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 6}
    assert {frozenset((r.src, r.dst)) for r in S.links(nodes, 6).collect()} == want and len(want) > 100


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    near = " ".join([*words, "tail"])
    rows = [(5, text), (3, near), (9, text), (4, None), (8, ""), (7, " \n "), (6, "other text here at all"), (None, text), (5, text)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component long")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {r.doc_id: r.fingerprint for r in got}
    assert fp[4] == fp[8] == fp[7] == "0" * 16 and all(len(x) == 16 for x in fp.values())
    comp = {r.doc_id: r.component_id for r in got}
    near_d = bin(int(fp[5], 16) ^ int(fp[3], 16)).count("1")
    assert comp[4] == comp[8] == comp[7] == 4 and comp[6] == 6
    assert comp[5] == comp[9] == comp[None] == (3 if near_d <= 2 else 5)
    assert S.near_duplicates(df.limit(0)).count() == 0
    rnd = np.random.default_rng(0)
    docs = [(i, " ".join(rnd.choice(words, 5))) for i in range(60)]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), most=2).collect()}
    ids = sorted(got)
    bits = {i: int(got[i].fingerprint, 16) for i in ids}
    want = brute_components([(a, b) for a in ids for b in ids if a < b and bin(bits[a] ^ bits[b]).count("1") <= 2], ids)
    assert {i: got[i].component_id for i in ids} == want


def test_query_by_brute_force(spark):
    """The whole query on a whole table: fingerprints by hand, links by comparing all pairs."""
    small = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in S.op2_simhash(spark, small).collect()}
    assert set(got) == set(text)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bits = {}
    for i, t in text.items():
        own = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        shingles = [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
        h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], "u8")
        bits[i] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
        assert got[i].fingerprint == f"{bits[i]:016x}"
    ids = sorted(bits)
    fps = np.array([bits[i] for i in ids], "u8")
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    want = brute_components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b], ids)
    assert {i: r.component_id for i, r in got.items()} == want


def test_a_very_long_text(spark):
    rows = [(1, "word " * 400_000), (2, "word " * 399_999 + "word"), (3, "x" * 3_000_000)]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].component_id == 1 and got[3].component_id == 3
