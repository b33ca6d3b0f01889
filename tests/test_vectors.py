import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import hnsw
from plumbline.operators import proximity as P
from plumbline.operators import vectors as V
from plumbline.plans import search

SMALL = "/root/testdata/sf0.1"


def plain_beam(x, bias, edges, q, start, width):
    score = lambda p: float(q @ x[p] - bias[p])
    held, expanded, seen = {start: score(start)}, set(), {start}
    while open_ := [p for p in held if p not in expanded]:
        p = max(open_, key=held.get)
        expanded.add(p)
        for r in edges[p] - seen:
            seen.add(r)
            held[r] = score(r)
        held = dict(sorted(held.items(), key=lambda i: -i[1])[:width])
    return sorted(held, key=lambda p: -held[p])


def plain_diverse(x, p, found, most):
    far = lambda a, b: float(((x[a] - x[b]) ** 2).sum())
    out = []
    for c in sorted(set(found) - {p}, key=lambda c: far(p, c)):
        if len(out) < most and all(far(p, c) < far(c, s) for s in out):
            out.append(c)
    return out


def plain_layers(x, ids, m, ef):
    """The layered graph row by row, in sets."""
    top, bias = hnsw.tops(ids, m), (x * x).sum(1) / 2
    order = sorted(range(len(x)), key=lambda i: (-top[i], ids[i]))
    levels = max(top) + 1
    graph = [{} for _ in range(levels)]
    for layer in range(levels - 1, -1, -1):
        own = [i for i in order if top[i] >= layer]
        edges, most = graph[layer], m if layer else 2 * m
        edges[own[0]] = set()
        for p in own[1:]:
            start = order[0]
            if top[p] == layer and layer < levels - 1:
                for above in range(levels - 1, layer, -1):
                    start = plain_beam(x, bias, graph[above], x[p], start, 1)[0]
            elif top[p] == layer:
                start = own[0]
            chosen = plain_diverse(x, p, plain_beam(x, bias, edges, x[p], start, ef), m)
            edges[p] = set(chosen)
            for c in chosen:
                edges[c].add(p)
                if len(edges[c]) > most:
                    edges[c] = set(plain_diverse(x, c, edges[c], most))
    return graph


def test_layers_equal_a_plain_build():
    rng = np.random.default_rng(7)
    x, ids = rng.normal(size=(160, 6)), rng.permutation(1000)[:160]
    graph, want = hnsw.build(x, ids, m=4, ef=12, together=1), plain_layers(x, ids, 4, 12)
    assert len(graph.nodes) == len(want) >= 3
    for nodes, edges, plain in zip(graph.nodes, graph.edges, want):
        got = {int(p): {int(nodes[e]) for e in edges[i] if e < len(nodes)} for i, p in enumerate(nodes)}
        assert got == plain


def test_beam_equals_a_plain_search_and_diverse_is_plain():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    edges = np.vstack([rng.integers(0, 201, (200, 6)), np.full((1, 6), 200)]).astype("i4")
    sets = [set(e.tolist()) - {200} for e in edges]
    q = rng.normal(size=(20, 5))
    found, score = P.beam(x, np.zeros(200), edges, q, np.full(20, 9), 15, spread=1)
    for i in range(20):
        want = plain_beam(x, np.zeros(200), sets, q[i], 9, 15)
        assert found[i][found[i] < 200].tolist() == want and np.allclose(score[i][: len(want)], x[want] @ q[i])
    points, near = np.arange(50), rng.integers(0, 201, (50, 30)).astype("i4")
    for p, got in zip(points, P.diverse(x, points, near, 7)):
        assert got[got < 200].tolist() == plain_diverse(x, p, set(near[p].tolist()) - {200}, 7)


def test_rescue_reaches_all():
    x = np.random.default_rng(1).normal(size=(90, 3))
    edges = np.full((91, 3), 90, "i4")
    edges[:30, 0] = (np.arange(30) + 1) % 30
    edges[40:60, 0] = 40 + (np.arange(20) + 1) % 20
    P.rescue(x, edges, 0, 5)
    assert P.reached(edges, 0).all()


def test_layered_graphs_find_the_nearest(spark):
    rows = {r.ef: r.recall for r in search.hnsw_recall(spark, SMALL).collect()}
    assert list(sorted(rows)) == search.EFS and rows[64] >= 0.95 and rows[512] >= 0.99 and rows[512] >= rows[16]


def test_several_partitions_and_blocks(spark):
    rows = search.corpus(spark, SMALL).select("id", "vector")
    graphs = hnsw.index(rows, part=300)
    assert graphs.count() == 7 and len({r.part for r in graphs.collect()}) == 7
    asked = search.queries(rows)
    found = hnsw.search(graphs, asked, 10, [100])
    assert V.recalls(found, V.top_k(rows, asked, 10), 10, ["ef"]).first()["recall"] >= 0.99
    assert hnsw.search(hnsw.index(rows.limit(0)), asked, 10, [20]).count() == 0
    few = hnsw.search(hnsw.index(rows.where("id < 3")), asked.where("qid = 0"), 10, [20]).collect()
    assert sorted(r.id for r in few) == [0, 1, 2]


def test_a_search_scores_few_queries_at_a_time():
    rng = np.random.default_rng(2)
    x, ids, q = rng.normal(size=(600, 64)), np.arange(600), rng.normal(size=(1024, 64))
    edges = np.vstack([rng.integers(0, 600, (600, 32)), np.full((1, 32), 600)]).astype("i4")
    tracemalloc.start()
    rows = [len(at) for at, _, _ in hnsw.best(x, ids, x.astype("f4"), ids, edges, q, np.zeros(1024, "i4"), 10, 512, 6)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All queries at once would hold 1,024 x 512 vectors of 64 doubles twice, 537 MB.
    assert sum(rows) == 10240 and max(rows) <= 10 * 32 and peak < 100e6


def test_graphs_are_built_in_tasks_of_their_own(spark):
    graphs = hnsw.index(search.corpus(spark, SMALL).select("id", "vector"), part=100)
    assert graphs.count() == 20 and len(graphs.inputFiles()) >= 12


@pytest.mark.parametrize("coding", ["exact", "pq"])
def test_a_sweep_equals_separate_searches(spark, coding):
    rows = search.corpus(spark, SMALL).select("id", "vector")
    asked = search.queries(rows)
    index, coded = V.build_index(rows, nlist=20, coding=coding)
    coded = coded.cache()
    swept = V.sweep_index(index, coded, asked, 30, [1, 3, 7]).cache()
    for n in (1, 3, 7):
        assert sorted(map(tuple, swept.where(F.col("nprobe") == n).drop("nprobe").collect())) == sorted(map(tuple, V.search_index(index, coded, asked, 30, n).collect()))
    refined = V.refined_sweep(swept, rows, asked, 10, [1, 3])
    for n, f in ((3, 1), (7, 3)):
        want = V.refine(V.search_index(index, coded, asked, 10 * f, n), rows, asked, 10)
        assert sorted(map(tuple, refined.where((F.col("nprobe") == n) & (F.col("factor") == f)).drop("nprobe", "factor").collect())) == sorted(map(tuple, want.collect()))
    share = {r.nprobe: r.share for r in V.shares_read(index, coded, asked, [1, len(index.centroids)]).collect()}
    assert 0 < share[1] < 0.3 and share[len(index.centroids)] == 1.0
