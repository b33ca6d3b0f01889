import numpy as np
import pytest

from plumbline.functions import decisions as D
from plumbline.operators import flips as P
from plumbline.operators import stats as S


def exhaustive(ok, weights, base, most, alpha=0.05, margin=0.05):
    """Every number of flips tried in turn, as in a plain loop. ok: arm -> verdicts; weights: replicate x question."""
    n, out = weights.shape[1], {}
    for arm in ok:
        if arm == base:
            continue
        candidates = np.flatnonzero((ok[base] == 1) & (ok[arm] == 0))

        def classed(own):
            d = weights @ (ok[base] - own) / n
            low, high = (round(float(np.quantile(d, q)), 6) for q in (alpha / 2, 1 - alpha / 2))
            return "DROP" if low > 0 else "PLATEAU" if high < margin else "INCONCLUSIVE"

        before, found = classed(ok[arm]), (None, None)
        for k in range(1, min(most, len(candidates)) + 1) if before == "DROP" else []:
            own = ok[arm].copy()
            own[candidates[:k]] = 1
            if classed(own) != "DROP":
                found = (k, classed(own))
                break
        out[arm] = (before, len(candidates), *found)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flips_equal_exhaustive_search(spark, seed):
    rng, n = np.random.default_rng(seed), 60
    ok = {"a": (rng.random(n) < 0.9).astype(int)} | {f"b{i}": (rng.random(n) < p).astype(int) for i, p in enumerate((0.2, 0.5, 0.65, 0.75, 0.88, 1.0))}
    runs = spark.createDataFrame([(arm, i, bool(v)) for arm, own in ok.items() for i, v in enumerate(own)], "arm string, idx long, ok boolean")
    weights = np.zeros((S.REPLICATES, n))
    for r in S.draws(spark, n).collect():
        weights[r.rep, r.idx] = r.weight
    for most in (80, 5):
        got = {r.arm: (r["class"], r.n_candidates, r.flips, r.class_after) for r in P.flip_distances(runs, n, "a", most).collect()}
        assert got == exhaustive(ok, weights, "a", most)
    assert sum(v[2] is not None for v in exhaustive(ok, weights, "a", 80).values()) >= 2


def test_a_curve_through_points_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    points = {g: [(f"p{i}", float(x), float(rng.normal())) for i, x in enumerate(rng.choice(100, 6, replace=False))] for g in range(3)}
    targets = [(g, f"t{j}", float(x), 1.0) for g in range(3) for j, x in enumerate([-5, 105, 50, 33.3, points[g][2][1], max(p[1] for p in points[g]), min(p[1] for p in points[g])])]
    df = spark.createDataFrame([(g, *p) for g, own in points.items() for p in own], "g int, arm string, x double, y double")
    got = {(r.g, r.target): r for r in P.interpolated(df, spark.createDataFrame(targets, "g int, target string, x double, y double"), ["g"]).collect()}
    for g, t, x, _ in targets:
        own = sorted((p[1], p[2]) for p in points[g])
        xs, ys = zip(*own)
        assert got[g, t].fit == pytest.approx(np.interp(x, xs, ys)) and got[g, t].extrapolated == (x < xs[0] or x > xs[-1])
    one = P.interpolated(df.where("g = 0 and arm = 'p0'"), spark.createDataFrame([(0, "t", points[0][0][1], 1.0)], "g int, target string, x double, y double"), ["g"]).first()
    assert one.fit == points[0][0][2] and not one.extrapolated


def test_residuals_are_those_of_a_plain_bootstrap(spark):
    rng, n = np.random.default_rng(6), 40
    recall = {f"a{i}": np.floor(rng.random(n) * 64 * (i + 3) / 8) / 64 for i in range(5)}
    quality = {a: (rng.random(n) < 0.2 + 0.12 * i).astype(float) for i, a in enumerate(recall)}
    runs = spark.createDataFrame([(a, i, float(recall[a][i]), float(quality[a][i])) for a in recall for i in range(n)], "arm string, idx long, recall double, quality double")
    from pyspark.sql import functions as F

    got = P.residuals(runs, n, F.col("arm") != "a2").collect()
    weights = np.zeros((S.REPLICATES, n))
    for r in S.draws(spark, n).collect():
        weights[r.rep, r.idx] = r.weight

    def residual(w):
        m = sorted((w @ recall[a] / w.sum(), w @ quality[a] / w.sum()) for a in recall if a != "a2")
        return w @ quality["a2"] / w.sum() - np.interp(w @ recall["a2"] / w.sum(), *zip(*m))

    boot = [residual(w) for w in weights]
    assert len(got) == 1 and got[0].residual == pytest.approx(residual(np.ones(n)), abs=1e-6)
    assert (got[0].ci_low, got[0].ci_high) == (pytest.approx(np.quantile(boot, 0.025), abs=2e-6), pytest.approx(np.quantile(boot, 0.975), abs=2e-6))


def test_subsets_rescale_evenly(spark):
    rng, n = np.random.default_rng(8), 50
    ok = rng.random((n, 4)) < np.linspace(0.2, 0.7, 4)
    ok[:9] = False
    runs = spark.createDataFrame([(q, f"a{a}", float(a + rng.random()), bool(ok[q, a])) for q in range(n) for a in range(4)], "qid long, arm string, x double, ok boolean")
    means = P.subset_means(runs, 4).cache()
    got = {r.subset: r for r in P.subset_fits(means).collect()}
    never, always = int((~ok).all(1).sum()), int(ok.all(1).sum())
    assert (got["all"].n, got["solvable"].n, got["discriminating"].n) == (n, n - never, n - never - always) and never >= 9
    assert got["solvable"].least_rescale == got["solvable"].most_rescale == got["solvable"].rescale == round(n / (n - never), 6)
    assert got["all"].rescale == 1.0 and (always == 0 or got["discriminating"].least_rescale < got["discriminating"].most_rescale)
    own = sorted((r.x, r.y) for r in means.where("subset = 'solvable'").collect())
    slope, intercept = np.polyfit(*zip(*own), 1)
    assert got["solvable"].slope == pytest.approx(slope, abs=1e-6) and got["solvable"].intercept == pytest.approx(intercept, abs=1e-6)
    assert {r.subset for r in P.subset_changepoints(means).collect()} == set(got) and D.MARGIN == 0.05
