"""Bootstrap summaries over paired samples. All of them share the portable draws of ``stats``: a replicate is a weight per
row, joined by the row's number, and one draw serves every arm, depth and metric of a summary, so differences stay paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import decisions as D
from plumbline.operators import stats as S


def interval(value: Column, alpha: float = S.ALPHA) -> Column:
    """(low, high) of replicates as a struct: interpolated quantiles, nulls left out, to six places."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return F.struct(F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))


def with_draws(rows: DataFrame, n: int, replicates: int = S.REPLICATES, seed: int | str = S.SEED) -> DataFrame:
    """rows (idx, ...) once for each replicate that draws them, with rep and weight. Both sides are dealt by idx; neither is sent
    through the driver, however small its files are."""
    return rows.hint("shuffle_hash").join(S.draws(rows.sparkSession, n, replicates, seed), "idx")


def medians(values: DataFrame, by: list[str], n: int, replicates: int = S.REPLICATES, seed: int | str = S.SEED) -> DataFrame:
    """(by, rep, median) for values (by, idx 0 .. n-1, value)."""
    return with_draws(values, n, replicates, seed).groupBy(*by, "rep").agg(F.percentile("value", 0.5, F.col("weight")).alias("median"))


def median_summary(values: DataFrame, by: list[str], n: int, alpha: float = S.ALPHA) -> DataFrame:
    """(by, n, mean, median, n_positive, n_nonzero, sign_p, ci_low, ci_high, excludes_zero): the paired summary with the
    interval of the median. values has idx and value."""
    boot = medians(values, by, n).groupBy(*by).agg(interval(F.col("median"), alpha).alias("ci"))
    out = S.paired_summary(values.withColumnRenamed("value", "delta"), by).join(boot, by)
    low, high = F.col("ci.low"), F.col("ci.high")
    return out.select(*by, "n", "mean", "median", "n_positive", "n_nonzero", "sign_p", low.alias("ci_low"), high.alias("ci_high"), D.excludes_zero(low, high).alias("excludes_zero"))


def contrast(a: DataFrame, b: DataFrame, n_a: int, n_b: int, alpha: float = S.ALPHA, seed: int = S.SEED) -> DataFrame:
    """One row (median, low, high, excludes_zero, n_a, n_b): the difference of the medians of two samples of different
    questions (idx, value), each drawn on its own; an error if one is empty."""
    if not n_a or not n_b:
        raise ValueError("both strata need a paired observation")
    one, two = (medians(x, [], n, seed=f"{seed}{label}").select("rep", F.col("median").alias(label)) for x, n, label in ((a, n_a, "a"), (b, n_b, "b")))
    ci = one.join(two, "rep").agg(interval(F.col("a") - F.col("b"), alpha).alias("ci"))
    point = a.agg(F.percentile("value", 0.5).alias("ma")).crossJoin(b.agg(F.percentile("value", 0.5).alias("mb")))
    out = point.crossJoin(ci)
    return out.select((F.col("ma") - F.col("mb")).alias("median"), F.col("ci.low").alias("low"), F.col("ci.high").alias("high"), D.excludes_zero(F.col("ci.low"), F.col("ci.high")).alias("excludes_zero"), F.lit(n_a).alias("n_a"), F.lit(n_b).alias("n_b"))


def arm_means(runs: DataFrame, n: int, metrics: list[str]) -> DataFrame:
    """(arm, rep, each metric's mean) of runs (arm, idx, metrics)."""
    w = F.col("weight")
    return with_draws(runs, n).groupBy("arm", "rep").agg(*[(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in metrics])


def summarise_arms(runs: DataFrame, n: int, base: str, margin: float = D.MARGIN, alpha: float = S.ALPHA) -> DataFrame:
    """(arm, n, recall, quality, their intervals, delta, its interval, class) of runs (arm, idx, recall, quality); delta is
    the base arm's quality less the arm's."""
    boot = arm_means(runs, n, ["recall", "quality"])
    ref = boot.where(F.col("arm") == base).select("rep", F.col("quality").alias("ref"))
    ci = boot.join(ref, "rep").groupBy("arm").agg(interval(F.col("recall"), alpha).alias("r"), interval(F.col("quality"), alpha).alias("q"), interval(F.col("ref") - F.col("quality"), alpha).alias("d"))
    point = runs.groupBy("arm").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("quality").alias("quality"))
    ref_point = point.where(F.col("arm") == base).select(F.col("quality").alias("ref"))
    out = point.join(ci, "arm").crossJoin(F.broadcast(ref_point.limit(1)))
    klass = F.when(F.col("arm") == base, "reference").otherwise(D.classify_delta(F.col("d.low"), F.col("d.high"), margin))
    pair = lambda c, name: [F.col(f"{c}.low").alias(f"{name}_ci_low"), F.col(f"{c}.high").alias(f"{name}_ci_high")]
    return out.select("arm", "n", F.round("recall", 6).alias("recall"), *pair("r", "recall"), F.round("quality", 6).alias("quality"), *pair("q", "quality"), F.round(F.col("ref") - F.col("quality"), 6).alias("delta"), *pair("d", "delta"), klass.alias("class"))


def evaluate_pairs(runs: DataFrame, n: int, plan: DataFrame, tests: int, tolerance: float = D.TOLERANCE, alpha: float = S.ALPHA) -> DataFrame:
    """For each planned pair (pair, first, second) of arms the difference of quality with its interval at alpha and at
    alpha / tests, and whether the arms' recalls match."""
    boot = arm_means(runs, n, ["quality"])
    point = runs.groupBy("arm").agg(F.avg("recall").alias("recall"), F.avg("quality").alias("quality"))
    side = lambda df, name: df.select(*[F.col(c).alias(name if c == "arm" else c if c == "rep" else f"{name}_{c}") for c in df.columns])
    means = plan.join(side(boot, "first"), "first").join(side(boot, "second"), ["second", "rep"])
    diff = F.col("first_quality") - F.col("second_quality")
    ci = means.groupBy("pair").agg(interval(diff, alpha).alias("face"), interval(diff, S.bonferroni(alpha, tests)).alias("adj"))
    out = plan.join(side(point, "first"), "first").join(side(point, "second"), "second").join(ci, "pair")
    gap = F.abs(F.col("first_recall") - F.col("second_recall"))
    return out.select("pair", "first", "second", F.round(gap, 6).alias("recall_gap"), D.is_matched(F.col("first_recall"), F.col("second_recall"), tolerance).alias("matched"), F.round(diff, 6).alias("diff"), F.col("face.low").alias("face_low"), F.col("face.high").alias("face_high"), F.col("adj.low").alias("adj_low"), F.col("adj.high").alias("adj_high"), (F.col("pair") == "A").alias("primary"))


def mechanism_branch(pairs: DataFrame, margin: float = D.MARGIN) -> DataFrame:
    """One row (branch) of evaluated pairs: M1 if a matched pair's interval excludes zero (the primary pair's at face value,
    another's at the adjusted width), M2 if all matched pairs lie within the margin, else M3; M3 without matched pairs."""
    low = F.when(F.col("primary"), F.col("face_low")).otherwise(F.col("adj_low"))
    high = F.when(F.col("primary"), F.col("face_high")).otherwise(F.col("adj_high"))
    inside = (F.col("face_low") >= -margin) & (F.col("face_high") <= margin)
    any_out = F.coalesce(F.bool_or(F.when(F.col("matched"), D.excludes_zero(low, high))), F.lit(False))
    all_in = F.coalesce(F.bool_and(F.when(F.col("matched"), inside)), F.lit(False))
    return pairs.agg(F.when(any_out, "M1").when(all_in, "M2").otherwise("M3").alias("branch"))


def adjacent_slopes(runs: DataFrame, n: int, order: list[str], alpha: float = S.ALPHA) -> DataFrame:
    """(upper, lower, d_recall, d_quality, slope, its interval) of arms next to one another in ``order`` (by falling recall),
    recall and quality drawn together; replicates without a recall difference are left out."""
    steps = list(zip(order, order[1:], strict=False))
    plan = runs.sparkSession.createDataFrame(steps, "upper string, lower string")
    boot, point = arm_means(runs, n, ["recall", "quality"]), runs.groupBy("arm").agg(F.avg("recall").alias("recall"), F.avg("quality").alias("quality"))
    side = lambda df, name: df.select(*[F.col(c).alias(name if c == "arm" else c if c == "rep" else f"{name}_{c}") for c in df.columns])
    dq, dr = F.col("upper_quality") - F.col("lower_quality"), F.col("upper_recall") - F.col("lower_recall")
    slope = F.when(dr != 0, dq / dr)
    ci = plan.join(side(boot, "upper"), "upper").join(side(boot, "lower"), ["lower", "rep"]).groupBy("upper", "lower").agg(interval(slope, alpha).alias("ci"))
    out = plan.join(side(point, "upper"), "upper").join(side(point, "lower"), "lower").join(ci, ["upper", "lower"])
    return out.select("upper", "lower", F.round(dr, 6).alias("d_recall"), F.round(dq, 6).alias("d_quality"), F.round(slope, 6).alias("slope"), F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"))


def rate(flags: DataFrame, n: int, alpha: float = S.ALPHA) -> DataFrame:
    """One row (rate, n, n_true, ci_low, ci_high) of flags (idx, flag); nulls and no interval for an empty sample."""
    hit = F.col("flag").cast("int")
    boot = with_draws(flags, n).groupBy("rep").agg((F.sum(hit * F.col("weight")) / F.sum("weight")).alias("rate")).agg(interval(F.col("rate"), alpha).alias("ci"))
    point = flags.agg(F.avg(hit).alias("rate"), F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_true"))
    return point.crossJoin(boot).select("rate", "n", "n_true", F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"))


def slope(runs: DataFrame, n: int, alpha: float = S.ALPHA) -> DataFrame:
    """One row (slope, intercept, sse, ci_low, ci_high): a line through the arms' mean recall and quality, fitted again in
    each replicate."""
    boot = arm_means(runs, n, ["recall", "quality"]).groupBy("rep").agg(F.regr_slope("quality", "recall").alias("slope")).agg(interval(F.col("slope"), alpha).alias("ci"))
    point = runs.groupBy("arm").agg(F.avg("recall").alias("recall"), F.avg("quality").alias("quality"))
    line = S.fit_line(point, [], "recall", "quality")
    return line.crossJoin(boot).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("sse", 8).alias("sse"), F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"))


def power(a: DataFrame, b: DataFrame, n_a: int, n_b: int, shifts: list[float], studies: int = 100, replicates: int = 200, alpha: float = S.ALPHA, seed: int = S.SEED) -> DataFrame:
    """(shift, power): how often the contrast of two samples (value), each less its own median, excludes zero when a shift is
    taken off the first. Studies are dealt to the executors; each has its own generator, so results do not depend on how.
    The samples, aggregated to one value a question, travel with the function."""
    import numpy as np
    import pandas as pd

    x, y = (np.array(sorted(r["value"] for r in df.select("value").limit(S.checked(n) + 1).collect()), float) for df, n in ((a, n_a), (b, n_b)))
    x, y = x - np.median(x), y - np.median(y)

    def run(batches):
        for pdf in batches:
            out = []
            for shift, study in zip(pdf["shift"], pdf["study"], strict=True):
                rng = np.random.default_rng([seed, int(study), int(round(shift * 1000)) & 0xFFFFFFFF])
                p, q = rng.choice(x, x.size) - shift, rng.choice(y, y.size)
                boot = np.median(p[rng.integers(0, p.size, (replicates, p.size))], 1) - np.median(q[rng.integers(0, q.size, (replicates, q.size))], 1)
                low, high = np.percentile(boot, [100 * alpha / 2, 100 * (1 - alpha / 2)])
                out.append((shift, bool(low > 0 or high < 0)))
            yield pd.DataFrame(out, columns=["shift", "hit"])

    spark = a.sparkSession
    grid = spark.range(studies).select(F.col("id").alias("study")).crossJoin(spark.createDataFrame([(float(s),) for s in shifts], "shift double"))
    hits = grid.repartition(min(64, studies)).mapInPandas(run, "shift double, hit boolean")
    return hits.groupBy("shift").agg(F.round(F.avg(F.col("hit").cast("int")), 3).alias("power"))


def power_at(table: DataFrame, gradient: float) -> DataFrame:
    """One row (power) of the simulated shift; fails where it was not simulated."""
    found = table.agg(F.max(F.when(F.col("shift") == gradient, F.col("power"))).alias("power"))
    return found.select(F.coalesce("power", F.raise_error(F.lit(f"no simulated row at {gradient}")).cast("double")).alias("power"))


def gradient_for(table: DataFrame, target: float) -> DataFrame:
    """One row (gradient): the least simulated shift that reaches the power as text, or '>' and the largest."""
    text = lambda c: c.cast("bigint").cast("string")
    least = F.min(F.when(F.col("power") >= target, F.col("shift")))
    return table.agg(F.coalesce(text(least), F.concat(F.lit(">"), text(F.max("shift")))).alias("gradient"))
