"""How far a verdict is from another: flips that move an arm out of its class, residuals from a curve through other arms, and
refits over subsets of the questions. Samples are aggregated, one row a question and arm; all replicates share one draw."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import decisions as D
from plumbline.operators import boot as B
from plumbline.operators import stats as S
from plumbline.operators.fits import changepoint
from plumbline.sources.tables import cut

#: Flips that are tried at most.
MOST_FLIPS = 80
#: A bound of an interval that is smaller counts as zero when it is rounded to six places.
ROUNDED = 5e-7


def flip_distances(runs: DataFrame, n: int, base: str, most: int = MOST_FLIPS, margin: float = D.MARGIN, alpha: float = S.ALPHA, replicates: int = S.REPLICATES) -> DataFrame:
    """(arm, class, n_candidates, flips, class_after) of runs (arm, idx 0 .. n-1, ok) for every arm but the base: the least number of
    questions that the base has right and the arm wrong, in the order of idx, which must become ties before an arm of class
    DROP leaves it. Null for arms of another class, and where ``most`` flips do not do it.

    A flip takes its question's weight from each replicate's loss, so losses fall with every flip and so does the lower end
    of their interval, which lies between two of the sorted losses. Each replicate gives the flips at which its own loss is
    gone; the sorted numbers of two replicates are bounds, and only between those is the interval worked out.
    """
    ref = runs.where(F.col("arm") == base).select("idx", F.col("ok").cast("int").alias("ref"))
    pairs = cut(runs.where(F.col("arm") != base).select("arm", "idx", F.col("ok").cast("int").alias("own")).join(ref, "idx"), "flip-pairs")
    draws = S.draws(runs.sparkSession, n, replicates)
    loss = cut(pairs.hint("shuffle_hash").join(draws, "idx").groupBy("arm", "rep").agg(F.sum(F.col("weight") * (F.col("ref") - F.col("own"))).alias("loss")), "flip-losses")
    classed = lambda rows, by: rows.groupBy(*by).agg(B.interval(F.col("loss") / n, alpha).alias("ci")).withColumn("class", D.classify_delta(F.col("ci.low"), F.col("ci.high"), margin))
    before = classed(loss, ["arm"]).select("arm", "class")
    place = F.row_number().over(Window.partitionBy("arm").orderBy("idx"))
    candidates = pairs.where("ref = 1 and own = 0").withColumn("place", place)
    counts = candidates.groupBy("arm").agg(F.count("*").alias("n_candidates"))
    tried = candidates.where(F.col("place") <= most).select("arm", "idx", "place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))).alias("rep"))
    upto = Window.partitionBy("arm", "rep").orderBy("place")
    weighed = tried.join(draws, ["rep", "idx"], "left").join(loss, ["arm", "rep"])
    left = cut(weighed.select("arm", "rep", "place", (F.col("loss") - F.sum(F.coalesce("weight", F.lit(0))).over(upto)).alias("loss")), "flip-left")
    gone = left.where(F.col("loss") / n < ROUNDED).groupBy("arm", "rep").agg(F.min("place").alias("at"))
    # A row a replicate: the lower end lies between the sorted losses at these two places.
    j = int((replicates - 1) * alpha / 2)
    bounds = gone.groupBy("arm").agg(F.array_sort(F.collect_list("at")).alias("at")).select("arm", F.get("at", F.lit(j)).alias("from"), F.coalesce(F.get("at", F.lit(j + 1)), F.lit(most)).alias("to"))
    near = left.join(bounds, "arm").where("place between from and to")
    moved = classed(near, ["arm", "place"]).where("class != 'DROP'").groupBy("arm").agg(F.min("place").alias("flips"), F.min_by("class", "place").alias("class_after"))
    out = before.join(counts, "arm", "left").join(moved, "arm", "left")
    drop = F.col("class") == "DROP"
    return out.select("arm", "class", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.when(drop, F.col("flips")).alias("flips"), F.when(drop, F.col("class_after")).alias("class_after"))


def interpolated(points: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, target, x, y, fit, extrapolated) of targets (by, target, x, y): the piecewise linear curve through points (by, arm, x, y) at
    a target's x, and flat beyond its ends; null without points. Of points with one x the last by arm counts on its left."""
    other = points.select(*by, F.col("arm").alias("_arm"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    both = targets.join(other, by) if by else targets.join(other)  # a few points to each group of replicates
    spot = F.struct("_x", "_y")
    low = F.max_by(spot, F.when(F.col("_x") <= F.col("x"), F.struct("_x", "_arm"))).alias("low")
    high = F.min_by(spot, F.when(F.col("_x") > F.col("x"), F.struct("_x", "_arm"))).alias("high")
    beside = both.groupBy(*by, "target", "x", "y").agg(low, high)
    slope = (F.col("high._y") - F.col("low._y")) / (F.col("high._x") - F.col("low._x"))
    fit = F.when(F.col("low").isNull(), F.col("high._y")).when(F.col("high").isNull(), F.col("low._y")).otherwise(F.col("low._y") + slope * (F.col("x") - F.col("low._x")))
    beyond = F.col("low").isNull() | (F.col("high").isNull() & (F.col("x") > F.col("low._x")))
    return beside.select(*by, "target", "x", "y", fit.alias("fit"), beyond.alias("extrapolated"))


def residuals(runs: DataFrame, n: int, on_curve: Column, alpha: float = S.ALPHA) -> DataFrame:
    """(arm, recall, quality, residual, ci_low, ci_high, extrapolated) of runs (arm, idx, recall, quality) for the arms that are not
    ``on_curve``: how far an arm's quality lies from the curve of quality by recall through the arms that are, which is drawn
    anew in each replicate."""
    boot = cut(B.arm_means(runs, n, ["recall", "quality"]), "residual-means")
    point = cut(runs.groupBy("arm").agg(F.avg("recall").alias("recall"), F.avg("quality").alias("quality")).withColumn("rep", F.lit(-1).cast("bigint")).select("arm", "rep", "recall", "quality"), "residual-points")
    both = boot.select("arm", "rep", "recall", "quality").union(point).select("rep", "arm", F.col("recall").alias("x"), F.col("quality").alias("y"))
    fits = interpolated(both.where(on_curve), both.where(~on_curve).withColumnRenamed("arm", "target"), ["rep"]).withColumn("residual", F.col("y") - F.col("fit"))
    fits = cut(fits, "residual-fits")
    ci = fits.where("rep >= 0").groupBy("target").agg(B.interval(F.col("residual"), alpha).alias("ci"))
    out = fits.where("rep < 0").join(ci, "target")
    return out.select(F.col("target").alias("arm"), F.round("x", 6).alias("recall"), F.round("y", 6).alias("quality"), F.round("residual", 6).alias("residual"), F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"), "extrapolated")


def subset_means(runs: DataFrame, n_arms: int) -> DataFrame:
    """(subset, arm, n, x, y) of runs (qid, arm, x, ok), one for each question and arm: means over all questions, those that some arm
    has right (solvable), and those that some have right and some wrong (discriminating). A row goes to each of its subsets,
    so all of them are one aggregation."""
    right = runs.groupBy("qid").agg(F.sum(F.col("ok").cast("int")).alias("right"))
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("right") > 0, F.lit("solvable")), F.when((F.col("right") > 0) & (F.col("right") < n_arms), F.lit("discriminating"))))
    rows = runs.join(right, "qid").select(F.explode(subsets).alias("subset"), "arm", "x", F.col("ok").cast("int").alias("y"))
    return rows.groupBy("subset", "arm").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def subset_fits(means: DataFrame) -> DataFrame:
    """(subset, n, slope, intercept, sse, least_rescale, most_rescale, rescale): a line through each subset's arms; how much larger each
    arm's mean is than over all questions, at least and at most, and how much it must be if the subset only leaves out
    questions that no arm has right. Arms without a right answer have no ratio."""
    whole = means.where("subset = 'all'").select("arm", F.col("y").alias("all_y"), F.col("n").alias("all_n"))
    rows = means.join(whole, "arm")
    ratio = F.col("y") / F.nullif(F.col("all_y"), F.lit(0.0))
    out = rows.groupBy("subset").agg(F.max("n").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), (F.regr_syy("y", "x") - F.regr_sxy("y", "x") ** 2 / F.nullif(F.regr_sxx("y", "x"), F.lit(0.0))).alias("sse"), F.min(ratio).alias("least"), F.max(ratio).alias("most"), F.max(F.col("all_n") / F.col("n")).alias("rescale"))
    to = lambda c, name, k=6: F.round(c, k).alias(name)
    return out.select("subset", "n", to("slope", "slope"), to("intercept", "intercept"), to("sse", "sse"), to("least", "least_rescale"), to("most", "most_rescale"), to("rescale", "rescale"))


def subset_changepoints(means: DataFrame) -> DataFrame:
    """(subset, tau, left, right, sse): two lines that meet, through each subset's arms; a group holds a row an arm."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("arm")
        found = changepoint(own["x"].to_numpy(), own["y"].to_numpy())
        return pd.DataFrame([{"subset": own["subset"].iloc[0], **{k: round(found[k], 6) for k in ("tau", "left", "right", "sse")}}])

    return means.groupBy("subset").applyInPandas(fit, "subset string, tau double, left double, right double, sse double")
