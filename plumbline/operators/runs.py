"""Runs of arms over questions: pairing, completeness, summaries, operating points and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_deltas(runs: DataFrame, metric: str, a: str, b: str, key: str = "qid", arm: str = "arm") -> DataFrame:
    """(key, delta): metric of arm a less that of arm b; fails at run time on a key that one of them lacks."""
    left = runs.where(F.col(arm) == a).select(key, F.col(metric).alias("x"), F.lit(True).alias("in_a"))
    right = runs.where(F.col(arm) == b).select(key, F.col(metric).alias("y"), F.lit(True).alias("in_b"))
    both = left.join(right, key, "full_outer")
    ok = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return both.select(key, F.when(ok, F.col("x") - F.col("y")).otherwise(F.raise_error(F.concat(F.lit("unpaired key "), F.col(key).cast("string"))).cast("double")).alias("delta"))


def complete_keys(runs: DataFrame, arms: list[str], key: str = "qid", arm: str = "arm") -> DataFrame:
    """Keys that have every arm."""
    return runs.where(F.col(arm).isin(arms)).groupBy(key).agg(F.count_distinct(arm).alias("n")).where(F.col("n") == len(arms)).select(key)


def incomplete(runs: DataFrame, keys: DataFrame, arms: list[str], key: str = "qid", arm: str = "arm") -> DataFrame:
    """(key, arm, n) of wanted pairs that do not occur exactly once, and of those that were not asked for."""
    wanted = keys.select(key, F.explode(F.array(*map(F.lit, arms))).alias(arm)).withColumn("wanted", F.lit(True))
    have = runs.groupBy(key, arm).agg(F.count("*").alias("n"))
    return wanted.join(have, [key, arm], "full_outer").where((F.coalesce("n", F.lit(0)) != 1) | F.col("wanted").isNull()).select(key, arm, F.coalesce("n", F.lit(0)).alias("n"))


def keep_one(rows: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """One row a key, the last (or first) in order; combined before the shuffle, so a hot key moves one row a task."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, p50, p99), linearly interpolated and exact."""
    return rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.99).alias("p99"))


def lift(summary: DataFrame, arm: str, value: str, base: str) -> DataFrame:
    """summary with the difference of value from that of the arm named base, which is one row."""
    ref = summary.where(F.col(arm) == base).select(F.col(value).alias("_base"))
    return summary.crossJoin(F.broadcast(ref.limit(1))).withColumn("lift", F.col(value) - F.col("_base")).drop("_base")


def best_points(sweep: DataFrame, targets: list[float], arm: str = "arm", recall: str = "recall", qps: str = "qps", value: str = "sweep_value") -> DataFrame:
    """(arm, target, value, recall, qps, met) for each arm and target: of the points that reach it the one with the highest
    qps, ties to the least value; if none does, the one with the highest recall, ties to the highest qps."""
    both = sweep.select(arm, recall, qps, value, F.explode(F.array(*map(F.lit, targets))).alias("target"))
    met = F.col(recall) >= F.col("target")
    rank = F.struct(met.alias("a"), F.when(met, F.col(qps)).otherwise(F.col(recall)).alias("b"), F.when(met, -F.col(value)).otherwise(F.col(qps)).cast("double").alias("c"))
    out = both.groupBy(arm, "target").agg(F.max_by(F.struct(value, recall, qps, met.alias("met")), rank).alias("r"))
    return out.select(arm, "target", f"r.{value}", f"r.{recall}", f"r.{qps}", "r.met")


def nearest_point(sweep: DataFrame, target: float, by: list[str], recall: str = "recall", value: str = "sweep_value") -> DataFrame:
    """Row of each group whose recall is nearest to the target, ties to the least value."""
    rank = F.struct(F.abs(F.col(recall) - target).alias("d"), F.col(value))
    return sweep.groupBy(*by).agg(F.min_by(F.struct(value, recall), rank).alias("r")).select(*by, "r.*")


def knee(arms: DataFrame, recall: str = "recall", klass: str = "class") -> DataFrame:
    """One row (r_star): the least recall at and above which every arm is PLATEAU, null if the best one is not."""
    w = Window.orderBy(F.desc(recall)).rowsBetween(Window.unboundedPreceding, 0)
    ok = arms.withColumn("ok", F.min((F.col(klass) == "PLATEAU").cast("int")).over(w))
    return ok.agg(F.min(F.when(F.col("ok") == 1, F.col(recall))).alias("r_star"))


def cumulative_before(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows with cum_before, the sum of value over the rows before in each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cum_before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def size_prefix(rows: DataFrame, by: list[str], order: str, value: str, budget: int) -> DataFrame:
    """(by, n, total): how many leading rows fit the budget; it ends at the first that does not."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = rows.withColumn("upto", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.groupBy(*by).agg(F.count(F.when(F.col("upto") <= budget, 1)).alias("n"), F.coalesce(F.max(F.when(F.col("upto") <= budget, F.col("upto"))), F.lit(0)).alias("total"))


def greedy_prefix(sizes: Column, budget: int) -> Column:
    """Places of the items that a greedy pass takes, in order: one that does not fit the rest of the budget is skipped."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("own"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["size"] <= budget
        return F.struct(F.when(fits, a["used"] + x["size"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["own"], F.array(x["at"]))).otherwise(a["own"]).alias("own"))

    items = F.transform(sizes, lambda v, i: F.struct(v.cast("bigint").alias("size"), i.alias("at")))
    return F.aggregate(items, start, step, lambda a: a["own"])


def adjacent(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows with gap, the difference of value from the row before in each group; null for the first."""
    return rows.withColumn("gap", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def matched_pairs(arms: DataFrame, tolerance: float, key: str = "arm", family: str = "family", recall: str = "recall") -> DataFrame:
    """(arm_a, arm_b, gap) of arms of different families whose recalls differ by the tolerance at most: recalls are put in
    bins of that width, and a bin meets itself and the one above."""
    own = arms.select(key, family, recall, F.floor(F.col(recall) / tolerance).cast("int").alias("bin"))
    a = own.select(F.col(key).alias("x"), F.col(family).alias("fx"), F.col(recall).alias("rx"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    b = own.select(F.col(key).alias("y"), F.col(family).alias("fy"), F.col(recall).alias("ry"), "bin")
    near = a.join(b, "bin").where((F.col("x") < F.col("y")) & (F.col("fx") != F.col("fy")) & (F.abs(F.col("rx") - F.col("ry")) <= tolerance + 1e-12))
    return near.select(F.col("x").alias("arm_a"), F.col("y").alias("arm_b"), F.abs(F.col("rx") - F.col("ry")).alias("gap"))


def discrimination(verdicts: DataFrame, arms: int, key: str = "qid", correct: str = "correct") -> DataFrame:
    """(key, bucket): always, never or discriminating by how many of the arms are correct; incomplete keys fail."""
    per = verdicts.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col(correct), 1)).alias("c"))
    bucket = F.when(F.col("n") != arms, F.raise_error(F.lit("incomplete key")).cast("string")).when(F.col("c") == arms, "always").when(F.col("c") == 0, "never").otherwise("discriminating")
    return per.select(key, bucket.alias("bucket"))
