"""Resampling statistics over paired samples, in DataFrame expressions.

The bootstrap draws with a portable generator: slot s of replicate r takes row md5(seed:r:s) mod n, which any engine can
repeat. A replicate is a count per row, and all arms and metrics share one draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES, SEED, ALPHA = 200, 42, 0.05
#: Rows in a sample. Samples are aggregated (one row a question), and their draws are ``replicates`` times as many: a larger
#: sample fails instead of growing without notice.
MOST_ROWS = 1_000_000


def checked(n: int) -> int:
    if n > MOST_ROWS:
        raise ValueError(f"{n} questions in a sample; the bootstrap is for aggregated samples of at most {MOST_ROWS}")
    return n


def portable(label: Column, n: Column) -> Column:
    return F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("bigint") % n


def draws(spark, n: int, replicates: int = REPLICATES, seed: int | str = SEED) -> DataFrame:
    """(rep, idx, weight): how often each of n rows is drawn in each replicate, for n rows of an aggregated sample. Draws are
    dealt by idx, on which they are counted and joined. They come from a range whose size Spark knows: of an exploded array
    it would take a table of a row a replicate, and send all draws through the driver for a broadcast join."""
    n = checked(n)
    grid = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), (F.col("id") % max(n, 1)).alias("slot"))
    idx = portable(F.concat_ws(":", F.lit(str(seed)), "rep", "slot"), F.lit(max(n, 1)))
    return grid.select("rep", idx.alias("idx")).repartition("idx").groupBy("rep", "idx").agg(F.count("*").alias("weight"))


def boot_means(values: DataFrame, by: list[str], n: int, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(by, rep, mean) for values (by, idx 0 .. n-1, value)."""
    d = draws(values.sparkSession, n, replicates, seed)
    return values.hint("shuffle_hash").join(d, "idx").groupBy(*by, "rep").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))


def percentile_ci(samples: DataFrame, by: list[str], column: str = "mean", alpha: float = ALPHA) -> DataFrame:
    """(by, ci_low, ci_high): linearly interpolated quantiles, to six places."""
    q = F.percentile(column, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    rows = samples.groupBy(*by).agg(q.alias("q")) if by else samples.agg(q.alias("q"))
    return rows.select(*by, F.round(F.col("q")[0], 6).alias("ci_low"), F.round(F.col("q")[1], 6).alias("ci_high"))


def bonferroni(alpha: float, n: int) -> float:
    if n < 1:
        raise ValueError("at least one test")
    return alpha / n


#: log(n!) less Stirling's approximation of it, for n of 1 to 15; larger n have a series.
STIRLING = [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def _stirling(n: Column) -> Column:
    n, square = n.cast("double"), n.cast("double") * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / square) / square) / square) / square) / n
    return F.when(n > 15, series).otherwise(F.get(F.array(*map(F.lit, STIRLING)), n.cast("int") - 1))


def half_pmf(k: Column, n: Column) -> Column:
    """Chance of k among n at one half, to about twelve digits for any n. The powers of one half and the factorials on their own
    leave the range of a double beyond a thousand, and their logarithms lose digits."""
    e = (2.0 * k - n) / n
    apart = n / 2 * ((1 + e) * F.log1p(e) + (1 - e) * F.log1p(-e))
    inner = F.exp(_stirling(n) - _stirling(k) - _stirling(n - k) - apart) * F.sqrt(n / (2 * math.pi * k.cast("double") * (n - k)))
    return F.when((k == 0) | (k == n), F.pow(F.lit(0.5), n.cast("double"))).otherwise(inner)


def sign_test_p(positive: Column, n: Column) -> Column:
    """Exact two-sided sign test of positive among n without zeros; 1 for n = 0. Terms come one from the other, from the largest
    down, as shares of it."""
    k = F.least(positive, n - positive)
    start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("c"))

    def step(a: Column, i: Column) -> Column:
        c = a["c"] * i / (n - i + 1)
        return F.struct((a["s"] + c).alias("s"), c.alias("c"))

    # i is the place of the term before; there are k after the largest.
    shares = F.aggregate(F.when(k > 0, F.sequence(k, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * half_pmf(k, n) * shares))


def step_up(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with adjusted: the least of p (m - rank + 1) over all tests with a p at least as large. For a table of tests."""
    n = tests.count()
    ranked = tests.withColumn("_rank", F.row_number().over(Window.orderBy(p)))
    w = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col(p) * (n - F.col("_rank") + 1)).over(w))).drop("_rank")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with Cohen's kappa of two label columns; 1 or 0 where chance agreement is 1; null without rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("x")).agg(F.sum("n").alias("na")), cells.groupBy(F.col(b).alias("x")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "x").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t").cast("double") * F.col("t"))
    return n.crossJoin(chance).select(F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"), F.col("t").alias("n"))


def mcnemar(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, only_a, only_b, p): exact McNemar test of two boolean columns."""
    out = df.groupBy(*by).agg(F.count(F.when(F.col(a) & ~F.col(b), 1)).alias("only_a"), F.count(F.when(~F.col(a) & F.col(b), 1)).alias("only_b"))
    return out.withColumn("p", sign_test_p(F.col("only_a"), F.col("only_a") + F.col("only_b")))


def fit_line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept, sse) by least squares."""
    sums = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_slope(y, x)).alias("sse"))
    return sums


def paired_summary(deltas: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """(by, n, mean, median, n_positive, n_nonzero, sign_p)."""
    v = F.col(value)
    out = deltas.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.count(F.when(v > 0, 1)).alias("n_positive"), F.count(F.when(v != 0, 1)).alias("n_nonzero"))
    return out.withColumn("sign_p", sign_test_p(F.col("n_positive"), F.col("n_nonzero")))


def mc_se(rate: Column, n: Column) -> Column:
    return F.sqrt(rate * (1 - rate) / n)
