"""Tables that reports are made of: conversions by rule, full contingencies, list agreement, rank correlations, refits without
one arm, sessions from marker lines, rendered hits and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conversion_table(rows: DataFrame, rules: list[str], correct: str, declined: str, by: str = "arm") -> DataFrame:
    """(by, rule, conversion, decline_rate, error_rate): for each boolean rule of presence, how often an answer is correct,
    declined or wrong among the rows where it holds; null where it never does."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("holds")) for r in rules])).alias("r")
    own = rows.select(by, F.col(correct).alias("c"), F.col(declined).alias("d"), each).select(by, "c", "d", "r.*")
    rate = lambda cond, name: F.round(F.avg(F.when(F.col("holds"), cond.cast("int"))), 6).alias(name)
    return own.groupBy(by, "rule").agg(rate(F.col("c"), "conversion"), rate(F.col("d") & ~F.col("c"), "decline_rate"), rate(~F.col("c") & ~F.col("d"), "error_rate"))


def contingency(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """(a, b, n, share) for every pair of values, also those that do not occur."""
    spark = rows.sparkSession
    kind = rows.schema[a].dataType.simpleString()
    cells = spark.createDataFrame([(x, y) for x in values for y in values], f"{a} {kind}, {b} {kind}")
    found = rows.where(F.col(a).isin(values) & F.col(b).isin(values)).groupBy(a, b).agg(F.count("*").alias("n"))
    out = cells.join(found, [a, b], "left").na.fill(0, ["n"])
    total = found.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).select(a, b, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def list_agreement(left: DataFrame, right: DataFrame, tie: float = 1e-6) -> DataFrame:
    """(qid, same_set, same_order, near_ties, mismatches) of two ranked results (qid, rank, id, score): at places where the ids
    differ, a gap of the two scores below ``tie`` is a near tie, any other a mismatch."""
    a, b = (df.select("qid", "rank", F.col("id").alias(f"{n}_id"), F.col("score").alias(f"{n}_score")) for df, n in ((left, "a"), (right, "b")))
    both = a.join(b, ["qid", "rank"], "full_outer")
    differ = ~F.col("a_id").eqNullSafe(F.col("b_id"))
    close = F.coalesce(F.abs(F.col("a_score") - F.col("b_score")) < tie, F.lit(False))
    sets = lambda c: F.array_sort(F.collect_list(c))  # noqa: E731  as many as the lists are long
    out = both.groupBy("qid").agg((sets("a_id") == sets("b_id")).alias("same_set"), (F.count(F.when(differ, 1)) == 0).alias("same_order"), F.count(F.when(differ & close, 1)).alias("near_ties"), F.count(F.when(differ & ~close, 1)).alias("mismatches"))
    return out


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, n): rank correlation with average ranks for ties. For aggregated rows, one an arm."""
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    return ranked.agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


def normal_interval(rows: DataFrame, by: list[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    """(by, low, high): the normal interval of a mean; null for one row."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))
    return rows.groupBy(*by).agg(F.round(F.avg(value) - half, 6).alias("low"), F.round(F.avg(value) + half, 6).alias("high"))


def without_each(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(dropped, slope, n): a line through the points again without each one. The points are aggregated, one an arm."""
    names = F.broadcast(points.select(F.col(key).alias("dropped")))
    both = points.crossJoin(names).where(F.col(key) != F.col("dropped"))
    return both.groupBy("dropped").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.count("*").alias("n"))


def sessions(lines: DataFrame, by: list[str], order: str, marker: Column) -> DataFrame:
    """lines with session: how many marker lines there are up to each, itself included; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("session", F.sum(marker.cast("int")).over(w).cast("bigint"))


def prefix_unit(path: Column, body: Column) -> Column:
    return F.concat(F.lit("===== "), path, F.lit(" =====\n"), body, F.lit("\n\n"))


def prefix_text(units: Column) -> Column:
    """An array of (path, body) in order as one text, without the last blank line."""
    return F.regexp_replace(F.array_join(F.transform(units, lambda u: prefix_unit(u["path"], u["body"])), ""), r"\n\n\z", "")


def compact_blocks(blocks: Column, most: int = 2000) -> Column:
    """Blocks (type, text) with their text cut to ``most`` characters and its whole length."""
    return F.transform(blocks, lambda b: F.struct(b["type"].alias("type"), F.substring(F.coalesce(b["text"], F.lit("")), 1, most).alias("text"), F.length(F.coalesce(b["text"], F.lit(""))).alias("length")))


def rendered_hits(found: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, answer) for all wanted qids: their hits (qid, rank, id) as numbered texts (id, text), or 'No results found.'"""
    own = found.join(texts, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] "), h["text"])), "\n")
    return wanted.select("qid").join(own, "qid", "left").select("qid", F.coalesce(text, F.lit("No results found.")).alias("answer"))


def merged_picks(picks: DataFrame, by: list[str], name: str) -> DataFrame:
    """picks with equal ``by`` as one row, with their names in order."""
    return picks.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.col(name).cast("string"))), "+").alias("names"))


def replicate_flags(lines: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, disagree) of keys with exactly two lines, whether their values differ; more than two fail."""
    per = lines.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(value) != F.max(value)).alias("disagree"))
    ok = F.when(F.col("n") <= 2, F.col("disagree")).otherwise(F.raise_error(F.lit("more than two lines of a key")).cast("boolean"))
    return per.where("n > 1").select(*keys, ok.alias("disagree"))


def nearest_unused(items: Column, targets: list[float]) -> Column:
    """For each target in turn the place of the nearest depth (an array) that no earlier target took, -1 if all are taken."""

    def taken_with(taken: Column, target: float) -> Column:
        gaps = F.transform(items, lambda d, i: F.struct(F.abs(d - target).alias("d"), i.alias("i")))
        free = F.array_sort(F.filter(gaps, lambda x: ~F.array_contains(taken, x["i"])))
        return F.concat(taken, F.array(F.coalesce(F.get(free, 0)["i"], F.lit(-1))))

    out = F.array().cast("array<int>")
    for target in targets:
        out = taken_with(out, target)
    return out
