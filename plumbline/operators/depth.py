"""How verdicts change with retrieval depth: buckets, the signal of separable questions, conversion and its composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import decisions as D
from plumbline.operators import boot as B
from plumbline.operators import stats as S


def buckets(cube: DataFrame) -> DataFrame:
    """(k, qid, bucket) of verdicts (arm, k, qid, judge): always, never or discriminating over the arms of a depth. A
    question that lacks an arm which others have at that depth fails."""
    arms = cube.groupBy("k").agg(F.count_distinct("arm").alias("arms"))
    per = cube.groupBy("k", "qid").agg(F.count_distinct("arm").alias("n"), F.count("*").alias("m"), F.sum(F.col("judge").cast("int")).alias("c")).join(F.broadcast(arms), "k")
    ragged = (F.col("n") != F.col("arms")) | (F.col("m") != F.col("n"))
    name = F.when(ragged, F.raise_error(F.lit("ragged arms")).cast("string")).when(F.col("c") == F.col("n"), "always").when(F.col("c") == 0, "never").otherwise("discriminating")
    return per.select("k", "qid", name.alias("bucket"))


def decompose(found: DataFrame, separable: DataFrame) -> DataFrame:
    """(k, always, never, discriminating, n_separable, separable_rate, null, signal) from buckets (k, qid, bucket) and
    (k, qid, separable): the rate of discriminating questions among those whose lists differ, less that among the others;
    null if either side is empty."""
    both = found.join(separable, ["k", "qid"])
    hit = (F.col("bucket") == "discriminating").cast("int")
    count = lambda b: F.count(F.when(F.col("bucket") == b, 1)).alias(b)
    out = both.groupBy("k").agg(count("always"), count("never"), count("discriminating"), F.count(F.when(F.col("separable"), 1)).alias("n_separable"), F.avg(F.when(F.col("separable"), hit)).alias("separable_rate"), F.avg(F.when(~F.col("separable"), hit)).alias("null"))
    return out.withColumn("signal", F.col("separable_rate") - F.col("null"))


def mediators(cube: DataFrame) -> DataFrame:
    """(arm, k, presence, em, judge, conversion): means, and correct answers among questions whose answer was retrieved."""
    mean = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    return cube.groupBy("arm", "k").agg(mean("presence"), mean("em"), mean("judge"), F.avg(F.when(F.col("presence"), F.col("judge").cast("int"))).alias("conversion"))


def composition(cube: DataFrame, low: int, high: int) -> DataFrame:
    """(arm, moving, fixed, newly): conversion at the higher depth among questions present there, among those present at
    the lower depth already, and among those that are new."""
    at = lambda k, p: cube.where(F.col("k") == k).select("arm", "qid", F.col("presence").alias(f"{p}_p"), F.col("judge").cast("int").alias(f"{p}_j"))
    both = at(low, "low").join(at(high, "high"), ["arm", "qid"])
    rate = lambda c: F.avg(F.when(c, F.col("high_j")))
    return both.groupBy("arm").agg(rate(F.col("high_p")).alias("moving"), rate(F.col("low_p")).alias("fixed"), rate(F.col("high_p") & ~F.col("low_p")).alias("newly"))


def monotone(found: DataFrame, bucket: str, rising: bool = True) -> DataFrame:
    """One row (holds): whether the count of a bucket never falls (or never rises) with depth."""
    from pyspark.sql import Window

    counts = found.groupBy("k").agg(F.count(F.when(F.col("bucket") == bucket, 1)).alias("n"))
    step = F.col("n") - F.lag("n").over(Window.orderBy("k"))  # one row a depth
    return counts.select(step.alias("step")).agg(F.coalesce(F.min((F.col("step") >= 0 if rising else F.col("step") <= 0).cast("int")) == 1, F.lit(True)).alias("holds"))


def separable(lists: DataFrame, k_col: str = "k") -> DataFrame:
    """(k, qid, separable) of lists (k, qid, arm, ids): whether the arms' ordered lists differ; ids below 0 only fill up."""
    own = lists.select(k_col, "qid", F.filter("ids", lambda i: i >= 0).alias("ids"))
    return own.groupBy(k_col, "qid").agg((F.count_distinct("ids") > 1).alias("separable"))


def replicate_rates(cells: DataFrame, n: int, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """(by, rep, share, separable_rate, null, signal) of cells (by, idx, hit, separable): the rates of discriminating
    questions in each replicate, null where no question of a side was drawn."""
    w, hit, sep = F.col("weight"), F.col("hit").cast("int"), F.col("separable")
    rate = lambda cond: F.sum(F.when(cond, hit * w)) / F.sum(F.when(cond, w))
    out = B.with_draws(cells, n).groupBy(*by, "rep").agg(rate(F.lit(True)).alias("share"), rate(sep).alias("separable_rate"), rate(~sep).alias("null"))
    return out.withColumn("signal", F.col("separable_rate") - F.col("null"))


def rate_intervals(reps: DataFrame, by: tuple[str, ...] = ("k",)) -> DataFrame:
    """(by, name, low, high) of the replicate rates."""
    each = [F.struct(F.lit(c).alias("name"), B.interval(F.col(c)).alias("ci")) for c in ("share", "separable_rate", "null", "signal")]
    return reps.groupBy(*by).agg(F.array(*each).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.name", "x.ci.low", "x.ci.high")


def signal_pairs(point: DataFrame, reps: DataFrame, tests: int | None = None) -> DataFrame:
    """(k_lo, k_hi, diff, ci_low, ci_high, significant) for all pairs of depths from the signals by depth (k, signal) and by
    replicate (k, rep, signal); the level is divided by the number of pairs, or by ``tests``."""
    n = point.count()
    m = tests or max(1, n * (n - 1) // 2)
    a, b = point.select(F.col("k").alias("k_lo"), F.col("signal").alias("x")), point.select(F.col("k").alias("k_hi"), F.col("signal").alias("y"))
    pairs = a.join(b, F.col("k_lo") < F.col("k_hi"))  # depths, of which there are a few
    ra, rb = reps.select("rep", F.col("k").alias("k_lo"), F.col("signal").alias("x")), reps.select("rep", F.col("k").alias("k_hi"), F.col("signal").alias("y"))
    ci = ra.join(rb, "rep").where("k_lo < k_hi").groupBy("k_lo", "k_hi").agg(B.interval(F.col("y") - F.col("x"), S.ALPHA / m).alias("ci"))
    low, high = F.col("ci.low"), F.col("ci.high")
    return pairs.join(ci, ["k_lo", "k_hi"]).select("k_lo", "k_hi", F.round(F.col("y") - F.col("x"), 6).alias("diff"), low.alias("ci_low"), high.alias("ci_high"), D.excludes_zero(low, high).alias("significant"))


def widest_pair(pairs: DataFrame) -> DataFrame:
    """The one pair with the largest difference of the point estimates, ties to the least depths. Chosen once, from the
    points: pairs must hold intervals at the level of a single test."""
    rank = F.struct(F.abs("diff").alias("d"), (-F.col("k_lo")).alias("a"), (-F.col("k_hi")).alias("b"))
    return pairs.agg(F.max_by(F.struct(*pairs.columns), rank).alias("r")).select("r.*")


def fixed_rate(found: DataFrame, qids: DataFrame, name: str = "rate") -> DataFrame:
    """(k, rate) of discriminating questions on one set of questions (qid) at every depth."""
    return found.join(qids.select("qid"), "qid", "left_semi").groupBy("k").agg(F.avg((F.col("bucket") == "discriminating").cast("int")).alias(name))


def fixed_composition(found: DataFrame, separable_ids: DataFrame, identical_ids: DataFrame) -> DataFrame:
    """(k, fixed_separable_rate, fixed_identical_rate, fixed_signal): both sets of questions stay the same at all depths."""
    out = fixed_rate(found, separable_ids, "fixed_separable_rate").join(fixed_rate(found, identical_ids, "fixed_identical_rate"), "k", "full_outer")
    return out.withColumn("fixed_signal", F.col("fixed_separable_rate") - F.col("fixed_identical_rate"))


def membership(found: DataFrame, qids: DataFrame) -> DataFrame:
    """(k, n_disc, n_disc_overlap): how many questions of a set discriminate at each depth, and how many of those do at the
    least depth, too."""
    own = found.join(qids.select("qid"), "qid", "left_semi").where("bucket = 'discriminating'")
    least = found.agg(F.min("k").alias("k0"))
    first = own.join(F.broadcast(least), F.col("k") == F.col("k0"), "left_semi").select("qid", F.lit(1).alias("first"))
    counts = own.join(first, "qid", "left").groupBy("k").agg(F.count("*").alias("n_disc"), F.count("first").alias("n_disc_overlap"))
    return found.select("k").distinct().join(counts, "k", "left").na.fill(0, ["n_disc", "n_disc_overlap"])


def excess(signals: DataFrame) -> DataFrame:
    """(k, excess): the number of questions that a signal stands for; null without a signal."""
    return signals.select("k", F.round(F.col("signal") * F.col("n_separable"), 4).alias("excess"))


def inverted(verdicts: DataFrame, separable_at: DataFrame, worst: str, best: str) -> DataFrame:
    """(k, inverted): among discriminating questions whose lists differ, the share that the worst arm answers and the best
    does not; null without such questions."""
    arm = lambda name: F.bool_or(F.when(F.col("arm") == name, F.col("judge")))
    per = verdicts.groupBy("k", "qid").agg(arm(worst).alias("worst"), arm(best).alias("best"), (F.count_distinct("judge") > 1).alias("disc"))
    flag = (F.col("worst") & ~F.col("best")).cast("int")
    return per.join(separable_at, ["k", "qid"]).groupBy("k").agg(F.round(F.avg(F.when(F.col("disc") & F.col("separable"), flag)), 6).alias("inverted"))


def mediator_intervals(cube: DataFrame, n: int) -> DataFrame:
    """(arm, k, name, low, high): intervals of the mediators of cube (arm, k, idx, presence, em, judge), one draw for all;
    replicates without a question whose answer was retrieved give no conversion."""
    w = F.col("weight")
    mean = lambda c: F.sum(F.col(c).cast("int") * w) / F.sum(w)
    some = F.col("presence")
    conversion = F.sum(F.when(some, F.col("judge").cast("int") * w)) / F.sum(F.when(some, w))
    reps = B.with_draws(cube, n).groupBy("arm", "k", "rep").agg(*[mean(c).alias(c) for c in ("presence", "em", "judge")], conversion.alias("conversion"))
    each = [F.struct(F.lit(c).alias("name"), B.interval(F.col(c)).alias("ci")) for c in ("presence", "em", "judge", "conversion")]
    return reps.groupBy("arm", "k").agg(F.array(*each).alias("x")).select("arm", "k", F.explode("x").alias("x")).select("arm", "k", "x.name", "x.ci.low", "x.ci.high")


def peak_branch(signals: DataFrame) -> DataFrame:
    """One row (branch): X-B if the signal is largest at the least depth, X-C at the largest, else X-A; ties to the least."""
    best = F.max_by("k", F.struct(F.col("signal"), (-F.col("k")).alias("k")))
    return signals.agg(F.when(best == F.min("k"), "X-B").when(best == F.max("k"), "X-C").otherwise("X-A").alias("branch"))


def noise_depths(cells: DataFrame) -> DataFrame:
    """Depths (k) at which questions with equal lists discriminate at least as often as those whose lists differ."""
    return cells.where(F.col("null") >= F.col("separable_rate")).select("k")


def cells_differ(rows: DataFrame) -> DataFrame:
    """(k, arm) of the cells of rows (k, arm, qid) that do not have all the questions that occur anywhere."""
    n = rows.agg(F.count_distinct("qid").alias("all"))
    per = rows.groupBy("k", "arm").agg(F.count_distinct("qid").alias("n"))
    return per.crossJoin(F.broadcast(n)).where("n != all").select("k", "arm")
