"""Queries over ``events`` as verdicts by retrieval depth: arms (event types), questions (users), and what the first k values
of each say. Signals, mediators, contrasts and their bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators import depth as P
from plumbline.operators.graph import number_rows
from plumbline.plans.study import _FULL, arms_of, complete
from plumbline.sources.tables import cut, table

DEPTHS = (1, 3, 5, 10)


def cube(spark, d) -> tuple[DataFrame, int]:
    """(k, arm, qid, idx, judge, presence, em, ids) of questions that every arm has, and their number."""
    own, _ = complete(spark, d)
    ids = cut(number_rows(own.select("qid").distinct(), ["qid"]).withColumnRenamed("row_id", "idx"), "cube-questions")
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    first = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("arm"), "value", place.alias("place")).where(F.col("place") <= max(DEPTHS))
    rows = first.join(ids, "qid").select("*", F.explode(F.array(*map(F.lit, DEPTHS))).alias("k")).where("place <= k")
    bins = F.transform(F.array_sort(F.collect_list(F.struct("place", F.floor(F.col("value") / 50).cast("bigint").alias("bin")))), lambda x: x["bin"])
    out = rows.groupBy("k", "arm", "qid", "idx").agg((F.avg("value") > 50).alias("judge"), (F.max("value") > 60).alias("presence"), (F.min("value") > 30).alias("em"), bins.alias("ids"))
    return cut(out, "cube"), ids.count()


def cells(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Buckets, what is separable, and both as cells (k, idx, hit, separable)."""
    own, n = cube(spark, d)
    found, sep = cut(P.buckets(own), "buckets"), cut(P.separable(own), "separable")
    idx = own.select("k", "qid", "idx").distinct()
    both = found.join(sep, ["k", "qid"]).join(idx, ["k", "qid"]).select("k", "idx", (F.col("bucket") == "discriminating").alias("hit"), "separable")
    return found, sep, cut(both, "cells"), n


def depth_signals(spark, d):
    found, sep, _, _ = cells(spark, d)
    out = P.decompose(found, sep)
    rounded = [F.round(c, 6).alias(c) for c in ("separable_rate", "null", "signal")]
    return out.select("k", "always", "never", "discriminating", "n_separable", *rounded)


def depth_intervals(spark, d):
    _, _, own, n = cells(spark, d)
    return P.rate_intervals(P.replicate_rates(own, n))


def depth_pairs(spark, d):
    found, sep, own, n = cells(spark, d)
    point = cut(P.decompose(found, sep).select("k", "signal"), "signals")
    return P.signal_pairs(point, cut(P.replicate_rates(own, n), "signal-replicates"))


def depth_widest(spark, d):
    found, sep, own, n = cells(spark, d)
    point = cut(P.decompose(found, sep).select("k", "signal"), "signals")
    pairs = P.signal_pairs(point, cut(P.replicate_rates(own, n), "signal-replicates"), tests=1)
    return P.widest_pair(cut(pairs.drop("significant"), "signal-pairs"))


def depth_excess(spark, d):
    found, sep, _, _ = cells(spark, d)
    return P.excess(P.decompose(found, sep))


def depth_fixed(spark, d):
    """Rates on the questions that are separable, or are not, at the least depth."""
    found, sep, _, _ = cells(spark, d)
    least = sep.where(F.col("k") == min(DEPTHS))
    out = P.fixed_composition(found, least.where("separable"), least.where("not separable"))
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("fixed_separable_rate", "fixed_identical_rate", "fixed_signal")])


def depth_membership(spark, d):
    found, sep, _, _ = cells(spark, d)
    return P.membership(found, sep.where((F.col("k") == max(DEPTHS)) & F.col("separable")))


def depth_inverted(spark, d):
    own, _ = cube(spark, d)
    arms = arms_of(own)
    return P.inverted(own, P.separable(own), arms[0], arms[-1])


def depth_predictions(spark, d):
    """Whether always-correct questions grow and never-correct ones shrink with depth, where the signal peaks, and how many
    depths are noise."""
    found, sep, _, _ = cells(spark, d)
    cells_ = cut(P.decompose(found, sep), "decomposed")
    out = P.monotone(found, "always").withColumnRenamed("holds", "always_grows").crossJoin(P.monotone(found, "never", rising=False).withColumnRenamed("holds", "never_shrinks"))
    return out.crossJoin(P.peak_branch(cells_).withColumnRenamed("branch", "peak")).crossJoin(P.noise_depths(cells_).agg(F.count("*").alias("n_noise")))


def mediators(spark, d):
    own, _ = cube(spark, d)
    return P.mediators(own).select("arm", "k", *[F.round(c, 6).alias(c) for c in ("presence", "em", "judge", "conversion")])


def mediator_intervals(spark, d):
    own, n = cube(spark, d)
    return P.mediator_intervals(own.select("arm", "k", "idx", "presence", "em", "judge"), n)


def conversion_composition(spark, d):
    own, _ = cube(spark, d)
    return P.composition(own, min(DEPTHS), max(DEPTHS)).select("arm", *[F.round(c, 6).alias(c) for c in ("moving", "fixed", "newly")])


def numbered_runs(spark, d) -> tuple[DataFrame, int]:
    """Runs of complete questions with recall and quality in 0 to 1; recalls are whole 1024ths, whose sums are exact in any order."""
    own, _ = complete(spark, d)
    own = cut(own, "complete-runs")
    ids = cut(number_rows(own.select("qid").distinct(), ["qid"]).withColumnRenamed("row_id", "idx"), "run-questions")
    runs = own.join(ids, "qid").select("arm", "qid", "idx", (F.floor(F.col("value") * 1024 / 100) / 1024).alias("recall"), (F.col("value") > 50).cast("int").cast("double").alias("quality"))
    return cut(runs, "numbered-runs"), ids.count()


def arm_intervals(spark, d):
    runs, n = numbered_runs(spark, d)
    return B.summarise_arms(runs, n, arms_of(runs)[0])


def planned_pairs(spark, d):
    runs, n = numbered_runs(spark, d)
    arms = arms_of(runs)
    plan = spark.createDataFrame([(chr(65 + i), a, b) for i, (a, b) in enumerate(zip(arms, arms[1:], strict=False))], "pair string, first string, second string")
    return B.evaluate_pairs(runs, n, plan, 5)


def planned_branch(spark, d):
    return B.mechanism_branch(planned_pairs(spark, d))


def recall_slopes(spark, d):
    runs, n = numbered_runs(spark, d)
    order = [r["arm"] for r in runs.groupBy("arm").agg(F.avg("recall").alias("r")).orderBy(F.desc("r"), "arm").collect()]  # a row an arm
    return B.adjacent_slopes(runs, n, order)


def recall_line(spark, d):
    runs, n = numbered_runs(spark, d)
    return B.slope(runs, n).drop("sse")


def answer_rate(spark, d):
    runs, n = numbered_runs(spark, d)
    arm = arms_of(runs)[0]
    out = B.rate(runs.where(F.col("arm") == arm).select("idx", (F.col("quality") > 0).alias("flag")), n)
    return out.withColumn("rate", F.round("rate", 6))


def deltas(spark, d) -> tuple[DataFrame, int]:
    """(qid, idx, value): the first arm's value less the second's."""
    runs, n = numbered_runs(spark, d)
    arms = arms_of(runs)
    a, b = (runs.where(F.col("arm") == arm).select("qid", "idx", F.col("recall").alias(name)) for arm, name in zip(arms, "xy", strict=False))
    return cut(a.join(b.drop("idx"), "qid").select("qid", "idx", F.round(F.col("x") - F.col("y"), 6).alias("value")), "deltas"), n


def median_interval(spark, d):
    own, n = deltas(spark, d)
    out = B.median_summary(own.withColumn("metric", F.lit("recall")), ["metric"], n)
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median")], "n_positive", "n_nonzero", F.round("sign_p", 9).alias("sign_p"), "ci_low", "ci_high", "excludes_zero")


def strata(spark, d) -> tuple[DataFrame, DataFrame, int, int]:
    """Paired differences of questions with even and with odd numbers, each numbered by itself."""
    own, _ = deltas(spark, d)
    sides = [cut(number_rows(own.where(F.col("qid") % 2 == i).select("qid", "value"), ["qid"]).select(F.col("row_id").alias("idx"), "value"), "stratum") for i in (0, 1)]
    return (*sides, *(s.count() for s in sides))


def strata_contrast(spark, d):
    a, b, n, m = strata(spark, d)
    return B.contrast(a, b, n, m).withColumn("median", F.round("median", 6))


def contrast_power(spark, d):
    """Power of the contrast at injected shifts; the first row is the false-positive rate."""
    a, b, n, m = strata(spark, d)
    out = cut(B.power(a, b, n, m, [0.0, 0.2, 1.0, 5.0], studies=40, replicates=100), "power")
    return out.crossJoin(B.gradient_for(out, 0.8)).crossJoin(B.power_at(out, 5.0).withColumnRenamed("power", "at_most"))


QUERIES = {f.__name__: f for f in (depth_signals, depth_intervals, depth_pairs, depth_widest, depth_excess, depth_fixed, depth_membership, depth_inverted, depth_predictions, conversion_composition, arm_intervals, planned_pairs, planned_branch, recall_slopes, recall_line, answer_rate, median_interval, strata_contrast, contrast_power)}
QUERIES |= {"mediators": mediators, "mediator_intervals": mediator_intervals}

_CUBE = f"""{_FULL}, q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS idx FROM k),
v AS (SELECT user_id AS qid, event_type AS arm, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM events),
c AS (SELECT t.k, v.arm, v.qid, q.idx, avg(value) > 50 AS judge, max(value) > 60 AS presence, min(value) > 30 AS em, list(floor(value / 50)::BIGINT ORDER BY place) AS ids FROM v JOIN q USING (qid) JOIN (SELECT unnest([1, 3, 5, 10]) AS k) t ON place <= t.k GROUP BY ALL),
b AS (SELECT k, qid, idx, count(*) AS n, count(*) FILTER (judge) AS right_, count(DISTINCT ids) > 1 AS separable FROM c GROUP BY k, qid, idx),
e AS (SELECT *, CASE WHEN right_ = n THEN 'always' WHEN right_ = 0 THEN 'never' ELSE 'discriminating' END AS bucket FROM b),
h AS (SELECT *, (bucket = 'discriminating')::INT AS hit FROM e)"""
_SIGNAL = f"""{_CUBE}, s AS (SELECT k, count(*) FILTER (bucket = 'always') AS always, count(*) FILTER (bucket = 'never') AS never, count(*) FILTER (bucket = 'discriminating') AS discriminating, count(*) FILTER (separable) AS n_separable, avg(hit) FILTER (separable) AS separable_rate, avg(hit) FILTER (NOT separable) AS "null" FROM h GROUP BY k),
z AS (SELECT *, separable_rate - "null" AS signal FROM s)"""
#: The portable draws, from a count of questions in n.
_DRAWS = "g AS (SELECT rep, ('0x' || substr(md5('{seed}:' || rep || ':' || slot), 1, 8))::BIGINT % n AS idx FROM (SELECT count(*) AS n FROM {of}), range(200) t(rep), range(n) u(slot))"
_REPS = f"""{_SIGNAL}, {_DRAWS.format(seed=42, of='q')}, y AS (SELECT k, rep, avg(hit) AS share, avg(hit) FILTER (separable) AS separable_rate, avg(hit) FILTER (NOT separable) AS "null" FROM h JOIN g USING (idx) GROUP BY k, rep),
w AS (SELECT *, separable_rate - "null" AS signal FROM y)"""


def _pairs(level: str) -> str:
    return f"""{_REPS}, p AS (SELECT x.k AS k_lo, y.k AS k_hi, y.signal - x.signal AS diff FROM z x JOIN z y ON x.k < y.k),
i AS (SELECT x.k AS k_lo, y.k AS k_hi, round(quantile_cont(y.signal - x.signal, ({level}) / 2), 6) AS ci_low, round(quantile_cont(y.signal - x.signal, 1 - ({level}) / 2), 6) AS ci_high FROM w x JOIN w y ON x.rep = y.rep AND x.k < y.k GROUP BY x.k, y.k)"""


_NAMES = ("share", "separable_rate", '"null"', "signal")
_CI = "round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high"
_MED = ("presence", "em", "judge")
_NUM = f"""{_FULL}, q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS idx FROM k), x AS (SELECT f.arm, f.qid, q.idx, floor(f.value * 1024 / 100) / 1024 AS recall, (f.value > 50)::INT::DOUBLE AS quality FROM f JOIN q USING (qid)),
{_DRAWS.format(seed=42, of='q')}, m AS (SELECT arm, rep, avg(recall) AS recall, avg(quality) AS quality FROM x JOIN g USING (idx) GROUP BY arm, rep), p AS (SELECT arm, count(*) AS n, avg(recall) AS recall, avg(quality) AS quality FROM x GROUP BY arm)"""
_PLAN = f"""{_NUM}, l AS (SELECT chr(64 + x.i::INT) AS pair, x.arm AS first, y.arm AS second FROM a x JOIN a y ON y.i = x.i + 1),
o AS (SELECT pair, first, second, u.rep, u.quality - v.quality AS diff FROM l JOIN m u ON u.arm = first JOIN m v ON v.arm = second AND v.rep = u.rep),
j AS (SELECT pair, round(quantile_cont(diff, 0.025), 6) AS face_low, round(quantile_cont(diff, 0.975), 6) AS face_high, round(quantile_cont(diff, 0.005), 6) AS adj_low, round(quantile_cont(diff, 0.995), 6) AS adj_high FROM o GROUP BY pair),
y AS (SELECT l.pair, first, second, round(abs(u.recall - v.recall), 6) AS recall_gap, abs(u.recall - v.recall) <= 0.03 + 1e-12 AS matched, round(u.quality - v.quality, 6) AS diff, face_low, face_high, adj_low, adj_high, l.pair = 'A' AS "primary" FROM l JOIN p u ON u.arm = first JOIN p v ON v.arm = second JOIN j ON j.pair = l.pair)"""
_DELTAS = f"""{_FULL}, q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS idx FROM k), x AS (SELECT f.arm, f.qid, q.idx, floor(f.value * 1024 / 100) / 1024 AS recall FROM f JOIN q USING (qid)),
dl AS (SELECT u.qid, u.idx, round(u.recall - v.recall, 6) AS value FROM x u JOIN x v USING (qid) WHERE u.arm = (SELECT arm FROM a WHERE i = 1) AND v.arm = (SELECT arm FROM a WHERE i = 2))"""
_SIGN = "CASE WHEN n_nonzero = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(n_positive, n_nonzero - n_positive) + 1), lambda i: exp(lgamma(n_nonzero + 1) - lgamma(i + 1) - lgamma(n_nonzero - i + 1) + n_nonzero * ln(0.5))))) END"

SQL = {
    "depth_signals": f'WITH {_SIGNAL} SELECT k, always, never, discriminating, n_separable, round(separable_rate, 6) AS separable_rate, round("null", 6) AS "null", round(signal, 6) AS signal FROM z',
    "depth_intervals": f"WITH {_REPS} " + " UNION ALL ".join(f"SELECT k, '{n.strip(chr(34))}' AS name, {_CI.format(n)} FROM w GROUP BY k" for n in _NAMES),
    "depth_pairs": f"WITH {_pairs('0.05 / 6')} SELECT k_lo, k_hi, round(diff, 6) AS diff, ci_low, ci_high, ci_low > 0 OR ci_high < 0 AS significant FROM p JOIN i USING (k_lo, k_hi)",
    "depth_widest": f"WITH {_pairs('0.05')} SELECT k_lo, k_hi, round(diff, 6) AS diff, ci_low, ci_high FROM p JOIN i USING (k_lo, k_hi) ORDER BY abs(round(diff, 6)) DESC NULLS LAST, k_lo, k_hi LIMIT 1",
    "depth_excess": f"WITH {_SIGNAL} SELECT k, round(signal * n_separable, 4) AS excess FROM z",
    "depth_fixed": f"WITH {_CUBE}, o AS (SELECT qid, separable AS was FROM h WHERE k = 1), t AS (SELECT k, avg(hit) FILTER (was) AS a, avg(hit) FILTER (NOT was) AS b FROM h JOIN o USING (qid) GROUP BY k) SELECT k, round(a, 6) AS fixed_separable_rate, round(b, 6) AS fixed_identical_rate, round(a - b, 6) AS fixed_signal FROM t",
    "depth_membership": f"WITH {_CUBE}, o AS (SELECT qid FROM h WHERE k = 10 AND separable), f0 AS (SELECT qid FROM h SEMI JOIN o USING (qid) WHERE k = 1 AND hit = 1) SELECT k, count(*) FILTER (hit = 1 AND qid IN (SELECT qid FROM o)) AS n_disc, count(*) FILTER (hit = 1 AND qid IN (SELECT qid FROM f0)) AS n_disc_overlap FROM h GROUP BY k",
    "depth_inverted": f"WITH {_CUBE}, o AS (SELECT k, qid, bool_or(judge) FILTER (arm = (SELECT min(arm) FROM a)) AS w, bool_or(judge) FILTER (arm = (SELECT max(arm) FROM a)) AS t FROM c GROUP BY k, qid) SELECT k, round(avg((w AND NOT t)::INT) FILTER (hit = 1 AND separable), 6) AS inverted FROM h JOIN o USING (k, qid) GROUP BY k",
    "depth_predictions": f"""WITH {_SIGNAL}, t AS (SELECT k, always - lag(always) OVER (ORDER BY k) AS up, never - lag(never) OVER (ORDER BY k) AS down FROM z), o AS (SELECT k FROM z ORDER BY signal DESC NULLS LAST, k LIMIT 1)
SELECT (SELECT bool_and(up >= 0) FROM t) AS always_grows, (SELECT bool_and(down <= 0) FROM t) AS never_shrinks, (SELECT CASE k WHEN 1 THEN 'X-B' WHEN 10 THEN 'X-C' ELSE 'X-A' END FROM o) AS peak, (SELECT count(*) FROM z WHERE "null" >= separable_rate) AS n_noise""",
    "mediators": f"WITH {_CUBE} SELECT arm, k, round(avg(presence::INT), 6) AS presence, round(avg(em::INT), 6) AS em, round(avg(judge::INT), 6) AS judge, round(avg(judge::INT) FILTER (presence), 6) AS conversion FROM c GROUP BY arm, k",
    "mediator_intervals": f"WITH {_CUBE}, {_DRAWS.format(seed=42, of='q')}, o AS (SELECT arm, k, rep, avg(presence::INT) AS presence, avg(em::INT) AS em, avg(judge::INT) AS judge, avg(judge::INT) FILTER (presence) AS conversion FROM c JOIN g USING (idx) GROUP BY arm, k, rep) " + " UNION ALL ".join(f"SELECT arm, k, '{n}' AS name, {_CI.format(n)} FROM o GROUP BY arm, k" for n in (*_MED, "conversion")),
    "conversion_composition": f"WITH {_CUBE}, t AS (SELECT x.arm, x.presence AS lp, y.presence AS hp, y.judge::INT AS j FROM c x JOIN c y USING (arm, qid) WHERE x.k = 1 AND y.k = 10) SELECT arm, round(avg(j) FILTER (hp), 6) AS moving, round(avg(j) FILTER (lp), 6) AS fixed, round(avg(j) FILTER (hp AND NOT lp), 6) AS newly FROM t GROUP BY arm",
    "arm_intervals": f"""WITH {_NUM}, r0 AS (SELECT rep, quality AS ref FROM m WHERE arm = (SELECT min(arm) FROM a)),
i AS (SELECT arm, round(quantile_cont(recall, 0.025), 6) AS recall_ci_low, round(quantile_cont(recall, 0.975), 6) AS recall_ci_high, round(quantile_cont(quality, 0.025), 6) AS quality_ci_low, round(quantile_cont(quality, 0.975), 6) AS quality_ci_high, round(quantile_cont(ref - quality, 0.025), 6) AS delta_ci_low, round(quantile_cont(ref - quality, 0.975), 6) AS delta_ci_high FROM m JOIN r0 USING (rep) GROUP BY arm)
SELECT arm, n, round(recall, 6) AS recall, recall_ci_low, recall_ci_high, round(quality, 6) AS quality, quality_ci_low, quality_ci_high, round((SELECT quality FROM p WHERE arm = (SELECT min(arm) FROM a)) - quality, 6) AS delta, delta_ci_low, delta_ci_high, CASE WHEN arm = (SELECT min(arm) FROM a) THEN 'reference' WHEN delta_ci_low > 0 THEN 'DROP' WHEN delta_ci_high < 0.05 THEN 'PLATEAU' ELSE 'INCONCLUSIVE' END AS class FROM p JOIN i USING (arm)""",
    "planned_pairs": f"WITH {_PLAN} SELECT * FROM y",
    "planned_branch": f"""WITH {_PLAN}, t AS (SELECT *, CASE WHEN "primary" THEN face_low ELSE adj_low END AS lo, CASE WHEN "primary" THEN face_high ELSE adj_high END AS hi FROM y)
SELECT CASE WHEN coalesce(bool_or(lo > 0 OR hi < 0) FILTER (matched), false) THEN 'M1' WHEN coalesce(bool_and(face_low >= -0.05 AND face_high <= 0.05) FILTER (matched), false) THEN 'M2' ELSE 'M3' END AS branch FROM t""",
    "recall_slopes": f"""WITH {_NUM}, o AS (SELECT arm, recall, quality, row_number() OVER (ORDER BY recall DESC, arm) AS place FROM p), l AS (SELECT x.arm AS upper, y.arm AS lower, x.recall - y.recall AS dr, x.quality - y.quality AS dq FROM o x JOIN o y ON y.place = x.place + 1),
t AS (SELECT upper, lower, CASE WHEN u.recall != v.recall THEN (u.quality - v.quality) / (u.recall - v.recall) END AS s FROM l JOIN m u ON u.arm = upper JOIN m v ON v.arm = lower AND v.rep = u.rep)
SELECT l.upper, l.lower, round(dr, 6) AS d_recall, round(dq, 6) AS d_quality, round(CASE WHEN dr != 0 THEN dq / dr END, 6) AS slope, ci_low, ci_high FROM l JOIN (SELECT upper, lower, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM t GROUP BY upper, lower) USING (upper, lower)""",
    "recall_line": f"WITH {_NUM}, t AS (SELECT rep, regr_slope(quality, recall) AS s FROM m GROUP BY rep) SELECT round(regr_slope(quality, recall), 6) AS slope, round(regr_intercept(quality, recall), 6) AS intercept, (SELECT round(quantile_cont(s, 0.025), 6) FROM t) AS ci_low, (SELECT round(quantile_cont(s, 0.975), 6) FROM t) AS ci_high FROM p",
    "answer_rate": f"WITH {_NUM} SELECT round(avg(quality), 6) AS rate, count(*) AS n, count(*) FILTER (quality > 0) AS n_true, (SELECT round(quantile_cont(quality, 0.025), 6) FROM m WHERE arm = (SELECT min(arm) FROM a)) AS ci_low, (SELECT round(quantile_cont(quality, 0.975), 6) FROM m WHERE arm = (SELECT min(arm) FROM a)) AS ci_high FROM x WHERE arm = (SELECT min(arm) FROM a)",
    "median_interval": f"""WITH {_DELTAS}, {_DRAWS.format(seed=42, of='dl')}, t AS (SELECT rep, quantile_cont(value, 0.5) AS med FROM dl JOIN g USING (idx) GROUP BY rep), i AS (SELECT round(quantile_cont(med, 0.025), 6) AS ci_low, round(quantile_cont(med, 0.975), 6) AS ci_high FROM t),
s AS (SELECT count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, count(*) FILTER (value > 0) AS n_positive, count(*) FILTER (value != 0) AS n_nonzero FROM dl)
SELECT 'recall' AS metric, n, round(mean, 6) AS mean, round(median, 6) AS median, n_positive, n_nonzero, round({_SIGN}, 9) AS sign_p, ci_low, ci_high, ci_low > 0 OR ci_high < 0 AS excludes_zero FROM s, i""",
    "strata_contrast": f"""WITH {_DELTAS}, d0 AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS idx, value FROM dl WHERE qid % 2 = 0), d1 AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS idx, value FROM dl WHERE qid % 2 = 1),
{_DRAWS.format(seed='42a', of='d0').replace('g AS', 'g0 AS', 1)}, {_DRAWS.format(seed='42b', of='d1').replace('g AS', 'g1 AS', 1)},
m0 AS (SELECT rep, quantile_cont(value, 0.5) AS a FROM d0 JOIN g0 USING (idx) GROUP BY rep), m1 AS (SELECT rep, quantile_cont(value, 0.5) AS b FROM d1 JOIN g1 USING (idx) GROUP BY rep),
i AS (SELECT round(quantile_cont(a - b, 0.025), 6) AS low, round(quantile_cont(a - b, 0.975), 6) AS high FROM m0 JOIN m1 USING (rep))
SELECT round((SELECT quantile_cont(value, 0.5) FROM d0) - (SELECT quantile_cont(value, 0.5) FROM d1), 6) AS median, low, high, low > 0 OR high < 0 AS excludes_zero, (SELECT count(*)::INT FROM d0) AS n_a, (SELECT count(*)::INT FROM d1) AS n_b FROM i""",
}
