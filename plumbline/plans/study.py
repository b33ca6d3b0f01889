"""Queries over ``events`` as runs of arms (event types) over questions (users), over ``labels`` as verdicts of two
raters, and over lineitem as relational coverage: pairing, resampling, decisions, operating points and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import decisions as D
from plumbline.operators import runs as R
from plumbline.operators import stats as S
from plumbline.operators.graph import number_rows
from plumbline.sources.tables import cut, table

ARM_A, ARM_B = "click", "view"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row a question and arm: mean value to six places, number of events."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


def arms_of(df: DataFrame) -> list[str]:
    return [r["arm"] for r in df.select("arm").distinct().orderBy("arm").collect()]


def complete(spark, d) -> tuple[DataFrame, list[str]]:
    """Runs of the questions that have every arm."""
    own = cut(runs(spark, d), "runs")
    arms = arms_of(own)
    return own.join(R.complete_keys(own, arms), "qid", "left_semi"), arms


def arm_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.sum("value"), 4).alias("total"))


def latency(spark, d):
    out = R.latency_summary(table(spark, d, "events").withColumnRenamed("event_type", "arm"), ["arm"], "value")
    return out.select("arm", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


def arm_lift(spark, d):
    own = runs(spark, d).groupBy("arm").agg(F.round(F.avg("value"), 6).alias("mean"))
    base = own.agg(F.min("arm")).first()[0]
    return R.lift(own, "arm", "mean", base).withColumn("lift", F.round("lift", 6))


def complete_questions(spark, d):
    return complete(spark, d)[0].select("qid").distinct()


def incomplete_pairs(spark, d):
    own = cut(runs(spark, d), "runs")
    return R.incomplete(own, own.select("qid").distinct(), arms_of(own))


def two_arms(spark, d):
    own, arms = complete(spark, d)
    return R.paired_deltas(own, "value", arms[0], arms[1]), arms


def paired_deltas(spark, d):
    return two_arms(spark, d)[0].select("qid", F.round("delta", 6).alias("delta"))


def paired_summary(spark, d):
    deltas, _ = two_arms(spark, d)
    out = S.paired_summary(deltas.withColumn("metric", F.lit("value")), ["metric"])
    return out.select("metric", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n_positive", "n_nonzero", F.round("sign_p", 9).alias("sign_p"))


def bootstrap_ci(spark, d):
    """Mean, interval and class of every arm's loss against the first one, over one shared draw."""
    own, arms = complete(spark, d)
    own = cut(own, "complete-runs")
    ids = cut(number_rows(own.select("qid").distinct(), ["qid"]).withColumnRenamed("row_id", "idx"), "question-numbers")
    base = own.where(F.col("arm") == arms[0]).select("qid", F.col("value").alias("base"))
    deltas = own.where(F.col("arm") != arms[0]).join(base, "qid").join(ids, "qid").select("arm", "idx", (F.col("base") - F.col("value")).alias("value"))
    means = S.boot_means(deltas, ["arm"], ids.count())
    ci = S.percentile_ci(means, ["arm"])
    point = deltas.groupBy("arm").agg(F.round(F.avg("value"), 6).alias("delta"))
    return point.join(ci, "arm").withColumn("class", D.classify_delta(F.col("ci_low"), F.col("ci_high"))).withColumn("excludes_zero", D.excludes_zero(F.col("ci_low"), F.col("ci_high")))


def arm_tests(spark, d):
    """McNemar tests of each arm against the first one on whether a value is above 50, with step-up adjusted p."""
    own, arms = complete(spark, d)
    own = own.select("qid", "arm", (F.col("value") > 50).alias("ok"))
    base = own.where(F.col("arm") == arms[0]).select("qid", F.col("ok").alias("base"))
    tests = S.mcnemar(own.where(F.col("arm") != arms[0]).join(base, "qid"), ["arm"], "base", "ok")
    out = S.step_up(cut(tests, "tests"))
    return out.select("arm", "only_a", "only_b", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


def discrimination(spark, d):
    own, arms = complete(spark, d)
    return R.discrimination(own.withColumn("correct", F.col("value") > 50), len(arms)).groupBy("bucket").agg(F.count("*").alias("n"))


def kappa(spark, d):
    out = S.kappa(table(spark, d, "labels"), "quality", "toxic")
    return out.select(F.round("kappa", 9).alias("kappa"), "n", (F.col("kappa") >= D.KAPPA_FLOOR).alias("passes"))


def label_crosstab(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def line_fit(spark, d):
    """Least squares of the number of events on the mean value, for each arm."""
    out = S.fit_line(runs(spark, d), ["arm"], "value", "n")
    return out.select("arm", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def sweep(spark, d) -> DataFrame:
    """Operating points: suppliers' nations as arms, sizes of parts as the swept value."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_linenumber")
    return li.groupBy((F.col("l_suppkey") % 20).alias("arm"), F.col("l_linenumber").cast("int").alias("sweep_value")).agg(F.round(F.avg(F.col("l_quantity").cast("double")) / 50, 6).alias("recall"), F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("qps"))


def best_points(spark, d):
    return R.best_points(sweep(spark, d), [0.5, 0.52, 0.99])


def nearest_point(spark, d):
    return R.nearest_point(sweep(spark, d), 0.51, ["arm"])


def knee(spark, d):
    arms = sweep(spark, d).groupBy("arm").agg(F.max("recall").alias("recall"), F.min("qps").alias("low"))
    return R.knee(arms.withColumn("class", F.when(F.col("low") < 0.05, "PLATEAU").otherwise("DROP")))


def adjacent_gaps(spark, d):
    return R.adjacent(sweep(spark, d), ["arm"], "sweep_value", "recall").select("arm", "sweep_value", F.round("gap", 6).alias("gap"))


def matched_arms(spark, d):
    arms = sweep(spark, d).groupBy("arm").agg(F.max("recall").alias("recall")).withColumn("family", F.col("arm") % 3)
    return R.matched_pairs(arms, 0.003).withColumn("gap", F.round("gap", 6))


def cumulative_tokens(spark, d):
    """Tokens before each turn of a conversation and the depth at which it starts."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens"))
    before = R.cumulative_before(turns, ["conv_id"], "turn", "tokens")
    total = F.sum("tokens").over(Window.partitionBy("conv_id"))
    return before.select("conv_id", "turn", "cum_before", F.round(F.col("cum_before") / total, 6).alias("depth"))


def size_prefix(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens"))
    return R.size_prefix(turns, ["conv_id"], "turn", "tokens", 100)


def greedy_prefix(spark, d):
    """Turns that a greedy pass over each conversation takes within 100 tokens."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens")))).alias("t"))
    return turns.select("conv_id", F.array_join(R.greedy_prefix(F.transform("t", lambda x: x["tokens"]), 100), ",").alias("taken"))


def first_event(spark, d):
    own = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return R.keep_one(own, ["user_id", "event_type"], "event_id", last=False)


def last_event(spark, d):
    own = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return R.keep_one(own, ["user_id", "event_type"], "event_id")


def pivot_means(spark, d):
    own = runs(spark, d)
    return own.groupBy("qid").pivot("arm", arms_of(own)).agg(F.first("value"))


def totals(spark, d):
    """Counts and totals by arm and day with the rows of all days and all arms."""
    own = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.to_date("ts").cast("string").alias("day"), "value")
    return own.cube("arm", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (arm_summary, latency, arm_lift, complete_questions, incomplete_pairs, paired_deltas, paired_summary, bootstrap_ci, arm_tests, discrimination, kappa, label_crosstab, line_fit, best_points, nearest_point, knee, adjacent_gaps, matched_arms, cumulative_tokens, size_prefix, greedy_prefix, first_event, last_event, pivot_means, totals)}

_RUNS = "r AS (SELECT user_id AS qid, event_type AS arm, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL)"
_ARMS = "a AS (SELECT arm, row_number() OVER (ORDER BY arm) AS i FROM (SELECT DISTINCT arm FROM r))"
_FULL = f"{_RUNS}, {_ARMS}, k AS (SELECT qid FROM r GROUP BY qid HAVING count(DISTINCT arm) = (SELECT count(*) FROM a)), f AS (SELECT r.* FROM r SEMI JOIN k USING (qid))"
_DELTA = f"{_FULL}, dl AS (SELECT x.qid, x.value - y.value AS delta FROM f x JOIN f y USING (qid) WHERE x.arm = (SELECT arm FROM a WHERE i = 1) AND y.arm = (SELECT arm FROM a WHERE i = 2))"
#: Chance of at most k of n at one half, times two.
_SIGN = "CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + {n} * ln(0.5))))) END"
_SWEEP = "s AS (SELECT l_suppkey % 20 AS arm, l_linenumber::INT AS sweep_value, round(avg(l_quantity::DOUBLE) / 50, 6) AS recall, round(avg(l_discount::DOUBLE), 6) AS qps FROM lineitem GROUP BY ALL)"
_TURNS = "t AS (SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations)"

SQL = {
    "arm_summary": "SELECT event_type AS arm, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "latency": "SELECT event_type AS arm, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "arm_lift": f"WITH {_RUNS}, m AS (SELECT arm, round(avg(value), 6) AS mean FROM r GROUP BY arm) SELECT arm, mean, round(mean - (SELECT mean FROM m ORDER BY arm LIMIT 1), 6) AS lift FROM m",
    "complete_questions": f"WITH {_FULL} SELECT qid FROM k",
    "incomplete_pairs": f"WITH {_RUNS}, {_ARMS} SELECT q.qid, a.arm, 0::BIGINT AS n FROM (SELECT DISTINCT qid FROM r) q CROSS JOIN a ANTI JOIN r ON r.qid = q.qid AND r.arm = a.arm",
    "paired_deltas": f"WITH {_DELTA} SELECT qid, round(delta, 6) AS delta FROM dl",
    "paired_summary": f"WITH {_DELTA}, m AS (SELECT count(*) AS n, avg(delta) AS mean, quantile_cont(delta, 0.5) AS median, count(*) FILTER (delta > 0) AS n_positive, count(*) FILTER (delta != 0) AS n_nonzero FROM dl) SELECT 'value' AS metric, n, round(mean, 6) AS mean, round(median, 6) AS median, n_positive, n_nonzero, round({_SIGN.format(n='n_nonzero', k='n_positive')}, 9) AS sign_p FROM m",
    "bootstrap_ci": f"""WITH {_FULL}, q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS idx FROM k), c AS (SELECT count(*) AS n FROM q),
dl AS (SELECT y.arm, q.idx, x.value - y.value AS delta FROM f x JOIN f y USING (qid) JOIN q USING (qid) WHERE x.arm = (SELECT arm FROM a WHERE i = 1) AND y.arm != x.arm),
g AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || slot), 1, 8))::BIGINT % n AS idx FROM c, range(200) t(rep), range(n) u(slot)),
m AS (SELECT arm, rep, avg(delta) AS mean FROM dl JOIN g USING (idx) GROUP BY arm, rep),
ci AS (SELECT arm, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM m GROUP BY arm),
p AS (SELECT arm, round(avg(delta), 6) AS delta FROM dl GROUP BY arm)
SELECT arm, delta, ci_low, ci_high, CASE WHEN ci_low > 0 THEN 'DROP' WHEN ci_high < 0.05 THEN 'PLATEAU' ELSE 'INCONCLUSIVE' END AS class, (ci_low > 0 OR ci_high < 0) AS excludes_zero FROM p JOIN ci USING (arm)""",
    "arm_tests": f"""WITH {_FULL}, o AS (SELECT y.arm, count(*) FILTER (x.value > 50 AND y.value <= 50) AS only_a, count(*) FILTER (x.value <= 50 AND y.value > 50) AS only_b FROM f x JOIN f y USING (qid) WHERE x.arm = (SELECT arm FROM a WHERE i = 1) AND y.arm != x.arm GROUP BY y.arm),
p AS (SELECT *, {_SIGN.format(n='(only_a + only_b)', k='only_a')} AS p FROM o), w AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p)
SELECT arm, only_a, only_b, round(p, 9) AS p, round(least(1.0, min(p * (m - rk + 1)) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM w""",
    "discrimination": f"WITH {_FULL}, c AS (SELECT qid, count(*) AS n, count(*) FILTER (value > 50) AS c FROM f GROUP BY qid) SELECT CASE WHEN c = n THEN 'always' WHEN c = 0 THEN 'never' ELSE 'discriminating' END AS bucket, count(*) AS n FROM c GROUP BY 1",
    "kappa": "WITH l AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM l), e AS (SELECT sum(x.c * y.c)::DOUBLE / ((SELECT n FROM t) * (SELECT n FROM t)) AS pe FROM (SELECT a, count(*) AS c FROM l GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM l GROUP BY b) y ON x.a = y.b) SELECT round(CASE WHEN pe = 1 THEN (po = 1)::INT ELSE (po - pe) / (1 - pe) END, 9) AS kappa, n, (po - pe) / (1 - pe) >= 0.6 AS passes FROM t, e",
    "label_crosstab": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "line_fit": f"WITH {_RUNS} SELECT arm, round(regr_slope(n, value), 6) AS slope, round(regr_intercept(n, value), 4) AS intercept FROM r GROUP BY arm",
    "best_points": f"""WITH {_SWEEP}, b AS (SELECT *, recall >= target AS met FROM s, (SELECT unnest([0.5, 0.52, 0.99])::DOUBLE AS target))
SELECT arm, target, sweep_value, recall, qps, met FROM (SELECT *, row_number() OVER (PARTITION BY arm, target ORDER BY met DESC, CASE WHEN met THEN qps ELSE recall END DESC, CASE WHEN met THEN -sweep_value ELSE qps END DESC) AS rn FROM b) WHERE rn = 1""",
    "nearest_point": f"WITH {_SWEEP} SELECT arm, sweep_value, recall FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY abs(recall - 0.51), sweep_value) AS rn FROM s) WHERE rn = 1",
    "knee": f"WITH {_SWEEP}, m AS (SELECT arm, max(recall) AS recall, min(qps) < 0.05 AS ok FROM s GROUP BY arm) SELECT min(recall) AS r_star FROM m WHERE recall > coalesce((SELECT max(recall) FROM m WHERE NOT ok), -1)",
    "adjacent_gaps": f"WITH {_SWEEP} SELECT arm, sweep_value, round(recall - lag(recall) OVER (PARTITION BY arm ORDER BY sweep_value), 6) AS gap FROM s",
    "matched_arms": f"WITH {_SWEEP}, m AS (SELECT arm, max(recall) AS recall FROM s GROUP BY arm) SELECT x.arm AS arm_a, y.arm AS arm_b, round(abs(x.recall - y.recall), 6) AS gap FROM m x JOIN m y ON x.arm < y.arm AND x.arm % 3 != y.arm % 3 AND abs(x.recall - y.recall) <= 0.003 + 1e-12",
    "cumulative_tokens": f"WITH {_TURNS} SELECT conv_id, turn, cum_before, round(cum_before / total, 6) AS depth FROM (SELECT conv_id, turn, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum_before, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM t)",
    "greedy_prefix": f"""WITH RECURSIVE {_TURNS}, o AS (SELECT conv_id, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, tokens) - 1 AS i FROM t),
g AS (SELECT conv_id, -1::BIGINT AS i, 0::BIGINT AS used, []::BIGINT[] AS own FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT g.conv_id, o.i, CASE WHEN used + tokens <= 100 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 100 THEN list_append(own, o.i) ELSE own END FROM g JOIN o ON o.conv_id = g.conv_id AND o.i = g.i + 1)
SELECT conv_id, array_to_string(arg_max(own, i), ',') AS taken FROM g GROUP BY conv_id""",
    "size_prefix": f"WITH {_TURNS}, u AS (SELECT conv_id, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t) SELECT conv_id, count(*) FILTER (upto <= 100) AS n, coalesce(max(upto) FILTER (upto <= 100), 0)::BIGINT AS total FROM u GROUP BY conv_id",
    "first_event": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
    "last_event": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "pivot_means": f"WITH {_RUNS} SELECT qid, " + ", ".join(f"max(value) FILTER (arm = '{a}') AS \"{a}\"" for a in ("click", "error", "purchase", "signup", "view")) + " FROM r GROUP BY qid",
    "totals": "SELECT event_type AS arm, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY CUBE (event_type, strftime(ts, '%Y-%m-%d'))",
}
