"""Queries over ``events`` as verdicts of arms (event types) on questions (users): flip distances, residuals, refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import flips as P
from plumbline.operators.graph import number_rows
from plumbline.plans.study import _FULL, complete
from plumbline.sources.tables import cut


def verdicts(spark, d):
    """(arm, qid, idx, recall, ok) of complete questions, their number, and the arms; recalls are whole 1024ths, so that sums do
    not depend on their order, and verdicts lean to the first arm."""
    own, arms = complete(spark, d)
    ids = cut(number_rows(own.select("qid").distinct(), ["qid"]).withColumnRenamed("row_id", "idx"), "verdict-questions")
    ok = F.col("value") > F.when(F.col("arm") == arms[0], 44).otherwise(50)
    return cut(own.join(ids, "qid").select("arm", "qid", "idx", (F.floor(F.col("value") * 1024 / 100) / 1024).alias("recall"), ok.alias("ok")), "verdicts"), ids.count(), arms


def flip_distances(spark, d):
    own, n, arms = verdicts(spark, d)
    return P.flip_distances(own, n, arms[0], most=n)


def curve_residuals(spark, d):
    """Residuals of the last two arms from the curve through the others."""
    own, n, arms = verdicts(spark, d)
    own = own.withColumn("quality", F.col("ok").cast("double"))
    return P.residuals(own, n, ~F.col("arm").isin(arms[-2:]))


def subset_fits(spark, d):
    own, _, arms = verdicts(spark, d)
    return P.subset_fits(cut(P.subset_means(own.withColumnRenamed("recall", "x"), len(arms)), "subset-means"))


def subset_changepoints(spark, d):
    own, _, arms = verdicts(spark, d)
    return P.subset_changepoints(P.subset_means(own.withColumnRenamed("recall", "x"), len(arms)))


QUERIES = {f.__name__: f for f in (flip_distances, curve_residuals, subset_fits, subset_changepoints)}

_VERDICTS = f"""{_FULL}, q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS idx FROM k), c AS (SELECT count(*) AS n FROM q), b AS (SELECT min(arm) AS base FROM a),
x AS (SELECT f.arm, f.qid, q.idx, floor(f.value * 1024 / 100) / 1024 AS recall, (f.value > CASE WHEN f.arm = base THEN 44 ELSE 50 END)::INT AS ok FROM f JOIN q USING (qid), b),
g AS (SELECT rep, idx, count(*) AS w FROM (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || slot), 1, 8))::BIGINT % n AS idx FROM c, range(200) t(rep), range(n) u(slot)) GROUP BY ALL)"""
_CLASS = "CASE WHEN round(quantile_cont({0}, 0.025), 6) > 0 THEN 'DROP' WHEN round(quantile_cont({0}, 0.975), 6) < 0.05 THEN 'PLATEAU' ELSE 'INCONCLUSIVE' END"
SQL = {
    "flip_distances": f"""WITH {_VERDICTS}, p AS (SELECT y.arm, y.idx, z.ok AS ref, y.ok FROM x y JOIN x z USING (idx), b WHERE z.arm = base AND y.arm != base),
l AS (SELECT arm, rep, sum(w * (ref - ok)) AS loss FROM p JOIN g USING (idx) GROUP BY ALL),
o AS (SELECT arm, {_CLASS.format('loss / n')} AS class FROM l, c GROUP BY arm),
d AS (SELECT arm, idx, row_number() OVER (PARTITION BY arm ORDER BY idx) AS place FROM p WHERE ref = 1 AND ok = 0),
t AS (SELECT d.arm, l.rep, place, loss - sum(coalesce(w, 0)) OVER (PARTITION BY d.arm, l.rep ORDER BY place) AS loss FROM d JOIN l USING (arm) LEFT JOIN g ON g.idx = d.idx AND g.rep = l.rep),
e AS (SELECT arm, place, {_CLASS.format('loss / n')} AS class FROM t, c GROUP BY arm, place),
h AS (SELECT arm, min(place) AS flips, arg_min(class, place) AS class_after FROM e WHERE class != 'DROP' GROUP BY arm)
SELECT o.arm, o.class, (SELECT count(*) FROM d WHERE d.arm = o.arm) AS n_candidates, (CASE WHEN o.class = 'DROP' THEN flips END)::INT AS flips, CASE WHEN o.class = 'DROP' THEN class_after END AS class_after FROM o LEFT JOIN h USING (arm)""",
    "curve_residuals": f"""WITH {_VERDICTS}, m AS (SELECT arm, rep, sum(recall * w) / sum(w) AS x, sum(ok * w) / sum(w)::DOUBLE AS y FROM x JOIN g USING (idx) GROUP BY ALL UNION ALL SELECT arm, -1, avg(recall), avg(ok) FROM x GROUP BY arm),
s AS (SELECT arm IN (SELECT arm FROM a ORDER BY arm DESC LIMIT 2) AS target, * FROM m),
u AS (SELECT t.arm, t.rep, t.x, t.y, arg_max(o.x, (o.x, o.arm)) FILTER (o.x <= t.x) AS lx, arg_max(o.y, (o.x, o.arm)) FILTER (o.x <= t.x) AS ly, arg_min(o.x, (o.x, o.arm)) FILTER (o.x > t.x) AS hx, arg_min(o.y, (o.x, o.arm)) FILTER (o.x > t.x) AS hy
  FROM s t JOIN s o ON t.rep = o.rep AND t.target AND NOT o.target GROUP BY ALL),
v AS (SELECT *, y - CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly ELSE ly + (hy - ly) / (hx - lx) * (x - lx) END AS r FROM u),
i AS (SELECT arm, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high FROM v WHERE rep >= 0 GROUP BY arm)
SELECT arm, round(x, 6) AS recall, round(y, 6) AS quality, round(r, 6) AS residual, ci_low, ci_high, lx IS NULL OR (hx IS NULL AND x > lx) AS extrapolated FROM v JOIN i USING (arm) WHERE rep < 0""",
    "subset_fits": f"""WITH {_VERDICTS}, n AS (SELECT qid, sum(ok) AS c FROM x GROUP BY qid), s AS (SELECT unnest(['all', 'solvable', 'discriminating']) AS subset),
m AS (SELECT subset, arm, count(*) AS n, avg(recall) AS x, avg(ok) AS y FROM x JOIN n USING (qid), s WHERE subset = 'all' OR c > 0 AND (subset = 'solvable' OR c < (SELECT count(*) FROM a)) GROUP BY ALL)
SELECT m.subset, max(m.n) AS n, round(regr_slope(m.y, m.x), 6) AS slope, round(regr_intercept(m.y, m.x), 6) AS intercept, round(regr_syy(m.y, m.x) - regr_sxy(m.y, m.x) ** 2 / nullif(regr_sxx(m.y, m.x), 0), 6) AS sse,
round(min(m.y / nullif(o.y, 0)), 6) AS least_rescale, round(max(m.y / nullif(o.y, 0)), 6) AS most_rescale, round(max(o.n / m.n), 6) AS rescale FROM m JOIN m o ON o.subset = 'all' AND o.arm = m.arm GROUP BY m.subset""",
}
