"""Queries of report tables over events, lines, embeddings, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import decisions as D
from plumbline.functions import text as X
from plumbline.operators import reports as R
from plumbline.operators import runs as U
from plumbline.plans import search
from plumbline.plans.depths import _CUBE, _DELTAS, cube, numbered_runs
from plumbline.plans.study import _FULL, _SWEEP, sweep
from plumbline.sources.tables import cut, table


def conversion_rules(spark, d):
    """At the largest depth, answers by two rules of presence."""
    own, _ = cube(spark, d)
    return R.conversion_table(own.where("k = 10").withColumn("quiet", F.size("ids") < 2), ["presence", "em"], "judge", "quiet")


def label_cells(spark, d):
    return R.contingency(table(spark, d, "labels"), "quality", "toxic", [0, 1])


def rank_agreement(spark, d):
    """Exact against SQ8 search, place by place."""
    return R.list_agreement(search.exact_topk(spark, d), search.sq8_topk(spark, d))


def rendered_results(spark, d):
    """The first three neighbours of each query as text; a query that is not among the vectors has none."""
    rows = search.corpus(spark, d)
    found = search.exact_topk(spark, d).where(F.col("rank") <= 3)
    wanted = search.queries(rows).select("qid").union(spark.createDataFrame([(-7,)], "qid bigint"))
    return R.rendered_hits(found, rows.select("id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text")), wanted)


def arm_ranks(spark, d):
    """Rank correlation of the arms' mean value and number of events."""
    own = table(spark, d, "events").groupBy((F.col("user_id") % 30).alias("u")).agg(F.round(F.avg("value"), 1).alias("mean"), F.count("*").alias("n"))
    return R.spearman(own, "mean", "n")


def normal_classes(spark, d):
    """Each arm's class by a normal interval of its loss against the first arm."""
    runs, _ = numbered_runs(spark, d)
    first = runs.agg(F.min("arm")).first()[0]
    base = runs.where(F.col("arm") == first).select("qid", F.col("quality").alias("ref"))
    loss = runs.where(F.col("arm") != first).join(base, "qid").select("arm", (F.col("ref") - F.col("quality")).alias("loss"))
    return R.normal_interval(loss, ["arm"], "loss").withColumn("class", D.classify_delta(F.col("low"), F.col("high")))


def slopes_without(spark, d):
    arms = sweep(spark, d).groupBy("arm").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("qps"), 6).alias("qps"))
    return R.without_each(cut(arms, "sweep-arms"), "arm", "qps", "recall")


def conversation_sessions(spark, d):
    """Turns of users open a session; sessions with their turns and characters."""
    own = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    out = R.sessions(own, ["conv_id"], "turn", F.col("role") == "user")
    return out.groupBy("conv_id", "session").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"))


def stuffed_prefix(spark, d):
    """Conversations as files of a prompt, in order of their turns."""
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("body")))).alias("u"))
    return own.select("conv_id", F.md5(R.prefix_text(F.col("u"))).alias("digest"))


def block_lengths(spark, d):
    """Turns as blocks of a transcript, cut to 50 characters."""
    own = table(spark, d, "conversations").select("conv_id", "turn", R.compact_blocks(F.array(F.struct(F.col("role").alias("type"), F.col("text").alias("text"))), 50).alias("b"))
    return own.select("conv_id", "turn", F.explode("b").alias("b")).select("conv_id", "turn", "b.type", F.md5("b.text").alias("digest"), "b.length")


def merged_points(spark, d):
    """Operating points nearest to three recalls, with equal picks in one row."""
    own, out = cut(sweep(spark, d), "sweep"), None
    for target in (0.5, 0.505, 0.52):
        part = U.nearest_point(own, target, ["arm"]).withColumn("target", F.lit(target))
        out = part if out is None else out.union(part)
    return R.merged_picks(out, ["arm", "sweep_value"], "target")


def replicate_disagreement(spark, d):
    """Users and arms with exactly two events of a kind, and whether their values fall on different sides."""
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    own = table(spark, d, "events").withColumn("place", place).where("place <= 2")
    return R.replicate_flags(own.select(F.col("user_id").alias("qid"), F.col("event_type").alias("arm"), (F.col("value") > 50).alias("ok")), ["qid", "arm"], "ok")


def picked_turns(spark, d):
    """For each conversation the turns nearest to three depths, none twice."""
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    depths = F.transform("t", lambda x, i: F.round(i / F.size("t"), 6))
    return own.select("conv_id", F.array_join(F.transform(R.nearest_unused(depths, [0.1, 0.5, 0.9]), lambda i: i.cast("string")), ",").alias("places"))


def size_curve(spark, d):
    """By arm and size the median and mean of what a run took, with the size's total."""
    own = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("size"), F.col("l_quantity").cast("double").alias("tokens"), F.col("l_discount").cast("double").alias("cost"))
    total = own.groupBy("size").agg(F.sum("tokens").alias("corpus_tokens"))
    out = own.groupBy("arm", "size").agg(F.round(F.percentile("tokens", 0.5), 4).alias("median_tokens"), F.round(F.avg("cost"), 6).alias("mean_cost"), F.count("*").alias("n"))
    return out.join(total, "size").select("arm", "size", "median_tokens", "mean_cost", "n", "corpus_tokens")


def depth_table(spark, d):
    """Turns by role and depth in tenths: mean length, number, and whether all are long."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    own = table(spark, d, "conversations").select("role", F.round(F.floor(place * 10 / n) / 10, 1).alias("depth"), F.length("text").alias("len"))
    return own.groupBy("role", "depth").agg(F.round(F.avg("len"), 4).alias("mean"), F.count("*").alias("n"), F.bool_and(F.col("len") > 20).alias("all_long"))


def cell_means(spark, d):
    """Events by arm, depth and temperature of a plan of cells."""
    own = table(spark, d, "events").select(F.col("event_type").alias("arm"), F.element_at(F.array(*map(F.lit, (1, 3, 5, 10))), (F.col("event_id") % 4 + 1).cast("int")).alias("k"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.0).alias("temperature"), "value")
    return own.groupBy("arm", "k", "temperature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


def scope_progress(spark, d):
    """Of all customers by scope (their nation), how many every arm has finished and how many are left."""
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_nationkey").alias("scope"))
    done = table(spark, d, "events").groupBy(F.col("user_id").alias("qid")).agg(F.count_distinct("event_type").alias("arms"))
    both = wanted.join(done, "qid", "left")
    return both.groupBy("scope").agg(F.count(F.when(F.col("arms") == 5, 1)).alias("completed"), F.count(F.when(F.coalesce("arms", F.lit(0)) < 5, 1)).alias("remaining"))


def turn_overlap(spark, d):
    """Shared tokens of each turn with the one before, and whether it is contained, by conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, d, "conversations").select("conv_id", "turn", X.code_tokens(F.col("text")).alias("a")).withColumn("b", F.lag("a").over(w)).where("b is not null")
    shared = F.size(F.array_intersect("a", "b"))
    return own.groupBy("conv_id").agg(F.sum(shared).alias("shared"), F.count(F.when(shared == F.size("a"), 1)).alias("contained"))


def collapsed_texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.collapsed_key(F.col("text"))).alias("digest"))


def rater_agreement(spark, d):
    own = table(spark, d, "labels").where("quality is not null and toxic is not null")
    share = F.avg((F.col("quality") == F.col("toxic")).cast("int"))
    return own.agg(F.round(share, 6).alias("agreement"), (share >= 0.95).alias("reliable"))


def day_records(spark, d):
    """By arm the pairs that were run, and the first and last day."""
    own = table(spark, d, "events").select(F.col("event_type").alias("arm"), "user_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("day"))
    return own.groupBy("arm").agg(F.count_distinct("user_id").alias("pairs"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def source_shares(spark, d):
    """Sources of documents with their share, and whether it is over a twentieth."""
    own = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") > 0.05 * F.col("total")).alias("large"))


def median_loss(spark, d) -> DataFrame:
    """Deltas that are dearer, cheaper and equal, with the median of their sizes."""
    from plumbline.plans.depths import deltas

    own, _ = deltas(spark, d)
    v = F.col("value")
    return own.agg(F.count(F.when(v > 0, 1)).alias("dearer"), F.count(F.when(v < 0, 1)).alias("cheaper"), F.count(F.when(v == 0, 1)).alias("equal"), F.round(F.percentile(F.abs(v), 0.5), 6).alias("mad"))


QUERIES = {f.__name__: f for f in (conversion_rules, label_cells, rank_agreement, rendered_results, arm_ranks, normal_classes, slopes_without, conversation_sessions, stuffed_prefix, block_lengths, merged_points, replicate_disagreement, picked_turns, size_curve, depth_table, cell_means, scope_progress, turn_overlap, collapsed_texts, rater_agreement, day_records, source_shares, median_loss)}

_LISTS = f"{search._RAW}, {search._BOUNDS}, {search._SQ8}, t AS ({search._top('e', 'e')}), p AS ({search._top('e', 'z')})"

SQL = {
    "picked_turns": """WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), d AS (SELECT conv_id, i, round(i / n, 6) AS d FROM p),
a AS (SELECT conv_id, arg_min(i, (abs(d - 0.1::DOUBLE), i)) AS x FROM d GROUP BY conv_id), b AS (SELECT conv_id, any_value(x) AS x, arg_min(i, (abs(d - 0.5::DOUBLE), i)) FILTER (i != x) AS y FROM d JOIN a USING (conv_id) GROUP BY conv_id),
c AS (SELECT conv_id, any_value(x) AS x, any_value(y) AS y, arg_min(i, (abs(d - 0.9::DOUBLE), i)) FILTER (i != x AND i != y) AS z FROM d JOIN b USING (conv_id) GROUP BY conv_id)
SELECT conv_id, concat_ws(',', x, coalesce(y, -1), coalesce(z, -1)) AS places FROM c""",
    "conversion_rules": f"WITH {_CUBE}, x AS (SELECT arm, judge, len(ids) < 2 AS quiet, unnest(['presence', 'em']) AS rule, unnest([presence, em]) AS holds FROM c WHERE k = 10) SELECT arm, rule, round(avg(judge::INT) FILTER (holds), 6) AS conversion, round(avg((quiet AND NOT judge)::INT) FILTER (holds), 6) AS decline_rate, round(avg((NOT judge AND NOT quiet)::INT) FILTER (holds), 6) AS error_rate FROM x GROUP BY arm, rule",
    "label_cells": "WITH v AS (SELECT x.v AS quality, y.v AS toxic FROM (SELECT unnest([0, 1]) AS v) x, (SELECT unnest([0, 1]) AS v) y), f AS (SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1) GROUP BY ALL) SELECT quality, toxic, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM f), 6)::DOUBLE AS share FROM v LEFT JOIN f USING (quality, toxic)",
    "rank_agreement": f"WITH {_LISTS}, j AS (SELECT t.qid, t.id AS a, p.id AS b, t.score AS s, p.score AS r FROM t JOIN p USING (qid, rank)) SELECT qid, list_sort(list(a)) = list_sort(list(b)) AS same_set, count(*) FILTER (a != b) = 0 AS same_order, count(*) FILTER (a != b AND abs(s - r) < 1e-6) AS near_ties, count(*) FILTER (a != b AND abs(s - r) >= 1e-6) AS mismatches FROM j GROUP BY qid",
    "rendered_results": f"WITH {search._RAW}, t AS ({search._top('e', 'e', 3)}) SELECT qid, string_agg('[' || rank || '] label ' || label, chr(10) ORDER BY rank) AS answer FROM t JOIN e ON e.id = t.id GROUP BY qid UNION ALL SELECT -7, 'No results found.'",
    "arm_ranks": "WITH o AS (SELECT user_id % 30 AS u, round(avg(value), 1) AS m, count(*) AS n FROM events GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS x, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS y FROM o) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r",
    "normal_classes": f"WITH {_FULL}, x AS (SELECT arm, qid, (value > 50)::INT::DOUBLE AS q FROM f), l AS (SELECT y.arm, b.q - y.q AS loss FROM x y JOIN x b USING (qid) WHERE b.arm = (SELECT min(arm) FROM a) AND y.arm != b.arm), i AS (SELECT arm, round(avg(loss) - 1.959963984540054 * stddev_samp(loss) / sqrt(count(loss)), 6) AS low, round(avg(loss) + 1.959963984540054 * stddev_samp(loss) / sqrt(count(loss)), 6) AS high FROM l GROUP BY arm) SELECT *, CASE WHEN low > 0 THEN 'DROP' WHEN high < 0.05 THEN 'PLATEAU' ELSE 'INCONCLUSIVE' END AS class FROM i",
    "slopes_without": f"WITH {_SWEEP}, m AS (SELECT arm, round(avg(recall), 6) AS recall, round(avg(qps), 6) AS qps FROM s GROUP BY arm) SELECT d.arm AS dropped, round(regr_slope(m.recall, m.qps), 6) AS slope, count(*) AS n FROM m JOIN m d ON m.arm != d.arm GROUP BY d.arm",
    "conversation_sessions": "WITH s AS (SELECT conv_id, length(text) AS n, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS session FROM conversations) SELECT conv_id, session, count(*) AS turns, sum(n)::BIGINT AS chars FROM s GROUP BY ALL",
    "stuffed_prefix": "SELECT conv_id, md5(string_agg('===== t' || turn || ' =====' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "block_lengths": "SELECT conv_id, turn, role AS type, md5(substr(text, 1, 50)) AS digest, length(text)::INT AS length FROM conversations",
    "merged_points": f"WITH {_SWEEP}, g AS (SELECT arm, target, arg_min(sweep_value, (abs(recall - target), sweep_value)) AS sweep_value FROM s, (SELECT unnest([0.5, 0.505, 0.52])::DOUBLE AS target) GROUP BY arm, target) SELECT arm, sweep_value, string_agg(target::VARCHAR, '+' ORDER BY target) AS names FROM g GROUP BY arm, sweep_value",
    "replicate_disagreement": "WITH p AS (SELECT user_id AS qid, event_type AS arm, value > 50 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) SELECT qid, arm, min(ok) != max(ok) AS disagree FROM p WHERE i <= 2 GROUP BY qid, arm HAVING count(*) = 2",
    "size_curve": "WITH o AS (SELECT l_returnflag AS arm, l_linenumber AS size, l_quantity::DOUBLE AS tokens, l_discount::DOUBLE AS cost FROM lineitem) SELECT arm, size, round(quantile_cont(tokens, 0.5), 4) AS median_tokens, round(avg(cost), 6) AS mean_cost, count(*) AS n, any_value(t) AS corpus_tokens FROM o JOIN (SELECT size, sum(tokens) AS t FROM o GROUP BY size) USING (size) GROUP BY arm, size",
    "depth_table": "WITH o AS (SELECT role, length(text) AS len, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) SELECT role, round(floor(p * 10 / n) / 10, 1)::DOUBLE AS depth, round(avg(len), 4) AS mean, count(*) AS n, bool_and(len > 20) AS all_long FROM o GROUP BY 1, 2",
    "cell_means": "SELECT event_type AS arm, [1, 3, 5, 10][event_id % 4 + 1] AS k, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS temperature, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3",
    "scope_progress": "WITH d AS (SELECT user_id AS qid, count(DISTINCT event_type) AS arms FROM events GROUP BY 1) SELECT c_nationkey AS scope, count(*) FILTER (arms = 5) AS completed, count(*) FILTER (coalesce(arms, 0) < 5) AS remaining FROM customer LEFT JOIN d ON qid = c_custkey GROUP BY 1",
    "turn_overlap": "WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda w: length(w) > 2)) AS a FROM conversations), b AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM k), c AS (SELECT conv_id, len(list_intersect(a, b)) AS s, len(a) AS n FROM b WHERE b IS NOT NULL) SELECT conv_id, sum(s)::BIGINT AS shared, count(*) FILTER (s = n) AS contained FROM c GROUP BY conv_id",
    "collapsed_texts": r"SELECT conv_id, turn, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM conversations",
    "rater_agreement": "SELECT round(avg((quality = toxic)::INT), 6) AS agreement, avg((quality = toxic)::INT) >= 0.95 AS reliable FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "day_records": "SELECT event_type AS arm, count(DISTINCT user_id) AS pairs, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1",
    "source_shares": "WITH o AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM o) SELECT source, n, round(n / total, 6)::DOUBLE AS share, n > 0.05 * total AS large FROM o, t",
    "median_loss": f"WITH {_DELTAS} SELECT count(*) FILTER (value > 0) AS dearer, count(*) FILTER (value < 0) AS cheaper, count(*) FILTER (value = 0) AS equal, round(quantile_cont(abs(value), 0.5), 6) AS mad FROM dl",
}
