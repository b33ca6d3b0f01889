"""Queries of checks, selections and decisions: parts and orders as questions, suppliers as files, events as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import decisions as D
from plumbline.functions import gates as G
from plumbline.functions import text as X
from plumbline.functions import threads as H
from plumbline.operators import selection as S
from plumbline.operators import validation as V
from plumbline.sources import tables as T
from plumbline.sources.tables import table

SEED = 7


def paths(spark, d) -> DataFrame:
    """Suppliers as paths of a tree with tests, sources, documentation and some files at the root."""
    i = F.col("s_suppkey")
    text = i.cast("string")
    path = F.when(i % 11 == 0, F.concat(F.lit("."), text, F.lit("ignore"))).when(i % 4 == 0, F.concat(F.lit("tests/t"), text, F.lit(".py"))).when(i % 4 == 1, F.concat(F.lit("src/core/"), text, F.lit(".py"))).when(i % 4 == 2, F.concat(F.lit("src/"), text, F.lit(".md"))).otherwise(F.concat(F.lit("docs/"), text, F.lit(".rst")))
    return table(spark, d, "supplier").select(path.alias("path"))


def questions(spark, d) -> DataFrame:
    """Parts as questions with files, symbols, a difficulty and whether they belong to the smallest scope; some are wrong."""
    i = F.col("p_partkey")
    file = lambda j: F.concat(F.lit("src/core/"), j.cast("string"), F.lit(".py"))
    files = F.when(i % 13 == 0, "").when(i % 5 == 0, F.concat(file(i * 4 % 40 + 1), F.lit("; docs/"), (i % 50).cast("string"), F.lit(".rst"))).otherwise(file(i * 4 % 60 + 1))
    qid = F.when(i % 17 == 0, "q0").when(i % 101 == 0, " ").otherwise(F.concat(F.lit("q"), i.cast("string")))
    return table(spark, d, "part").select(qid.alias("qid"), files.alias("expected_files"), F.when(i % 9 > 0, "sym").alias("expected_symbols"), F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard", "odd"))), (i % 4 + 1).cast("int")).alias("difficulty"), F.when(i % 2 == 0, "True").otherwise("no").alias("scaling_subset"))


def question_problems(spark, d):
    return V.question_problems(questions(spark, d), paths(spark, d), ["easy", "medium", "hard"], "src/", total=5, mix={"easy": 3})


def eligible_questions(spark, d):
    return V.eligible(questions(spark, d), ("src/",), ("src/core/1",))


SCOPES = [("S", ("src/core/",), ()), ("M", (), ("tests/",)), ("L", (), ())]


def scope_nesting(spark, d):
    return V.nesting(paths(spark, d), SCOPES)


def ignore_files(spark, d):
    return V.ignore_files(paths(spark, d))


def tree_differences(spark, d):
    """Paths of the tree against those that questions name."""
    named = questions(spark, d).select(F.explode(X.split_field(F.col("expected_files"))).alias("path"))
    return V.differing(paths(spark, d), named, "path")


def errored_runs(spark, d):
    own = table(spark, d, "events").select(F.col("event_id").alias("qid"), F.col("event_type").alias("arm"), F.when(F.col("value") > 60, F.concat(F.lit("code "), (F.col("event_id") % 7).cast("string"))).when(F.col("value") > 40, " ").alias("error"))
    return V.errored(own)


def stale_threads(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("fetch_basis"))
    return V.stale(own, ["F", "O"]).groupBy("fetch_basis").agg(F.count("*").alias("n"))


def index_completeness(spark, d):
    docs = table(spark, d, "documents")
    made = docs.select(F.explode(X.chunks(F.coalesce("text", F.lit("")), 1800, 200)).alias("body"))
    return V.index_complete(docs.agg(F.sum(F.size(X.chunks(F.coalesce("text", F.lit("")), 1800, 200))).alias("n")), made, docs.agg(F.sum(X.chunk_count(F.coalesce("text", F.lit("")), 1800, 200)).alias("n")))


def bound_calls(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("qid"), F.floor(F.col("value") / 10).cast("bigint").alias("n_results"), F.col("event_type").alias("type"))
    wanted = table(spark, d, "events").select(F.col("user_id").alias("qid")).distinct()
    return V.calls_bind(calls.where("type = 'purchase'").drop("type"), wanted, 9)


def used_shards(spark, d):
    own = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    own = own.withColumn("shard", F.row_number().over(Window.orderBy("p")) - 1).select(V.shard_of(F.col("shard"), 41).alias("shard"), "n")  # a few shards
    return V.shards_for(own, 1000)


def manifest_upsert(spark, d):
    """Nations as files of a manifest; those of region 1 are recorded again."""
    own = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), F.col("n_regionkey").cast("bigint").alias("bytes"))
    again = own.where("bytes = 1").withColumn("bytes", F.lit(99).cast("bigint")).union(spark.createDataFrame([("NEW", "0", 1)], own.schema))
    return V.upserted(own, again, "path")


def manifest_status(spark, d):
    """Pages as files on disk against a manifest in which some are missing and some changed."""
    found = table(spark, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    want = table(spark, d, "pages").select(F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("#gone"))).otherwise(F.col("url")).alias("path"), F.when(F.col("page_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("html", 256)).alias("sha256"))
    return T.verify(found, want).distinct().groupBy("status").agg(F.count("*").alias("n"))


def ledger_stamps(spark, d):
    own = table(spark, d, "nation").select(F.col("n_name").alias("run_label"), F.col("n_nationkey").cast("double").alias("spend_usd"), F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, "abc").alias("committed_in"))
    commits = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_name").alias("run_label"), F.md5("n_name").alias("commit"))
    return V.stamped(own, commits)


def ledger_sums(spark, d):
    """Orders as a ledger against the events' checkpoints."""
    ledger = table(spark, d, "orders").select((F.col("o_orderkey") % 10).cast("double").alias("spend_usd"))
    swept = table(spark, d, "events").select((F.col("event_id") % 10).cast("double").alias("spent"))
    return T.reconcile(ledger, swept)


def checkpoint(spark, d) -> DataFrame:
    """Events as lines of a checkpoint, in order of their ids."""
    return table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("arm"), F.round("value", 4).alias("cost_total_billed"), F.lit("a").alias("_file"), F.col("event_id").alias("_at"))


def checkpoint_latest(spark, d):
    return T.latest(checkpoint(spark, d)).drop("_file")


def checkpoint_first(spark, d):
    return T.latest(checkpoint(spark, d), first=True).drop("_file")


def checkpoint_spent(spark, d):
    own = checkpoint(spark, d)
    a, b = T.spent(own), T.spent(own, every_line=True)
    return a.select(F.round("spent", 3).alias("latest")).crossJoin(b.select(F.round("spent", 3).alias("all_lines")))


def checkpoint_missing(spark, d):
    """Customers, and whoever else has an event, as wanted questions of two arms: those without any event are missing, too."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("qid")).union(table(spark, d, "events").select("user_id"))
    wanted = users.distinct().select("qid", F.explode(F.array(F.lit("click"), F.lit("absent"))).alias("arm"))
    return T.missing(checkpoint(spark, d), wanted)


def selected_questions(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return S.main_and_sanity(own, "c_custkey", F.col("c_acctbal") > 0, 40, 10, SEED)


def disjoint_questions(spark, d):
    """Customers by segment, two each, no two of a segment with a common nation or region."""
    own = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.array(F.col("c_nationkey") % 7).alias("evidence"))
    return S.disjoint_quota(own, "c_mktsegment", "c_custkey", "evidence", {"AUTOMOBILE": 3, "BUILDING": 2}, SEED)


def run_order(spark, d):
    return S.interleaved(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", ["agentic", "indexed", "stuffed"], SEED)


def crossed_names(spark, d):
    return S.cross(table(spark, d, "region"), table(spark, d, "nation"), "r_name", "n_name", "-", SEED)


def seeded_uuids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.seeded_uuid(SEED, F.col("n_nationkey")).alias("uuid"))


def working_days(spark, d):
    """The first weekdays after each order's day, as many as its priority says."""
    own = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("n"))
    return own.select("o_orderkey", F.array_join(F.transform(S.weekdays(F.col("day"), F.col("n")), lambda x: x.cast("string")), ",").alias("days"))


def training_questions(spark, d):
    train = table(spark, d, "part").select("p_partkey", "p_name")
    held = table(spark, d, "part").where("p_partkey < 20").select("p_name")
    return S.train_without(train, held, X.collapsed_key(F.col("p_name")), 15, SEED).select(X.collapsed_key(F.col("p_name")).alias("name"))


def bridge_pairs(spark, d):
    """Lines as passages of orders, with other orders' parts as bridges; no title more than twice."""
    own = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("place"), "l_linenumber", "l_partkey")
    own = own.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ps")).where("size(ps) >= 2 and place < 400")
    bridges = F.transform(F.slice("ps", 2, 5), lambda p: F.struct((p["l_partkey"] % 40).cast("string").alias("bridge"), p["l_partkey"].alias("row_b")))
    rows = own.select("place", F.col("place").alias("row_a"), (F.col("ps")[0]["l_partkey"] % 40).cast("string").alias("page"), bridges.alias("bridges"))
    return S.title_shares(S.capped_pairs(rows, 60, 5))


def label_decisions(spark, d):
    """Customers' segments as labels of two raters, adjudicated."""
    i = F.col("c_custkey")
    label = lambda c: F.element_at(F.array(*map(F.lit, D.LABELS)), (c % 5 + 1).cast("int"))
    own = table(spark, d, "customer").select(label(i).alias("a"), label(F.floor(i / 3)).alias("b"))
    return own.select(D.binary_label(F.col("a")).alias("of_a"), D.adjudicate(F.col("a"), F.col("b")).alias("x")).groupBy("of_a", "x.binary", "x.class").agg(F.count("*").alias("n"))


def branch_table(spark, d):
    """Every branch rule on a grid of intervals and medians that suppliers stand for."""
    i = F.col("s_suppkey").cast("double")
    low, median = F.sin(i) * 0.2, F.sin(i) * 0.2 + 0.05 * F.abs(F.cos(i))
    high = low + 0.15
    own = table(spark, d, "supplier").select("s_suppkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(median, 6).alias("median"), (F.col("s_suppkey") % 10 / 10).alias("accuracy"))
    lo, hi, acc = F.col("low"), F.col("high"), F.col("accuracy")
    rules = {
        "class": D.classify_delta(lo, hi),
        "branch": D.resolve_branch(D.excludes_zero(lo, hi), F.col("median"), "dearer", "cheaper", "none"),
        "parametric": D.parametric_reading(acc),
        "verdict": D.gate_verdict(acc),
        "hop": D.hop_branch(lo, hi, acc > 0.7),
        "gate": D.gate_branch(acc, lo > 0),
        "knee": D.knee_width_branch(lo, hi, F.lit(-0.19), F.lit(0.33), lo - 0.1, hi),
        "flat": G.flatness(lo, hi, F.col("median")),
        "share": D.share_branch(acc),
        "r12": G.class_changed(D.parametric_reading(acc), D.gate_verdict(acc)),
    }
    return own.select("s_suppkey", *[c.alias(n) for n, c in rules.items()])


def gate_table(spark, d):
    """Gates over counts by nation."""
    own = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("k"), F.array_sort(F.collect_list(F.round(F.col("c_acctbal") / 10000, 4))).alias("r"), F.round(F.sum("c_acctbal"), 2).alias("spent"))
    n, k = F.col("n"), F.col("k")
    rules = {"declines": D.decline_gate(n - k, k), "concordant": G.concordance_gate(n, k), "upheld": G.uphold_gate(n, k), "budget": G.within_budget(F.col("spent"), 250000.0), "reproduced": G.reproduced(n, k, 50), "spotcheck": G.disagreement_gate(n, n - k, 60, 10), "flips": G.flip_share_branch(n - k, n), "gap": F.round(G.ladder_gap(F.col("r")), 4)}
    return own.select("c_nationkey", *[c.alias(name) for name, c in rules.items()])


def thread_documents(spark, d):
    """Conversations as issue threads: documents without the comments of bots."""
    user = F.struct(F.col("role").alias("login"), F.when(F.col("role") == "assistant", "Bot").otherwise("User").alias("type"))
    comment = F.struct("turn", user.alias("user"), F.col("text").alias("body"))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(comment)).alias("c"), F.min_by("text", "turn").alias("body"))
    own = own.withColumn("kept", H.without_bots(F.col("c")))
    t = F.struct(F.concat(F.lit("Thread "), F.col("conv_id").cast("string")).alias("title"), F.col("body").alias("body"), F.col("kept.kept").alias("comments"))
    return own.select(H.file_name(F.lit("a/b"), F.col("conv_id")).alias("file"), F.md5(H.document(t)).alias("digest"), F.col("kept.dropped").alias("dropped"))


def thread_questions(spark, d):
    """Questions from titles that name other threads, and whether enough is left of them."""
    title = F.concat(F.col("p_name"), F.lit(" fails since #"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " when the engine starts twice").otherwise(""))
    own = table(spark, d, "part").select("p_partkey", title.alias("title"))
    return own.select("p_partkey", X.thread_question(F.lit("a/b"), F.col("title")).alias("question"), X.degenerate_head(F.col("title")).alias("degenerate"))


def path_scopes(spark, d):
    p = F.col("path")
    own = paths(spark, d).select(p, H.in_subset(p, ("src/",), ("src/core/1",)).alias("inside"), H.tier(p, ("src/core/", "src/", "docs/")).alias("tier"), H.visible(p, ("py", "md")).alias("visible"))
    return own.groupBy("inside", "tier", "visible").agg(F.count("*").alias("n"))


def prompt_texts(spark, d):
    """Conversations as retrieved passages of a prompt."""
    p = F.struct("turn", F.col("role").alias("title"), "text")
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return own.select("conv_id", F.md5(X.user_message(X.render_context(F.filter("p", lambda x: x["title"] == "user")), F.lit("why?"))).alias("digest"))


def retrieved_hops(spark, d):
    """Orders as questions, their lines' parts as retrieved rows, two parts as gold."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    ids = F.transform("x", lambda r: r["l_partkey"])
    own = own.select("l_orderkey", X.padded(ids, 6).alias("ids"))
    gold = F.array(F.element_at("ids", 2), F.element_at("ids", 5), F.lit(-1).cast("bigint"))
    return own.select("l_orderkey", X.hops_retrieved(gold, F.col("ids"), 3).alias("hops"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def gold_verdicts(spark, d):
    """Problems of verdicts on golds, by verdict."""
    i = F.col("p_partkey")
    old = F.array(F.lit("alpha"), F.lit("beta"))
    new = F.when(i % 5 == 0, F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))).when(i % 5 == 1, F.array(F.lit("x"))).when(i % 5 == 2, old).when(i % 5 == 3, F.array(F.lit("delta")))
    verdict = F.element_at(F.array(*map(F.lit, (*X.VERDICTS, "other"))), (F.floor(i / 5) % 5 + 1).cast("int"))
    own = table(spark, d, "part").select(verdict.alias("verdict"), new.alias("new"))
    return own.select("verdict", X.verdict_problem(F.col("verdict"), old, F.col("new"), F.col("new")).alias("problem")).groupBy("verdict", "problem").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (question_problems, eligible_questions, scope_nesting, ignore_files, tree_differences, errored_runs, stale_threads, index_completeness, bound_calls, used_shards, manifest_upsert, manifest_status, ledger_stamps, ledger_sums, checkpoint_latest, checkpoint_first, checkpoint_spent, checkpoint_missing, selected_questions, disjoint_questions, run_order, crossed_names, seeded_uuids, working_days, training_questions, bridge_pairs, label_decisions, branch_table, gate_table, thread_documents, thread_questions, path_scopes, prompt_texts, retrieved_hops, gold_verdicts)}

_PATHS = "f AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN '.' || s_suppkey || 'ignore' WHEN s_suppkey % 4 = 0 THEN 'tests/t' || s_suppkey || '.py' WHEN s_suppkey % 4 = 1 THEN 'src/core/' || s_suppkey || '.py' WHEN s_suppkey % 4 = 2 THEN 'src/' || s_suppkey || '.md' ELSE 'docs/' || s_suppkey || '.rst' END AS path FROM supplier)"
_QUESTIONS = """q AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 17 = 0 THEN 'q0' WHEN p_partkey % 101 = 0 THEN ' ' ELSE 'q' || p_partkey END AS qid,
CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'src/core/' || (p_partkey * 4 % 40 + 1) || '.py; docs/' || (p_partkey % 50) || '.rst' ELSE 'src/core/' || (p_partkey * 4 % 60 + 1) || '.py' END AS files,
['easy', 'medium', 'hard', 'odd'][p_partkey % 4 + 1] AS difficulty FROM part), n AS (SELECT i, qid, trim(unnest(string_split(files, ';'))) AS path FROM q WHERE files != '')"""
_INSIDE = "starts_with(path, 'src/') AND NOT starts_with(path, 'src/core/1')"
_CHECK = "c AS (SELECT user_id AS qid, event_type AS arm, round(value, 4) AS cost_total_billed, event_id AS _at FROM events)"
_LATEST = "l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid, arm ORDER BY _at {0}) = 1)"
_BRANCH = "b AS (SELECT s_suppkey, round(sin(s_suppkey) * 0.2, 6) AS low, round(sin(s_suppkey) * 0.2 + 0.15, 6) AS high, round(sin(s_suppkey) * 0.2 + 0.05 * abs(cos(s_suppkey)), 6) AS median, (s_suppkey % 10 / 10)::DOUBLE AS acc FROM supplier)"
_HOLDS = "CASE WHEN acc <= 0.1 THEN 'holds' WHEN acc <= 0.3 THEN 'partial_leak' ELSE 'does_not_ground' END"
_GATE = "CASE WHEN acc <= 0.05 THEN 'pass' WHEN acc <= 0.10 THEN 'investigate' ELSE 'fail' END"
_SHUFFLE = "md5('7:' || {0})"
_CHUNKS = "CASE WHEN length(coalesce(text, '')) <= 1800 THEN 1 ELSE ceil((length(text) - 200) / 1600.0)::BIGINT END"

SQL = {
    "question_problems": f"""WITH {_PATHS}, {_QUESTIONS}
SELECT qid, 'qid is missing' AS problem FROM q WHERE trim(qid) = '' UNION ALL SELECT qid, 'no expected files' FROM q WHERE files = '' UNION ALL SELECT qid, 'unknown difficulty' FROM q WHERE difficulty = 'odd'
UNION ALL SELECT qid, 'scaling question outside src/' FROM q WHERE i % 2 = 0 AND i IN (SELECT i FROM n WHERE NOT starts_with(path, 'src/')) UNION ALL SELECT qid, 'no expected symbols' FROM q WHERE i % 9 = 0
UNION ALL SELECT qid, 'duplicate qid' FROM q WHERE trim(qid) != '' GROUP BY qid HAVING count(*) > 1 UNION ALL SELECT DISTINCT qid, 'unknown file ' || path FROM n WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT NULL, 'expected 5 questions, got ' || count(*) FROM q HAVING count(*) != 5 UNION ALL SELECT NULL, 'expected 3 questions of difficulty easy, got ' || count(*) FROM q WHERE difficulty = 'easy' HAVING count(*) != 3""",
    "eligible_questions": f"WITH {_QUESTIONS}, m AS (SELECT i, qid, unnest(list_filter(string_split(files, ';'), lambda x: x != '')) AS path FROM q) SELECT any_value(qid) AS qid FROM m GROUP BY i HAVING bool_and({_INSIDE})",
    "scope_nesting": f"""WITH {_PATHS}, t AS (SELECT count(*) FILTER (starts_with(path, 'src/core/')) AS s, count(*) FILTER (NOT starts_with(path, 'tests/')) AS m, count(*) AS l, count(*) FILTER (starts_with(path, 'src/core/') AND starts_with(path, 'tests/')) AS out FROM (SELECT DISTINCT path FROM f))
SELECT 'S' AS scope, s AS n, s > 0 AND out = 0 AND s < m AS strictly_inside FROM t UNION ALL SELECT 'M', m, m > 0 AND m < l FROM t UNION ALL SELECT 'L', l, NULL FROM t""",
    "ignore_files": f"WITH {_PATHS} SELECT path FROM f WHERE regexp_matches(path, '^\\.[^/]*ignore$') AND path != '.gitignore'",
    "tree_differences": f"WITH {_PATHS}, {_QUESTIONS} SELECT path, 'left' AS side FROM (SELECT path FROM f EXCEPT SELECT path FROM n) UNION ALL SELECT path, 'right' FROM (SELECT path FROM n EXCEPT SELECT path FROM f)",
    "errored_runs": "SELECT event_id AS qid, event_type AS arm, 'code ' || (event_id % 7) AS error FROM events WHERE value > 60",
    "stale_threads": "WITH t AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS fetch_basis FROM orders) SELECT fetch_basis, count(*) AS n FROM t WHERE coalesce(fetch_basis NOT IN ('F', 'O'), true) GROUP BY 1",
    "index_completeness": f"WITH t AS (SELECT sum({_CHUNKS})::BIGINT AS n FROM documents) SELECT n AS reported, n AS counted, n AS predicted, n > 0 AS complete FROM t",
    "bound_calls": "WITH c AS (SELECT user_id AS qid, floor(value / 10)::BIGINT AS n FROM events WHERE event_type = 'purchase') SELECT qid, 'too many results' AS problem FROM c GROUP BY qid HAVING max(n) > 9 UNION ALL SELECT qid, 'no call' FROM (SELECT DISTINCT user_id AS qid FROM events) WHERE qid NOT IN (SELECT qid FROM c)",
    "used_shards": "WITH p AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT printf('train-%05d-of-00041.parquet', row_number() OVER (ORDER BY p) - 1) AS shard, n FROM p), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT shard, n, least(n, 1000 - before)::BIGINT AS taken FROM b WHERE before < 1000",
    "manifest_upsert": "SELECT n_name AS path, sha256(n_name) AS sha256, CASE WHEN n_regionkey = 1 THEN 99 ELSE n_regionkey END::BIGINT AS bytes FROM nation UNION ALL SELECT 'NEW', '0', 1",
    "manifest_status": "WITH w AS (SELECT DISTINCT CASE WHEN page_id % 10 = 0 THEN url || '#gone' ELSE url END AS path, page_id % 7 = 0 AND page_id % 10 != 0 AS bad, page_id % 10 = 0 AS gone FROM pages) SELECT CASE WHEN gone THEN 'MISSING' WHEN bad THEN 'HASH MISMATCH' ELSE 'verified' END AS status, count(*) AS n FROM w GROUP BY 1",
    "ledger_stamps": "SELECT n_name AS run_label, n_nationkey::DOUBLE AS spend_usd, CASE WHEN n_nationkey % 3 = 1 THEN 'abc' WHEN n_nationkey < 15 THEN md5(n_name) WHEN n_nationkey % 3 = 0 THEN '' END AS committed_in FROM nation",
    "ledger_sums": "WITH t AS (SELECT (SELECT sum(o_orderkey % 10)::DOUBLE FROM orders) AS ledger, (SELECT sum(event_id % 10)::DOUBLE FROM events) AS checkpoints) SELECT ledger, checkpoints, ledger - checkpoints AS delta, abs(ledger - checkpoints) <= 0.01 AS agrees FROM t",
    "checkpoint_latest": f"WITH {_CHECK}, {_LATEST.format('DESC')} SELECT * FROM l",
    "checkpoint_first": f"WITH {_CHECK}, {_LATEST.format('')} SELECT * FROM l",
    "checkpoint_spent": f"WITH {_CHECK}, {_LATEST.format('DESC')} SELECT (SELECT round(sum(cost_total_billed), 3) FROM l) AS latest, (SELECT round(sum(cost_total_billed), 3) FROM c) AS all_lines",
    "checkpoint_missing": "SELECT qid, arm FROM (SELECT * FROM (SELECT c_custkey AS qid FROM customer UNION SELECT user_id FROM events), (SELECT unnest(['click', 'absent']) AS arm)) ANTI JOIN (SELECT user_id AS qid, event_type AS arm FROM events) USING (qid, arm)",
    "selected_questions": f"""WITH m AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY md5('7:main:' || c_custkey), c_custkey LIMIT 40), s AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM m) ORDER BY md5('7:sanity:' || c_custkey), c_custkey LIMIT 10)
SELECT c_custkey, 'main' AS part FROM m UNION ALL SELECT c_custkey, 'sanity' FROM s""",
    "disjoint_questions": """WITH RECURSIVE p AS (SELECT c_mktsegment, c_custkey, c_nationkey % 7 AS e, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS i, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 ELSE 2 END AS quota FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')),
g AS (SELECT c_mktsegment, 0::BIGINT AS i, []::BIGINT[] AS taken, []::INT[] AS seen, any_value(quota) AS quota FROM p GROUP BY c_mktsegment UNION ALL
SELECT g.c_mktsegment, p.i, CASE WHEN NOT list_contains(seen, e) THEN list_append(taken, p.c_custkey) ELSE taken END, CASE WHEN NOT list_contains(seen, e) THEN list_append(seen, e) ELSE seen END, g.quota FROM g JOIN p ON p.c_mktsegment = g.c_mktsegment AND p.i = g.i + 1 WHERE len(taken) < g.quota)
SELECT c_mktsegment, unnest(arg_max(taken, i)) AS c_custkey FROM g GROUP BY c_mktsegment""",
    "run_order": "WITH a AS (SELECT * FROM (VALUES ('agentic', 0), ('indexed', 1), ('stuffed', 2)) t(arm, p)), o AS (SELECT arm, p, n_nationkey, row_number() OVER (PARTITION BY arm ORDER BY md5('7:' || arm || ':' || p || ':' || n_nationkey), n_nationkey) - 1 AS round FROM nation, a) SELECT round * 3 + p AS position, round, arm, n_nationkey FROM o",
    "crossed_names": "SELECT r_name || '-' || n_name AS name, md5('7:' || r_name || '-' || n_name) AS \"order\" FROM region, nation",
    "seeded_uuids": "WITH h AS (SELECT n_nationkey, md5('7:' || n_nationkey) AS h FROM nation) SELECT n_nationkey, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || substr('89ab', ('0x' || h[17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h",
    "working_days": "WITH x AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS n, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + 14, INTERVAL 1 DAY)) AS day FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY day) AS i FROM x WHERE isodow(day) < 6) SELECT o_orderkey, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day) AS days FROM w WHERE i <= n GROUP BY o_orderkey",
    "training_questions": "SELECT name FROM (SELECT DISTINCT lower(p_name) AS name FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey < 20)) ORDER BY md5('7:' || name), name LIMIT 15",
    "label_decisions": """WITH l AS (SELECT c_custkey % 5 AS a, floor(c_custkey / 3)::BIGINT % 5 AS b, ['eligible', 'ambiguous', 'wrong_gold', 'stale_gold', 'unanswerable'] AS names FROM customer)
SELECT CASE a WHEN 0 THEN 'eligible' ELSE 'ineligible' END AS of_a, CASE WHEN a > 0 AND b > 0 THEN 'ineligible' ELSE 'eligible' END AS "binary", CASE WHEN a = 0 OR b = 0 THEN 'eligible' WHEN a = b THEN names[a + 1] ELSE 'ineligible_class_disputed' END AS class, count(*) AS n FROM l GROUP BY ALL""",
    "branch_table": f"""WITH {_BRANCH} SELECT s_suppkey, CASE WHEN low > 0 THEN 'DROP' WHEN high < 0.05 THEN 'PLATEAU' ELSE 'INCONCLUSIVE' END AS class, CASE WHEN NOT (low > 0 OR high < 0) THEN 'none' WHEN median > 0 THEN 'dearer' ELSE 'cheaper' END AS branch, {_HOLDS} AS parametric, {_GATE} AS verdict,
CASE WHEN acc > 0.7 THEN 'H4-confounded' WHEN NOT (low > 0 OR high < 0) THEN 'H2' WHEN high < 0 THEN 'H1' ELSE 'H3' END AS hop, CASE WHEN acc <= 0 AND NOT low > 0 THEN 'G1' ELSE 'G2' END AS gate, CASE WHEN low - 0.1 <= 0 AND high >= 0 THEN 'N3' WHEN high - low <= 0.05 AND NOT (low <= -0.185 OR high >= 0.325) THEN 'N1' ELSE 'N2' END AS knee,
(low > 0 OR high < 0) AND abs(median) >= 0.1 AS flat, CASE WHEN acc >= 0.4 THEN 'P1' WHEN acc >= 0.15 THEN 'P2' ELSE 'P3' END AS share, CASE WHEN {_HOLDS} = {_GATE} THEN 'R2' ELSE 'R1' END AS r12 FROM b""",
    "gate_table": """WITH c AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS k, list_sort(list(round(c_acctbal / 10000, 4))) AS r, round(sum(c_acctbal), 2) AS spent FROM customer GROUP BY 1), b AS (SELECT *, list_filter(r, lambda x: x BETWEEN 0.8 AND 0.97) AS o FROM c)
SELECT c_nationkey, (n - k) / n >= 0.8 AS declines, k / n >= 0.6 AS concordant, n < 10 OR k / n <= 0.9 AS upheld, spent <= 250000 AS budget, k >= 50 AND k <= n AS reproduced, n = 60 AND n - k <= 10 AS spotcheck, (n - k) / n >= 0.05 AS flips, round(coalesce(list_max(list_transform(range(1, len(o)), lambda i: o[i + 1] - o[i])), 0), 4)::DOUBLE AS gap FROM b""",
    "thread_documents": """WITH t AS (SELECT conv_id, arg_min(text, turn) AS body, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (role != 'assistant') AS c, count(*) FILTER (role = 'assistant')::INT AS dropped FROM conversations GROUP BY conv_id)
SELECT 'a_b__' || lpad(conv_id::VARCHAR, greatest(4, length(conv_id::VARCHAR))::INT, '0') || '.md' AS file, md5(regexp_replace('# Thread ' || conv_id || chr(10) || chr(10) || body || coalesce(chr(10) || chr(10) || c, ''), '\\s+$', '') || chr(10)) AS digest, dropped FROM t""",
    "thread_questions": """WITH t AS (SELECT p_partkey, p_name || ' fails since #…' || CASE WHEN p_partkey % 3 = 0 THEN ' when the engine starts twice' ELSE '' END AS s FROM part)
SELECT p_partkey, 'In a/b, someone reported: "' || s || '" What was this eventually traced to, and what resolved it?' AS question, len(list_filter(regexp_extract_all(lower(s), '[a-z_][a-z0-9_]*'), lambda w: w NOT IN ('when', 'the'))) < 4 AS degenerate FROM t""",
    "path_scopes": f"WITH {_PATHS} SELECT {_INSIDE} AS inside, CASE WHEN starts_with(path, 'src/core/') THEN 0 WHEN starts_with(path, 'src/') THEN 1 WHEN starts_with(path, 'docs/') THEN 2 ELSE 3 END::INT AS tier, NOT starts_with(path, '.') AND (ends_with(path, '.py') OR ends_with(path, '.md')) AS visible, count(*) AS n FROM f GROUP BY ALL",
    "prompt_texts": "WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, string_agg('[' || k || '] user' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t FROM u GROUP BY conv_id) SELECT conv_id, md5('Passages:' || chr(10) || chr(10) || coalesce(t, '(no passages were retrieved)') || chr(10) || chr(10) || 'Question: why?') AS digest FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id)",
    "retrieved_hops": "WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, list_concat(x, [-1, -1, -1, -1, -1, -1])[1:6] AS ids FROM o) SELECT l_orderkey, len(list_distinct(list_intersect([ids[2], ids[5]], list_filter(ids[1:3], lambda i: i >= 0))))::INT AS hops, array_to_string(ids, ',') AS ids FROM p",
    "gold_verdicts": """WITH p AS (SELECT ['keep', 'augment', 'replace', 'unanswerable_from_corpus', 'other'][floor(p_partkey / 5)::BIGINT % 5 + 1] AS verdict, p_partkey % 5 AS c FROM part)
SELECT verdict, CASE verdict WHEN 'other' THEN 'unknown verdict other' WHEN 'keep' THEN CASE WHEN c IN (0, 1, 3) THEN 'keep must not change the golds' END WHEN 'unanswerable_from_corpus' THEN CASE WHEN c != 4 THEN 'unanswerable_from_corpus must supply no golds' END
WHEN 'augment' THEN CASE WHEN c != 0 THEN 'augment must add at least one alias and drop none' END WHEN 'replace' THEN CASE c WHEN 4 THEN 'replace must supply a non-empty gold list' WHEN 2 THEN 'replace must differ from the existing golds' WHEN 1 THEN 'no proposed alias is long enough to be matchable' END END AS problem, count(*) AS n FROM p GROUP BY ALL""",
}
