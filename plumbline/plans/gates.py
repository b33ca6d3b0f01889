"""Gates on provenance over orders as questions and their parts as titles, and the changes that edits of documents make to an
index."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import provenance as P
from plumbline.plans.corpus import OVERLAP, SIZE
from plumbline.sources.tables import cut, table


def _questions(spark, d):
    """Annotated questions: customers, known under another spelling of their names, with nested outputs of what they ordered."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").join(table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    outputs = lines.groupBy("o_custkey", "l_orderkey").agg(F.collect_list(F.struct(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("title"))).alias("provenance"))
    known = outputs.groupBy("o_custkey").agg(F.collect_list(F.struct("provenance")).alias("output")).join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    questions = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("  "), F.upper("c_name"), F.lit("?")).alias("question"))
    return P.annotated(questions, known.select(F.regexp_replace("c_name", "#", " -- ").alias("input"), "output"))


def _corpus(spark, d):
    """Titles of the parts that the corpus holds: those of an even number."""
    return table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("title"))


def _usable(spark, d):
    return cut(P.usable(_questions(spark, d), _corpus(spark, d)), "usable")


def provenance_reproduced(spark, d):
    """The questions with a title in the corpus against a frozen list, from which those of one nation are missing."""
    found = _usable(spark, d).where(F.size("used") > 0)
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("qid"))
    frozen = found.select("qid", F.array_join("titles", "|").alias("titles")).join(gone, "qid", "left_anti")
    return P.reproduced(found, frozen).union(P.reproduced(found, found.select("qid", F.array_join("titles", "|").alias("titles"))))


def provenance_titles(spark, d):
    """Titles used and dropped, and cached titles (by a supplier's number) against those of the corpus."""
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("title"))
    cache = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("row")).distinct().join(ids, "row").select("row", F.when(F.col("row") % 97 == 5, "another").otherwise(F.col("title")).alias("title"))
    return P.titles_agree(_usable(spark, d), cache, ids)


def provenance_recomputed(spark, d):
    """Line prices recomputed from quantity and the part's price against the table's."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    rows = lines.select(F.round(F.col("l_quantity") * F.col("p_retailprice"), 2).alias("now"), F.round("l_extendedprice", 2).alias("was"))
    return P.recomputed(rows, "now", "was")


def _chunks(text):
    return F.posexplode(X.chunks(text, SIZE, OVERLAP)).alias("chunk", "text")


def index_changes(spark, d):
    """Rows of an index that are inserted, kept, moved and deleted, by kind of edit: a new document each hundred, text put at
    the end, a line put in the middle, and a chunk's length of text put in front."""
    own = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    step = SIZE - OVERLAP
    edits = {
        "new_file": F.col("text"),
        "tail_append": F.concat("text", F.lit(" more words at the end")),
        "mid_edit": F.concat(F.substring("text", F.lit(1), half), F.lit("\nanother line\n"), F.substring("text", half + 1, F.length("text"))),
        "front_block": F.concat(F.repeat(F.lit("x"), step), F.col("text")),
    }
    before = own.select("doc_id", F.explode(F.array(*map(F.lit, edits))).alias("edit"), "text")
    after = before.withColumn("text", F.coalesce(*[F.when(F.col("edit") == name, text) for name, text in edits.items()]))
    new = own.where("doc_id % 100 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new_file").alias("edit"), F.reverse("text").alias("text"))
    key = F.concat_ws(":", "edit", F.col("doc_id").cast("string")).alias("doc_id")
    state = lambda rows: P.identified(rows.select(key, _chunks(F.col("text"))))
    changes = P.merged(state(before), state(after.unionByName(new)))
    return changes.groupBy(F.substring_index("doc_id", ":", 1).alias("edit"), "change").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (provenance_reproduced, provenance_titles, provenance_recomputed, index_changes)}

_USABLE = """t AS (SELECT o_custkey AS qid, list(DISTINCT p_name || ' ' || p_size) AS titles FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1),
h AS (SELECT list(DISTINCT p_name || ' ' || p_size) AS have FROM part WHERE p_partkey % 2 = 0),
u AS (SELECT qid, len(titles) AS n, len(list_intersect(titles, have)) AS used FROM t, h)"""
_EDITED = f"""e AS (SELECT doc_id, edit, text AS t, CASE edit WHEN 'new_file' THEN text WHEN 'tail_append' THEN text || ' more words at the end' WHEN 'mid_edit' THEN substr(text, 1, length(text) // 2) || chr(10) || 'another line' || chr(10) || substr(text, length(text) // 2 + 1) ELSE repeat('x', {SIZE - OVERLAP}) || text END AS u
  FROM documents, (SELECT unnest(['new_file', 'tail_append', 'mid_edit', 'front_block']) AS edit) WHERE text IS NOT NULL),
b AS (SELECT 0 AS s, edit, doc_id, t FROM e UNION ALL SELECT 1, edit, doc_id, u FROM e UNION ALL SELECT 1, 'new_file', -1 - doc_id, reverse(text) FROM documents WHERE text IS NOT NULL AND doc_id % 100 = 0),
c AS (SELECT s, edit, doc_id, i, substr(t, i * {SIZE - OVERLAP} + 1, {SIZE}) AS x FROM (SELECT *, unnest(range(0, CASE WHEN length(t) <= {SIZE} THEN 1 ELSE ceil((length(t) - {OVERLAP}) / {SIZE - OVERLAP}.0)::BIGINT END)) AS i FROM b)),
n AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q FROM c WINDOW w AS (PARTITION BY s, edit, doc_id ORDER BY i)),
k AS (SELECT *, row_number() OVER (PARTITION BY s, edit, doc_id, p, x, q ORDER BY i) AS r FROM n),
f AS (SELECT coalesce(o.edit, m.edit) AS edit, o.i AS was, m.i AS now FROM (FROM k WHERE s = 0) o FULL JOIN (FROM k WHERE s = 1) m
  ON o.edit = m.edit AND o.doc_id = m.doc_id AND o.x = m.x AND o.p IS NOT DISTINCT FROM m.p AND o.q IS NOT DISTINCT FROM m.q AND o.r = m.r)"""
SQL = {
    "provenance_reproduced": f"WITH {_USABLE}, g AS (SELECT count(*) AS n, count(*) FILTER (c_nationkey = 3) AS gone FROM u JOIN customer ON c_custkey = qid WHERE used > 0) SELECT 'K0' AS gate, n AS value, gone = 0 AS same_ids, gone = 0 AS same_titles, gone = 0 AS passed FROM g UNION ALL SELECT 'K0', n, true, true, true FROM g",
    "provenance_titles": f"""WITH {_USABLE}, m AS (SELECT count(*) AS bad FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 97 = 5))
SELECT 'K1' AS gate, sum(used)::BIGINT AS value, sum(n - used)::BIGINT AS dropped, count(*) FILTER (used = 0) AS empty, (SELECT bad FROM m) AS mismatches, count(*) FILTER (used = 0) = 0 AND (SELECT bad FROM m) = 0 AS passed FROM u""",
    "provenance_recomputed": "SELECT 'K2' AS gate, count(*) AS value, count(*) FILTER (round(l_quantity * p_retailprice, 2) != round(l_extendedprice, 2)) AS mismatches, count(*) FILTER (round(l_quantity * p_retailprice, 2) != round(l_extendedprice, 2)) = 0 AS passed FROM lineitem JOIN part ON p_partkey = l_partkey",
    "index_changes": f"WITH {_EDITED} SELECT edit, CASE WHEN was IS NULL THEN 'insert' WHEN now IS NULL THEN 'delete' WHEN was = now THEN 'keep' ELSE 'move' END AS change, count(*) AS n FROM f GROUP BY ALL",
}
