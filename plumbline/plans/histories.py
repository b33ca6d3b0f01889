"""Queries over ``part`` as planted facts and ``conversations`` as histories: rendering, questions, structural checks, cut
histories and stale answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import memory as M
from plumbline.operators import runs as R
from plumbline.sources.tables import table


def facts(spark, d) -> DataFrame:
    """Parts as facts of all four types in turn."""
    i = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, M.FACT_TYPES)), (i % 4 + 1).cast("int"))
    text = lambda c: c.cast("string")
    return table(spark, d, "part").select(text(i).alias("fact_id"), kind.alias("fact_type"), F.regexp_replace("p_name", " ", "-").alias("subject"), F.lower(F.regexp_replace("p_type", " ", "_")).alias("attribute"), text(i + 1000).alias("value"), F.concat(F.lit("alt"), text(i)).alias("alternative"), text(i % 700 + 1003).alias("stale_value"))


def lines(spark, d) -> DataFrame:
    own = facts(spark, d)
    f = F.struct(*own.columns)
    return own.select(M.fact_bullet(f).alias("text")).union(own.where("fact_type = 'superseded'").select(M.revision_bullet(f).alias("text"))).union(own.select(F.concat(F.lit("<!-- turn:"), "value", F.lit(" -->")).alias("text")))


def fact_texts(spark, d):
    own = facts(spark, d)
    f = F.struct(*own.columns)
    return own.select("fact_id", M.fact_bullet(f).alias("bullet"), F.when(F.col("fact_type") == "superseded", M.revision_bullet(f)).alias("revision"), M.fact_question(f).alias("question"))


def fact_leaks(spark, d):
    """Facts whose question gives something away; every seventh part's alternative is its subject here."""
    own = facts(spark, d)
    return M.answers_in_questions(own.withColumn("alternative", F.when(F.col("fact_id").cast("int") % 7 == 0, F.col("subject")).otherwise(F.col("alternative"))))


def fact_distractors(spark, d):
    return M.thin_distractors(lines(spark, d), facts(spark, d), 3, 4)


def fact_repeats(spark, d):
    return M.repeated_answers(lines(spark, d), facts(spark, d))


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.ceil(F.length("text") / 4).cast("bigint").alias("tokens"))


def recent_turns(spark, d):
    """What of each conversation its last 150 tokens show."""
    out = M.truncate_recent(turns(spark, d), ["conv_id"], "turn", "tokens", 150)
    return out.withColumn("fraction", F.round("fraction", 6))


def probes(spark, d) -> DataFrame:
    own = R.cumulative_before(turns(spark, d), ["conv_id"], "turn", "tokens")
    total = F.sum("tokens").over(Window.partitionBy("conv_id"))
    return own.withColumn("total", total).select("conv_id", "turn", F.round(M.depth_of(F.col("cum_before"), F.greatest("total", F.lit(1))), 6).alias("depth"))


def probes_off_band(spark, d):
    return M.off_band(probes(spark, d), [0.1, 0.5, 0.9], 0.05)


def invisible_turns(spark, d):
    return M.invisible_originals(probes(spark, d), 0.6, 0.05)


def turn_texts(spark, d):
    """Turns with their sentences as bullets, rendered."""
    t = F.struct(F.lit("09:00").alias("time"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("turn_id"), F.filter(F.split("text", r"\. "), lambda s: s != "").alias("bullets"))
    return turns(spark, d).select("conv_id", "turn", F.md5(M.turn_text(t)).alias("digest"))


def day_texts(spark, d):
    """Conversations as days of one session each."""
    t = F.struct("turn", F.lit("09:00").alias("time"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("turn_id"), F.array("text").alias("bullets"))
    own = turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("turns"))
    return own.select("conv_id", F.md5(M.day_text(F.array(F.struct(F.lit("09:00").alias("time"), F.col("turns").alias("turns"))))).alias("digest"))


def stale_answers(spark, d):
    """By type of fact how many answers name the superseded value, and how many commit to it."""
    own = facts(spark, d)
    i = F.col("fact_id").cast("int")
    answer = F.when(i % 3 == 0, F.concat(F.lit("It is "), "value")).when(i % 3 == 1, F.concat(F.lit("It was "), "stale_value")).otherwise(F.concat(F.lit("Changed from "), "stale_value", F.lit(" to "), "value"))
    own = own.select("fact_type", "stale_value", answer.alias("answer"), (i % 3 != 1).alias("ok"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return own.groupBy("fact_type").agg(F.count("*").alias("n"), count(M.stale_mentioned(F.col("answer"), F.col("stale_value")), "mentioned"), count(M.stale_as_answer(F.col("answer"), F.col("stale_value"), F.col("ok")), "committed"))


QUERIES = {f.__name__: f for f in (fact_texts, fact_leaks, fact_distractors, fact_repeats, recent_turns, probes_off_band, invisible_turns, turn_texts, day_texts, stale_answers)}

_FACTS = """f AS (SELECT p_partkey AS i, p_partkey::VARCHAR AS fact_id, ['decision', 'value', 'owner', 'superseded'][p_partkey % 4 + 1] AS fact_type, replace(p_name, ' ', '-') AS subject, lower(replace(p_type, ' ', '_')) AS attribute,
  (p_partkey + 1000)::VARCHAR AS value, 'alt' || p_partkey AS alternative, (p_partkey % 700 + 1003)::VARCHAR AS stale_value FROM part),
t AS (SELECT *, CASE fact_type WHEN 'decision' THEN 'We decided to route `' || subject || '` through `' || value || '` rather than `' || alternative || '`.' WHEN 'value' THEN 'We set `' || attribute || '` on `' || subject || '` to ' || value || '.'
  WHEN 'owner' THEN value || ' owns `' || subject || '`.' ELSE 'We decided `' || attribute || '` on `' || subject || '` would be ' || stale_value || '.' END AS bullet,
  CASE WHEN fact_type = 'superseded' THEN 'We revisited `' || attribute || '` on `' || subject || '` and changed it from ' || stale_value || ' to ' || value || '.' END AS revision,
  CASE fact_type WHEN 'decision' THEN 'What did we decide to route `' || subject || '` through?' WHEN 'value' THEN 'What value did we set `' || attribute || '` on `' || subject || '` to?' WHEN 'owner' THEN 'Who owns `' || subject || '`?' ELSE 'What is `' || attribute || '` on `' || subject || '` currently set to?' END AS question FROM f)"""
_LINES = f"{_FACTS}, l AS (SELECT bullet AS text FROM t UNION ALL SELECT revision FROM t WHERE revision IS NOT NULL)"
_TURNS = "u AS (SELECT conv_id, turn, text, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations)"
_PROBES = f"{_TURNS}, c AS (SELECT conv_id, turn, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, greatest(sum(tokens) OVER (PARTITION BY conv_id), 1) AS total FROM u), p AS (SELECT conv_id, turn, round(before / total, 6) AS depth FROM c)"

SQL = {
    "fact_texts": f"WITH {_FACTS} SELECT fact_id, bullet, revision, question FROM t",
    "fact_leaks": f"WITH {_FACTS}, x AS (SELECT fact_id, lower(question) AS q, value, stale_value, CASE WHEN i % 7 = 0 THEN subject ELSE alternative END AS alternative FROM t) SELECT fact_id, 'value' AS problem FROM x WHERE contains(q, lower(value)) UNION ALL SELECT fact_id, 'stale_value' FROM x WHERE contains(q, lower(stale_value)) UNION ALL SELECT fact_id, 'alternative' FROM x WHERE contains(q, lower(alternative))",
    "fact_distractors": rf"""WITH {_LINES}, p AS (SELECT DISTINCT regexp_extract(m, '`([^`]+)` on', 1) AS attribute, regexp_extract(m, ' on `([^`]+)`', 1) AS subject FROM (SELECT unnest(regexp_extract_all(text, '`[^`]+` on `[^`]+`')) AS m FROM l)),
s AS (SELECT attribute, count(*) AS n FROM p GROUP BY attribute), m AS (SELECT subject, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS subject FROM l) GROUP BY subject),
x AS (SELECT t.fact_id, coalesce(s.n, 0) - (p.subject IS NOT NULL)::INT AS others, coalesce(m.n, 0) AS said FROM t LEFT JOIN s USING (attribute) LEFT JOIN p ON p.attribute = t.attribute AND p.subject = t.subject LEFT JOIN m ON m.subject = t.subject)
SELECT fact_id, 'attribute' AS problem FROM x WHERE others < 3 UNION ALL SELECT fact_id, 'mentions' FROM x WHERE said < 4""",
    "fact_repeats": rf"WITH {_LINES}, w AS (SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\w+')) AS value FROM l) GROUP BY value) SELECT fact_id, n FROM t JOIN w USING (value) WHERE n > CASE fact_type WHEN 'superseded' THEN 2 ELSE 1 END",
    "recent_turns": f"WITH {_TURNS}, c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM u) SELECT conv_id, min(turn) FILTER (upto <= 150) AS first, count(*) FILTER (upto <= 150) AS n, round(coalesce(coalesce(sum(tokens) FILTER (upto <= 150), 0) / sum(tokens), 1.0), 6)::DOUBLE AS fraction FROM c GROUP BY conv_id",
    "probes_off_band": f"WITH {_PROBES} SELECT conv_id, turn, depth FROM p WHERE NOT (abs(depth - 0.1) <= 0.05 OR abs(depth - 0.5) <= 0.05 OR abs(depth - 0.9) <= 0.05)",
    "invisible_turns": f"WITH {_PROBES} SELECT conv_id, turn, depth FROM p WHERE depth <= (1.0 - 0.6) + 0.05",
    "turn_texts": f"WITH {_TURNS} SELECT conv_id, turn, md5(array_to_string(list_concat(['### 09:00', '<!-- session:' || conv_id || ' turn:' || turn || ' transcript:/synthetic/' || conv_id || '.jsonl -->'], list_transform(list_filter(string_split(text, '. '), lambda s: s != ''), lambda s: '- ' || s)), chr(10))) AS digest FROM u",
    "day_texts": rf"WITH {_TURNS}, x AS (SELECT conv_id, string_agg('### 09:00' || chr(10) || '<!-- session:' || conv_id || ' turn:' || turn || ' transcript:/synthetic/' || conv_id || '.jsonl -->' || chr(10) || '- ' || text || chr(10), chr(10) ORDER BY turn) AS t FROM u GROUP BY conv_id) SELECT conv_id, md5(regexp_replace(chr(10) || '## Session 09:00' || chr(10) || chr(10) || t, '\s+$', '') || chr(10)) AS digest FROM x",
    "stale_answers": f"WITH {_FACTS}, x AS (SELECT fact_type, i % 3 AS r, value, stale_value, CASE i % 3 WHEN 0 THEN 'It is ' || value WHEN 1 THEN 'It was ' || stale_value ELSE 'Changed from ' || stale_value || ' to ' || value END AS answer FROM f) SELECT fact_type, count(*) AS n, count(*) FILTER (contains(answer, stale_value)) AS mentioned, count(*) FILTER (contains(answer, stale_value) AND r = 1) AS committed FROM x GROUP BY fact_type",
}
