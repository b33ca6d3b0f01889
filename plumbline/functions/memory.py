"""Histories with planted facts: rendering of turns and facts, questions, depths, scores, and structural checks.

A fact is a struct of fact_id, fact_type (decision, value, owner or superseded), subject, attribute, value, alternative
and stale_value. Checks give one row (fact_id, problem) for each violation; none means that the history is sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_TYPES = ("decision", "value", "owner", "superseded")


def depth_of(before: Column, total: Column) -> Column:
    """Share of a history that comes before; fails for an empty one."""
    return F.when(total > 0, before / total).otherwise(F.raise_error(F.lit("a history needs tokens")).cast("double"))


def truncate_recent(days: DataFrame, by: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """(by, first, n, fraction): the first of the most recent whole days that fit the budget (null if none does), how many
    fit, and their share of all tokens. It ends at the first day, from the last backwards, that does not fit."""
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.col("upto") <= budget
    out = days.withColumn("upto", F.sum(tokens).over(w)).groupBy(*by)
    share = F.coalesce(F.sum(F.when(kept, F.col(tokens))), F.lit(0)) / F.sum(tokens)
    return out.agg(F.min(F.when(kept, F.col(order))).alias("first"), F.count(F.when(kept, 1)).alias("n"), F.coalesce(share, F.lit(1.0)).alias("fraction"))


def ticked(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def of_type(fact_type: Column, cases: dict[str, Column]) -> Column:
    """The case of a fact's type; fails for another type."""
    out = F.raise_error(F.concat(F.lit("unknown fact type "), F.coalesce(fact_type, F.lit("null")))).cast("string")
    for name, text in cases.items():
        out = F.when(fact_type == name, text).otherwise(out)
    return out


def fact_bullet(f: Column) -> Column:
    """What is planted for a fact; for a superseded one the statement that is revised later."""
    s, a = ticked(f["subject"]), ticked(f["attribute"])
    return of_type(f["fact_type"], {
        "decision": F.concat(F.lit("We decided to route "), s, F.lit(" through "), ticked(f["value"]), F.lit(" rather than "), ticked(f["alternative"]), F.lit(".")),
        "value": F.concat(F.lit("We set "), a, F.lit(" on "), s, F.lit(" to "), f["value"], F.lit(".")),
        "owner": F.concat(f["value"], F.lit(" owns "), s, F.lit(".")),
        "superseded": F.concat(F.lit("We decided "), a, F.lit(" on "), s, F.lit(" would be "), f["stale_value"], F.lit(".")),
    })


def revision_bullet(f: Column) -> Column:
    """The later statement of a superseded fact; fails for others."""
    text = F.concat(F.lit("We revisited "), ticked(f["attribute"]), F.lit(" on "), ticked(f["subject"]), F.lit(" and changed it from "), f["stale_value"], F.lit(" to "), f["value"], F.lit("."))
    return F.when(f["fact_type"] == "superseded", text).otherwise(F.raise_error(F.lit("only superseded facts have a revision")).cast("string"))


def fact_question(f: Column) -> Column:
    """The question after a fact: it names the subject and the attribute, never a value."""
    s, a = ticked(f["subject"]), ticked(f["attribute"])
    return of_type(f["fact_type"], {
        "decision": F.concat(F.lit("What did we decide to route "), s, F.lit(" through?")),
        "value": F.concat(F.lit("What value did we set "), a, F.lit(" on "), s, F.lit(" to?")),
        "owner": F.concat(F.lit("Who owns "), s, F.lit("?")),
        "superseded": F.concat(F.lit("What is "), a, F.lit(" on "), s, F.lit(" currently set to?")),
    })


def turn_text(t: Column) -> Column:
    """A turn (time, session_id, turn_id, bullets) as a heading, an anchor comment and a list."""
    anchor = F.concat(F.lit("<!-- session:"), t["session_id"], F.lit(" turn:"), t["turn_id"], F.lit(" transcript:/synthetic/"), t["session_id"], F.lit(".jsonl -->"))
    head = F.concat(F.lit("### "), t["time"])
    return F.array_join(F.concat(F.array(head, anchor), F.transform(t["bullets"], lambda b: F.concat(F.lit("- "), b))), "\n")


def day_text(sessions: Column) -> Column:
    """A day's sessions (time, turns) as one text that ends with one line feed."""
    parts = F.flatten(F.transform(sessions, lambda s: F.concat(F.array(F.concat(F.lit("## Session "), s["time"], F.lit("\n"))), F.transform(s["turns"], lambda t: F.concat(turn_text(t), F.lit("\n"))))))
    return F.concat(F.regexp_replace(F.concat(F.lit("\n"), F.array_join(parts, "\n")), r"\s+$", ""), F.lit("\n"))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def stale_mentioned(answer: Column, stale: Column) -> Column:
    """Whether an answer names the value that was superseded, in whatever sense."""
    return F.coalesce((stale != "") & F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(stale)), F.lit(False))


def stale_as_answer(answer: Column, stale: Column, correct: Column) -> Column:
    """Whether it commits to it: it names it and was not judged correct."""
    return stale_mentioned(answer, stale) & ~F.coalesce(correct, F.lit(False))


def answers_in_questions(facts: DataFrame) -> DataFrame:
    """Facts whose question holds the value, the stale value or the alternative, case aside."""
    f = F.struct(*facts.columns)
    question = F.lower(fact_question(f))
    holds = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & F.contains(question, F.lower(F.col(c)))
    found = F.filter(F.array(*[F.when(holds(c), F.lit(c)) for c in ("value", "stale_value", "alternative")]), lambda x: x.isNotNull())
    return facts.select("fact_id", F.explode(found).alias("problem"))


def thin_distractors(lines: DataFrame, facts: DataFrame, components: int, mentions: int) -> DataFrame:
    """Facts whose attribute fewer other subjects share, or whose subject is mentioned less often, than asked for, in the
    lines (text) of a history. Lines are scanned once; what they name is counted and joined."""
    named = lambda i: F.regexp_extract_all("text", F.lit(r"`([^`]+)` on `([^`]+)`"), F.lit(i))
    pairs = lines.select(F.explode(F.arrays_zip(named(1).alias("attribute"), named(2).alias("subject"))).alias("p")).select("p.*").distinct()
    shared = pairs.groupBy("attribute").agg(F.count("*").alias("n_subjects"))
    own = pairs.withColumn("own", F.lit(1))
    said = lines.select(F.explode(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1))).alias("subject")).groupBy("subject").agg(F.count("*").alias("n_mentions"))
    both = facts.select("fact_id", "attribute", "subject").join(shared, "attribute", "left").join(own, ["attribute", "subject"], "left").join(said, "subject", "left")
    few = (F.coalesce("attribute", F.lit("")) != "") & (F.coalesce("n_subjects", F.lit(0)) - F.coalesce("own", F.lit(0)) < components)
    quiet = F.coalesce("n_mentions", F.lit(0)) < mentions
    found = F.filter(F.array(F.when(few, F.lit("attribute")), F.when(quiet, F.lit("mentions"))), lambda x: x.isNotNull())
    return both.select("fact_id", F.explode(found).alias("problem"))


def repeated_answers(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, n) of facts whose value (one word of letters, digits and _) occurs more often in the lines than once, or twice
    if superseded. Comments do not count; words are counted in one pass and joined."""
    words = lines.select(F.explode(F.regexp_extract_all(without_comments(F.col("text")), F.lit(r"\w+"), F.lit(0))).alias("value"))
    counts = words.groupBy("value").agg(F.count("*").alias("n"))
    return facts.join(counts, "value").where(F.col("n") > F.when(F.col("fact_type") == "superseded", 2).otherwise(1)).select("fact_id", "n")


def off_band(probes: DataFrame, bands: list[float], tolerance: float) -> DataFrame:
    """Probes (id, depth) that lie within the tolerance of no band."""
    near = F.exists(F.array(*map(F.lit, bands)), lambda b: F.abs(F.col("depth") - b) <= tolerance)
    return probes.where(~near)


def invisible_originals(originals: DataFrame, fit_fraction: float, margin: float) -> DataFrame:
    """Statements (id, depth) that a history cut to its most recent part does not show."""
    return originals.where(F.col("depth") <= (1.0 - fit_fraction) + margin)
