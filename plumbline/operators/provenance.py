"""Gates on provenance: questions joined to a knowledge source by a normalised key, the titles in its nested outputs, and whether
what is found equals a frozen list, both ways, without collecting either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import collapse, norm_text


def question_key(text: Column) -> Column:
    """NFKD, lower case, every run of other characters than letters a-z and digits as one blank."""
    return collapse(norm_text(text))


def titles(outputs: Column) -> Column:
    """The distinct titles, sorted, of outputs (array of structs with provenance: array of structs with title); null and empty ones
    and outputs without provenance give none."""
    each = F.transform(outputs, lambda o: F.transform(F.coalesce(o["provenance"], F.array()), lambda p: p["title"]))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.coalesce(each, F.array())), lambda t: t.isNotNull() & (t != ""))))


def annotated(questions: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(qid, titles) of questions (qid, question) that the knowledge source (input, output) has under the same key. Of inputs with
    one key the last by input counts."""
    known = knowledge.select(question_key(F.col("input")).alias("key"), "input", titles(F.col("output")).alias("titles"))
    known = known.groupBy("key").agg(F.max_by("titles", "input").alias("titles"))
    return questions.select("qid", question_key(F.col("question")).alias("key")).join(known, "key").select("qid", "titles")


def usable(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, titles, used, dropped) of annotated questions (qid, titles): ``used`` are the titles that the corpus (title) has, and
    ``dropped`` is the number of others. Titles are joined one by one; a question's titles are few."""
    each = found.select("qid", "titles", F.explode_outer("titles").alias("title"))
    have = corpus.select("title").where("title is not null").distinct().withColumn("there", F.lit(True))
    both = each.join(have, "title", "left").groupBy("qid").agg(F.first("titles").alias("titles"), F.array_sort(F.collect_list(F.when(F.col("there"), F.col("title")))).alias("used"))
    return both.select("qid", "titles", "used", (F.size("titles") - F.size("used")).alias("dropped"))


def differing(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n_left, n_right, only_left, only_right): rows of two tables as multisets, compared by a digest of their columns.
    Counts are added up by digest, so a row that one side has more often counts as often as it has it more."""
    mark = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    both = left.select(mark.alias("mark"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select(mark.alias("mark"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.groupBy("mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return per.agg(total(F.col("a"), "n_left"), total(F.col("b"), "n_right"), total(F.greatest(F.col("a") - F.col("b"), F.lit(0)), "only_left"), total(F.greatest(F.col("b") - F.col("a"), F.lit(0)), "only_right"))


def reproduced(found: DataFrame, frozen: DataFrame, expected: int | None = None) -> DataFrame:
    """One row (gate, value, same_ids, same_titles, passed): questions with a title in the corpus (qid, titles) against the frozen
    ones (qid, titles as one string, joined by bars); passed if both hold and there are as many as expected."""
    own = found.select("qid", F.array_join("titles", "|").alias("titles"))
    both = differing(own, frozen, ["qid", "titles"]).crossJoin(differing(own, frozen, ["qid"]).select(F.col("only_left").alias("a"), F.col("only_right").alias("b")))
    same_ids, same = (F.col("a") == 0) & (F.col("b") == 0), (F.col("only_left") == 0) & (F.col("only_right") == 0)
    enough = F.lit(True) if expected is None else F.col("n_left") == expected
    return both.select(F.lit("K0").alias("gate"), F.col("n_left").alias("value"), same_ids.alias("same_ids"), same.alias("same_titles"), (same & enough).alias("passed"))


def titles_agree(found: DataFrame, cache: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (gate, value, dropped, empty, mismatches, passed): of usable questions the titles used and dropped, and the questions
    left without one; and cached rows (row, title) whose title is not that of the corpus's row (row, title), or that it lacks."""
    used = found.agg(F.coalesce(F.sum(F.size("used")), F.lit(0)).alias("value"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.count_if(F.size("used") == 0).alias("empty"))
    bad = cache.alias("c").join(ids.alias("i"), "row", "left").agg(F.count_if(~F.col("c.title").eqNullSafe(F.col("i.title"))).alias("mismatches"))
    return used.crossJoin(bad).select(F.lit("K1").alias("gate"), "value", "dropped", "empty", "mismatches", ((F.col("empty") == 0) & (F.col("mismatches") == 0)).alias("passed"))


def recomputed(rows: DataFrame, column: str, frozen: str, expected: int | None = None) -> DataFrame:
    """One row (gate, value, mismatches, passed): rows in which a recomputed column equals the frozen one; two nulls are equal."""
    bad = F.count_if(~F.col(column).eqNullSafe(F.col(frozen)))
    enough = F.lit(True) if expected is None else F.count("*") == expected
    return rows.agg(F.lit("K2").alias("gate"), F.count("*").alias("value"), bad.alias("mismatches"), ((bad == 0) & enough).alias("passed"))


# Reindexing


def identified(chunks: DataFrame, by: str = "doc_id", order: str = "chunk", text: str = "text") -> DataFrame:
    """chunks with identity, what a row of an index is known by: a digest of the document, the chunk and the chunks beside it. A
    change to a chunk or its order gives it and its neighbours others; a place in the document is no part of it, so
    text that moves as a whole keeps its rows. Equal ones in a document are told apart by their number."""
    w = Window.partitionBy(by).orderBy(order)  # a document's chunks
    own = chunks.withColumn("_digest", F.md5(text))
    mark = F.md5(F.concat_ws("/", F.col(by).cast("string"), F.coalesce(F.lag("_digest").over(w), F.lit("")), "_digest", F.coalesce(F.lead("_digest").over(w), F.lit(""))))
    own = own.withColumn("_mark", mark)
    again = F.row_number().over(Window.partitionBy(by, "_mark").orderBy(order))
    return own.withColumn("identity", F.concat_ws("#", "_mark", again)).drop("_digest", "_mark")


def merged(before: DataFrame, after: DataFrame, by: str = "doc_id", order: str = "chunk") -> DataFrame:
    """(by, identity, was, now, change) for the rows of two states of an index (identified()): insert, keep, move (kept, with another
    place) or delete. One full outer join by identity, so a reindex writes what is not kept and embeds inserts alone."""
    old, new = before.select(by, "identity", F.col(order).alias("was")), after.select(by, "identity", F.col(order).alias("now"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "keep").otherwise("move")
    return old.join(new, [by, "identity"], "full_outer").select(by, "identity", "was", "now", change.alias("change"))
