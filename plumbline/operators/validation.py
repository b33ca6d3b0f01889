"""Checks over inputs and results. A check gives the rows that break a rule, none if it holds; ``must_be_empty`` turns one
into a condition that stops a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.threads import in_subset


def must_be_empty(problems: DataFrame, what: str, shown: int = 5) -> None:
    """Fails with the first rows of problems, if there are any."""
    rows = problems.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {'; '.join(str(tuple(r)) for r in rows)}")


def errored(runs: DataFrame, key: str = "qid", arm: str = "arm") -> DataFrame:
    """Runs with an error that is not empty."""
    return runs.where(F.coalesce(F.trim("error"), F.lit("")) != "").select(key, arm, "error")


def stale(threads: DataFrame, accepted: list[str]) -> DataFrame:
    """Rows whose fetch_basis is not accepted; null is not."""
    return threads.where(~F.coalesce(F.col("fetch_basis").isin(accepted), F.lit(False)))


def question_problems(questions: DataFrame, files: DataFrame, difficulties: list[str], prefix: str, total: int | None = None, scaling: int | None = None, mix: dict[str, int] | None = None) -> DataFrame:
    """(qid, problem) of questions (qid, expected_files and expected_symbols parted by semicolons, difficulty, scaling_subset
    as text) against files (path): missing and duplicate ids, files that are missing, unknown or outside the prefix, wrong
    difficulties, missing symbols, and, where numbers are given, wrong numbers (with a null qid)."""
    q = questions.withColumns({"files": X.split_field(F.coalesce("expected_files", F.lit(""))), "symbols": X.split_field(F.coalesce("expected_symbols", F.lit(""))), "scaled": X.truthy(F.col("scaling_subset"))})
    blank = F.trim(F.coalesce("qid", F.lit(""))) == ""
    outside = F.size(F.filter("files", lambda p: ~F.startswith(p, F.lit(prefix)))) > 0
    rules = {
        "qid is missing": blank,
        "no expected files": F.size("files") == 0,
        "unknown difficulty": ~F.coalesce(F.col("difficulty").isin(difficulties), F.lit(False)),
        f"scaling question outside {prefix}": F.col("scaled") & outside,
        "no expected symbols": F.size("symbols") == 0,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    out = q.select("qid", F.explode(found).alias("problem"))
    out = out.union(q.where(~blank).groupBy("qid").count().where("count > 1").select("qid", F.lit("duplicate qid")))
    named = q.select("qid", F.explode("files").alias("path")).distinct()
    out = out.union(named.join(files.select("path").distinct(), "path", "left_anti").select("qid", F.concat(F.lit("unknown file "), F.col("path"))))
    counts = {"questions": (total, F.count("*")), "scaling questions": (scaling, F.count(F.when(F.col("scaled"), 1)))}
    counts |= {f"questions of difficulty {k}": (n, F.count(F.when(F.col("difficulty") == k, 1))) for k, n in (mix or {}).items()}
    wanted = {name: x for name, x in counts.items() if x[0] is not None}
    if wanted:
        wrong = [F.when(n != want, F.concat(F.lit(f"expected {want} {name}, got "), n.cast("string"))) for name, (want, n) in wanted.items()]
        row = q.agg(F.array(*wrong).alias("x")).select(F.lit(None).cast("string").alias("qid"), F.explode("x").alias("problem"))
        out = out.union(row.where("problem is not null"))
    return out


def nesting(paths: DataFrame, scopes: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """(scope, n, strictly_inside) of scopes (name, include, exclude) from small to large: the number of paths, and whether all
    are in the next scope, which has more; null for the last. An empty scope is in none."""
    flags = [in_subset(F.col("path"), include, exclude) for _, include, exclude in scopes]
    aggs = [F.count(F.when(f, 1)).alias(f"n{i}") for i, f in enumerate(flags)]
    aggs += [F.count(F.when(f & ~flags[i + 1], 1)).alias(f"out{i}") for i, f in enumerate(flags[:-1])]
    row = paths.select("path").distinct().agg(*aggs)
    each = [F.struct(F.lit(name).alias("scope"), F.col(f"n{i}").alias("n"), ((F.col(f"n{i}") > 0) & (F.col(f"out{i}") == 0) & (F.col(f"n{i}") < F.col(f"n{i + 1}")) if i + 1 < len(scopes) else F.lit(None).cast("boolean")).alias("strictly_inside")) for i, (name, _, _) in enumerate(scopes)]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def eligible(questions: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(qid) of questions all of whose expected files lie in a scope; one without files does not."""
    files = F.filter(F.split(F.coalesce("expected_files", F.lit("")), ";"), lambda p: p != "")
    return questions.where((F.size(files) > 0) & F.forall(files, lambda p: in_subset(p, include, exclude))).select("qid")


def ignore_files(paths: DataFrame) -> DataFrame:
    """Paths of ignore files at the root, but for .gitignore."""
    return paths.where(F.col("path").rlike(r"^\.[^/]*ignore$") & (F.col("path") != ".gitignore")).select("path")


def differing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of two tables has."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return both.where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def index_complete(reported: DataFrame, rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: what the writer reported (column n), the rows that there are, what the corpus predicts (n), and whether all
    are equal and above zero."""
    one = reported.agg(F.sum("n").alias("reported")).crossJoin(rows.agg(F.count("*").alias("counted"))).crossJoin(predicted.agg(F.sum("n").alias("predicted")))
    same = (F.col("reported") == F.col("counted")) & (F.col("counted") == F.col("predicted")) & (F.col("counted") > 0)
    return one.withColumn("complete", F.coalesce(same, F.lit(False)))


def calls_bind(calls: DataFrame, wanted: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """(key, problem): keys with a call that returned more than k results, and wanted keys without any call."""
    over = calls.groupBy(key).agg(F.max("n_results").alias("n")).where(F.col("n") > k).select(key, F.lit("too many results").alias("problem"))
    return over.union(wanted.select(key).distinct().join(calls.select(key).distinct(), key, "left_anti").select(key, F.lit("no call")))


def provenance_problems(questions: DataFrame, chunks: DataFrame, shown: int = 20) -> DataFrame:
    """One row (n, n_bad, bad_qids): questions (qid, row_a, row_b, gold as normalised text) whose rows are unknown or whose gold
    is not in the second row's normalised text (chunks: row, norm)."""
    both = questions.join(chunks.select(F.col("row").alias("row_b"), "norm"), "row_b", "left")
    golds = F.array("gold")
    fine = F.col("row_a").isNotNull() & F.col("row_b").isNotNull() & X.answer_present_words(golds, F.array("norm"))
    bad = both.withColumn("bad", ~F.coalesce(fine, F.lit(False)))
    first = bad.where("bad").select("qid").orderBy("qid").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("qid")), ",").alias("bad_qids"))
    return bad.agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad")).crossJoin(first)


def shard_of(i: Column, n: int) -> Column:
    """The file name of one of n shards."""
    return F.format_string(f"train-%05d-of-{n:05d}.parquet", i.cast("int"))


def shards_for(shards: DataFrame, target: int) -> DataFrame:
    """(shard, n, taken) of the shards in order until their rows reach a target; taken is how many rows of each are used.
    For a list of shards, one row a file."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = shards.withColumn("before", before).where(F.col("before") < target)
    return rows.select("shard", "n", F.least("n", F.lit(target) - F.col("before")).alias("taken"))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows of the same columns put in by key: a new row replaces the old one."""
    kept = table.join(rows.select(key), key, "left_anti").select(*table.columns)
    return kept.unionByName(rows.select(*table.columns))


def stamped(ledger: DataFrame, commits: DataFrame, key: str = "run_label") -> DataFrame:
    """ledger with blank committed_in filled from commits (key, commit); others stay."""
    blank = F.trim(F.coalesce("committed_in", F.lit(""))) == ""
    both = ledger.join(commits.select(key, "commit"), key, "left")
    return both.withColumn("committed_in", F.when(blank, F.coalesce("commit", "committed_in")).otherwise(F.col("committed_in"))).select(*ledger.columns)
