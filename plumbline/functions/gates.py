"""Gates and branches over aggregated results as Columns. A gate is true where it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least(value: Column, threshold: float) -> Column:
    """False for null."""
    return F.coalesce(value >= threshold, F.lit(False))


def within_budget(spent: Column, limit: float) -> Column:
    return F.coalesce(spent <= limit, F.lit(False))


def reproduced(n: Column, n_reproduced: Column, threshold: int) -> Column:
    return (n_reproduced >= threshold) & (n_reproduced <= n)


def replicate_gate(low: Column, high: Column, n_disagree: Column, least: int = 5) -> Column:
    """The interval excludes zero and enough replicates disagree."""
    return ((low > 0) | (high < 0)) & (n_disagree >= least)


def flatness(low: Column, high: Column, difference: Column, least: float = 0.10) -> Column:
    """True if a difference between depths is real: its interval excludes zero and it is large enough."""
    return ((low > 0) | (high < 0)) & (F.abs(difference) >= least)


def kappa_gate(kappa: Column, floor: float = 0.60) -> Column:
    return at_least(kappa, floor)


def disagreement_gate(n: Column, disagreements: Column, want: int = 20, most: int = 3) -> Column:
    return (n == want) & (disagreements <= most)


def concordance_gate(n: Column, agree: Column, share: float = 0.60) -> Column:
    """Passes without rows."""
    return (n == 0) | (agree / F.nullif(n, F.lit(0)) >= share)


def uphold_gate(n: Column, upheld: Column, ceiling: float = 0.90, least: int = 10) -> Column:
    """Whether a verifier bites: it upholds at most this share of the proposals, or there are too few to tell."""
    return (n < least) | (upheld / F.nullif(n, F.lit(0)) <= ceiling)


def floor_gate(hops: Column, share: float = 0.30) -> Column:
    """An aggregate: both hops of enough questions were retrieved; false without questions."""
    return F.coalesce(F.avg((hops >= 2).cast("int")) >= share, F.lit(False))


def ladder_gap(recalls: Column, low: float = 0.80, high: float = 0.97) -> Column:
    """The largest step between neighbours among the recalls (an array) inside the band; 0 for fewer than two."""
    own = F.array_sort(F.filter(recalls, lambda r: r.between(low, high)))
    # A fold: a lambda that names the sorted array would sort it again for each of its elements.
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("gap"))
    gap = F.aggregate(own, start, lambda a, r: F.struct(r.cast("double").alias("last"), F.greatest(a["gap"], r - a["last"]).cast("double").alias("gap")), lambda a: a["gap"])
    return F.coalesce(gap, F.lit(0.0))


def class_changed(before: Column, after: Column) -> Column:
    return F.when(before.eqNullSafe(after), "R2").otherwise("R1")


def flip_share_branch(flips: Column, n: Column, share: float = 0.05) -> Column:
    return at_least(flips / F.nullif(n, F.lit(0)), share)


def title_share_gate(first: Column, second: Column, most: float = 0.05) -> Column:
    """No title has too large a share in either role."""
    return F.greatest(first, second) <= most


def knee_branch(r_star: Column, any_plateau: Column, edge: float = 0.97) -> Column:
    """K2 if every arm drops, K1 if the knee is at or below the edge, else K3."""
    return F.when(~any_plateau, "K2").when(r_star <= edge, "K1").otherwise("K3")


def mechanism(low: Column, high: Column, matched: Column, margin: float = 0.05) -> Column:
    """M1 if matched arms differ, M2 if their interval is inside the margin, else M3; null for arms that do not match."""
    return F.when(matched, F.when((low > 0) | (high < 0), "M1").when((low > -margin) & (high < margin), "M2").otherwise("M3"))


def membership(expected: Column, included: Column) -> Column:
    """Whether all, some or none of the expected items are included; fails where none are expected."""
    n = F.size(F.array_intersect(expected, included))
    return F.when(F.size(expected) == 0, F.raise_error(F.lit("no expected items")).cast("string")).when(n == 0, "none").when(n == F.size(F.array_distinct(expected)), "all").otherwise("partial")


def apply_verdict(verdict: Column, old: Column, new: Column) -> Column:
    """Golds after a verdict: keep and unanswerable_from_corpus leave them, augment adds, replace exchanges and needs new ones."""
    replaced = F.when(F.size(new) > 0, new).otherwise(F.raise_error(F.lit("replace without golds")).cast("array<string>"))
    unknown = F.raise_error(F.concat(F.lit("unknown verdict "), verdict)).cast("array<string>")
    return F.when(verdict.isin("keep", "unanswerable_from_corpus"), old).when(verdict == "augment", F.concat(old, F.array_except(new, old))).when(verdict == "replace", replaced).otherwise(unknown)


def changed(verdict: Column, old: Column, new: Column) -> Column:
    return F.when(apply_verdict(verdict, old, new) == old, "unchanged").otherwise("changed")


def equal_prompts(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """One row: prompts compared, equal, and not compared because one is null."""
    both = F.col(expected).isNotNull() & F.col(actual).isNotNull()
    return df.agg(F.count(F.when(both, 1)).alias("compared"), F.count(F.when(both & (F.col(expected) == F.col(actual)), 1)).alias("equal"), F.count(F.when(~both, 1)).alias("uncompared"))


def descending_scores(scores: Column, width: int, tolerance: float = 1e-6) -> Column:
    """Scores fall (within the tolerance) and there are as many as asked for."""
    ok = F.transform(scores, lambda x, i: (i == 0) | (x <= F.get(scores, i - 1) + tolerance))
    return (F.size(scores) == width) & F.forall(ok, lambda x: F.coalesce(x, F.lit(True)))


def forbidden_terms(fields: list[Column], terms: list[str]) -> Column:
    """Terms that occur between word boundaries in any of the fields, case and all."""
    blob = F.concat_ws("\n", *fields)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.regexp_like(blob, F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b"))))
