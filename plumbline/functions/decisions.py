"""Pre-registered decision rules and gates as Columns; thresholds are parameters with the usual values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARGIN, TOLERANCE, KAPPA_FLOOR, DECLINE_SHARE = 0.05, 0.03, 0.60, 0.80


def classify_delta(low: Column, high: Column, margin: float = MARGIN) -> Column:
    """DROP if the whole interval of a loss is above 0, PLATEAU if it is below the margin, else INCONCLUSIVE."""
    return F.when(low > 0, "DROP").when(high < margin, "PLATEAU").otherwise("INCONCLUSIVE")


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def is_matched(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tolerance + 1e-12


def resolve_branch(excludes: Column, median: Column, positive: str, negative: str, none: str) -> Column:
    """A lookup: no separation, or the side of the median; a median of exactly 0 counts as negative."""
    return F.when(~excludes, none).when(median > 0, positive).otherwise(negative)


def parametric_reading(accuracy: Column) -> Column:
    return F.when(accuracy <= 0.10, "holds").when(accuracy <= 0.30, "partial_leak").otherwise("does_not_ground")


def hop_branch(low: Column, high: Column, hop1_excludes: Column) -> Column:
    """H4-confounded if the first stratum separates by itself; else H2 if the contrast does not separate, H1 if it lies below
    zero, H3 above."""
    return F.when(hop1_excludes, "H4-confounded").when(~excludes_zero(low, high), "H2").when(high < 0, "H1").otherwise("H3")


def gate_branch(accuracy: Column, any_hit: Column) -> Column:
    return F.when((accuracy <= 0) & ~any_hit, "G1").otherwise("G2")


def decline_gate(declines: Column, errors: Column, share: float = DECLINE_SHARE) -> Column:
    """True if declines are at least this share of declines and errors; false if there are neither."""
    return F.coalesce(declines / F.nullif(declines + errors, F.lit(0)) >= share, F.lit(False))


def knee_width_branch(low: Column, high: Column, first: Column, last: Column, slope_low: Column, slope_high: Column, width: float = 0.05, near: float = 0.005) -> Column:
    """N3 if the slope's interval holds zero, N1 if the knee's interval is narrow and touches no end of the range, else N2."""
    touches = (low <= first + near) | (high >= last - near)
    return F.when((slope_low <= 0) & (slope_high >= 0), "N3").when((high - low <= width) & ~touches, "N1").otherwise("N2")


def gate_verdict(accuracy: Column, passing: float = 0.05, failing: float = 0.10) -> Column:
    """Whether a run without retrieval knows too much: pass, investigate or fail."""
    return F.when(accuracy <= passing, "pass").when(accuracy <= failing, "investigate").otherwise("fail")


def share_branch(share: Column) -> Column:
    return F.when(share >= 0.40, "P1").when(share >= 0.15, "P2").otherwise("P3")


def order_branch(position: Column, n: Column) -> Column:
    """Where the largest value is: first, last or interior."""
    return F.when(position == 1, "first").when(position == n, "last").otherwise("interior")


def four_sample(disagreement: Column) -> Column:
    """From a replicate disagreement rate R = 2 p (1 - p): p and the chance that four samples disagree; null outside 0 to 0.5."""
    p = (1 - F.sqrt(1 - 2 * disagreement)) / 2
    return F.when(disagreement.between(0, 0.5), F.struct(p.alias("p"), (1 - F.pow(p, 4.0) - F.pow(1 - p, 4.0)).alias("four")))


#: Labels of eligibility, and those of them that make a question ineligible.
LABELS = ("eligible", "ambiguous", "wrong_gold", "stale_gold", "unanswerable")
INELIGIBLE, DISPUTED = ("ambiguous", "wrong_gold", "stale_gold", "unanswerable"), "ineligible_class_disputed"


def valid_label(label: Column) -> Column:
    return F.coalesce(label.isin(*LABELS), F.lit(False))


def binary_label(label: Column) -> Column:
    return F.when(label.isin(*INELIGIBLE), "ineligible").otherwise("eligible")


def adjudicate(a: Column, b: Column) -> Column:
    """Two labels as (binary, class): a split on eligibility resolves to eligible, one on the kind of ineligibility is
    disputed; an unknown label fails."""
    known = valid_label(a) & valid_label(b)
    out = a.isin(*INELIGIBLE) & b.isin(*INELIGIBLE)
    binary = F.when(~known, F.raise_error(F.lit("unknown label")).cast("string")).when(out, "ineligible").otherwise("eligible")
    return F.struct(binary.alias("binary"), F.when(~out, "eligible").when(a == b, a).otherwise(DISPUTED).alias("class"))


def page_cap(n: Column, share: float = 0.02) -> Column:
    return F.greatest(F.lit(1), F.floor(n * share).cast("bigint"))
