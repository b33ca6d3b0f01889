"""Sweeps of the cost model: churn, perturbed knobs with their ranking, postdiction, crossovers and branches.

Points are one row a workload and size: live (prefix, dynamic, output, hit_rate) and index (prompt, output) columns as named
in ``point_costs``. Grids are joined as arrays of structs, so a sweep is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import cost as C

BAND = (10.0, 1000.0)


def scaled(regime: Column, price: Column, write: Column | None = None) -> Column:
    """A price regime with all prices multiplied, and another multiplier for cache writes if one is given."""
    times = lambda f: (regime[f] * price).alias(f)
    writes = regime["write_multiplier"] if write is None else F.coalesce(write, regime["write_multiplier"])
    return F.struct(times("input"), times("output"), writes.alias("write_multiplier"), regime["read_multiplier"].alias("read_multiplier"), regime["long_threshold"].alias("long_threshold"), times("long_input"), times("long_cached"), times("long_output"), regime["window"].alias("window"))


def churn_sweep(points: DataFrame, churn: list[float], factors: dict[str, float], usd_per_mtok: float) -> DataFrame:
    """points (workload, size, live, live_cold, index, other, tokens) for every fraction of text that changes a day, kind of
    edit with the factor of text that is embedded again, and state of the live cache: break_even and the share of the
    fixed cost that embedding takes. ``other`` is the fixed daily cost without churn."""
    f = F.explode(F.array(*map(F.lit, churn))).alias("churn")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("edit_kind"), F.lit(v).alias("factor")) for k, v in factors.items()])).alias("e")
    rows = points.select("*", f).select("*", kinds).select("*", F.explode(F.array(F.lit("measured"), F.lit("invalidated"))).alias("live_cache"))
    day = C.churn_daily(F.col("tokens"), F.col("churn"), usd_per_mtok, F.col("e.factor"))
    live = F.when(F.col("live_cache") == "measured", F.col("live")).otherwise(F.col("live_cold"))
    out = rows.withColumns({"churn_day": day, "live_now": live})
    return out.select("workload", "size", "churn", "e.edit_kind", "live_cache", C.break_even(F.col("live_now"), F.col("index"), F.col("other") + F.col("churn_day")).alias("break_even"), (F.col("churn_day") / (F.col("other") + F.col("churn_day"))).alias("reembed_share"))


def churn_star(other: Column, tokens: Column, usd_per_mtok: float, factor: Column) -> Column:
    """The fraction of text a day at which embedding again costs as much as the rest of the fixed cost; above 1 is never."""
    return other / C.churn_daily(tokens, 1.0, usd_per_mtok, factor)


def perturbed(points: DataFrame, regime: Column, knobs: list[tuple], fixed: Column) -> DataFrame:
    """points (workload, size, prefix, dynamic, output, hit_rate, prompt, index_output, and what ``fixed`` reads) under each knob
    (knob, setting, price, miss, infra, write or None, cached): live, index, fixed and break_even. ``fixed`` is the fixed
    daily cost, which the knob's infra multiplies."""
    fields = ("knob", "setting", "price", "miss", "infra", "write", "cached")
    kinds = ("string", "string", "double", "double", "double", "double", "boolean")
    one = lambda k: F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(fields, kinds, k, strict=True)])
    rows = points.select("*", F.explode(F.array(*map(one, knobs))).alias("k"))
    r = scaled(regime, F.col("k.price"), F.col("k.write"))
    hit = C.stretch_hit_rate(F.col("hit_rate"), F.col("k.miss"))
    args = (r, F.col("prefix"), F.col("dynamic"), F.col("output"), hit)
    live = F.when(F.col("k.cached"), C.live_query_cost(*args)).otherwise(C.live_query_cost(*args, cached=False))
    out = rows.withColumns({"live": live, "index": C.index_query_cost(r, F.col("prompt"), F.col("index_output")), "fixed": fixed * F.col("k.infra")})
    return out.withColumn("break_even", C.break_even(F.col("live"), F.col("index"), F.col("fixed"))).select("workload", "size", "k.knob", "k.setting", "live", "index", "fixed", "break_even")


def ranked(sweep: DataFrame, base: str = "base") -> DataFrame:
    """(workload, knob, spread, above, below, flips, infeasible, weakens, strengthens, changes) of a perturbed sweep, within
    each workload: the largest ratio of break-evens over the sizes, the base included, and what a knob pushes out of the
    band."""
    finite = F.col("break_even").isNotNull() & (F.col("break_even") < C.NEVER)
    knobs = sweep.where(F.col("knob") != base)
    names = knobs.select("workload", "knob").distinct()
    both = knobs.unionByName(sweep.where(F.col("knob") == base).drop("knob").join(names, "workload").select(*sweep.columns))
    spread = both.where(finite).groupBy("workload", "knob", "size").agg((F.max("break_even") / F.min("break_even")).alias("s")).groupBy("workload", "knob").agg(F.round(F.max("s"), 2).alias("spread"), F.coalesce(F.max("s") > 1.05, F.lit(False)).alias("changes"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = knobs.groupBy("workload", "knob").agg(has(F.col("break_even") >= BAND[1]).alias("above"), has(F.col("break_even") < BAND[0]).alias("below"), has(F.col("live") <= F.col("index")).alias("flips"), has(F.col("break_even").isNull()).alias("infeasible"))
    weak = F.col("above") | F.col("flips") | F.col("infeasible")
    out = flags.join(spread, ["workload", "knob"], "left")
    return out.select("workload", "knob", "spread", "above", "below", "flips", "infeasible", weak.alias("weakens"), (F.col("below") & ~weak).alias("strengthens"), F.coalesce("changes", F.lit(False)).alias("changes"))


def postdicted(points: DataFrame, pairs: dict[str, tuple[str, str]], tolerance: float = 0.10) -> DataFrame:
    """points with one row a basis (name: modelled and measured column): the relative error and whether it is within the
    tolerance; an unknown error is not."""
    bases = F.array(*[F.struct(F.lit(k).alias("basis"), F.col(a).alias("modelled"), F.col(b).alias("measured")) for k, (a, b) in pairs.items()])
    own = [c for c in points.columns if c not in {x for p in pairs.values() for x in p}]
    rows = points.select(*own, F.explode(bases).alias("b")).select(*own, "b.*")
    error = C.postdiction_error(F.col("modelled"), F.col("measured"))
    return rows.withColumn("rel_error", F.round(error, 4)).withColumn("within", F.coalesce(F.abs(error) <= tolerance, F.lit(False)))


def gate_passes(errors: DataFrame, tolerance: float, column: str = "rel_error") -> DataFrame:
    """One row (passes): all errors are known and within the tolerance."""
    return errors.agg(F.coalesce(F.bool_and(F.coalesce(F.abs(column) <= tolerance, F.lit(False))), F.lit(True)).alias("passes"))


def crossovers(costs: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """(by, low, high): neighbouring sizes, in order, between which the cheaper of live and index changes."""
    w = Window.partitionBy(*by).orderBy(order)
    cheaper = F.when(F.col("live") > F.col("index"), "index").otherwise("live")
    rows = costs.withColumn("cheaper", cheaper).select(*by, F.lag(size).over(w).alias("low"), F.col(size).alias("high"), F.lag("cheaper").over(w).alias("was"), "cheaper")
    return rows.where("was is not null and was != cheaper").select(*by, "low", "high")


def unseen_branches(points: DataFrame, a: str, b: str) -> DataFrame:
    """One row (f, band, k) from break-evens (size, arm, break_even): finite at every size, some or none (F1, F2, F3), all
    finite ones in the band (B1) or not (B2), and whether arm a's is below b's at every size (K1), is not at some (K2), or
    one is not finite (K3)."""
    finite = F.col("break_even").isNotNull() & (F.col("break_even") < C.NEVER)
    inside = (F.col("break_even") >= BAND[0]) & (F.col("break_even") < BAND[1])
    f = F.when(F.bool_and(finite), "F1").when(~F.bool_or(finite), "F3").otherwise("F2")
    band = F.when(F.coalesce(F.bool_and(F.when(finite, inside)), F.lit(True)), "B1").otherwise("B2")
    of = lambda arm: F.max(F.when((F.col("arm") == arm) & finite, F.col("break_even")))
    per = points.groupBy("size").agg(of(a).alias("x"), of(b).alias("y"))
    k = per.agg(F.when(F.bool_or(F.col("x").isNull() | F.col("y").isNull()), "K3").when(F.bool_and(F.col("x") < F.col("y")), "K1").otherwise("K2").alias("k"))
    return points.agg(f.alias("f"), band.alias("band")).crossJoin(k)


def hit_rate(reads: Column, writes: Column) -> Column:
    return F.coalesce(F.try_divide(reads, reads + writes), F.lit(0.0))


def cheaper_of(a: Column, b: Column, first: str, second: str) -> Column:
    return F.when(a < b, first).when(b < a, second).otherwise("tie")


def matched_sizes(left: DataFrame, right: DataFrame, band: float, first: str, second: str) -> DataFrame:
    """For scopes of two corpora (scope, tokens, first, second: mean costs of two arms) every pair: the ratio of their tokens,
    whether it is within the band, who is cheaper in each, and whether that agrees."""
    a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for df, p in ((left, "a"), (right, "b")))
    ratio = F.greatest("a_tokens", "b_tokens") / F.least("a_tokens", "b_tokens")
    both = a.crossJoin(F.broadcast(b)).withColumns({"ratio": ratio, "a_cheaper": cheaper_of(F.col(f"a_{first}"), F.col(f"a_{second}"), first, second), "b_cheaper": cheaper_of(F.col(f"b_{first}"), F.col(f"b_{second}"), first, second)})  # a few scopes
    return both.select("a_scope", "b_scope", F.round("ratio", 4).alias("ratio"), (F.col("ratio") <= band).alias("matched"), "a_cheaper", "b_cheaper", (F.col("a_cheaper") == F.col("b_cheaper")).alias("agree"))
