"""The cost model of indexed against live search as Columns; infeasible is null, never is infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_MONTH, HOURS_PER_MONTH = 30.4375, 730.5
GIB = float(1 << 30)
NEVER = float("inf")


def c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rates(regime: Column, tokens: Column) -> Column:
    """(input, write, read, output) USD per million tokens; a request above the long-context threshold is priced as a
    whole by the long tier. regime has input, output, write_multiplier, read_multiplier, long_threshold, long_input,
    long_cached, long_output."""
    long = regime["long_threshold"].isNotNull() & (tokens > regime["long_threshold"])
    pick = lambda a, b: F.when(long, a).otherwise(b)
    return F.struct(
        pick(regime["long_input"], regime["input"]).alias("input"),
        pick(regime["long_input"], regime["input"] * regime["write_multiplier"]).alias("write"),
        pick(regime["long_cached"], regime["input"] * regime["read_multiplier"]).alias("read"),
        pick(regime["long_output"], regime["output"]).alias("output"),
    )


def live_query_cost(regime: Column, prefix, dynamic, output, hit_rate, cached: bool = True) -> Column:
    """USD of a query with the corpus as prefix; null beyond the context window."""
    total = c(prefix) + c(dynamic)
    r = rates(regime, total)
    per_prefix = c(hit_rate) * r["read"] + (1 - c(hit_rate)) * r["write"] if cached else r["input"]
    usd = (c(prefix) * per_prefix + c(dynamic) * r["input"] + c(output) * r["output"]) / 1e6
    return F.when(total <= regime["window"], usd)


def index_query_cost(regime: Column, prompt, output) -> Column:
    """USD of a query with retrieved context, uncached; null beyond the context window."""
    r = rates(regime, c(prompt))
    return F.when(c(prompt) <= regime["window"], (c(prompt) * r["input"] + c(output) * r["output"]) / 1e6)


def raw_bytes(n, dims) -> Column:
    return c(n).cast("double") * c(dims) * 4


def footprint_bytes(n, dims, multiplier) -> Column:
    """Index bytes from a compression multiplier; null unless it is positive."""
    return F.when(c(multiplier) > 0, raw_bytes(n, dims) / c(multiplier))


def infra_monthly(footprint, mode, headroom, instance_gib, usd_per_hour, usd_per_gib_month) -> Column:
    """Monthly USD: whole instances that hold the index with headroom, or memory by the GiB."""
    need = c(footprint) * c(headroom) / GIB
    whole = F.greatest(F.lit(1.0), F.ceil(need / c(instance_gib)).cast("double")) * c(usd_per_hour) * HOURS_PER_MONTH
    return F.when(c(mode) == "dedicated", whole).when(c(mode) == "shared", need * c(usd_per_gib_month))


def embed_cost(tokens, usd_per_mtok) -> Column:
    return c(tokens) / 1e6 * c(usd_per_mtok)


def churn_daily(corpus_tokens, fraction, usd_per_mtok, factor=1.0) -> Column:
    """USD a day to embed changed text again; null for a fraction outside 0 to 1."""
    return F.when(c(fraction).between(0, 1), embed_cost(c(corpus_tokens) * c(fraction) * c(factor), usd_per_mtok))


def fixed_daily(infra, embed_once, amortisation_days, churn) -> Column:
    return c(infra) / DAYS_PER_MONTH + c(embed_once) / c(amortisation_days) + c(churn)


def break_even(live, index, fixed) -> Column:
    """Queries a day from which the index is cheaper: null if a cost is infeasible, infinity if it never is."""
    saving = c(live) - c(index)
    return F.when(saving.isNull() | c(fixed).isNull(), F.lit(None).cast("double")).when(saving <= 0, F.lit(NEVER)).otherwise(c(fixed) / saving)


def payback_days(one_off, fixed, per_day, live, index) -> Column:
    saving = c(per_day) * (c(live) - c(index)) - c(fixed)
    return F.when(saving.isNull(), F.lit(None).cast("double")).when(saving <= 0, F.lit(NEVER)).otherwise(c(one_off) / saving)


def postdiction_error(modelled, measured) -> Column:
    """Signed relative error; null where either is null or the measured cost is 0."""
    return F.when(c(measured) != 0, (c(modelled) - c(measured)) / c(measured))


def stretch_hit_rate(hit_rate, factor) -> Column:
    """A hit rate whose misses are multiplied, within 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (1 - c(hit_rate)) * c(factor)))


def prompt_tokens(usage: Column) -> Column:
    z = lambda n: F.coalesce(usage[n], F.lit(0))
    return z("input_tokens") + z("cache_read_input_tokens") + z("cache_creation_input_tokens")


def billed(usage: Column, price: Column) -> Column:
    """USD billed with cache writes and reads, to six places; missing counters are 0."""
    z = lambda n: F.coalesce(usage[n], F.lit(0))
    sent = z("input_tokens") + z("cache_creation_input_tokens") * price["write_multiplier"] + z("cache_read_input_tokens") * price["read_multiplier"]
    return F.round((sent * price["input"] + z("output_tokens") * price["output"]) / 1e6, 6)


def listed(usage: Column, price: Column) -> Column:
    """USD of all input at list price, to six places."""
    return F.round((prompt_tokens(usage) * price["input"] + F.coalesce(usage["output_tokens"], F.lit(0)) * price["output"]) / 1e6, 6)
