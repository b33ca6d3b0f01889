"""Samples, selections and orders that any engine can repeat: order by md5 of a seed and a key, then greedy rules.

Greedy choices depend on what was taken before. Those of strata fold over their candidates in rounds of bounded size; those of
pairs over all candidates, which are questions and not documents: ``MOST`` bounds them, and more fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import number_rows
from plumbline.sources.tables import cut

MOST = 100_000
#: Candidates of a stratum that are folded over in one round.
POOL = 10_000


def shuffled(seed: int | str, *keys: Column) -> Column:
    """What to order by for an order that depends on the seed and the keys alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """n rows of df by a seeded order of their keys; fails if there are fewer."""
    rows = df.orderBy(shuffled(seed, F.col(key)), key).limit(n)
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"only {have} rows; cannot draw {n}")
    return rows


def main_and_sanity(df: DataFrame, key: str, passes: Column, n_main: int, n_sanity: int, seed: int) -> DataFrame:
    """(key, part): a main draw from the rows that pass, and a sanity draw from all rows that are not in it."""
    main = draw(df.where(passes).select(key), key, n_main, f"{seed}:main")
    rest = draw(df.select(key).join(main, key, "left_anti"), key, n_sanity, f"{seed}:sanity")
    return main.withColumn("part", F.lit("main")).union(rest.withColumn("part", F.lit("sanity")))


def disjoint_quota(candidates: DataFrame, stratum: str, key: str, evidence: str, quotas: dict[str, int], seed: int, block: int = POOL) -> DataFrame:
    """(stratum, key): each stratum's candidates in a seeded order, until its quota is full; one whose evidence (an array)
    overlaps that of a taken one of its stratum is passed over. Fails if a quota is not filled. A task folds over ``block`` candidates
    at a time, which only bounds its memory: strata may have any number."""
    kind, seen = candidates.schema[key].dataType.simpleString(), candidates.schema[evidence].dataType.simpleString()
    label = candidates.schema[stratum].dataType.simpleString()
    own = candidates.where(F.col(stratum).isin(list(quotas)))
    own = cut(own.select(F.col(stratum).alias("part"), F.struct(shuffled(seed, F.col(key)).alias("at"), F.col(key).alias("key")).alias("place"), F.col(evidence).alias("evidence")), "quota-candidates")
    none = F.array()
    start = candidates.sparkSession.createDataFrame(list(quotas.items()), f"part {label}, quota int")
    state = start.select("part", "quota", none.cast(f"array<{kind}>").alias("taken"), none.cast(seen).alias("seen"))

    def step(a: Column, x: Column) -> Column:
        ok = (F.size(a["taken"]) < F.col("quota")) & ~F.coalesce(F.arrays_overlap(a["seen"], x["evidence"]), F.lit(False))
        return F.struct(F.when(ok, F.concat(a["taken"], F.array(x["place"]["key"]))).otherwise(a["taken"]).alias("taken"), F.when(ok, F.concat(a["seen"], x["evidence"])).otherwise(a["seen"]).alias("seen"))

    # What is passed over once is passed over for good, so the candidates after those of a round that overlap nothing taken are
    # all that the next round can take from; the first of them is taken, which bounds the rounds by the quotas.
    while True:
        fits = own.join(F.broadcast(state), "part").where((F.size("taken") < F.col("quota")) & ~F.coalesce(F.arrays_overlap("seen", "evidence"), F.lit(False)))
        fits = fits.where(~F.array_contains("taken", F.col("place.key")))
        first = fits.select("part", "place", "evidence", F.row_number().over(Window.partitionBy("part").orderBy("place")).alias("_n")).where(F.col("_n") <= block)
        pools = first.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "evidence"))).alias("pool"))
        grown = F.aggregate("pool", F.struct("taken", "seen"), step)
        after = state.join(pools, "part", "left").select("part", "quota", F.when(F.col("pool").isNull(), F.struct("taken", "seen")).otherwise(grown).alias("s"), F.coalesce(F.size("pool"), F.lit(0)).alias("n"))
        after = cut(after.select("part", "quota", "s.taken", "s.seen", "n"), "quota-taken")
        state = after.drop("n")
        if not after.where((F.size("taken") < F.col("quota")) & (F.col("n") >= block)).take(1):
            break
    short = F.size("taken") < F.col("quota")
    full = F.when(short, F.raise_error(F.concat(F.lit("stratum not filled: "), F.col("part"))).cast(f"array<{kind}>")).otherwise(F.col("taken"))
    return state.select(F.col("part").alias(stratum), F.explode(full).alias(key))


def interleaved(keys: DataFrame, key: str, arms: list[str], seed: int) -> DataFrame:
    """(position, round, arm, key): arms take turns, each in its own order of the keys. The order within an arm is by hash, in
    parts that sort on their own, so no arm's keys meet in one task."""
    own = keys.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, arms))).alias("at", "arm"))
    own = own.withColumn("order", shuffled(seed, F.col("arm"), F.col("at"), F.col(key)))
    ranked = number_rows(own, ["arm", "order", key])
    first = ranked.groupBy("arm").agg(F.min("row_id").alias("first"))
    out = ranked.join(F.broadcast(first), "arm").withColumn("round", F.col("row_id") - F.col("first"))  # one row an arm
    return out.select((F.col("round") * len(arms) + F.col("at")).alias("position"), "round", "arm", key)


def cross(left: DataFrame, right: DataFrame, a: str, b: str, sep: str, seed: int) -> DataFrame:
    """(name, order) of all combinations of two lists of names, in a seeded order. For name lists, not for tables."""
    both = left.select(a).crossJoin(F.broadcast(right.select(b).limit(MOST)))
    name = F.concat(F.col(a), F.lit(sep), F.col(b))
    return both.select(name.alias("name"), shuffled(seed, name).alias("order"))


def seeded_uuid(seed: int | str, *keys: Column) -> Column:
    """A version 4 UUID from the hash of a seed and keys."""
    h = shuffled(seed, *keys)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def weekdays(start: Column, n: Column) -> Column:
    """The first n days from start that are Monday to Friday, as an array."""
    days = F.sequence(start, F.date_add(start, (n * 7 / 5 + 7).cast("int")))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), F.lit(1), n.cast("int"))


def train_without(train: DataFrame, held: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """n distinct questions of train that do not occur in held, in a seeded order; key is what tells questions apart."""
    own = train.withColumn("_key", key).dropDuplicates(["_key"])
    rest = own.join(held.withColumn("_key", key).select("_key").distinct(), "_key", "left_anti")
    return rest.orderBy(shuffled(seed, F.col("_key")), "_key").limit(n).drop("_key")


def capped_pairs(candidates: DataFrame, n: int, cap: int) -> DataFrame:
    """(row_a, row_b, page, bridge) of candidates (place, row_a, page, bridges: array of (bridge, row_b)) in order of place:
    the first bridge of each that is not used up, with no title used more often than cap in either role, until n are found.
    """
    if candidates.count() > MOST:
        raise ValueError(f"more than {MOST} candidates")

    def run(pdf):
        import pandas as pd

        used: dict[str, int] = {}
        out = []
        for r in pdf.sort_values("place").itertuples():
            if len(out) >= n:
                break
            if used.get(r.page, 0) >= cap:
                continue
            for b in r.bridges:
                if used.get(b["bridge"], 0) < cap:
                    out.append((r.row_a, b["row_b"], r.page, b["bridge"]))
                    for title in (r.page, b["bridge"]):
                        used[title] = used.get(title, 0) + 1
                    break
        return pd.DataFrame(out, columns=["row_a", "row_b", "page", "bridge"])

    return candidates.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "row_a bigint, row_b bigint, page string, bridge string")


def title_shares(pairs: DataFrame) -> DataFrame:
    """(title, n, share) of the titles of pairs in either role, the share of all pairs."""
    total = pairs.agg(F.count("*").alias("total"))
    own = pairs.select(F.explode(F.array("page", "bridge")).alias("title")).groupBy("title").agg(F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(total)).select("title", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
