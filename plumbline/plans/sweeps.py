"""Queries of the cost model's sweeps and of index footprints, over suppliers as workloads of growing size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import cost as C
from plumbline.operators import footprint as P
from plumbline.operators import sensitivity as S
from plumbline.plans.corpus import regime
from plumbline.sources.tables import cut, table

EMBED = 0.02
KNOBS = [("base", "headline", 1.0, 1.0, 1.0, None, True), ("price", "x0.5", 0.5, 1.0, 1.0, None, True), ("price", "x1.5", 1.5, 1.0, 1.0, None, True), ("misses", "x2", 1.0, 2.0, 1.0, None, True), ("infra", "x2", 1.0, 1.0, 2.0, None, True), ("infra", "x0.1", 1.0, 1.0, 0.1, None, True), ("ttl", "5m", 1.0, 1.0, 1.0, 1.25, True), ("uncached", "list", 1.0, 1.0, 1.0, None, False)]


def points(spark, d) -> DataFrame:
    i = F.col("s_suppkey")
    own = table(spark, d, "supplier").select(F.concat(F.lit("w"), (i % 3).cast("string")).alias("workload"), i.alias("size"), (i * 12_000).cast("double").alias("tokens"))
    infra = C.infra_monthly(C.footprint_bytes(F.col("tokens") / 500, 1024, 3.5), "dedicated", 1.5, 16.0, 0.2, 5.0)
    other = C.fixed_daily(infra, C.embed_cost(F.col("tokens"), EMBED), 365.0, 0.0)
    return own.withColumns({"prefix": F.col("tokens"), "dynamic": F.lit(20.0), "output": F.lit(30.0), "hit_rate": F.lit(0.9), "prompt": F.lit(5000.0), "index_output": F.lit(30.0), "other": other})


def costed(spark, d) -> DataFrame:
    p, r = points(spark, d), regime()
    live = lambda hit: C.live_query_cost(r, F.col("prefix"), F.col("dynamic"), F.col("output"), hit)
    return p.withColumns({"live": live(F.col("hit_rate")), "live_cold": live(F.lit(0.0)), "index": C.index_query_cost(r, F.col("prompt"), F.col("index_output"))})


def rounded(df: DataFrame, be: str = "break_even") -> DataFrame:
    """Break-evens as a kind and a number: infinity does not travel well."""
    kind = F.when(F.col(be).isNull(), "infeasible").when(F.col(be) == C.NEVER, "never").otherwise("reached")
    return df.withColumn("kind", kind).withColumn(be, F.round(F.when(F.col(be) < C.NEVER, F.col(be)), 4))


def churn_sweep(spark, d):
    out = S.churn_sweep(costed(spark, d), [0.0, 0.01, 0.2], {"append": 1.0, "rewrite": 3.0}, EMBED)
    return rounded(out).withColumn("reembed_share", F.round("reembed_share", 6))


def churn_limits(spark, d):
    """The daily churn at which embedding costs as much as all else, by workload."""
    star = S.churn_star(F.col("other"), F.greatest("tokens", F.lit(1.0)), EMBED, F.lit(3.0))
    return points(spark, d).groupBy("workload").agg(F.round(F.min(star), 6).alias("least"), F.round(F.max(star), 4).alias("most"))


def swept(spark, d) -> DataFrame:
    return S.perturbed(points(spark, d), regime(), KNOBS, F.col("other"))


def knob_sweep(spark, d):
    out = rounded(swept(spark, d))
    return out.select("workload", "size", "knob", "setting", F.round("live", 9).alias("live"), F.round("index", 9).alias("index"), F.round("fixed", 9).alias("fixed"), "break_even", "kind")


def knob_ranking(spark, d):
    return S.ranked(cut(swept(spark, d), "knobs"))


def postdiction(spark, d):
    """Modelled against measured costs, on two bases; every eleventh measurement is off."""
    own = costed(spark, d).where("live is not null and size > 0")
    off = F.when(F.col("size") % 11 == 0, 1.3).otherwise(1.02)
    own = own.select("workload", "size", "live", "live_cold", (F.col("live") * off).alias("billed"), (F.col("live_cold") * 1.01).alias("listed"))
    out = S.postdicted(own, {"mean_billed": ("live", "billed"), "mean_list": ("live_cold", "listed")})
    return out.select("workload", "size", "basis", "rel_error", "within")


def postdiction_gate(spark, d):
    own = cut(postdiction(spark, d), "postdiction")
    return S.gate_passes(own.where("size % 11 > 0"), 0.1).withColumnRenamed("passes", "clean").crossJoin(S.gate_passes(own, 0.1))


def crossover_sizes(spark, d):
    return S.crossovers(costed(spark, d).where("live is not null"), ["workload"], "size", "size")


def branch_letters(spark, d):
    """Break-evens of two index arms of which one sends more context."""
    own = costed(spark, d)
    be = lambda index: C.break_even(F.col("live"), index, F.col("other"))
    arms = F.array(F.struct(F.lit("k10").alias("arm"), be(F.col("index")).alias("break_even")), F.struct(F.lit("k3").alias("arm"), be(F.col("index") * 0.5).alias("break_even")))
    rows = own.select("size", F.explode(arms).alias("a")).select("size", "a.*")
    return S.unseen_branches(rows, "k3", "k10")


def cache_rates(spark, d):
    """Hit rates and what caching saves, by priority of orders as requests."""
    own = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).otherwise(0)).alias("reads"), F.sum(F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey"))).alias("writes"))
    return own.select("o_orderpriority", F.round(S.hit_rate(F.col("reads"), F.coalesce("writes", F.lit(0))), 6).alias("hit_rate"))


def matched_corpora(spark, d):
    """Regions as scopes of two corpora, with mean costs of two arms."""
    own = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 4).alias("scope")).agg(F.sum("s_suppkey").alias("tokens"), F.round(F.avg("s_acctbal"), 4).alias("live"), F.round(F.percentile("s_acctbal", 0.5), 4).alias("index"))
    return S.matched_sizes(own.where("scope < 2"), own.where("scope >= 2"), 1.25, "live", "index")


def measured_arms(spark, d) -> DataFrame:
    """Parts' sizes as arms of an index: codes, segments, and bytes that the model explains but for a known rest."""
    n, dims, nlist = 100_000, 64, 16
    own = table(spark, d, "part").select(F.concat(F.lit("arm"), F.col("p_partkey").cast("string")).alias("arm"), (F.col("p_partkey") % 4).alias("t"), (F.col("p_partkey") % 5 + 1).alias("n_segments"))
    own = own.withColumns({"ivf": F.col("t") > 0, "rabitq": F.col("t") == 3, "pq_m": F.when(F.col("t") == 2, 16), "codes": F.when(F.col("t") == 0, 0).when(F.col("t") == 1, 64).when(F.col("t") == 2, 16).otherwise(8)})
    rest = F.when(F.col("rabitq"), 8 * n).otherwise(F.col("n_segments") * 100)
    index = F.when(F.col("ivf"), P.modelled(n, dims, nlist) + rest).otherwise(0).cast("bigint")
    own = own.withColumns({"index_files_bytes": index, "chunk_cache_bytes": F.when(F.col("ivf"), 0).otherwise(n * dims * 4).cast("bigint"), "segment_heap_bytes": (F.col("n_segments") * 50_000).cast("bigint")})
    return own.withColumn("loaded_bytes", F.col("index_files_bytes") + F.col("chunk_cache_bytes") + F.col("segment_heap_bytes"))


def footprint_factor(spark, d):
    return P.factor_bytes(measured_arms(spark, d), 100_000, 64, 16).select(F.round("factor", 6).alias("factor"), F.round("worst", 6).alias("worst"))


def footprint_parts(spark, d):
    return P.decompose(measured_arms(spark, d), 8.0, 100_000, 64, 16)


def footprint_inferred(spark, d):
    """The same with centroids inferred from what is left."""
    return P.decompose(measured_arms(spark, d), 7.9, 100_000, 64, 10**6, uniform=False).where("component = 'ivf_coarse_centroids'")


def scope_totals(spark, d):
    """Documents, characters and estimated tokens by language, with each one's share and a row for all."""
    own = table(spark, d, "documents").select("lang", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    total = own.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"), F.sum(F.ceil(F.col("n") / 4)).alias("tokens"))
    share = F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy()), 6)  # a row a language
    all_ = total.agg(F.lit("TOTAL").alias("lang"), F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.lit(1.0).alias("share"))
    return total.withColumn("share", share).union(all_)


def skip_rates(spark, d):
    """Share of chunks that an edit leaves as they are: text put at the end, and text put in the middle."""
    from plumbline.functions.text import chunks

    own = table(spark, d, "documents").where("text is not null and length(text) > 4000").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    end, middle = F.concat("text", F.lit(" more")), F.concat(F.substring("text", F.lit(1), half), F.lit(" more"), F.substring("text", half + 1, F.length("text")))
    was = chunks(F.col("text"), 1800, 200)
    kept = lambda now: F.size(F.array_intersect(was, now))
    out = own.select(F.size(F.array_distinct(was)).alias("n"), kept(chunks(end, 1800, 200)).alias("e"), kept(chunks(middle, 1800, 200)).alias("m"))
    return out.agg(F.round(F.sum("e") / F.sum("n"), 6).alias("tail_append"), F.round(F.sum("m") / F.sum("n"), 6).alias("mid_edit"))


QUERIES = {f.__name__: f for f in (churn_sweep, churn_limits, knob_sweep, knob_ranking, postdiction, postdiction_gate, crossover_sizes, branch_letters, cache_rates, matched_corpora, footprint_factor, footprint_parts, footprint_inferred, scope_totals, skip_rates)}


def _live(prefix: str, hit: str, price: str = "1.0", write: str = "2.0", cached: bool = True) -> str:
    """USD of a live query, null beyond the window."""
    long = f"({prefix} + 20 > 272000)"
    pay = f"({hit} * CASE WHEN {long} THEN 0.4 ELSE 0.2 END + (1 - {hit}) * CASE WHEN {long} THEN 4.0 ELSE 2.0 * {write} END)" if cached else f"CASE WHEN {long} THEN 4.0 ELSE 2.0 END"
    return f"CASE WHEN {prefix} + 20 <= 1000000 THEN ({prefix} * {pay} + 20 * CASE WHEN {long} THEN 4.0 ELSE 2.0 END + 30 * CASE WHEN {long} THEN 12.0 ELSE 10.0 END) / 1e6::DOUBLE * {price} END"


_POINTS = f"""p AS (SELECT 'w' || s_suppkey % 3 AS workload, s_suppkey AS size, (s_suppkey * 12000)::DOUBLE AS tokens FROM supplier),
t AS (SELECT *, {_live('tokens', '0.9')} AS live, {_live('tokens', '0.0')} AS live_cold, (5000 * 2.0 + 30 * 10.0)::DOUBLE / 1e6 AS index, greatest(1.0, ceil(tokens / 500 * 1024 * 4 / 3.5 * 1.5 / 1073741824 / 16.0)) * 0.2 * 730.5 / 30.4375 + tokens / 1e6 * 0.02 / 365.0 AS other FROM p)"""
_BE = "CASE WHEN {live} IS NULL THEN NULL WHEN {live} - {index} <= 0 THEN 'inf'::DOUBLE ELSE ({fixed}) / ({live} - {index}) END"
_KIND = "CASE WHEN be IS NULL THEN 'infeasible' WHEN be = 'inf' THEN 'never' ELSE 'reached' END AS kind, round(CASE WHEN be < 'inf' THEN be END, 4) AS break_even"
_KNOBS = " UNION ALL ".join(
    f"SELECT workload, size, '{knob}' AS knob, '{setting}' AS setting, {_live('tokens', f'least(1.0, greatest(0.0, 1 - (1 - 0.9) * {miss}))', str(price), str(write or 2.0), cached)} AS live, (5000 * 2.0 + 30 * 10.0)::DOUBLE / 1e6 * {price} AS index, other * {infra} AS fixed FROM t"
    for knob, setting, price, miss, infra, write, cached in KNOBS
)
_SWEPT = f"WITH {_POINTS}, k AS ({_KNOBS}), s AS (SELECT *, {_BE.format(live='live', index='index', fixed='fixed')} AS be FROM k)"
_ARMS = """a AS (SELECT 'arm' || p_partkey AS arm, p_partkey % 4 AS t, p_partkey % 5 + 1 AS seg FROM part),
b AS (SELECT *, [0, 64, 16, 8][t + 1] AS codes, CASE WHEN t = 2 THEN seg * 16 * 256 * 4 * 4 ELSE 0 END AS book FROM a),
c AS (SELECT *, CASE WHEN t > 0 THEN 100000 * codes + seg * 16 * 64 * 4 + 800000 + book + CASE WHEN t = 3 THEN 800000 ELSE seg * 100 END ELSE 0 END AS idx, CASE WHEN t = 0 THEN 25600000 ELSE 0 END AS cache, seg * 50000 AS heap FROM b)"""
_ROW = 'SELECT arm, component, bytes::BIGINT AS bytes, round(bytes / 100000.0::DOUBLE, 2) AS bytes_per_vector, round(bytes / (idx + cache + heap)::DOUBLE, 4) AS share, basis FROM u'
_CHUNKED = "list_transform(range(0, CASE WHEN length({0}) <= 1800 THEN 1 ELSE ceil((length({0}) - 200) / 1600.0)::BIGINT END), lambda i: substr({0}, i * 1600 + 1, 1800))"

SQL = {
    "churn_sweep": f"""WITH {_POINTS}, g AS (SELECT * FROM t, (SELECT unnest([0.0, 0.01, 0.2])::DOUBLE AS churn), (VALUES ('append', 1.0::DOUBLE), ('rewrite', 3.0::DOUBLE)) e(edit_kind, factor), (SELECT unnest(['measured', 'invalidated']) AS live_cache)),
x AS (SELECT *, tokens * churn * factor / 1e6 * 0.02 AS day, CASE live_cache WHEN 'measured' THEN live ELSE live_cold END AS l FROM g), s AS (SELECT *, {_BE.format(live='l', index='index', fixed='other + day')} AS be FROM x)
SELECT workload, size, churn, edit_kind, live_cache, round(day / (other + day), 6) AS reembed_share, {_KIND} FROM s""",
    "churn_limits": f"WITH {_POINTS}, x AS (SELECT workload, other / (greatest(tokens, 1) * 3.0 / 1e6 * 0.02) AS star FROM t) SELECT workload, round(min(star), 6) AS least, round(max(star), 4) AS most FROM x GROUP BY workload",
    "knob_sweep": f"{_SWEPT} SELECT workload, size, knob, setting, round(live, 9) AS live, round(index, 9) AS index, round(fixed, 9) AS fixed, {_KIND} FROM s",
    "knob_ranking": f"""{_SWEPT}, n AS (SELECT DISTINCT workload, knob FROM s WHERE knob != 'base'), u AS (SELECT workload, knob, size, be FROM s WHERE knob != 'base' UNION ALL SELECT s.workload, n.knob, size, be FROM s JOIN n USING (workload) WHERE s.knob = 'base'),
r AS (SELECT workload, knob, size, max(be) / min(be) AS q FROM u WHERE be < 'inf' GROUP BY ALL), w AS (SELECT workload, knob, round(max(q), 2) AS spread, max(q) > 1.05 AS changes FROM r GROUP BY ALL),
f AS (SELECT workload, knob, coalesce(bool_or(be >= 1000), false) AS above, coalesce(bool_or(be < 10), false) AS below, coalesce(bool_or(live <= index), false) AS flips, bool_or(be IS NULL) AS infeasible FROM s WHERE knob != 'base' GROUP BY ALL)
SELECT workload, knob, spread, above, below, flips, infeasible, above OR flips OR infeasible AS weakens, below AND NOT (above OR flips OR infeasible) AS strengthens, coalesce(changes, false) AS changes FROM f LEFT JOIN w USING (workload, knob)""",
    "postdiction": f"""WITH {_POINTS}, o AS (SELECT * FROM t WHERE live IS NOT NULL AND size > 0), e AS (SELECT workload, size, 'mean_billed' AS basis, (live - live * m) / (live * m) AS err FROM (SELECT *, CASE WHEN size % 11 = 0 THEN 1.3 ELSE 1.02 END::DOUBLE AS m FROM o) UNION ALL SELECT workload, size, 'mean_list', (live_cold - live_cold * 1.01::DOUBLE) / (live_cold * 1.01::DOUBLE) FROM o)
SELECT workload, size, basis, round(err, 4) AS rel_error, abs(err) <= 0.1 AS within FROM e""",
    "postdiction_gate": f"WITH {_POINTS} SELECT true AS clean, count(*) FILTER (size > 0 AND live IS NOT NULL AND size % 11 = 0) = 0 AS passes FROM t",
    "crossover_sizes": f"WITH {_POINTS}, x AS (SELECT workload, size, live > index AS c, lag(live > index) OVER w AS was, lag(size) OVER w AS low FROM t WHERE live IS NOT NULL WINDOW w AS (PARTITION BY workload ORDER BY size)) SELECT workload, low, size AS high FROM x WHERE was IS NOT NULL AND was != c",
    "branch_letters": f"""WITH {_POINTS}, o AS (SELECT size, {_BE.format(live='live', index='index', fixed='other')} AS k10, {_BE.format(live='live', index='(index * 0.5)', fixed='other')} AS k3 FROM t), u AS (SELECT size, k10 AS be FROM o UNION ALL SELECT size, k3 FROM o)
SELECT CASE WHEN bool_and(coalesce(be < 'inf', false)) THEN 'F1' WHEN NOT bool_or(coalesce(be < 'inf', false)) THEN 'F3' ELSE 'F2' END AS f, CASE WHEN coalesce(bool_and(be >= 10 AND be < 1000) FILTER (be < 'inf'), true) THEN 'B1' ELSE 'B2' END AS band,
(SELECT CASE WHEN bool_or(NOT coalesce(k3 < 'inf' AND k10 < 'inf', false)) THEN 'K3' WHEN bool_and(k3 < k10) THEN 'K1' ELSE 'K2' END FROM o) AS k FROM u""",
    "cache_rates": "WITH x AS (SELECT o_orderpriority, sum(CASE WHEN o_custkey % 3 > 0 THEN o_custkey ELSE 0 END) AS r, coalesce(sum(o_orderkey) FILTER (o_custkey % 3 = 0), 0) AS w FROM orders GROUP BY 1) SELECT o_orderpriority, round(coalesce(r / nullif(r + w, 0), 0), 6)::DOUBLE AS hit_rate FROM x",
    "matched_corpora": """WITH o AS (SELECT s_nationkey % 4 AS scope, sum(s_suppkey) AS tokens, round(avg(s_acctbal), 4) AS live, round(quantile_cont(s_acctbal, 0.5), 4) AS idx FROM supplier GROUP BY 1), c AS (SELECT *, CASE WHEN live < idx THEN 'live' WHEN idx < live THEN 'index' ELSE 'tie' END AS cheaper FROM o)
SELECT a.scope AS a_scope, b.scope AS b_scope, round(greatest(a.tokens, b.tokens)::DOUBLE / least(a.tokens, b.tokens), 4) AS ratio, greatest(a.tokens, b.tokens)::DOUBLE / least(a.tokens, b.tokens) <= 1.25 AS matched, a.cheaper AS a_cheaper, b.cheaper AS b_cheaper, a.cheaper = b.cheaper AS agree FROM c a, c b WHERE a.scope < 2 AND b.scope >= 2""",
    "footprint_factor": f"WITH {_ARMS} SELECT round(avg((idx - (100000 * codes + seg * 16 * 64 * 4 + 800000 + book)) / 100000.0::DOUBLE) FILTER (t = 3), 6) AS factor, round(max(abs(idx - (100000 * codes + seg * 16 * 64 * 4 + 800000 + book)) / 100000.0::DOUBLE) FILTER (t IN (1, 2)), 6) AS worst FROM c",
    "footprint_parts": f"""WITH {_ARMS}, u AS (SELECT *, 'vector_chunk_cache' AS component, cache AS bytes, 'measured' AS basis FROM c WHERE cache > 0 UNION ALL SELECT *, 'quantized_codes', 100000 * codes, 'derived' FROM c WHERE t > 0 UNION ALL SELECT *, 'pq_codebook', book, 'derived' FROM c WHERE book > 0
UNION ALL SELECT *, 'row_ids', 800000, 'derived' FROM c WHERE t > 0 UNION ALL SELECT *, 'rabitq_per_vector_factors', 800000, 'derived' FROM c WHERE t = 3 UNION ALL SELECT *, 'ivf_coarse_centroids', seg * 16 * 64 * 4, 'derived' FROM c WHERE t > 0 UNION ALL SELECT *, 'unexplained_residual', seg * 100, 'residual' FROM c WHERE t IN (1, 2) UNION ALL SELECT *, 'segment_heap', heap, 'measured' FROM c) {_ROW}""",
    "footprint_inferred": f"WITH {_ARMS}, u AS (SELECT *, 'ivf_coarse_centroids' AS component, idx - 100000 * codes - book - 800000 - CASE WHEN t = 3 THEN 790000 ELSE 0 END AS bytes, 'inferred' AS basis FROM c WHERE t > 0) {_ROW}",
    "scope_totals": "WITH o AS (SELECT lang, count(*) AS docs, sum(length(coalesce(text, '')))::BIGINT AS chars, sum(ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS tokens FROM documents GROUP BY lang) SELECT lang, docs, chars, tokens, round(chars / (SELECT sum(chars) FROM o), 6)::DOUBLE AS share FROM o UNION ALL SELECT 'TOTAL', sum(docs), sum(chars), sum(tokens), 1.0 FROM o",
    "skip_rates": f"""WITH o AS (SELECT text AS t, text || ' more' AS e, substr(text, 1, length(text) // 2) || ' more' || substr(text, length(text) // 2 + 1) AS m FROM documents WHERE length(text) > 4000), c AS (SELECT {_CHUNKED.format('t')} AS t, {_CHUNKED.format('e')} AS e, {_CHUNKED.format('m')} AS m FROM o)
SELECT round(sum(len(list_intersect(t, e))) / sum(len(list_distinct(t))), 6)::DOUBLE AS tail_append, round(sum(len(list_intersect(t, m))) / sum(len(list_distinct(t))), 6)::DOUBLE AS mid_edit FROM c""",
}
