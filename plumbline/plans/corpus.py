"""Queries over texts: answers, chunks, token frequencies, reference graphs, and the cost model over a grid."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import cost as C
from plumbline.functions import text as X
from plumbline.functions import titles as N
from plumbline.operators import graph as G
from plumbline.sources.tables import cut, table

SIZE, OVERLAP = 1800, 200
WINDOW = 1_000_000


def normalised_answers(spark, d):
    own = table(spark, d, "conversations")
    return own.select("conv_id", "turn", F.md5(X.normalise_answer(F.col("text"))).alias("answer"), X.is_decline(F.col("text")).alias("declines"))


def turn_f1(spark, d):
    """Token F1 and exact match of each turn with the one before in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("gold")).where("gold is not null")
    return own.select("conv_id", "turn", F.round(X.f1(F.col("text"), F.array("gold")), 9).alias("f1"), X.exact_match(F.col("text"), F.array("gold")).alias("em"))


def norm_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.norm_text("text").alias("norm"))


def answers_present(spark, d):
    """Turns of each conversation that have one of two golds, as part of their text, and as a word of it."""
    golds = F.array(X.norm_text(F.lit("The")), X.norm_text(F.lit("ên")))
    own = table(spark, d, "conversations").select("conv_id", X.norm_text("text").alias("norm"), golds.alias("golds"))
    texts, subset = F.array("norm"), F.when(F.col("conv_id") % 2 == 0, "main").otherwise("sanity")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return own.groupBy("conv_id").agg(count(X.answer_present(F.col("golds"), texts), "n"), count(X.answer_present_words(F.col("golds"), texts), "n_words"), count(X.in_primary(F.col("golds"), texts, subset), "n_primary"))


def chunks(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), SIZE, OVERLAP)).alias("chunk", "body"))
    return own.select("doc_id", "chunk", F.md5("body").alias("digest"), F.length("body").alias("n_chars"))


def chunk_counts(spark, d):
    """Chunks by source as predicted from lengths, and as made."""
    own = table(spark, d, "documents")
    return own.groupBy("source").agg(F.sum(X.chunk_count(F.col("text"), SIZE, OVERLAP)).alias("predicted"), F.sum(F.size(X.chunks(F.col("text"), SIZE, OVERLAP)).cast("bigint")).alias("made"))


def chunk_rows(spark, d):
    """Chunks with consecutive numbers over documents and their places."""
    own = table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), SIZE, OVERLAP)).alias("chunk", "body")).select("doc_id", "chunk")
    return G.number_rows(own, ["doc_id", "chunk"])


def first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.first_sentence(F.col("text"))).alias("digest"))


def token_frequencies(spark, d):
    own = table(spark, d, "conversations").select(X.code_tokens(F.col("text")).alias("tokens"))
    return G.document_frequencies(own, "tokens")


def rare_tokens(spark, d):
    """For each turn the largest ln(n / (1 + df)) over its tokens: how good a handle its rarest token is for a search."""
    own = table(spark, d, "conversations").select("conv_id", "turn", X.code_tokens(F.col("text")).alias("tokens"))
    n = own.count()
    df = cut(G.document_frequencies(own, "tokens"), "token-frequencies")
    each = own.select("conv_id", "turn", F.explode_outer("tokens").alias("token")).join(df, "token", "left")
    return each.groupBy("conv_id", "turn").agg(F.round(F.coalesce(F.max(F.log(F.lit(float(n)) / (1 + F.col("df")))), F.lit(0.0)), 9).alias("handle"))


def threads(spark, d) -> DataFrame:
    """Parts as threads that refer to others by number; references in code do not count."""
    own = table(spark, d, "part").select(F.col("p_partkey").alias("number"))
    refs = F.concat(F.lit("Fixed by #"), F.col("number") * 2, F.lit(" and (#"), F.col("number") * 3 + 1, F.lit(") `#7` a/b#9 ```#8"))
    return own.select("number", refs.alias("text"))


def reference_edges(spark, d):
    return G.build_graph(threads(spark, d))


def reference_chains(spark, d):
    own = threads(spark, d)
    edges = cut(G.build_graph(own), "edges")
    paths = G.extract_chains(own.select("number"), edges)
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").alias("n"), X.hop_class(F.size("path")).alias("stratum"))


def chain_heads(spark, d):
    own = threads(spark, d)
    edges = cut(G.build_graph(own), "edges")
    best = G.one_per_head(G.extract_chains(own.select("number"), edges))
    return best.select("head", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def page_paths(spark, d):
    """Paths of pages without scheme and host, and whether they name text files."""
    path = X.normalise_path(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""))
    return table(spark, d, "pages").select("page_id", path.alias("path"), F.coalesce(X.is_text_file(path), F.lit(False)).alias("is_text"))


def title_bridges(spark, d):
    """Parts as pages whose text names the next part and itself."""
    own = table(spark, d, "part").select("p_partkey", "p_name")
    after = own.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    text = F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" stands beside a "), F.upper("next"), F.lit(", like any "), F.col("next"), F.lit("."))
    pages = own.join(after, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("page"), text.alias("text"))
    return N.bridges(pages, own.select(F.col("p_name").alias("title"))).select("id", F.array_join("bridges", "|").alias("bridges"))


def redacted_reasons(spark, d):
    """Turns whose quotes of the turn before are taken out, by conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, d, "conversations").select("conv_id", F.concat(F.substring("text", 1, 40), F.lit(" end")).alias("text"), F.lag("text").over(w).alias("passages"))
    return own.groupBy("conv_id").agg(F.count(F.when(N.redact("text", "passages") != F.col("text"), 1)).alias("n_redacted"), F.count("*").alias("n"))


def regime(i: str = "2.0", o: str = "10.0") -> Column:
    lit = lambda v: F.lit(v).cast("double")
    return F.struct(lit(2.0).alias("input"), lit(10.0).alias("output"), lit(2.0).alias("write_multiplier"), lit(0.1).alias("read_multiplier"), lit(272_000).alias("long_threshold"), lit(4.0).alias("long_input"), lit(0.4).alias("long_cached"), lit(12.0).alias("long_output"), lit(WINDOW).alias("window"))


def cost_grid(spark, d):
    """Break-even of an index against live search for suppliers as workloads, over hit rates and footprints."""
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("workload"), (F.col("s_suppkey") * 12_000).cast("double").alias("prefix"))
    own = own.select("*", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.9))).alias("hit_rate")).select("*", F.explode(F.array(F.lit(1.0), F.lit(3.5), F.lit(8.66))).alias("footprint"))
    r = regime()
    live = C.live_query_cost(r, F.col("prefix"), 20.0, 30.0, F.col("hit_rate"))
    index = C.index_query_cost(r, 5000.0, 30.0)
    infra = C.infra_monthly(C.footprint_bytes(F.col("prefix") / 500, 1024, F.col("footprint")), "dedicated", 1.5, 16.0, 0.2, 5.0)
    fixed = C.fixed_daily(infra, C.embed_cost(F.col("prefix"), 0.02), 365.0, C.churn_daily(F.col("prefix"), 0.01, 0.02))
    out = own.select("workload", "hit_rate", "footprint", live.alias("live"), index.alias("index"), fixed.alias("fixed"))
    be = C.break_even(F.col("live"), F.col("index"), F.col("fixed"))
    return out.select("workload", "hit_rate", "footprint", F.round("live", 9).alias("live"), F.round("index", 9).alias("index"), F.round("fixed", 9).alias("fixed"), F.when(be == C.NEVER, "never").when(be.isNull(), "infeasible").otherwise("reached").alias("kind"), F.round(F.when(be < C.NEVER, be), 6).alias("break_even"))


def billed_costs(spark, d):
    """Billed and listed cost of orders as requests, with the share that caching saves, by priority."""
    own = table(spark, d, "orders").select("o_orderpriority", F.struct((F.col("o_orderkey") % 9000).alias("input_tokens"), (F.col("o_orderkey") % 700).alias("output_tokens"), (F.col("o_custkey") % 5000).alias("cache_creation_input_tokens"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") * 10).alias("cache_read_input_tokens")).alias("usage"))
    out = own.select("o_orderpriority", C.billed(F.col("usage"), regime()).alias("b"), C.listed(F.col("usage"), regime()).alias("l")).groupBy(F.col("o_orderpriority").alias("arm"))
    out = out.agg(F.count("*").alias("n"), F.round(F.sum("b"), 4).alias("billed"), F.round(F.sum("l"), 4).alias("listed"))
    return out.withColumn("saved", F.round(1 - F.col("billed") / F.col("listed"), 6))


QUERIES = {f.__name__: f for f in (normalised_answers, turn_f1, norm_text, answers_present, chunks, chunk_counts, chunk_rows, first_sentences, token_frequencies, rare_tokens, reference_edges, reference_chains, chain_heads, page_paths, cost_grid, billed_costs, title_bridges, redacted_reasons)}

#: Letters with a mark as the letter and a blank, which is what NFKD and the fold make of them; other characters as a blank.
_MARKED = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xE0, 0x100) if len(unicodedata.normalize("NFKD", chr(c))) == 2}
_NFKD = "lower({0})"
for _letter, _plain in _MARKED.items():
    _NFKD = f"replace({_NFKD}, '{_letter}', '{_plain} ')"
_NFKD = f"regexp_replace({_NFKD}, '[^a-z0-9 ]', ' ', 'g')"
#: Articles go word by word here: DuckDB's \b knows ASCII letters only.
_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_CUT = f"c AS (SELECT doc_id, unnest(range(0, CASE WHEN length(text) <= {SIZE} THEN 1 ELSE ceil((length(text) - {OVERLAP}) / {SIZE - OVERLAP}.0)::BIGINT END))::INT AS chunk, text, source FROM documents WHERE text IS NOT NULL)"
_TOKENS = "k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda w: length(w) > 2)) AS tokens FROM conversations)"
_EDGES = "p AS (SELECT p_partkey AS number FROM part), e AS (SELECT DISTINCT src, dst FROM (SELECT number AS src, unnest([number * 2, number * 3 + 1]) AS dst FROM p) WHERE dst != src AND dst IN (SELECT number FROM p))"
_PATHS = """g AS (SELECT [number] AS path FROM p UNION ALL SELECT list_append(path, e.dst) FROM g JOIN e ON e.src = path[-1] WHERE len(path) < 6 AND NOT list_contains(path, e.dst)),
m AS (SELECT path FROM g WHERE len(path) = 6 OR NOT EXISTS (SELECT 1 FROM e WHERE e.src = g.path[-1] AND NOT list_contains(g.path, e.dst)))"""

SQL = {
    "normalised_answers": rf"SELECT conv_id, turn, md5({_NORM.format('text')}) AS answer, lower(trim(regexp_replace(translate(trim(text), '’', ''''), '[.!]+$', ''))) = 'i don''t know' AS declines FROM conversations",
    "turn_f1": f"""WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
t AS (SELECT conv_id, turn, {_NORM.format('text')} AS x, {_NORM.format('gold')} AS y FROM l WHERE gold IS NOT NULL),
w AS (SELECT *, list_filter(string_split(x, ' '), lambda w: w != '') AS a, list_filter(string_split(y, ' '), lambda w: w != '') AS b FROM t)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN (len(a) = len(b))::INT ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda w: least(len(list_filter(a, lambda z: z = w)), len(list_filter(b, lambda z: z = w))))), 0) / (len(a) + len(b)) END, 9) AS f1, (x = y)::INT AS em FROM w""",
    "answers_present": f"WITH n AS (SELECT conv_id, {_NFKD.format('text')} AS t FROM conversations), w AS (SELECT conv_id, contains(t, 'the') OR contains(t, 'e n') AS a, contains(' ' || t || ' ', ' the ') OR contains(' ' || t || ' ', ' e n ') AS b FROM n) SELECT conv_id, count(*) FILTER (a) AS n, count(*) FILTER (b) AS n_words, count(*) FILTER (b AND conv_id % 2 = 0) AS n_primary FROM w GROUP BY conv_id",
    "first_sentences": """WITH j AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != '' AND NOT regexp_matches(x, '^(>|#|```)')), ' ') AS t FROM documents)
SELECT doc_id, md5(substr(CASE WHEN regexp_matches(t, '[.!?][ \\t\\n\\x0B\\f\\r]') THEN regexp_extract(t, '^(.*?[.!?])[ \\t\\n\\x0B\\f\\r]', 1, 's') ELSE t END, 1, 300)) AS digest FROM j""",
    "norm_text": f"SELECT item_id, {_NFKD.format('text')} AS norm FROM benchmark",
    "page_paths": r"""WITH p AS (SELECT page_id, regexp_replace(replace(regexp_replace(trim(regexp_replace(url, '^[a-z]+://[^/]*', '')), '^["''`]+|["''`]+$', '', 'g'), chr(92), '/'), '^(\./|/)+', '') AS path FROM pages)
SELECT page_id, path, lower(regexp_extract(string_split(path, '/')[-1], '[^.].*\.([^.]+)$', 1)) IN ('py', 'md', 'txt', 'rst', 'toml', 'yaml', 'yml', 'json', 'cfg', 'ini', 'html', 'css', 'js', 'ts', 'sh', 'sql') AS is_text FROM p""",
    "chunks": f"WITH {_CUT} SELECT doc_id, chunk, md5(substr(text, chunk * {SIZE - OVERLAP} + 1, {SIZE})) AS digest, length(substr(text, chunk * {SIZE - OVERLAP} + 1, {SIZE}))::INT AS n_chars FROM c",
    "chunk_counts": f"""WITH RECURSIVE s AS (SELECT doc_id, source, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, source, n, 0 AS p FROM s UNION ALL SELECT doc_id, source, n, p + {SIZE - OVERLAP} FROM w WHERE p + {SIZE} < n), m AS (SELECT source, count(*) AS made FROM w GROUP BY source),
o AS (SELECT source, sum(CASE WHEN n <= {SIZE} THEN 1 ELSE ceil((n - {OVERLAP}) / {SIZE - OVERLAP}.0) END)::BIGINT AS predicted FROM s GROUP BY source) SELECT source, predicted, made FROM o JOIN m USING (source)""",
    "chunk_rows": f"WITH {_CUT} SELECT doc_id, chunk, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS row_id FROM c",
    "token_frequencies": f"WITH {_TOKENS} SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM k) GROUP BY token",
    "rare_tokens": f"WITH {_TOKENS}, f AS (SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM k) GROUP BY token), u AS (SELECT conv_id, turn, unnest(tokens) AS token FROM k), h AS (SELECT conv_id, turn, max(ln((SELECT count(*) FROM k) / (1.0 + df))) AS handle FROM u JOIN f USING (token) GROUP BY ALL) SELECT k.conv_id, k.turn, round(coalesce(handle, 0), 9)::DOUBLE AS handle FROM k LEFT JOIN h USING (conv_id, turn)",
    "reference_edges": f"WITH {_EDGES} SELECT src, dst FROM e",
    "reference_chains": f"WITH RECURSIVE {_EDGES}, {_PATHS} SELECT array_to_string(path, '>') AS path, len(path)::INT AS n, CASE len(path) WHEN 1 THEN 'hop1' WHEN 2 THEN 'hop2' ELSE 'hop3plus' END AS stratum FROM m",
    "chain_heads": f"WITH RECURSIVE {_EDGES}, {_PATHS} SELECT path[1] AS head, array_to_string(arg_min(path, (-len(path), path)), '>') AS path FROM m GROUP BY path[1]",
    "title_bridges": """WITH p AS (SELECT a.p_partkey AS id, lower(a.p_name) AS page, 'the ' || lower(a.p_name) || ' stands beside a ' || lower(b.p_name) || ' like any ' || lower(b.p_name) AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
n AS (SELECT DISTINCT lower(p_name) AS norm FROM part WHERE len(string_split(p_name, ' ')) >= 2 AND length(p_name) >= 10),
m AS (SELECT id, norm, strpos(' ' || t || ' ', ' ' || norm || ' ') AS at_ FROM p JOIN n ON contains(' ' || t || ' ', ' ' || norm || ' ') WHERE NOT contains(' ' || page || ' ', ' ' || norm || ' ') AND NOT contains(' ' || norm || ' ', ' ' || page || ' '))
SELECT id, string_agg(norm, '|' ORDER BY at_, len(string_split(norm, ' ')), norm) AS bridges FROM m GROUP BY id""",
    "redacted_reasons": """WITH w AS (SELECT conv_id, substr(text, 1, 40) || ' end' AS t, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
x AS (SELECT conv_id, list_bool_or(list_transform(range(1, length(t) - 18), lambda i: contains(p, substr(t, i, 20)))) AS hit FROM w)
SELECT conv_id, count(*) FILTER (hit) AS n_redacted, count(*) AS n FROM x GROUP BY conv_id""",
    "billed_costs": """WITH u AS (SELECT o_orderpriority AS arm, o_orderkey % 9000 AS i, o_orderkey % 700 AS o, o_custkey % 5000 AS w, CASE WHEN o_custkey % 3 > 0 THEN o_custkey * 10 ELSE 0 END AS r FROM orders),
x AS (SELECT arm, round(((i + w * 2.0::DOUBLE + r * 0.1::DOUBLE) * 2.0::DOUBLE + o * 10.0::DOUBLE) / 1e6, 6) AS b, round(((i + w + r) * 2.0::DOUBLE + o * 10.0::DOUBLE) / 1e6, 6) AS l FROM u),
s AS (SELECT arm, count(*) AS n, round(sum(b), 4) AS billed, round(sum(l), 4) AS listed FROM x GROUP BY arm)
SELECT arm, n, billed, listed, round(1 - billed / listed, 6) AS saved FROM s""",
    "cost_grid": f"""WITH g AS (SELECT s_suppkey AS workload, (s_suppkey * 12000)::DOUBLE AS prefix, hit_rate, footprint FROM supplier, (SELECT unnest([0.0, 0.5, 0.9])::DOUBLE AS hit_rate), (SELECT unnest([1.0, 3.5, 8.66])::DOUBLE AS footprint)),
r AS (SELECT *, prefix + 20 > 272000 AS long FROM g),
c AS (SELECT workload, hit_rate, footprint,
  CASE WHEN prefix + 20 <= {WINDOW} THEN (prefix * (hit_rate * CASE WHEN long THEN 0.4 ELSE 0.2 END + (1 - hit_rate) * 4.0) + 20 * CASE WHEN long THEN 4.0 ELSE 2.0 END + 30 * CASE WHEN long THEN 12.0 ELSE 10.0 END) / 1e6::DOUBLE END AS live,
  (5000 * 2.0 + 30 * 10.0)::DOUBLE / 1e6 AS index,
  greatest(1.0, ceil(prefix / 500 * 1024 * 4 / footprint * 1.5 / 1073741824 / 16.0)) * 0.2 * 730.5 / 30.4375 + prefix / 1e6 * 0.02 / 365.0 + prefix * 0.01 / 1e6 * 0.02 AS fixed FROM r),
b AS (SELECT *, CASE WHEN live IS NULL THEN NULL WHEN live - index <= 0 THEN 'inf'::DOUBLE ELSE fixed / (live - index) END AS be FROM c)
SELECT workload, hit_rate, footprint, round(live, 9) AS live, round(index, 9) AS index, round(fixed, 9) AS fixed, CASE WHEN be = 'inf' THEN 'never' WHEN be IS NULL THEN 'infeasible' ELSE 'reached' END AS kind, CASE WHEN be < 'inf' THEN round(be, 6) END AS break_even FROM b""",
}
