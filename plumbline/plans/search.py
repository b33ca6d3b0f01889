"""Queries over ``embeddings``: exact and approximate search, quantisation, projections. Queries are the rows whose id is
divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import hnsw
from plumbline.operators import vectors as V
from plumbline.sources.tables import cut, table

K, EVERY = 10, 50


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "vector")


def exact_topk(spark, d):
    rows = corpus(spark, d)
    return V.top_k(rows, queries(rows), K)


def exact_topk_renormalised(spark, d, dims: int = 32):
    rows = corpus(spark, d).withColumn("vector", V.truncate(F.col("vector"), dims))
    return V.top_k(rows, queries(rows), K)


def mrl_recall(spark, d):
    """Recall of the exact result that truncation to half the dimensions keeps."""
    rows = corpus(spark, d)
    short = rows.withColumn("vector", V.truncate(F.col("vector"), 32))
    return V.recall_at_k(V.top_k(short, queries(short), K), V.top_k(rows, queries(rows), K), K)


def sq8(rows: DataFrame) -> DataFrame:
    low, high = V.sq8_bounds(rows)
    return rows.withColumn("vector", V.sq8_values(V.sq8_codes(F.col("vector"), low, high), low, high))


def sq8_topk(spark, d):
    rows = corpus(spark, d)
    return V.top_k(sq8(rows), queries(rows), K)


def sq8_recall(spark, d):
    rows = corpus(spark, d)
    return V.recall_at_k(V.top_k(sq8(rows), queries(rows), K), V.top_k(rows, queries(rows), K), K)


def sq8_bounds(spark, d):
    rows = corpus(spark, d)
    return rows.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))


def pca_recall(spark, d, dims: int = 48):
    rows = corpus(spark, d).select("id", "vector")
    model = V.fit_pca(rows, center=False)
    short = cut(V.project(rows, model, dims), "projected")
    return V.recall_at_k(V.top_k(short, queries(short), K), V.top_k(rows, queries(rows), K), K)


def explained_variance(spark, d):
    share = V.fit_pca(corpus(spark, d)).explained()
    return spark.createDataFrame([(i + 1, round(float(x), 6)) for i, x in enumerate(share)], "dims int, explained double")


def _index(spark, d, coding: str, wide: int):
    """The corpus and what an index with a root of n cells finds; two thirds of the cells are probed, as these vectors have
    hardly any clusters."""
    rows = corpus(spark, d).select("id", "vector")
    index, coded = V.build_index(rows, coding=coding)
    coded = cut(coded, f"index-{coding}")
    found = V.search_index(index, coded, queries(rows), wide, -(-len(index.centroids) * 2 // 3))
    if coding != "exact":
        found = V.refine(found, rows, queries(rows), K)
    return rows, found


def _recall(spark, d, coding, wide):
    rows, found = _index(spark, d, coding, wide)
    return V.recall_at_k(found, V.top_k(rows, queries(rows), K), K).withColumn("enough", F.col("recall") >= 0.9)


def ivf_topk(spark, d):
    return _index(spark, d, "exact", K)[1]


def ivf_recall(spark, d):
    return _recall(spark, d, "exact", K)


def ivf_pq_recall(spark, d):
    return _recall(spark, d, "pq", 10 * K)


def ivf_sign_recall(spark, d):
    return _recall(spark, d, "sign", 10 * K)


NPROBES, FACTORS, EFS = [1, 2, 4, 8, 16, 32, 64, 128, 256], [1, 2, 5, 10], [16, 32, 64, 128, 256, 512]


def hnsw_topk(spark, d):
    rows = corpus(spark, d).select("id", "vector")
    return hnsw.search(hnsw.index(rows), queries(rows), K, [128]).drop("ef")


def hnsw_recall(spark, d):
    """Recall of the layered graphs at each width of the search."""
    rows = corpus(spark, d).select("id", "vector")
    found = hnsw.search(hnsw.index(rows), queries(rows), K, EFS)
    return V.recalls(found, V.top_k(rows, queries(rows), K), K, ["ef"])


def probe_sweep(spark, d):
    """Recall and share of rows read at each number of probed cells, where a cell is a label with the mean of its vectors."""
    rows = corpus(spark, d).where("label is not null and vector is not null")
    means = rows.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))
    own = means.orderBy("label").limit(V.FIT_ROWS).collect()  # a row a cell
    index = V.Index(V.stack([r["v"] for r in own]))
    cells = spark.createDataFrame([(r["label"], i) for i, r in enumerate(own)], "label int, cell int")
    coded = cut(V.as_floats(rows.join(cells, "label").select("id", "cell", "vector")), "label-cells")
    asked = queries(rows)
    found = V.sweep_index(index, coded, asked, K, NPROBES)
    return V.recalls(found, V.top_k(rows, asked, K), K, ["nprobe"]).join(V.shares_read(index, coded, asked, NPROBES), "nprobe")


def ivf_refine_sweep(spark, d):
    """Recall of product codes at each number of probed cells and each factor of candidates that are compared exactly."""
    rows = corpus(spark, d).select("id", "vector")
    index, coded = V.build_index(rows, coding="pq")
    coded, asked = cut(coded, "index-pq"), queries(rows)
    found = cut(V.sweep_index(index, coded, asked, K * max(FACTORS), NPROBES), "sweep")
    points = V.recalls(V.refined_sweep(found, rows, asked, K, FACTORS), V.top_k(rows, asked, K), K, ["nprobe", "factor"])
    return points.join(V.shares_read(index, coded, asked, NPROBES), "nprobe")


def label_precision(spark, d):
    """Share of each label's true neighbours that have the label of the query."""
    rows = corpus(spark, d)
    found = V.top_k(rows, queries(rows), K + 1).where("qid != id")
    w = Window.partitionBy("qid").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K)
    both = found.join(rows.select("id", F.col("label").alias("theirs")), "id").join(rows.select(F.col("id").alias("qid"), F.col("label").alias("own")), "qid")
    return both.groupBy(F.col("own").alias("label")).agg(F.round(F.avg((F.col("own") == F.col("theirs")).cast("double")), 6).alias("precision"), F.count("*").alias("n"))


def separable_lists(spark, d):
    """For each query whether exact and SQ8 search differ in their ordered first 10, and their overlap."""
    lists = lambda df, n: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(n))
    both = lists(exact_topk(spark, d), "a").join(lists(sq8_topk(spark, d), "b"), "qid")
    return both.select("qid", V.separable(F.col("a"), F.col("b"), K).alias("separable"), F.round(V.recall_ids(F.col("b"), F.col("a"), K), 6).alias("recall"))


def index_bytes(spark, d):
    """Bytes of the coded vectors of each index, as they are stored."""
    rows = corpus(spark, d).select("id", "vector")
    out = None
    for coding in ("exact", "pq", "sign"):
        part = V.stored_bytes(V.build_index(rows, coding=coding)[1]).select(F.lit(coding).alias("coding"), "bytes", "n")
        out = part if out is None else out.union(part)
    return out


def payload(spark, d):
    """Bytes and compression of each coding for these dimensions."""
    dim = corpus(spark, d).agg(F.max(F.size("vector"))).first()[0]
    return spark.createDataFrame([(c, V.payload_bytes(c, dim), 4 * dim / V.payload_bytes(c, dim)) for c in ("exact", "sq8", "pq", "sign")], "coding string, bytes int, compression double")


QUERIES = {f.__name__: f for f in (exact_topk, exact_topk_renormalised, mrl_recall, sq8_topk, sq8_recall, sq8_bounds, pca_recall, explained_variance, ivf_topk, ivf_recall, ivf_pq_recall, ivf_sign_recall, hnsw_topk, hnsw_recall, probe_sweep, ivf_refine_sweep, label_precision, separable_lists, payload, index_bytes)}

_TOP = """
SELECT qid, rank::INT AS rank, id, score FROM (
  SELECT q.id AS qid, c.id AS id, round(list_dot_product(q.v, c.v), 6) AS score,
    row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, c.v), 6) DESC, c.id) AS rank
  FROM {q} q, {c} c WHERE q.id % 50 = 0) WHERE rank <= {k}"""
_RAW = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_SHORT = "s AS (SELECT id, list_transform(list_slice(v, 1, 32), lambda x: x / sqrt(list_dot_product(list_slice(v, 1, 32), list_slice(v, 1, 32)))) AS v FROM e)"
_BOUNDS = "b AS (SELECT dim, min(x) AS low, max(x) AS high FROM (SELECT unnest(range(len(v))) AS dim, unnest(v) AS x FROM e) GROUP BY dim), bl AS (SELECT list(low ORDER BY dim) AS low, list(CASE WHEN high > low THEN high - low ELSE 1 END ORDER BY dim) AS w FROM b)"
_SQ8 = "z AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: low[i] + (least(255, greatest(0, floor((v[i] - low[i]) / w[i] * 256))) + 0.5) * w[i] / 256) AS v FROM e, bl)"


def _top(q: str, c: str, k: int = K) -> str:
    return _TOP.format(q=q, c=c, k=k)


def _recall_sql(parts: str, pred: str) -> str:
    return f"WITH {_RAW}, {parts}, t AS ({_top('e', 'e')}), p AS ({pred}) SELECT round(avg(r), 6) AS recall FROM (SELECT t.qid, count(p.id) / count(*) AS r FROM t LEFT JOIN p ON t.qid = p.qid AND t.id = p.id GROUP BY t.qid)"


_CODINGS = "d AS (SELECT max(len(embedding)) AS dim, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT coding, (CASE coding WHEN 'exact' THEN 4 * dim WHEN 'sq8' THEN dim WHEN 'pq' THEN 8 ELSE ceil(dim / 8) + 8 END)::INT AS bytes, dim, n FROM d, (SELECT unnest(['exact', 'sq8', 'pq', 'sign']) AS coding))"

SQL = {
    "payload": f"WITH {_CODINGS} SELECT coding, bytes, (4 * dim / bytes)::DOUBLE AS compression FROM c",
    "index_bytes": f"WITH {_CODINGS} SELECT coding, bytes, n FROM c WHERE coding != 'sq8'",
    "exact_topk": f"WITH {_RAW} {_top('e', 'e')}",
    "exact_topk_renormalised": f"WITH {_RAW}, {_SHORT} {_top('s', 's')}",
    "mrl_recall": _recall_sql(_SHORT, _top("s", "s")),
    "sq8_topk": f"WITH {_RAW}, {_BOUNDS}, {_SQ8} {_top('e', 'z')}",
    "sq8_recall": _recall_sql(f"{_BOUNDS}, {_SQ8}", _top("e", "z")),
    "sq8_bounds": f"WITH {_RAW}, {_BOUNDS} SELECT dim::INT AS dim, low, high FROM b",
    "probe_sweep": f"""WITH {_RAW}, l AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL),
m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM l) GROUP BY ALL) GROUP BY label),
p AS (SELECT q.id AS qid, q.v, m.label, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, m.v) DESC, m.label) - 1 AS probe FROM l q, m WHERE q.id % {EVERY} = 0),
s AS (SELECT unnest({NPROBES})::INT AS nprobe),
f AS (SELECT nprobe, qid, c.id, row_number() OVER (PARTITION BY nprobe, qid ORDER BY round(list_dot_product(p.v, c.v), 6) DESC, c.id) AS r FROM s JOIN p ON probe < nprobe JOIN l c USING (label)),
t AS ({_top('l', 'l')}),
h AS (SELECT nprobe, count(t.id) / (SELECT count(*) FROM t) AS recall FROM f LEFT JOIN t ON t.qid = f.qid AND t.id = f.id WHERE r <= {K} GROUP BY nprobe),
n AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT nprobe, round(recall, 6) AS recall, round(sum(n) / ((SELECT count(DISTINCT qid) FROM p) * (SELECT count(*) FROM l)), 6) AS share
FROM h JOIN p ON probe < nprobe JOIN n USING (label) GROUP BY nprobe, recall""",
    "label_precision": f"""WITH {_RAW}, t AS ({_top('e', 'e', K + 1)}), n AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM t WHERE qid != id)
SELECT o.label, round(avg((o.label = c.label)::INT), 6) AS precision, count(*) AS n FROM n JOIN e o ON o.id = n.qid JOIN e c ON c.id = n.id WHERE r <= {K} GROUP BY o.label""",
    "separable_lists": f"""WITH {_RAW}, {_BOUNDS}, {_SQ8}, t AS ({_top('e', 'e')}), p AS ({_top('e', 'z')}),
a AS (SELECT qid, list(id ORDER BY rank) AS ids FROM t GROUP BY qid), c AS (SELECT qid, list(id ORDER BY rank) AS ids FROM p GROUP BY qid)
SELECT qid, a.ids != c.ids AS separable, round(len(list_intersect(a.ids, c.ids)) / 10.0, 6)::DOUBLE AS recall FROM a JOIN c USING (qid)""",
}
