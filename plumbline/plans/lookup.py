"""Queries that look rows up by number, keep fitted models as tables, and place sentences in the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import containment as C
from plumbline.operators import vectors as V
from plumbline.plans import search
from plumbline.plans.corpus import OVERLAP, SIZE
from plumbline.sources import models, rows
from plumbline.sources.tables import cut, shared_dir, table


def passages_at_rows(spark, d):
    """The documents whose numbers a search returns as ids, read by row."""
    wanted = search.exact_topk(spark, d).select(F.col("id").alias("row"))
    found = rows.rows_at(spark, f"{d}/documents.parquet", wanted, ["doc_id", "text"], "doc_id")
    return found.select("row", "doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def numbered_documents(spark, d):
    return rows.numbered(spark, f"{d}/documents.parquet").groupBy("source").agg(F.sum("row").alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"))


def pca_model(spark, d):
    """Principal components saved, loaded and used: what their variances and the projected vectors' lengths add up to."""
    own = search.corpus(spark, d).select("id", "vector")
    path = f"{shared_dir(spark)}/pca-{uuid.uuid4().hex}"
    models.save_pca(spark, path, V.fit_pca(own))
    model = models.load_pca(spark, path)
    turned = V.project(own, model, len(model.components)).select(F.sum(V.dot(F.col("vector"), F.col("vector"))).alias("squares"))
    total, mean = float(model.variance.sum()), float((model.mean**2).sum())
    return turned.select(F.lit(len(model.components)).alias("dims"), F.round(F.lit(total), 6).alias("variance"), F.round(F.lit(mean), 6).alias("mean_square"), F.round("squares", 6).alias("squares"))


def _located(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.posexplode(C.sentences(F.col("text"))).alias("sentence", "text"))
    corpus = table(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), SIZE, OVERLAP)).alias("chunk", "text"))
    return C.locate(asked.select(F.struct("item_id", "sentence").alias("sid"), "text"), corpus)


def sentence_places(spark, d):
    """Where each sentence of the benchmark stands in chunks of the documents."""
    return _located(spark, d).select("sid.item_id", "sid.sentence", "n_chars", "short", "n_strict", "n_quoted", "adjacent", "doc_id", "chunk", "best", "lead", "token_unique")


def placed_items(spark, d):
    """For each item of the benchmark whether all its sentences have one place."""
    return C.by_question(cut(_located(spark, d).withColumn("item_id", F.col("sid.item_id")), "located"), "item_id")


QUERIES = {f.__name__: f for f in (passages_at_rows, numbered_documents, pca_model, sentence_places, placed_items)}

_QUOTES = C.QUOTES.replace("'", "''")
_QUOTED = f"trim(regexp_replace(lower(translate(nfc_normalize({{0}}), '{_QUOTES}', '')), '\\s+', ' ', 'g'))"
_STRICT = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_PLACES = f"""
s AS (SELECT item_id, unnest(range(len(x)))::INT AS sentence, unnest(x) AS t FROM (
  SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))), lambda y: y != '') AS x FROM benchmark WHERE text IS NOT NULL)),
c AS (SELECT doc_id, chunk, substr(text, chunk * {SIZE - OVERLAP} + 1, {SIZE}) AS t FROM (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= {SIZE} THEN 1 ELSE ceil((length(text) - {OVERLAP}) / {SIZE - OVERLAP}.0)::BIGINT END))::INT AS chunk FROM documents WHERE text IS NOT NULL)),
sn AS (SELECT item_id, sentence, {_STRICT.format('t')} AS ks, {_QUOTED.format('t')} AS kq, list_distinct(regexp_extract_all({_QUOTED.format('t')}, '[a-z0-9]+')) AS k FROM s),
cn AS (SELECT doc_id, chunk, {_STRICT.format('t')} AS st, {_QUOTED.format('t')} AS qt, list_distinct(regexp_extract_all({_QUOTED.format('t')}, '[a-z0-9]+')) AS ct FROM c),
m AS (SELECT item_id, sentence, doc_id, chunk, contains(st, ks) AS i, contains(qt, kq) AS j, len(list_intersect(k, ct)) / len(k) AS share FROM sn, cn WHERE len(k) >= {C.TOKENS}),
h AS (SELECT item_id, sentence, count(*) FILTER (i) AS n_strict, count(*) FILTER (j) AS n_quoted,
  count(*) FILTER (i) > 1 AND count(DISTINCT doc_id) FILTER (i) = 1 AND max(chunk) FILTER (i) - min(chunk) FILTER (i) + 1 = count(*) FILTER (i) AS adjacent FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS p, lead(share) OVER w AS after FROM m WHERE share >= {C.CONTAINMENT - C.MARGIN} - 1e-9 WINDOW w AS (PARTITION BY item_id, sentence ORDER BY share DESC, doc_id, chunk)),
l AS (SELECT item_id, sentence, length(ks)::INT AS n_chars, length(ks) < {C.SHORT} AS short, coalesce(n_strict, 0) AS n_strict, coalesce(n_quoted, 0) AS n_quoted, coalesce(adjacent, false) AS adjacent, doc_id, chunk,
  round(share, 9) AS best, round(share - coalesce(after, {C.CONTAINMENT - C.MARGIN}), 9) AS lead FROM sn LEFT JOIN h USING (item_id, sentence) LEFT JOIN (SELECT * FROM r WHERE p = 1) USING (item_id, sentence)),
f AS (SELECT *, coalesce(best >= {C.CONTAINMENT} AND lead >= {C.MARGIN}, false) AS token_unique FROM l)"""
SQL = {
    "passages_at_rows": f"""WITH {search._RAW}, t AS ({search._top('e', 'e')}), n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, * FROM documents)
SELECT row, doc_id, length(text)::INT AS n_chars, md5(text) AS digest FROM n WHERE row IN (SELECT id FROM t)""",
    "numbered_documents": "SELECT source, sum(row)::BIGINT AS rows, min(row) AS first, max(row) AS last FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, source FROM documents) GROUP BY source",
    "pca_model": """WITH x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT count(*)::INT AS dims, round(sum(v), 6) AS variance, round(sum(m * m), 6) AS mean_square, round((SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL), 6)::DOUBLE AS squares FROM (SELECT var_samp(x) AS v, avg(x) AS m FROM x GROUP BY i)""",
    "sentence_places": f"WITH {_PLACES} SELECT * FROM f",
    "placed_items": f"""WITH {_PLACES} SELECT item_id, count(*) AS n_sents, bool_and(n_strict = 1) AS all_one_strict, bool_and(n_quoted = 1) AS all_one_quoted, bool_and(token_unique) AS all_token_unique, bool_or(n_quoted = 0) AS any_zero_quoted, count(*) FILTER (short) AS n_short FROM f GROUP BY item_id""",
}
