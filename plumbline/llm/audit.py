"""Filter interaction audit: what each filter of a cascade removes, in every order of the filters.

Duplicates come from one range sort by a text's fingerprint (SHA-256) and doc_id, within a task by fingerprint, full text and
doc_id: each row is compared with its predecessor, and a run of equal texts that crosses a boundary of partitions learns
its least doc_id from one row a partition. Rows of one text are spread over as many partitions as they fill, so no text
is too frequent. The pass that compares also measures the other filters, and all that leaves it is a mask of failures for each
document. Masks are added up to counters by part, of which there are 32 at most, and each of the 120 orders is a sum of those.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, documents, mapped

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: The bit of the filter for duplicates.
SAME = 1 << FILTERS.index("E")


def failures(text: str) -> int:
    """The mask of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    own = n < MIN_WORDS
    own |= (100 * len(set(words)) < DISTINCT * n) << 1
    own |= (100 * (len(raw) - len(raw.translate(None, UPPER))) > CAPITALS * len(text)) << 2
    return own | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


MASKS = "pid int, doc_id bigint, part string, mask int, first boolean, head string, tail string, least bigint"


def masks(df: DataFrame) -> DataFrame:
    """(pid, doc_id, part, mask, first) for every row of df (doc_id, text, part), and for every partition a row without a mask
    with the fingerprints of its first and last text (head, tail) and the least doc_id of the run that ends it. ``first``
    marks rows of the run that begins the partition and may go on from the one before."""
    keyed = df.withColumn("print", F.sha2("text", 256))
    ordered = keyed.repartitionByRange("print", F.asc_nulls_last("doc_id")).sortWithinPartitions("print", "text", F.asc_nulls_last("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, head, before, tail, least, first = TaskContext.get().partitionId(), None, None, None, None, True
        for batch in batches:
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("print")
            own, starts = [], []
            for text, id_ in zip(batch.column("text").to_pylist(), ids, strict=True):
                if text != before:
                    first, least = before is None, id_
                    before = text
                again = least is not None and id_ is not None and least < id_
                own.append(failures(text) | SAME * again)
                starts.append(first)
            if ids:
                head = prints[0].as_py() if head is None else head
                tail = prints[len(ids) - 1].as_py()
                none = pa.nulls(len(ids), pa.string())
                columns = [pa.array([pid] * len(ids), pa.int32()), batch.column("doc_id"), batch.column("part"), pa.array(own, pa.int32()), pa.array(starts), none, none, pa.nulls(len(ids), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["pid", "doc_id", "part", "mask", "first", "head", "tail", "least"])
        if head is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "doc_id": pa.nulls(1, pa.int64()), "part": pa.nulls(1, pa.string()), "mask": pa.nulls(1, pa.int32()), "first": pa.array([first]), "head": [head], "tail": [tail], "least": pa.array([least], pa.int64())})

    return mapped(ordered.select("doc_id", "part", "text", "print"), run, MASKS)


def carried(edges: DataFrame) -> DataFrame:
    """(pid, from): for partitions that begin within a run, the run's least doc_id. edges has a row for each partition, of which
    there are as many as spark.sql.shuffle.partitions says, whatever the input. Of the partitions that end with a run the first
    is the one in which it begins, with the least of its doc_ids."""
    ends = edges.groupBy(F.col("tail").alias("head")).agg(F.min("pid").alias("begun"), F.min_by("least", "pid").alias("from"))
    return edges.select("pid", "head").join(ends, "head").where("begun < pid and from is not null").select("pid", "from")


def counted(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failures, those labelled good and toxic among them."""
    own = cut(masks(df), "masks")
    edges = own.where("mask is null").select("pid", "head", "tail", "least")
    rows = own.where("mask is not null").join(F.broadcast(carried(edges)), "pid", "left")  # a row a partition at most
    rows = rows.withColumn("mask", F.when(F.col("first") & (F.col("from") < F.col("doc_id")), F.col("mask").bitwiseOR(F.lit(SAME))).otherwise(F.col("mask")))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    # Documents that share a doc_id and a mask are one row before the join, and those without a doc_id are not joined.
    some = rows.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks.hint("merge"), "doc_id", "left")
    none = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    weigh = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    out = cut(some.select("part", "mask", "n", "good", "toxic").union(none).groupBy("part", "mask").agg(F.sum("n").alias("n"), weigh("good"), weigh("toxic")), "counters")
    discard(own)
    return out


def steps(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, good, toxic)."""
    places = [f"{''.join(order)}{k}" for order in itertools.permutations(filters) for k in range(1, len(filters) + 1)]
    # One row a part with its counters, at most one for each mask.
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("own"))
    rows = parts.select("part", "own", F.explode(F.split(F.lit(",".join(places)), ",")).alias("place"))
    rows = rows.select("part", "own", F.substring("place", 1, len(filters)).alias("filter_order"), F.substring("place", len(filters) + 1, 1).cast("int").alias("step"))
    bit = lambda letter: sum((F.when(letter == f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    earlier = sum((F.when(F.locate(f, F.col("filter_order")) < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumns({"bit": bit(F.substring("filter_order", F.col("step"), F.lit(1))), "earlier": earlier})

    def total(of: str, where) -> Column:
        return F.aggregate(F.filter("own", lambda c: where(c["mask"])), F.lit(0).cast("bigint"), lambda a, c: a + c[of])

    here = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    orders = math.factorial(len(filters))
    # Of all orders, a failure's filter comes before the document's other failures in one of as many as it has.
    share = F.aggregate(F.filter("own", lambda c: here(c["mask"])), F.lit(0).cast("bigint"), lambda a, c: a + c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("bigint"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~here(m) & ~gone(m)).alias("kept"),
        total("n", lambda m: here(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: here(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: here(m) & ~gone(m)).alias("good_lost"),
        total("toxic", lambda m: here(m) & ~gone(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order
    of the five filters and step, zeros included.

    A null text is empty and a null part the empty string. Rows count one by one, also where they repeat a doc_id; equal
    texts of one doc_id are no duplicates of each other, and a null doc_id is neither smaller nor larger than any. A
    document is good or toxic if any of its rows in labels (doc_id, quality, toxic) says so. Very long texts are treated
    whole; an empty table gives an empty result; other columns are ignored.
    """
    own = df.select(df[id_col].cast("bigint").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), F.coalesce(df[part_col].cast("string"), F.lit("")).alias("part"))
    return steps(counted(own, labels.select("doc_id", "quality", "toxic")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def audit_sql() -> str:
    fails = """(len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT"""
    here, gone = "mask & bit != 0", "mask & earlier != 0"
    count = lambda what, where: f"coalesce(sum({what}) FILTER ({where}), 0)::BIGINT"
    return rf"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
own AS (SELECT doc_id, part, t, min(doc_id) OVER (PARTITION BY t) AS least, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM doc),
label AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counter AS (
  SELECT part, {fails} AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM own LEFT JOIN label USING (doc_id) GROUP BY ALL),
filter AS (SELECT i, chr((65 + i)::INT) AS f FROM range(5) r(i)),
path AS (SELECT '' AS o, 0 AS step, 0 AS earlier, 0 AS bit
  UNION ALL SELECT o || f, step + 1, earlier | bit, (1 << i)::INT FROM path, filter WHERE NOT contains(o, f)),
place AS (SELECT w.o AS filter_order, s.step, s.earlier, s.bit FROM path w JOIN path s ON len(w.o) = 5 AND s.step > 0 AND starts_with(w.o, s.o)),
summed AS (
  SELECT part, filter_order, step, bit, {count("n", f"NOT ({here}) AND NOT ({gone})")} AS kept, {count("n", f"{here} AND NOT ({gone})")} AS removed, {count("n", f"{here} AND {gone}")} AS redundant,
    {count("n", "mask = bit")} AS unique_fails, {count("good", f"{here} AND NOT ({gone})")} AS good_lost, {count("toxic", f"{here} AND NOT ({gone})")} AS toxic_lost
  FROM counter, place GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM summed"""
