"""Quality selection by importance resampling with hashed n-gram models.

A document is the bag of its word unigrams and bigrams, hashed to ``BUCKETS`` buckets. Two generative models, bucket
frequencies of the target text (labelled as good) and of all raw text, give it the log importance weight
sum(log p_target - log p_raw); with Gumbel noise added, the k largest keys are a sample without replacement in
proportion to the weights. Both models count all documents. The k-th largest key is found by radix selection over the
bits of the exact keys: counts by 16 bits at a time, so the driver sees at most 65,536 counts a step, however many
documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, documents, mapped, texts
from plumbline.llm.simhash import split_words

BUCKETS = 10_000
SEED = 11
#: Words whose hashes a worker keeps; only bounds memory.
TABLE = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    def __init__(self):
        self.table: dict[bytes, int] = {}

    def buckets(self, text: str) -> np.ndarray:
        """Buckets of all unigrams and bigrams of a text."""
        import xxhash

        own = split_words(text)
        if len(self.table) > TABLE:
            self.table.clear()
        table = self.table
        for w in set(own):
            if w not in table:
                table[w] = xxhash.xxh64_intdigest(w, SEED)
        h = np.fromiter(map(table.__getitem__, own), "u8", len(own))
        pairs = (h[:-1] * MIX + h[1:]) * MIX
        both = np.concatenate([h, pairs ^ (pairs >> np.uint64(32))])
        return (both % np.uint64(BUCKETS)).astype("i8")


def model(df: DataFrame) -> np.ndarray:
    """Log frequency of each bucket over all texts of df, with one added to each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros(BUCKETS, "i8")
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(hasher.buckets(text), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.ones(BUCKETS)
    for r in mapped(df.select("text"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] += r["n"]  # BUCKETS rows
    return np.log(counts / counts.sum())


def ordered(keys: np.ndarray) -> np.ndarray:
    """Integers in the order of the given doubles, equal for equal doubles only."""
    bits = (keys + 0.0).view("i8")
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def weighted(df: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight, gumbel_key, and for the selection _key, _tie and _row (a number of its own) for every row of df
    (doc_id, text, noise); ratio is the log ratio of the models by bucket, noise a hash of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, row = Hasher(), TaskContext.get().partitionId() << 40
        for batch in batches:
            own = np.array([float(ratio[hasher.buckets(t)].sum()) for t in batch.column("text").to_pylist()])
            noise = batch.column("noise").to_numpy()
            u = ((noise & np.int64((1 << 52) - 1)).astype("f8") + 0.5) / float(1 << 52)
            key = own - np.log(-np.log(u))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own), pa.array(key), pa.array(ordered(key)), pa.array(noise), pa.array(np.arange(row, row + len(own)))], ["doc_id", "log_weight", "gumbel_key", "_key", "_tie", "_row"])
            row += len(own)

    return mapped(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, log_weight double, gumbel_key double, _key bigint, _tie bigint, _row bigint")


def threshold(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a bigint column, nulls left out; None if there are fewer than k or k is 0."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        # With the sign bit flipped, unsigned order is the order of the values.
        value = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
        own = df.where(F.col(column).isNotNull())
        if shift < 48:
            own = own.where(F.shiftrightunsigned(value, shift + 16) == F.lit(prefix))
        counts = own.groupBy(F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(0xFFFF)).alias("d")).count()
        for r in sorted(counts.collect(), key=lambda r: -r["d"]):
            if k <= r["count"]:
                prefix = prefix << 16 | r["d"]
                break
            k -= r["count"]
        else:
            return None
        if k <= 0:
            return None
    return prefix - (1 << 63)


def largest(df: DataFrame, k: int, columns: tuple[str, ...]) -> Column:
    """True for the k largest rows of df (which has more) by the given bigint columns, the last of which tells all rows apart."""
    kept, edge = F.lit(False), F.lit(True)
    for c in columns:
        at = threshold(df.where(edge), c, k)
        above, edge = edge & (F.col(c) > at), edge & (F.col(c) == at)
        k -= df.where(above).count()
        kept = kept | above
        if df.where(edge).count() == k:
            break
    return kept | edge


def resample(df: DataFrame, target: DataFrame, k: int | None = None, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept for every row; target holds the ids of the target text in ``doc_id``, which may
    be of any type.

    Exactly k rows are kept (or that share of all rows): those with the largest keys. Of rows with the key at the edge, those
    with the largest hash of doc_id are kept, and of rows with equal keys and ids any. Null and empty texts weigh nothing (0);
    a null doc_id has its own noise; with no target text all weights are those of an even model; an empty table gives an
    empty result; other columns are ignored.
    """
    # A hash of the id gives the noise, so that a lost task draws the same again.
    src = texts(df, id_col, text_col).withColumn("noise", F.xxhash64("doc_id", F.lit(SEED)))
    raw = model(src)
    # A merge join at every size: the ids grow with the corpus, and a plan that broadcasts few and shuffles many would not
    # tell from a small run what a large one needs.
    good = model(src.join(target.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    keyed = cut(weighted(src, good - raw), "importance")
    n = keyed.count()
    k = round(n * share) if k is None else k
    kept = F.lit(k > 0) if k >= n or k <= 0 else largest(keyed, k, ("_key", "_tie", "_row"))
    return keyed.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"))


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic; as large a share is kept as is good among the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = F.col("quality") == 1
    share = labels.where(F.col("quality").isNotNull()).agg(F.avg(good.cast("double"))).first()[0]
    return resample(documents(spark, sf_dir), labels.where(good & (F.coalesce("toxic", F.lit(0)) == 0)), share=1.0 if share is None else share)
