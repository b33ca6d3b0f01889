"""What an index's memory consists of. Measurements are one row an arm: n_segments, index_files_bytes, chunk_cache_bytes,
segment_heap_bytes, loaded_bytes, and what the arm is: codes (bytes a vector), pq_m, ivf and rabitq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT, ROW_ID = 4, 8
#: Points that a coarse centroid needs at least.
PER_CENTROID = 39


def codebook_bytes(pq_m: Column, n_segments: Column, dims: int) -> Column:
    """Codebooks of product quantisation, one a segment: m x 256 centroids of dims / m; 0 without."""
    return F.when(pq_m.isNull(), F.lit(0)).otherwise(n_segments * pq_m * 256 * F.floor(F.lit(dims) / pq_m) * FLOAT).cast("bigint")


def modelled(n_rows: int, dims: int, nlist: int) -> Column:
    """Bytes of an inverted index that the model explains: codes, centroids, row ids and codebooks."""
    own = F.lit(n_rows) * F.col("codes") + F.col("n_segments") * nlist * dims * FLOAT + n_rows * ROW_ID
    return (own + codebook_bytes(F.col("pq_m"), F.col("n_segments"), dims)).cast("bigint")


def factor_bytes(arms: DataFrame, n_rows: int, dims: int, nlist: int, most: float = 2.0) -> DataFrame:
    """One row (factor, worst): what the sign-code arms hold a vector beyond the model, and the largest error of the model on
    the other inverted indexes, its error bar; fails if that is not below ``most`` bytes or if segments are too small for
    nlist centroids."""
    small = F.floor(F.lit(n_rows) / F.col("n_segments") / PER_CENTROID) < nlist
    rest = (F.col("index_files_bytes") - modelled(n_rows, dims, nlist)) / n_rows
    own = arms.where("ivf").select("rabitq", F.when(small, F.raise_error(F.lit("segments too small for nlist")).cast("double")).otherwise(rest).alias("rest"))
    out = own.agg(F.avg(F.when(F.col("rabitq"), F.col("rest"))).alias("factor"), F.max(F.when(~F.col("rabitq"), F.abs("rest"))).alias("worst"))
    return out.select("factor", F.when(F.col("worst") < most, F.col("worst")).otherwise(F.raise_error(F.lit("the model's error bar is too large")).cast("double")).alias("worst"))


def decompose(arms: DataFrame, factor: float, n_rows: int, dims: int, nlist: int, uniform: bool = True) -> DataFrame:
    """(arm, component, bytes, bytes_per_vector, share, basis), one row a component; they sum to loaded_bytes (within two bytes,
    or the job fails), and what the model does not explain is a component of its own. With uneven segments (uniform
    false) the centroids are what is left, which must be 1 to nlist a segment."""
    index = F.col("index_files_bytes")
    has = index > 0
    zero = F.lit(0).cast("bigint")
    codes = F.when(has, F.col("codes") * n_rows).otherwise(zero).cast("bigint")
    book = codebook_bytes(F.col("pq_m"), F.col("n_segments"), dims)
    ids = F.when(has, F.lit(n_rows * ROW_ID)).otherwise(zero).cast("bigint")
    factors = F.when(F.col("rabitq"), F.round(F.lit(n_rows * factor))).otherwise(zero).cast("bigint")
    known = codes + book + ids + factors
    exact = (F.col("n_segments") * nlist * dims * FLOAT).cast("bigint")
    left = index - known
    implied = left / F.col("n_segments") / (dims * FLOAT)
    inferred = F.when((implied > 0) & (implied <= nlist), left).otherwise(F.raise_error(F.lit("implied centroids outside 1 .. nlist")).cast("bigint"))
    centroids = F.when(~F.col("ivf"), zero).otherwise(exact if uniform else inferred).cast("bigint")
    unexplained = F.when(has, index - known - centroids).otherwise(zero).cast("bigint")
    parts = {
        "vector_chunk_cache": (F.col("chunk_cache_bytes"), "measured"),
        "quantized_codes": (codes, "derived"),
        "pq_codebook": (book, "derived"),
        "row_ids": (ids, "derived"),
        "rabitq_per_vector_factors": (factors, "derived"),
        "ivf_coarse_centroids": (centroids, "derived" if uniform else "inferred"),
        "unexplained_residual": (unexplained, "residual"),
        "segment_heap": (F.col("segment_heap_bytes"), "measured"),
    }
    total = sum((b for b, _ in parts.values()), F.lit(0))
    sums = F.abs(total - F.col("loaded_bytes")) <= 2
    each = F.array(*[F.struct(F.lit(k).alias("component"), b.cast("bigint").alias("bytes"), F.lit(basis).alias("basis")) for k, (b, basis) in parts.items()])
    kind = "array<struct<component:string,bytes:bigint,basis:string>>"
    rows = arms.select("arm", "loaded_bytes", F.explode(F.when(sums, each).otherwise(F.raise_error(F.concat(F.lit("components do not sum: "), F.col("arm"))).cast(kind))).alias("p"))
    rows = rows.where((F.col("p.bytes") != 0) | F.col("p.component").isin("segment_heap"))
    return rows.select("arm", "p.component", "p.bytes", F.round(F.col("p.bytes") / n_rows, 2).alias("bytes_per_vector"), F.round(F.col("p.bytes") / F.col("loaded_bytes"), 4).alias("share"), "p.basis")
