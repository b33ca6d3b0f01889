"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints have 64 bits. Their bits are grouped into m partitions, correlated bits together; partition i gets a
threshold t_i >= -1 such that the t_i sum to d - m + 1, where d is the largest distance that links: two fingerprints
within d then differ in at most t_i bits of some partition i. Thresholds (and m) are chosen by dynamic programming on
estimated numbers of probes and candidates, from counts over all fingerprints. Each fingerprint probes the buckets
within t_i of its own value in partition i, and candidates are verified on all 64 bits.

For d <= 2, buckets whose probes times members exceed ``PAIRS`` are not compared pairwise: their members are linked
through fingerprints that are one bit away, which finds every pair at distance 2 or less in 65 rows a member, without
pairs. For larger d they are compared whole, dealt to blocks. Both are exact for buckets of any size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, documents, mapped, texts
from plumbline.llm.components import components

BITS = 64
#: Comparisons in a bucket beyond which its members are linked without pairs.
PAIRS = 4096
#: Cost of a probe in units of a verified candidate, for the choice of thresholds.
PROBE = 4.0
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, in UTF-8."""
    return text.encode().translate(LOWER).split()


def shingle_hashes(own: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of width words, space-joined; of all words if they are fewer; empty for none."""
    if not own:
        return np.zeros(0, "<u8")
    if len(own) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), 42)], "<u8")
    runs = zip(*(own[i:] for i in range(width)), strict=False) if width > 1 else ((w,) for w in own)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), itertools.repeat(42)), "<u8", len(own) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; zero for none. As an unsigned integer."""
    counts = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, width: int = 3, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint, the unsigned value's bits) and n_shingles of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(split_words(text), width)
                hashes = np.unique(hashes) if distinct else hashes
                fps.append(fingerprint(hashes))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, "u8").view("i8")), pa.array(sizes, pa.int64())], ["doc_id", "fp", "n_shingles"])

    src = texts(df, id_col, text_col)
    return mapped(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint, n_shingles bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both; counted over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(batch.column("fp").to_numpy().view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n).astype("i8"))], ["i", "j", "n"])

    counts = mapped(nodes.select("fp"), run, "i bigint, j bigint, n bigint", by=None).groupBy("i", "j").agg(F.sum("n").alias("n"))
    n, both = 0, np.zeros((BITS, BITS))
    for r in counts.collect():  # 64 x 64 + 1 rows
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m partitions of nearly equal size; each is grown from a free bit by the free bit that is most correlated with it."""
    p = np.diag(both) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-12)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    free, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        own = [max(sorted(free), key=lambda b: sum(corr[b, c] for c in free))]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: sum(corr[b, c] for c in own))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def probes(bits: list[int], t: int) -> list[int]:
    """What to change in a partition to reach every value within t."""
    return [mask(list(c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]


def estimates(n: int, both: np.ndarray, parts: list[list[int]], collisions: list[float], most: int) -> list[list[float]]:
    """Estimated cost of each partition for thresholds -1 .. most. Candidates at threshold 0 are the counted collisions;
    they grow with the threshold as for independent bits with the counted frequencies."""
    p = np.diag(both) / max(n, 1)
    out = []
    for bits, same in zip(parts, collisions, strict=True):
        dist = np.array([1.0])
        for b in bits:
            differ = 2 * p[b] * (1 - p[b])
            dist = np.convolve(dist, [1 - differ, differ])
        cum, size, cost = np.cumsum(dist), 1.0, [0.0]
        total = 0.0
        for t in range(most + 1):
            total += size
            size = size * (len(bits) - t) / (t + 1)
            cost.append(PROBE * n * total + same * (cum[min(t, len(cum) - 1)] / max(cum[0], 1e-300)))
        out.append(cost)
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 with the given sum and the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (c, own) in best.items():
            for t in range(-1, len(cost) - 1):
                new = (c + cost[t + 1], [*own, t])
                if have + t not in step or new < step[have + t]:
                    step[have + t] = new
        best = step
    return best[total]


def choose(nodes: DataFrame, distance: int, keys: list[str]) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost, over 1 to distance + 1 partitions; keys split buckets further."""
    n, both = bit_statistics(nodes)
    tried = {m: group_bits(n, both, m) for m in range(2, min(distance + 1, 5) + 1)} or {1: [list(range(BITS))]}
    flat = [(m, k, bits) for m, parts in tried.items() for k, bits in enumerate(parts)]
    counted = nodes.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask(bits)))).alias("key")) for i, (_, _, bits) in enumerate(flat)])).alias("x"))
    counted = counted.groupBy("x.i", "x.key", *keys).agg(F.count("*").alias("n")).groupBy("i").agg(F.sum(F.col("n").cast("double") * F.col("n") / 2).alias("s"))
    same = {r["i"]: r["s"] for r in counted.collect()}
    found = []
    for m, parts in tried.items():
        collisions = [same.get(i, 0.0) for i, (k, _, _) in enumerate(flat) if k == m]
        cost, thresholds = allocate(estimates(n, both, parts, collisions, min(distance, 3)), distance - m + 1)
        found.append((cost, m, [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]))
    return min(found)[2]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, most: int, sized: bool = False) -> DataFrame:
    """(src, dst): links between nodes (id, fp and, if sized, size) within most bits; all pairs, or for full buckets and a
    most of 2 or less a set of links that joins the same nodes. sized also asks that sizes differ by a factor of 1.25 at most."""
    keys = ["grade"] if sized else []
    base = nodes.select("id", "fp", *[F.floor(F.log(1.25, F.greatest("size", F.lit(1)).cast("double"))).cast("int").alias("grade")] * sized)
    layout = choose(base, most, keys)
    spots = [(i, mask(bits), change) for i, (bits, t) in enumerate(layout) for change in probes(bits, t)]
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(signed(m)).alias("mask"), F.lit(signed(c)).alias("change"), F.lit(c == 0).alias("own")) for i, m, c in spots]))
    rows = base.select("id", "fp", *keys, spot.alias("s")).select("id", "fp", *keys, "s.part", F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.change")).alias("key"), "s.own")
    if sized:  # the larger of two probes the grade below its own, too
        rows = rows.select("id", "fp", "part", "key", F.explode(F.array(F.struct("grade", "own"), F.struct((F.col("grade") - 1).alias("grade"), F.lit(False).alias("own")))).alias("g")).select("id", "fp", "part", "key", "g.grade", "g.own")
    by = ["part", "key", *keys]
    buckets = cut(rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("own").cast("bigint")).alias("m")).where("n > 1 and m > 0"), "buckets")
    full = F.col("n") * F.col("m") > PAIRS
    # Of full buckets, each block has a share of the rows and all the bucket's own members.
    blocks = F.when(full, F.ceil(F.sqrt(F.col("n") * F.col("m") / PAIRS))).otherwise(1).cast("int")
    met = cut(rows.join(buckets.withColumn("full", full if most <= 2 else F.lit(False)).withColumn("blocks", blocks).drop("n", "m"), by), "met")
    few = met.where("not full").select(*by, "id", "fp", "own", "blocks")
    a = few.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).alias("a")
    b = few.where("own").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*by, "block"]] + [F.col("a.id") != F.col("b.id"), (~F.col("a.own")) | (F.col("a.id") < F.col("b.id")), distance(F.col("a.fp"), F.col("b.fp")) <= most]
    pairs = a.join(b, on).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    if most > 2:
        out = cut(pairs.distinct(), "near-links")
        discard(buckets, met)
        return out
    many = cut(met.where("full").select("id", "fp").distinct(), "in-full-buckets")  # at most one row a node
    flips = F.explode(F.array(*[F.struct(F.col("fp").bitwiseXOR(F.lit(signed(c))).alias("key"), F.lit(c == 0).alias("own")) for c in [0, *(1 << b for b in range(BITS))]]))
    # At most 65 fingerprints are within one bit of a given one, and equal ones are combined before.
    near = many.groupBy("fp").agg(F.min("id").alias("id")).select("id", flips.alias("x")).groupBy("x.key")
    near = near.agg(F.min(F.when(F.col("x.own"), F.col("id"))).alias("center"), F.collect_list("id").alias("ids"))
    near = near.select((F.array_min("ids") if most > 1 else F.col("center")).alias("src"), F.explode("ids").alias("dst")).where("src != dst")
    same = many.join(many.groupBy("fp").agg(F.min("id").alias("first")), "fp").where("id != first").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    out = cut(pairs.union(near).union(same).distinct(), "near-links")
    discard(buckets, met, many)
    return out


def near_duplicates(df: DataFrame, width: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach) for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other; rows with equal doc_id or text get
    a row each; rows with a null doc_id are linked, but give no component its number (null if it has no other); an
    empty table gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(df, width, False, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    of = components(links(nodes.select(F.col("fp").alias("id"), "fp"), most))
    of = cut(of, "fingerprint-components")
    joined = nodes.join(of.withColumnRenamed("node", "fp"), "fp")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = joined.join(cut(least, "component-least"), "component").select("fp", "component_id")
    numbered = cut(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "numbered")
    return fps.join(numbered, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
