"""SpotSigs document fingerprints and their comparison, in DataFrame expressions only.

A spot signature is a common word (an anchor) with the chain of the next content words, common words left out. A
document's fingerprint is the set of its signatures as 64-bit hashes. Near-duplicates are found among distinct sets:
they are partitioned by length so that only lengths whose ratio allows the similarity meet, each set is indexed by the
few of its rarest signatures of which similar sets must share one, and candidates are compared by Jaccard similarity
only where the sizes and the places of the shared signature still allow enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, documents
from plumbline.llm.components import components

CHAIN = 2
SIMILARITY = 0.8
#: Documents in a bucket of neighbours, about; a bucket is one window partition.
BUCKET, MOST_BUCKETS = 256, 50_000
#: Common words of English, French, German and Spanish.
COMMON = """a an and are as at be but by for from had has have he her his in is it not of on or she that the their they this to was were
which will with you au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour qui que sa se
ses son sur un une vous auf aus bei das dem den der die ein eine einem einen einer er es für hat ich ihr im ist mit nicht sich sie sind so
und von war werden wie wir zu zum zur al con del el ella era los las lo más no nos para pero por se si sin su sus una y""".split()
COMMON = sorted(set(COMMON))


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text (never null) as an array of bigint.

    Words are runs of letters and digits, lower-cased. A text without common words gets a signature at every word, one
    without words a signature of its trimmed characters, and an empty one none.
    """
    common = lambda w: w.isin(COMMON)

    def of(own: Column) -> Column:
        content = F.filter(own, lambda w: ~common(w))
        places = F.filter(F.transform(own, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull())
        # The q-th common word, at place i, has i - q content words before it.
        at = lambda found, kept: F.transform(found, lambda i, q: F.xxhash64(F.get(own, i), *[F.get(kept, i - q + k) for k in range(chain)]))
        every = F.transform(own, lambda w, i: F.xxhash64(w, *[F.get(own, i + k) for k in range(1, chain + 1)]))
        return bind(places, lambda found: F.when(F.size(found) > 0, bind(content, lambda kept: at(found, kept))).otherwise(every))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    raw = F.trim(text)
    return bind(words, lambda own: F.when(F.size(own) > 0, F.array_sort(F.array_distinct(of(own)))).when(raw != "", F.array(F.xxhash64(raw))).otherwise(F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones. Sets of distinct elements share |a| + |b| - |a or b|."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise((F.size(a) + F.size(b) - union) / union)


def shown(sigs: Column) -> Column:
    """A fingerprint as a string: the signatures in hexadecimal, joined by commas."""
    return F.array_join(F.transform(sigs, lambda s: F.hex(s)), ",")


def near_duplicates(df: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the least doc_id that links of at least ``least`` reach) for every row.

    Rows with equal sets are one class and are never paired. A null text counts as empty; empty sets are alike; rows
    with a null doc_id are classed but give no number; an empty table gives an empty result; other columns are ignored.
    """
    sets = df.select(df[id_col].alias("doc_id"), signatures(F.coalesce(df[text_col], F.lit(""))).alias("sigs"))
    sets = cut(sets.withColumn("set_id", F.xxhash64("sigs")), "spot-sets")
    classes = cut(sets.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs")), "spot-classes")
    links = cut(similar_sets(classes.select(F.col("set_id").alias("id"), "sigs"), least), "spot-links")
    of = cut(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "spot-components")
    joined = classes.select("set_id", "least").join(of.withColumnRenamed("node", "set_id"), "set_id")
    first = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")), "spot-least")
    moved = joined.join(first, "component").select("set_id", "component_id")
    numbered = cut(classes.select("set_id", "least").join(moved, "set_id", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id")), "spot-numbered")
    return sets.select("doc_id", "set_id").join(numbered, "set_id").select("doc_id", "component_id")


def similar_sets(sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of all pairs of sets (id, sigs) with a Jaccard similarity of least or more, a < b, empty sets
    left out. Signatures are ordered from rare to common, so the ones that are indexed have short lists."""
    posted = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = cut(posted.groupBy("sig").agg(F.count("*").alias("df")), "sig-counts")
    shared = cut(posted.join(counts.where("df > 1"), "sig"), "shared-sigs")
    # A signature that no other set has cannot be shared; it still counts in the size n, and comes first in the order.
    ranked = shared.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("own"))
    # Of n signatures, n - ceil(least * n) + 1 in the common order hold one that a similar set's own prefix holds, too.
    prefix = F.col("n") - F.ceil(F.col("n") * least) + 1
    alone = F.col("n") - F.size("own")
    ranked = cut(ranked.select("id", "n", F.slice("own", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int")).alias("head"), alone.alias("alone"), F.transform("own", lambda s: s["sig"]).alias("sigs")), "ranked-sets")
    # Partitions by length: sets can be similar only within one partition or two that touch.
    part = F.floor(F.log(1 / least, F.col("n").cast("double"))).cast("int")
    index = ranked.select("id", "n", "alone", part.alias("part"), F.posexplode("head").alias("at", "s")).select("id", "n", "part", (F.col("at") + F.col("alone")).alias("at"), F.col("s.sig").alias("sig"))
    index = cut(index, "spot-index")
    probe = index.select("id", "n", "at", "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    x, y = probe.alias("x"), index.alias("y")
    # Sizes must allow the similarity, and so must what follows the places of the shared signature.
    need = F.ceil((F.col("x.n") + F.col("y.n")) * (least / (1 + least)) - 1e-9)
    after = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    on = [F.col("x.sig") == F.col("y.sig"), F.col("x.part") == F.col("y.part"), F.col("x.id") != F.col("y.id"), F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least, after >= need]
    candidates = cut(x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "spot-candidates")
    left = candidates.join(ranked.select(F.col("id").alias("a"), F.col("sigs").alias("sa"), F.col("n").alias("na")), "a")
    both = left.join(ranked.select(F.col("id").alias("b"), F.col("sigs").alias("sb"), F.col("n").alias("nb")), "b")
    common = (F.size("sa") + F.size("sb") - F.size(F.array_union("sa", "sb"))).cast("double")
    return both.select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("similarity")).where(F.col("similarity") >= least)


def with_next(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with next_text, the text of the document that follows in falling doc_id; the first follows the
    last. Rows that share a doc_id follow one another in order of their texts, those with a null doc_id come last.

    Documents are dealt to buckets of about BUCKET by ranges of doc_id; the row that follows a bucket's last one, the
    top of the bucket below, is copied into it, so that no window holds more than a bucket and texts move once.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = df.count()
    parts = max(1, min(MOST_BUCKETS, n // BUCKET))
    ids = df.select(key.alias("key")).repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("low"), F.max("key").alias("top"))
    spans = sorted((r["low"], r["top"]) for r in ids.collect())  # two numbers a bucket
    lows, tops = [x for x, _ in spans] or [0], [x for _, x in spans] or [0]
    step = math.isqrt(len(lows)) + 1
    literal = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    fine = F.array(*[literal(lows[i : i + step]) for i in range(0, len(lows), step)])
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("key")))
    placed = df.withColumn("key", key).withColumn("coarse", F.greatest(upto(literal(lows[::step])), F.lit(1)))
    placed = placed.withColumn("bucket", (F.col("coarse") - 1) * step + F.greatest(upto(F.element_at(fine, F.col("coarse"))), F.lit(1)) - 1)
    own = F.struct("bucket", F.lit(False).alias("copy"))
    above = F.struct(((F.col("bucket") + 1) % len(lows)).cast("int").alias("bucket"), F.lit(True).alias("copy"))
    is_top = F.element_at(literal(tops), F.col("bucket") + 1) == F.col("key")
    placed = placed.select("doc_id", "text", "key", F.explode(F.when(is_top, F.array(own, above)).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "key", "at.bucket", "at.copy")
    following = F.lead("text").over(Window.partitionBy("bucket").orderBy("copy", F.desc("key"), "text"))
    return placed.withColumn("next_text", following).where("not copy").select("doc_id", "text", "next_text")


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(df).select("doc_id", n.cast("bigint").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[signatures(F.col(c)).alias(f"of_{c}") for c in ("text", "edited", "next_text")])
    near = lambda c: likeness(F.col("of_text"), F.col(c)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", shown(F.col("of_text")).alias("fingerprint"), shown(F.col("of_edited")).alias("edited_fingerprint"), near("of_edited").alias("near_edited"), near("of_next_text").alias("near_next"))
