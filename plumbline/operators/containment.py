"""Where sentences stand in chunks of a corpus, by three locators: as they are but for case and white space, without quote
characters, and by the share of their tokens that a chunk holds.

Candidates come from an inverted index of tokens. A chunk that holds a share of a sentence's n tokens lacks so few that
it holds one of the sentence's rarest ones, of which there is one more than it may lack; only those are looked up. A chunk
with the sentence's whole string holds all its tokens but the first and last, which may be parts of longer words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions.text import collapse
from plumbline.sources.arrow import mapped
from plumbline.sources.tables import cut

#: Share of a sentence's tokens that a chunk must hold, and how much more than any other chunk, to be its place.
CONTAINMENT, MARGIN = 0.80, 0.05
#: Sentences of fewer characters are counted as short; those of fewer distinct tokens are not located.
SHORT, TOKENS = 40, 3
#: What tokens are.
TOKEN = re.compile("[a-z0-9]+")
#: Sentences that are compared with a chunk together, and sentences whose tokens a task remembers; they only bound memory.
TOGETHER, KNOWN = 500, 10_000
#: The quote characters that are removed.
QUOTES = '"“”‘’«»„′″`'


def sentences(text: Column) -> Column:
    """Runs up to and with their full stops, question and exclamation marks, as an array without blank ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), collapse), lambda s: s != "")


def folded(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(collapse(text))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def unquoted(text: Column) -> Column:
    """folded() of the NFKC form without quote characters; texts of ASCII alone skip the Python worker's work."""
    return folded(F.translate(_nfkc(text), QUOTES, ""))


def tokens(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(TOKEN.pattern), F.lit(0)))


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    own = df.where(F.col(text).isNotNull()).withColumns({"strict": folded(F.col(text)), "quoted": unquoted(F.col(text))})
    return own.select(key, "strict", "quoted", tokens(F.col("quoted")).alias("tokens"))


def candidates(asked: DataFrame, corpus: DataFrame, floor: float) -> DataFrame:
    """(sid, cid) of chunks (cid, tokens) that may hold a share of ``floor`` of a sentence's tokens, or its string (sid, tokens)."""
    words = asked.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    held = corpus.select("cid", F.explode("tokens").alias("token"))
    # Only counted: chunks are looked up by rare tokens, and those that most chunks have are never dealt.
    counts = cut(held.join(words.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("df")), "token-counts")
    rarest = Window.partitionBy("sid").orderBy(F.coalesce("df", F.lit(0)), "token")
    lacks = F.greatest(F.col("n") - F.ceil(F.col("n") * floor - 1e-9), F.lit(2))
    keys = words.join(counts, "token", "left").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= lacks + 1)
    keys = cut(keys.select("sid", "token"), "rare-tokens")
    # Dealt by chunk once, for the distinct pairs and for compared().
    return held.join(keys, "token").select("sid", "cid").repartition("cid").distinct()


def compared(pairs: DataFrame, able: DataFrame, chunks: DataFrame, floor: float) -> DataFrame:
    """(sid, cid, is_strict, is_quoted, share) of pairs (sid, cid) of which the chunk has a share of ``floor`` of the sentence's tokens or
    its string. A chunk comes once for up to about ``TOGETHER`` of its sentences and its tokens are told once for them, not for
    each pair anew."""
    groups = F.lit(max(1, -(-able.count() // TOGETHER)))
    asked = pairs.join(able.select("sid", F.col("strict").alias("s_strict"), F.col("quoted").alias("s_quoted")), "sid").withColumn("salt", F.pmod(F.xxhash64("sid"), groups))
    asked = asked.groupBy("cid", "salt").agg(F.collect_list(F.struct("s_strict", "s_quoted", "sid")).alias("asked")).drop("salt")
    kind = {c: pairs.schema[c].dataType.simpleString() for c in ("sid", "cid")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset] = {}
        for batch in batches:
            each = batch.column("asked")
            flat = each.flatten()
            ends = each.value_lengths().to_pylist()
            one, two = (flat.field(c).to_pylist() for c in ("s_strict", "s_quoted"))
            chunk, sentence, rows, at = [], [], [], 0
            for i, (strict, quoted, n) in enumerate(zip(batch.column("strict").to_pylist(), batch.column("quoted").to_pylist(), ends, strict=True)):
                have = set(TOKEN.findall(quoted))
                for j in range(at, at + n):
                    own = known.get(two[j])
                    if own is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        own = known[two[j]] = frozenset(TOKEN.findall(two[j]))
                    share, is_strict, is_quoted = len(own & have) / len(own), one[j] in strict, two[j] in quoted
                    if share >= floor - 1e-9 or is_strict or is_quoted:
                        chunk.append(i)
                        sentence.append(j)
                        rows.append((is_strict, is_quoted, share))
                at += n
            if rows:
                a, b, c = zip(*rows, strict=True)
                columns = [flat.field("sid").take(pa.array(sentence)), batch.column("cid").take(pa.array(chunk)), pa.array(a, pa.bool_()), pa.array(b, pa.bool_()), pa.array(c, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "cid", "is_strict", "is_quoted", "share"])

    both = asked.join(chunks.select("cid", "strict", "quoted"), "cid").select("cid", "strict", "quoted", "asked")
    return mapped(both, run, f"sid {kind['sid']}, cid {kind['cid']}, is_strict boolean, is_quoted boolean, share double")


def locate(asked: DataFrame, corpus: DataFrame, containment: float = CONTAINMENT, margin: float = MARGIN) -> DataFrame:
    """For each of asked (sid, text) with a text: n_chars; short; n_strict and n_quoted, chunks of corpus (doc_id, chunk, text) with
    its string; adjacent, whether those are neighbours in one document; the chunk with the largest share of its tokens (doc_id,
    chunk, best) and by how much it leads (lead); and token_unique, whether it is the sentence's one place.

    Shares below containment - margin are not looked for: they are null as best, and as the next best count as that. A
    sentence of fewer than three tokens has no place. Ties go to the first chunk; repeated chunks count each.
    """
    floor = containment - margin
    texts = cut(prepared(asked, "sid", "text"), "sentences")
    chunks = cut(prepared(corpus.withColumn("cid", F.struct("doc_id", "chunk")), "cid", "text"), "corpus-chunks")
    able = texts.where(F.size("tokens") >= TOKENS)
    pairs = candidates(able.select("sid", "tokens"), chunks.select("cid", "tokens"), floor)
    met = cut(compared(pairs, able, chunks, floor), "met-sentences")
    hits = F.when(F.col("is_strict"), F.col("cid"))
    found = met.groupBy("sid").agg(
        F.count_if("is_strict").alias("n_strict"),
        F.count_if("is_quoted").alias("n_quoted"),
        ((F.count_if("is_strict") > 1) & (F.min(hits.doc_id) == F.max(hits.doc_id)) & (F.max(hits.chunk) - F.min(hits.chunk) + 1 == F.count_if("is_strict"))).alias("adjacent"),
    )
    near = met.where(F.col("share") >= floor - 1e-9)
    w = Window.partitionBy("sid").orderBy(F.desc("share"), "cid")
    top = near.withColumns({"place": F.row_number().over(w), "next": F.lead("share").over(w)}).where("place = 1").select("sid", "cid", "share", "next")
    out = texts.select("sid", F.length("strict").alias("n_chars")).join(found, "sid", "left").join(top, "sid", "left")
    lead = F.col("share") - F.coalesce("next", F.lit(floor))
    return out.select(
        "sid",
        "n_chars",
        (F.col("n_chars") < SHORT).alias("short"),
        F.coalesce("n_strict", F.lit(0)).alias("n_strict"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("adjacent", F.lit(False)).alias("adjacent"),
        F.col("cid.doc_id").alias("doc_id"),
        F.col("cid.chunk").alias("chunk"),
        F.round("share", 9).alias("best"),
        F.round(lead, 9).alias("lead"),
        F.coalesce((F.round("share", 9) >= containment) & (F.round(lead, 9) >= margin), F.lit(False)).alias("token_unique"),
    )


def by_question(located: DataFrame, key: str = "qid") -> DataFrame:
    """For each question (key) of located sentences whether all are in exactly one chunk by each locator, whether one is in none, and
    how many are short."""
    every = lambda c: F.min(c.cast("int")) == 1
    return located.groupBy(key).agg(
        F.count("*").alias("n_sents"),
        every(F.col("n_strict") == 1).alias("all_one_strict"),
        every(F.col("n_quoted") == 1).alias("all_one_quoted"),
        every(F.col("token_unique")).alias("all_token_unique"),
        (F.max((F.col("n_quoted") == 0).cast("int")) == 1).alias("any_zero_quoted"),
        F.count_if("short").alias("n_short"),
    )
