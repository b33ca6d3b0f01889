"""Language identification with a byte convolutional network.

Bytes of the lower-cased text are embedded, filters of several widths run over windows of fixed length, each filter
keeps its maximum over the window, and a softmax layer gives the languages. Training is plain numpy on the driver, on a
bounded sample of labelled rows (``PER_LANG`` documents of each language, three windows from each); prediction runs in
Arrow batches over all windows of every whole text, and a document's probabilities are the mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, fresh, mapped

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS, EMBED = 16, 6
#: The bounds of the training sample: documents of each language; and languages, of which the most frequent are learned (a
#: language beyond them is never predicted).
PER_LANG, MOST_LANGS = 500, 200
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (widest * EMBED) x all filters, zero beyond a filter's own width
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def unrolled(self, windows: np.ndarray) -> np.ndarray:
        """window x place x the embedded bytes under the widest filter."""
        widest = max(WIDTHS)
        x = np.ascontiguousarray(self.embed[windows])
        n, length, e = x.shape
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (n, length - widest + 1, widest * e), x.strides))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of each filter over each window, where they are, and the unrolled input, for training."""
        rows = self.unrolled(windows)
        z = rows @ self.filters
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, 0), at, rows

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        rows = self.unrolled(windows)
        z = (rows.reshape(-1, rows.shape[2]) @ self.filters).reshape(*rows.shape[:2], -1).max(1)
        return softmax(np.maximum(z + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, bytes of the lower-cased text; the last is filled up with blanks."""
    raw = text.lower().encode()
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW), "u1").reshape(n, WINDOW)


def train(examples: list[tuple[str, str]]) -> Model | None:
    """A model from (text, language) pairs; None where there are none. Equal input gives an equal model."""
    langs = sorted({lang for _, lang in examples})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest, EMBED, n_filters), "f4")
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(widest * EMBED, n_filters)
    m = Model(langs, rng.normal(0, 0.5, (256, EMBED)).astype("f4"), (rng.normal(0, 0.3, mask.shape) * mask).astype("f4"), np.zeros(n_filters, "f4"), rng.normal(0, 0.2, (n_filters, len(langs))).astype("f4"), np.zeros(len(langs), "f4"))
    x, y = [], []
    for text, lang in examples:
        own = windows_of(text)
        x.append(own)
        y += [langs.index(lang)] * len(own)
    x, y = np.concatenate(x), np.array(y)
    weights = [m.embed, m.filters, m.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            h, where, rows = m.pooled(x[own])
            d = softmax(h @ m.out + m.out_bias)
            d[np.arange(len(own)), y[own]] -= 1
            d /= len(own)
            dh = (d @ m.out.T) * (h > 0)
            picked = rows[np.arange(len(own))[:, None], where]  # example x filter x input
            g_filters = np.einsum("nf,nfi->if", dh, picked) * mask
            g_in = (dh[:, :, None] * m.filters.T[None]).reshape(len(own), n_filters, widest, EMBED)
            g_embed = np.zeros_like(m.embed)
            taken = x[own][np.arange(len(own))[:, None, None], where[:, :, None] + np.arange(widest)]
            np.add.at(g_embed, taken.ravel(), g_in.reshape(-1, EMBED))
            step += 1
            for w, g, a, b in zip(weights, (g_embed, g_filters, dh.sum(0), h.T @ d, d.sum(0)), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return m


def predict_texts(model: Model | None, texts: list[str | None], most: int = 256) -> tuple[list[str], list[float]]:
    """Language and score of each text; UNKNOWN and 0.0 for null or a text without a letter, or where nothing was learned."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    at, parts = 0, []
    sums = np.zeros((len(own), len(model.langs) if model else 0))
    counts = np.zeros(len(own))

    def flush() -> None:
        if parts:
            x = np.concatenate([w for _, w in parts])
            k = np.repeat([k for k, _ in parts], [len(w) for _, w in parts])
            for a in range(0, len(x), most):
                np.add.at(sums, k[a : a + most], model.probabilities(x[a : a + most]))
            np.add.at(counts, k, 1)
            parts.clear()

    for k, i in enumerate(own):
        parts.append((k, w := windows_of(texts[i])))
        at += len(w)
        if at >= 4 * most:
            flush()
            at = 0
    flush()
    for k, i in enumerate(own):
        p = sums[k] / counts[k]
        best = int(p.argmax())
        langs[i], scores[i] = model.langs[best], float(min(1.0, p[best]))
    return langs, scores


def training_sample(labelled: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most about per_lang rows (doc_id, text, lang) of each language, taken by a hash of doc_id; of each text three
    windows at places that the hash gives, so that the driver's share is bounded by languages times per_lang."""
    df = labelled.where("lang is not null and text is not null and text != ''")
    counts = df.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    found = counts.collect()
    if not found:
        return []
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["n"])))])
    df = df.withColumn("share", share[F.col("lang")]).withColumn("hash", F.xxhash64(F.col("doc_id"), F.lit("lang")))
    df = df.where(F.col("share").isNotNull() & (F.pmod("hash", F.lit(1 << 30)) < F.col("share") * (1 << 30)))
    last = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    spots = [F.substring("text", (F.pmod(F.xxhash64("hash", F.lit(i)), last) + 1).cast("int"), F.lit(WINDOW)) for i in range(3)]
    rows = df.select("doc_id", "lang", F.array_distinct(F.array(*spots)).alias("spots")).collect()
    return [(t, r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["spots"])) for t in r["spots"]]


def fold(doc_id) -> F.Column:
    """True for documents that are held out: crc32 of doc_id as text, modulo 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score for every row (and the columns named in keep, unchanged).

    Null, empty and letterless texts are ``und`` with score 0; so is all where the model is None. Equal texts get equal
    results; ties go to the language first in order; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_texts(model, batch.column(own).to_pylist())
            names = [n for n in batch.schema.names if n != own]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    own = fresh(df, "_text")
    src = df.select(df[id_col].alias("doc_id"), df[text_col].alias(own), *[df[c] for c in keep if c != id_col])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != own]
    return mapped(src, run, ", ".join([*fields, "lang_pred string", "score double"]), by=own)


def learn(df: DataFrame) -> Model | None:
    """A model from the labelled rows of df (doc_id, text, lang) that are not held out."""
    rows = df.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~fold("doc_id"))
    return train(training_sample(rows))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    return identify(df, learn(df)).select("doc_id", fold("doc_id").alias("held_out"), "lang_pred", "score")
