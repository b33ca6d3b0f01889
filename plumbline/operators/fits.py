"""Fits and resampling that re-run a whole rule in each replicate. Samples are questions by arms, aggregated and small;
replicates are dealt out to the executors."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 200


def changepoint(x: np.ndarray, y: np.ndarray, grid: int = GRID) -> dict[str, float]:
    """Two lines that meet at tau: of an even grid inside the range of x (a millionth off its ends) the tau with the least
    squared error, the first of equals, with the intercept and both slopes.

    All taus are fitted at once: for each, the cross products of the columns 1, min(x, tau), max(x - tau, 0) and y give a
    system of three equations, which a pseudo-inverse solves also where a segment has too few points."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    taus = np.linspace(x.min() + 1e-6, x.max() - 1e-6, grid)
    columns = np.stack([np.ones((grid, len(x))), np.minimum(x, taus[:, None]), np.maximum(x - taus[:, None], 0)], 2)
    weights = (np.linalg.pinv(columns) @ y[:, None])[:, :, 0]
    errors = ((np.einsum("gnk,gk->gn", columns, weights) - y) ** 2).sum(1)
    best = int(np.argmin(errors))
    return {"tau": float(taus[best]), "intercept": float(weights[best, 0]), "left": float(weights[best, 1]), "right": float(weights[best, 2]), "sse": float(errors[best])}


#: Cells of an aggregated matrix that may come to the driver.
MOST_CELLS = 10_000_000


def matrix(df: DataFrame, key: str, arm: str, value: str) -> tuple[np.ndarray, list]:
    """An aggregated table as a matrix key x arm; an error if a cell is missing or occurs twice, or if there are more than
    MOST_CELLS."""
    pdf = df.select(key, arm, value).limit(MOST_CELLS + 1).toPandas()
    if len(pdf) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    wide = pdf.pivot(index=key, columns=arm, values=value)
    if wide.isna().any().any():
        raise ValueError("a question lacks an arm")
    return wide.to_numpy(float), list(wide.columns)


def replicated(spark: SparkSession, replicates: int, rule, schema: str, seed: int = 42, parts: int = 16) -> DataFrame:
    """rule(generator) of each replicate as a row (rep and the fields of schema); replicate r has its own generator, so
    results do not depend on how replicates are dealt out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"rep": int(r), **rule(np.random.default_rng([seed, int(r)]))} for r in pdf["rep"]])

    reps = spark.range(replicates).select(F.col("id").alias("rep"), (F.col("id") % parts).alias("part"))
    return reps.groupBy("part").applyInPandas(run, f"rep bigint, {schema}")


def bootstrap_changepoint(spark, recall: np.ndarray, accuracy: np.ndarray, replicates: int = 200, seed: int = 42, grid: int = 50) -> DataFrame:
    """(rep, tau, intercept, left, right, sse): both matrices question x arm, questions drawn once for both."""

    def rule(rng) -> dict[str, float]:
        idx = rng.integers(0, len(recall), len(recall))
        return changepoint(recall[idx].mean(0), accuracy[idx].mean(0), grid)

    return replicated(spark, replicates, rule, "tau double, intercept double, left double, right double, sse double", seed)


def knee_of(recalls: np.ndarray, classes: list[str]) -> float | None:
    """The least recall at and above which every arm is PLATEAU."""
    out = None
    for i in np.argsort(-recalls, kind="stable"):
        if classes[i] != "PLATEAU":
            break
        out = float(recalls[i])
    return out


def bootstrap_knee(spark, recall: np.ndarray, quality: np.ndarray, base: int, margin: float = 0.05, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(rep, r_star): the knee rule inside each replicate, classes by a normal interval of the drawn losses."""

    def rule(rng) -> dict[str, float]:
        idx = rng.integers(0, len(recall), len(recall))
        loss = quality[idx][:, [base]] - quality[idx]
        half = 1.959963984540054 * loss.std(0, ddof=1) / np.sqrt(len(idx))
        low, high = loss.mean(0) - half, loss.mean(0) + half
        classes = ["DROP" if a > 0 else "PLATEAU" if b < margin else "INCONCLUSIVE" for a, b in zip(low, high, strict=True)]
        knee = knee_of(recall[idx].mean(0), classes)
        return {"r_star": float("nan") if knee is None else knee}

    return replicated(spark, replicates, rule, "r_star double", seed)


def leave_k_out(spark, deltas: list[float], k: int, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(subset, median, low): every subset of k removed, with the lower bootstrap bound of the median."""
    values = np.asarray(deltas, float)
    subsets = list(itertools.combinations(range(len(values)), k))
    rows = spark.createDataFrame([(i, list(s)) for i, s in enumerate(subsets)], "subset int, gone array<int>")

    def run(batches):
        for pdf in batches:
            out = []
            for i, gone in zip(pdf["subset"], pdf["gone"], strict=True):
                kept = np.delete(values, list(gone))
                draw = np.random.default_rng([seed, int(i)]).integers(0, len(kept), (replicates, len(kept)))
                out.append((int(i), float(np.median(kept)), float(np.quantile(np.median(kept[draw], 1), 0.025))))
            yield pd.DataFrame(out, columns=["subset", "median", "low"])

    return rows.mapInPandas(run, "subset int, median double, low double")


def false_positive_rate(spark, pool: list[float], n: int, reps: int = 200, replicates: int = 200, seed: int = 42) -> DataFrame:
    """One row: how often an interval of the median excludes zero for samples of n from the pool less its median."""
    own = np.asarray(pool, float) - np.median(pool)

    def rule(rng) -> dict[str, bool]:
        x = rng.choice(own, n)
        m = np.median(x[rng.integers(0, n, (replicates, n))], 1)
        low, high = np.quantile(m, [0.025, 0.975])
        return {"hit": bool(low > 0 or high < 0)}

    out = replicated(spark, reps, rule, "hit boolean", seed)
    rate = F.avg(F.col("hit").cast("double"))
    return out.agg(rate.alias("rate"), F.sqrt(rate * (1 - rate) / F.count("*")).alias("se"))
