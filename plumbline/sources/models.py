"""Fitted models as tables: one row for each row of a field's matrix, and a digest of all values that is checked when they are
read. The digest is of the values, not of the files: it is the same wherever and in however many files the table is written."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.vectors import Index, Pca
from plumbline.sources.tables import struct

MODEL = struct("field string, at bigint, shape string, digest string").add("values", T.ArrayType(T.DoubleType()))


def digest(fields: dict[str, np.ndarray]) -> str:
    """SHA-256 of the fields by name, each with its shape and its doubles in little-endian order; -0.0 counts as 0.0."""
    out = hashlib.sha256()
    for name, value in sorted(fields.items()):
        own = np.asarray(value, "<f8") + 0.0
        out.update(f"{name}:{','.join(map(str, own.shape))};".encode() + own.tobytes())
    return out.hexdigest()


def save(spark: SparkSession, path: str, fields: dict[str, np.ndarray]) -> str:
    """Write the fields, arrays of any shape and numbers, as a table, and return its digest. An existing table is an error."""
    mark, rows = digest(fields), []
    for name, value in fields.items():
        own = np.asarray(value, "f8")
        flat = own.reshape(-1, own.shape[-1]) if own.ndim and own.size else own.reshape(1, -1)
        rows += [(name, i, ",".join(map(str, own.shape)), mark, r.tolist()) for i, r in enumerate(flat)]
    spark.createDataFrame(rows, MODEL).coalesce(1).write.parquet(path)
    return mark


def load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The fields of a saved model. Missing, repeated or changed rows are an error."""
    by: dict[str, list] = {}
    rows = spark.read.schema(MODEL).parquet(path).orderBy("field", "at").collect()  # a model fits the driver that fitted it
    for r in rows:
        by.setdefault(r["field"], []).append(r)
    fields = {}
    for name, own in by.items():
        shape = tuple(int(n) for n in own[0]["shape"].split(",") if n)
        values = np.array([x for r in own for x in r["values"]], "f8")
        if [r["at"] for r in own] != list(range(len(own))) or values.size != int(np.prod(shape)):
            raise ValueError(f"{path}: rows of {name} are missing or repeated")
        fields[name] = values.reshape(shape)
    if not rows or {r["digest"] for r in rows} != {digest(fields)}:
        raise ValueError(f"{path}: values differ from their digest")
    return fields


def save_pca(spark: SparkSession, path: str, model: Pca) -> str:
    return save(spark, path, {"mean": model.mean, "components": model.components, "variance": model.variance})


def load_pca(spark: SparkSession, path: str) -> Pca:
    own = load(spark, path)
    return Pca(own["mean"], own["components"], own["variance"])


def save_index(spark: SparkSession, path: str, index: Index) -> str:
    """The fitted parts of an inverted index: centroids, and codebooks or a rotation if its coding has them. Its coding is the
    name of a field."""
    parts = {"centroids": index.centroids, "books": index.books, "rotation": index.rotation, f"coding {index.coding}": 0.0}
    return save(spark, path, {k: v for k, v in parts.items() if v is not None})


def load_index(spark: SparkSession, path: str) -> Index:
    own = load(spark, path)
    coding = next(k.split(" ", 1)[1] for k in own if k.startswith("coding "))
    return Index(own["centroids"], coding, own.get("books"), own.get("rotation"))


def models(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, digest, fields, values): what saved models hold, without reading their values."""
    out = None
    for path in paths:
        own = spark.read.schema(MODEL).parquet(path).agg(F.first("digest").alias("digest"), F.countDistinct("field").alias("fields"), F.sum(F.size("values")).alias("values")).select(F.lit(path).alias("path"), "*")
        out = own if out is None else out.union(own)
    return out
