"""What the operators of this package share: reading tables, batches of bounded size for Python workers, and cutting
lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import tables
from plumbline.sources.tables import discard, sweep  # noqa: F401

#: Characters that separate words, as in the class [^\x20\x09-\x0D].
SPACES = r"\x20\x09-\x0D"
#: Bytes of text that a Python worker turns into objects at a time; a longer text comes alone. It only bounds memory.
SLICE = 2 << 20
#: Bytes of an Arrow batch between an executor and its Python worker, which hold several copies of it. A session that has
#: more is set to this by mapped(); it only bounds memory.
ARROW, ARROW_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """tables.cut(), after which the driver's garbage is collected: only that makes Spark remove the shuffle files of steps that
    are done, which count as disk."""
    out = tables.cut(df, label)
    df.sparkSession._jvm.System.gc()
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, renamed, a null text as empty; columns that clash are left behind."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACES}]+"), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes, a longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _give_back() -> None:
    """Return memory that is free to the system. A worker serves many tasks, and what it keeps adds up with its executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, by: str | None = "text", most: int = SLICE) -> DataFrame:
    """df.mapInArrow(run, schema) with batches cut into slices by the bytes of the column ``by``, and with what the task's
    Python worker no longer needs given back when it ends."""

    conf = df.sparkSession.conf
    most_bytes = conf.get(ARROW_CONF).lower().rstrip("b")
    if not most_bytes.isdigit() or not 0 < int(most_bytes) <= ARROW:
        conf.set(ARROW_CONF, str(ARROW))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for batch in batches for part in ([batch] if by is None else slices(batch, by, most)))
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)
