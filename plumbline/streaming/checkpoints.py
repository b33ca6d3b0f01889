"""Append-only checkpoints as a stream: new lines are read as files arrive, and the latest row of each key is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.tables import RUNS


def read_stream(spark: SparkSession, path: str, schema: T.StructType = RUNS, files: int = 100) -> DataFrame:
    """New JSON lines below a folder, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def first_rows(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def spend_by_window(stream: DataFrame, time: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts by tumbling or sliding windows; rows later than the watermark are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window, *by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of a key that follow one another within the gap, as sessions with start, end and count."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def upsert_to(stream: DataFrame, path: str, keys: list[str], order: str, state: str) -> StreamingQuery:
    """Keep the latest row of each key as Parquet below ``path``, a folder for each batch, named by its number: a batch
    that runs again overwrites itself. Read with ``current``."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key over all batches."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def drained(stream: DataFrame, path: str, state: str) -> DataFrame:
    """What an aggregated stream gives for all that is there now, as a table below ``path``: each batch replaces the one before,
    so the last one stays. Started again with the same state it goes on with what is new."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
