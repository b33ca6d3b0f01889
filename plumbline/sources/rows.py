"""Rows of a Parquet table by their number: files in the order of their names, rows in the order of each file.

A lookup reads of the table what it needs and no more: counts of rows by file, from which it knows the files of the wanted
rows; a narrow key of those files; and then their other columns where the key lies in a wanted range, which prunes row groups
by their statistics. Nothing is on the driver but a row for each file and a bounded number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import cut

#: Rows of a block by which wanted rows find their file, and of one by which they make a range of keys.
BLOCK = 1 << 16
#: Ranges of keys that a filter has at most.
RANGES = 64
FILE, AT = "_file", "_at"


def located(df: DataFrame) -> DataFrame:
    """df with the file of each row and its place in it."""
    return df.withColumns({FILE: F.col("_metadata.file_path"), AT: F.col("_metadata.row_index")})


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """(_file, first, n): each file's number of rows, from a scan without columns, and the number of its first row. The window
    has a row for each file."""
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias(FILE)).agg(F.count("*").alias("n"))
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(FILE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table with their numbers as ``row``. Counts are a row for each file."""
    own = located(spark.read.parquet(path))
    return own.join(F.broadcast(file_counts(spark, path)), FILE).withColumn("row", F.col("first") + F.col(AT)).drop(FILE, AT, "first", "n")


def placed(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, _file, _at) of wanted (row): each finds its file through the blocks of rows that the file has. Numbers beyond the
    table, null ones and repeats are left out."""
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK)))
    files = counts.where("n > 0").withColumn("block", blocks)
    own = wanted.where("row is not null and row >= 0").select(F.col("row").cast("bigint").alias("row")).distinct().withColumn("block", F.floor(F.col("row") / BLOCK))
    return own.join(files, "block").where((F.col("row") >= F.col("first")) & (F.col("row") < F.col("first") + F.col("n"))).select("row", FILE, (F.col("row") - F.col("first")).alias(AT))


def key_ranges(keys: DataFrame, most: int = RANGES) -> list[tuple]:
    """At most ``most`` ranges (least, largest) that hold all keys of (_file, _at, key): of blocks of rows, neighbours joined until
    they are few enough."""
    per = keys.groupBy(FILE, F.floor(F.col(AT) / BLOCK).alias("block")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    tiled = per.withColumn("tile", F.ntile(most).over(Window.orderBy("low", "high")))  # a row for each block of rows
    return [(r["low"], r["high"]) for r in tiled.groupBy("tile").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("low").collect()]


def within(column: str, ranges: list[tuple]) -> Column:
    test = F.lit(False)
    for low, high in ranges:
        test = test | ((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
    return test


def rows_at(spark: SparkSession, path: str, wanted: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(row, columns) of the wanted rows (row: numbers from 0). ``key`` is a narrow column without nulls in the wanted rows that
    grows with the row, or nearly so: it need not be unique or sorted, but that is what prunes. A number beyond the table
    gives no row, a repeated one gives one."""
    at = cut(placed(wanted, file_counts(spark, path)), "placed")
    files = [r[FILE] for r in at.select(FILE).distinct().orderBy(FILE).collect()]  # at most a row for each file
    if not files:
        empty = spark.read.parquet(path).select(*columns).limit(0)
        return empty.select(F.lit(0).cast("bigint").alias("row"), *columns)
    own = located(spark.read.schema(spark.read.parquet(path).schema).parquet(*files))
    ranges = key_ranges(own.select(FILE, AT, F.col(key).alias("key")).join(at, [FILE, AT]))
    return own.where(within(key, ranges)).select(FILE, AT, *columns).join(at, [FILE, AT]).select("row", *columns)


def cached(spark: SparkSession, folder: str, wanted: DataFrame, on: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``read`` gives for the wanted keys, from the table in ``folder`` where that has them: only keys that are missing are
    read, and they are appended to it. Keys for which there is nothing are asked for again each time."""
    keys = wanted.select(*on).distinct()
    have = stored(spark, folder)
    missing = keys if have is None else keys.join(have.select(*on).distinct(), on, "left_anti")
    if not missing.isEmpty():
        read(missing).write.mode("append").parquet(folder)
        have = stored(spark, folder)
    if have is None:
        return read(missing)
    return have.join(keys, on, "left_semi").dropDuplicates(on)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, None if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.parquet(folder) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
