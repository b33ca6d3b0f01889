"""Tables: readers with fixed schemas, tables cut into the cluster's shared folder, manifests and append-only ledgers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(fields: str) -> T.StructType:
    """A schema of simple fields; unlike StructType.fromDDL it needs no session, so modules can be imported without one."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in fields.split(","))])


RUNS = struct(
    "qid string, arm string, input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, turns int, stop_reason string, error string,"
    " wall_clock_s double, started_at string, answer string, judge_correct boolean, cost_total_billed double"
)
PRICES = struct("model string, input_usd_per_mtok double, output_usd_per_mtok double, cache_write_1h_multiplier double, cache_read_multiplier double, regime string, source_url string, fetched_date string, verified string")
LEDGER = struct("run_label string, spend_usd double, head string, dirty boolean, committed_in string, note string")
TRANSCRIPT = struct("role string, stop_reason string").add("content", T.ArrayType(struct("type string, text string, name string, tool_use_id string, content string, content_length bigint, is_error boolean")))
BROKEN = "_broken"
#: Folders of the tables made by cut(), for sweep().
_made: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset a folder of our own is made, in a
    session of one machine only: on a cluster every executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, so that later steps restart from there if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later step reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = file.rsplit("/", 1)[0]
            _delete(df.sparkSession, path)
            _made.difference_update({p for p in _made if p.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]})


def sweep(spark: SparkSession) -> int:
    """Delete all tables that cut() made and that are still there, and return their number. Results of operators read such
    tables: call it when the results have been written."""
    for path in (gone := sorted(_made)):
        _delete(spark, path)
    _made.clear()
    return len(gone)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RUNS, strict: bool = False) -> DataFrame:
    """JSON lines with their file and place in it (``_file``, ``_at``). Malformed lines are left out, or fail if strict."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"), "_file", "_at").select("r.*", "_file", "_at")
    if strict:
        return rows.select(*[F.when(F.col(BROKEN).isNotNull(), F.raise_error(F.lit("malformed line")).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in schema.fields], "_file", "_at")
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN)


def latest(checkpoint: DataFrame, keys: tuple[str, ...] = ("qid", "arm"), first: bool = False) -> DataFrame:
    """One line a key: the last one written, or the first."""
    pick = F.min_by if first else F.max_by
    return checkpoint.groupBy(*keys).agg(pick(F.struct(*checkpoint.columns), F.struct("_file", "_at")).alias("r")).select("r.*")


def spent(checkpoint: DataFrame, column: str = "cost_total_billed", every_line: bool = False) -> DataFrame:
    """One row with the money spent: of the last line of each key, or of every line."""
    rows = checkpoint if every_line else latest(checkpoint)
    return rows.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("spent"))


def missing(checkpoint: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("qid", "arm")) -> DataFrame:
    """Wanted keys that the checkpoint lacks."""
    return wanted.join(checkpoint.select(*keys).distinct(), list(keys), "left_anti")


def pricing(spark: SparkSession, path: str, regime: str) -> DataFrame:
    """Prices of one regime; an error if it has none."""
    rows = spark.read.csv(path, header=True, schema=PRICES).where(F.col("regime") == regime)
    if not rows.take(1):
        raise ValueError(f"no prices for regime {regime}")
    return rows


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of each row of the manifest (path, sha256): verified if a file found at the path has its digest, HASH MISMATCH
    if only others are found there, else MISSING. Neither side needs to hold a path once."""
    there = found.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    same = found.select(F.col("path").alias("_at"), F.col("sha256").alias("_sha")).distinct().withColumn("_same", F.lit(True))
    both = manifest.select("path", "sha256").join(there, F.col("path").eqNullSafe(F.col("_path")), "left")
    both = both.join(same, F.col("path").eqNullSafe(F.col("_at")) & F.col("sha256").eqNullSafe(F.col("_sha")), "left")
    return both.select("path", F.when(F.col("_same"), "verified").when(F.col("_there"), "HASH MISMATCH").otherwise("MISSING").alias("status"))


def reconcile(ledger: DataFrame, swept: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: the ledger's sum, the sum (column spent) of the checkpoints, their difference and whether they agree."""
    total = ledger.agg(F.coalesce(F.sum("spend_usd"), F.lit(0.0)).alias("ledger"))
    both = total.crossJoin(swept.agg(F.coalesce(F.sum("spent"), F.lit(0.0)).alias("checkpoints")))
    delta = F.col("ledger") - F.col("checkpoints")
    return both.select("ledger", "checkpoints", delta.alias("delta"), (F.abs(delta) <= tolerance).alias("agrees"))


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; a new file each time, so a reader never meets half a line."""
    df.write.mode("append").json(path)


def signature(files: DataFrame, size: int, overlap: int, name: str = "name") -> DataFrame:
    """One row with the signature of a corpus: SHA-256 of size:overlap and the sorted names, a line each."""
    names = F.array_join(F.array_sort(F.collect_list(name)), "\n")
    return files.agg(F.sha2(F.concat(F.lit(f"{size}:{overlap}\n"), names, F.lit("\n")), 256).alias("signature"))


def resume_from(lines: DataFrame, expected: str) -> DataFrame:
    """One row with the end of the last inserted batch, 0 if there is none; fails on a line of another corpus."""
    own = F.when(F.col("signature") == expected, F.col("batch_end")).otherwise(F.raise_error(F.lit("checkpoint of another corpus")).cast("bigint"))
    return lines.where("inserted").agg(F.coalesce(F.max(own), F.lit(0)).alias("batch_end"))


def tool_results(transcripts: DataFrame) -> DataFrame:
    """Blocks of tool results with the number that a 'Found N results' line gives, null if there is none."""
    blocks = transcripts.select("_file", "_at", F.posexplode("content").alias("block", "b")).where("b.type = 'tool_result'")
    found = F.regexp_extract("b.content", r"Found (\d+) results?", 1)
    return blocks.select("_file", "_at", "block", F.coalesce("b.content_length", F.length("b.content").cast("bigint")).alias("chars"), F.nullif(found, F.lit("")).cast("bigint").alias("n_results"))
