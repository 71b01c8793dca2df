"""Sizing helpers: how big an input is, and where intermediate tables go."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MB = 1 << 20
SMALL_FILES = 16

PLAIN_MAX_BYTES = "dialwise.order.plainMaxBytes"
ROWS_PER_BUCKET = "dialwise.order.rowsPerBucket"
MAX_BUCKETS = "dialwise.order.maxBuckets"

_DEFAULTS = {PLAIN_MAX_BYTES: 64 * MB, ROWS_PER_BUCKET: 500_000, MAX_BUCKETS: 20_000}


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def input_bytes(df: DataFrame) -> float:
    """Bytes of all leaf relations under ``df``, as Catalyst sizes them.

    Runs no job. Joins here are N:1, so the sum of the leaves is a usable
    estimate where Catalyst's own product of sizes is far too pessimistic.
    A leaf without statistics counts as very large, which selects the
    distributed path.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return float(sum(float(str(leaves.apply(i).stats().sizeInBytes()))
                     for i in range(leaves.size())))


def is_small(df: DataFrame) -> bool:
    """True when all of ``df`` provably fits the work of one task."""
    return input_bytes(df) <= setting(df.sparkSession, PLAIN_MAX_BYTES)


_WIDE = {"Join", "Aggregate", "Window", "Sort", "Generate", "Expand", "Distinct", "GlobalLimit",
         "RepartitionByExpression", "MapInPandas", "FlatMapGroupsInPandas"}


def is_narrow(df: DataFrame) -> bool:
    """True when reading ``df`` again costs a scan and nothing more."""
    tree = df._jdf.queryExecution().optimizedPlan().treeString()
    names = {m.group(1) for m in re.finditer(r"^[\s:+|-]*(\w+)", tree, re.M)}
    return not names & _WIDE


def bucket_count(spark: SparkSession, rows: int) -> int:
    wanted = math.ceil(rows / setting(spark, ROWS_PER_BUCKET))
    return max(1, min(wanted, setting(spark, MAX_BUCKETS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="dialwise-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage and survives the loss of executors. Unlike a checkpoint the
    copy keeps column pruning and pushdown for later readers. It is removed
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/dialwise-{uuid.uuid4().hex}"
    if is_small(df):
        # a small table would come back as one file and keep one core busy
        df = df.repartition(min(spark.sparkContext.defaultParallelism, SMALL_FILES))
    df.write.mode("errorifexists").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
