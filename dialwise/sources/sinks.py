"""Result tables, parameters, run reports and fitted pipelines on shared storage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = "run_id string, section string, key string, value string"


def write_result(df: DataFrame, path: str, format: str = "parquet", sep: str = ",") -> None:
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.options(header=True, sep=sep, quote='"', escape='"').csv(path)
    else:
        writer.format(format).save(path)


def read_result(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.options(header=True, quote='"', escape='"').csv(path) if format == "csv" \
        else reader.format(format).load(path)


def params_as_json(df: DataFrame, key: str, params: str = "params") -> DataFrame:
    """One JSON object per key with every parameter value as text."""
    return df.select(key, F.to_json(F.col(params)).alias("json"))


def write_params(df: DataFrame, key: str, path: str, params: str = "params") -> None:
    params_as_json(df, key, params).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add ``run_id, section, key, value`` rows to the run report.

    A section of a run is a partition of its own and is written as a whole, so
    a repeated run leaves one copy and other runs and sections stay.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in ("run_id", "section", "key", "value")])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_id", "section").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path).select("run_id", "section", "key", "value")


def pipeline_path(root: str, description: str, features: Sequence[str]) -> str:
    """A path of its own per description and feature set, so runs never share a model."""
    digest = hashlib.md5("\n".join([description, *features]).encode()).hexdigest()
    return f"{root.rstrip('/')}/{digest}"


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def load_or_fit(path: str, make: Callable[[], PipelineModel]) -> PipelineModel:
    """The saved pipeline, or a new one that is saved for the next call.

    A mark is written after all stages, so a save that was cut short is made anew.
    """
    spark = SparkSession.active()
    if exists(spark, f"{path}/complete/_SUCCESS"):
        return PipelineModel.load(path)
    model = make()
    model.write().overwrite().save(path)
    spark.range(1).write.mode("overwrite").parquet(f"{path}/complete")
    return model
