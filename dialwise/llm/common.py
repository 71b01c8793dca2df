"""Registry of this subpackage and what its jobs share: stored tables and Arrow plumbing."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dialwise.scale import remove_at_exit, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, **options: str) -> DataFrame:
    """Write once in the folder that ``spark.checkpoint.dir`` names and read back; ``options`` go to the writer.

    The copy cuts lineage, outlives executors and is removed when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast value of bounded size, sent with the code of its class, as functions are."""

    def __init__(self, spark: SparkSession, value):
        self.held, self.known = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"held": self.held, "known": None}

    @property
    def value(self):
        if self.known is None:
            self.known = pickle.loads(self.held.value)
        return self.known


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows in the jobs that run inside, for rows that hold texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """A job's shuffle files go as soon as it ends, in the jobs that run inside; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder's path for files that jobs of this application share."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """Run ``fn`` on every Arrow batch; it yields dicts of columns in the schema's names."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                     for f in arrow for x in (out[f.name],)], schema=arrow)

    return df.mapInArrow(run, kind)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator needs, whatever else the table holds."""
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"),
                       F.col(quoted(text_col)).cast("string").alias("text"))
