"""Delimited files: the lead file, and result tables read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_INT, _STR, _DBL = T.IntegerType(), T.StringType(), T.DoubleType()

# Columns of the lead file in file order.
LEAD_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("age", _INT), ("job", _STR), ("marital", _STR), ("education", _STR), ("default", _STR),
        ("housing", _STR), ("loan", _STR), ("contact", _STR), ("month", _STR), ("day_of_week", _STR),
        ("duration", _INT), ("campaign", _INT), ("pdays", _INT), ("previous", _INT), ("poutcome", _STR),
        ("emp.var.rate", _DBL), ("cons.price.idx", _DBL), ("cons.conf.idx", _DBL), ("euribor3m", _DBL),
        ("nr.employed", _DBL), ("y", _STR)]])


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";",
                   corrupt: str | None = None) -> DataFrame:
    """Read a quoted file with a header; dots in column names become underscores.

    Bad rows keep nulls; ``corrupt`` names a column for their raw text.
    """
    full = schema.add(corrupt, T.StringType()) if corrupt else schema
    reader = spark.read.schema(T.StructType(list(full))).options(
        sep=sep, header=True, quote='"', escape='"', mode="PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    try:
        df = reader.csv(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no readable file at {path}") from error
    return df.toDF(*[c.replace(".", "_") for c in df.columns])
