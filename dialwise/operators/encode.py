"""Categorical encodings and scaling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.functions.features import fill_null, recode
from dialwise.operators.ordering import running
from dialwise.scale import materialise

# Education levels from lowest to highest; unknown becomes -1.
EDUCATION_LEVELS = {"illiterate": 0, "basic.4y": 1, "basic.6y": 2, "basic.9y": 3, "high.school": 4,
                    "professional.course": 5, "university.degree": 6}

DICTIONARY_LIMIT = 10_000
INLINE_LEVELS = 32


def level_table(df: DataFrame, cols: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Distinct non-null values per column with their alphabetical position."""
    values = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
                .unpivot([], list(cols), "column", "level").where("level IS NOT NULL").distinct())
    # the first six bytes as a number sort as the text does; the text itself breaks ties
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("level", "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    ranked = running(values, prefix, "level", ["column"], strategy=strategy)
    return ranked.select("column", "level", (F.col("rank") - 1).cast("int").alias("code"))


def collect_levels(df: DataFrame, cols: Sequence[str], limit: int = DICTIONARY_LIMIT) -> dict[str, list[str]]:
    """Sorted levels per column on the driver; refuses dictionaries over ``limit``."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
             .unpivot([], list(cols), "column", "level").where("level IS NOT NULL") \
             .distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} levels; use one_hot_vector or label_encode")
    return {c: sorted(r["level"] for r in rows if r["column"] == c) for c in cols}


def label_encode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                 suffix: str = "") -> DataFrame:
    """Integer codes in alphabetical order of the levels in ``fit_on`` (default ``df``).

    A few levels become a CASE, a dictionary of checked small size is
    broadcast, and a larger one is left to an ordinary join.
    """
    source = df if fit_on is None else fit_on
    levels = level_table(source, cols)
    head = levels.limit(DICTIONARY_LIMIT + 1).collect()
    small = len(head) <= DICTIONARY_LIMIT
    levels = levels if small else materialise(levels)
    out = df
    for c in cols:
        name, text = f"{c}{suffix}", F.col(c).cast("string")
        mine = {r["level"]: r["code"] for r in head if r["column"] == c}
        if small and len(mine) <= INLINE_LEVELS:
            out = out.withColumn(name, recode(text, mine).cast("int"))
            continue
        if small:
            codes = F.broadcast(df.sparkSession.createDataFrame(list(mine.items()), "__level string, __code int"))
        else:
            codes = levels.where(F.col("column") == c).select(
                F.col("level").alias("__level"), F.col("code").alias("__code"))
        out = out.join(codes, text == F.col("__level"), "left")
        out = out.withColumn(name, F.col("__code")).drop("__level", "__code")
    return out


def ordinal_encode(df: DataFrame, col: str = "education", levels: Mapping[str, int] = EDUCATION_LEVELS,
                   unknown: int = -1) -> DataFrame:
    return df.withColumn(col, fill_null(recode(col, levels), unknown))


def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """0/1 columns ``col_level``, without the alphabetically first level of each.

    Levels whose names differ in signs alone get numbered columns, in order.
    """
    levels = levels or collect_levels(df, cols)
    made: dict = {}
    for c in cols:
        for v in list(levels[c])[1:]:
            plain = name = re.sub(r"\W+", "_", f"{c}_{v}")
            times = 1
            while name in made:
                times += 1
                name = f"{plain}_{times}"
            made[name] = F.coalesce(F.col(c) == v, F.lit(False)).cast("int")
    return df.withColumns(made).drop(*cols)


def one_hot_vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same encoding as one sparse vector column per input."""
    indexed, coded = [f"{c}__index" for c in cols], [f"{c}__onehot" for c in cols]
    # the encoder drops its last index, so the order is reversed
    indexer = StringIndexer(inputCols=list(cols), outputCols=indexed, stringOrderType="alphabetDesc")
    encoder = OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True)
    return Pipeline(stages=[indexer, encoder]).fit(df).transform(df).drop(*indexed)


def standardise(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z-scores with the population deviation of ``fit_on``; a constant column gives 0."""
    source = df if fit_on is None else fit_on
    stats = source.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                  for c in cols])).scalar()
    return df.withColumns({
        c: F.when(stats[c]["s"] > 0, (F.col(c) - stats[c]["m"]) / stats[c]["s"])
            .otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in cols})


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)
