"""Profiling operators: each scans its input once or twice, column-pruned."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.operators.joins import few_or_many, match
from dialwise.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
REACH = 8.0  # bandwidths after which a kernel is left out


def rows_from(wide: DataFrame, keys: Sequence[str], structs) -> DataFrame:
    """Turn one wide aggregate row into one row per struct."""
    return wide.select(*keys, F.inline(F.array(*structs)))


def columns_of(df: DataFrame, kind: str, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric or categorical columns, from the schema alone."""
    wanted = {"numeric": T.NumericType, "categorical": T.StringType}[kind]
    return [f.name for f in df.schema if isinstance(f.dataType, wanted) and f.name not in exclude]


def column_types(df: DataFrame) -> DataFrame:
    rows = [(f.name, "numeric" if isinstance(f.dataType, T.NumericType)
             else "categorical" if isinstance(f.dataType, T.StringType) else "other")
            for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def head(df: DataFrame, id: str, n: int = 5) -> DataFrame:
    return df.orderBy(id).limit(n)


def info(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return rows_from(wide, [], [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f.name).alias("non_null")) for f in df.schema])


def describe_numeric(df: DataFrame, cols: Sequence[str], group: Sequence[str] = (),
                     strategy: str = "auto") -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per column."""
    group = list(group)
    wide = df.groupBy(*group).agg(*[
        agg.alias(f"{c}__{name}") for c in cols for name, agg in (
            ("count", F.count(c)), ("mean", F.avg(c)), ("std", F.stddev_samp(c)),
            ("min", F.min(c).cast("double")), ("max", F.max(c).cast("double")))])
    basics = rows_from(wide, group, [
        F.struct(F.lit(c).alias("column"),
                 *[F.col(f"{c}__{n}").alias(n) for n in ("count", "mean", "std", "min", "max")])
        for c in cols])
    quartiles = exact_quantiles(df, cols, QUARTILES, group, strategy)
    return match(basics, quartiles, [*group, "column"])


def _counted_values(df, cols):
    return (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot([], list(cols), "column", "value").where("value IS NOT NULL")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, unique, top, freq; the smallest value wins a tie for top."""
    return _counted_values(df, cols).groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return rows_from(wide, [], [F.struct(F.lit(c).alias("column"), F.col(c).alias("unique"))
                                    for c in cols])
    return _counted_values(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns holding nulls, with count and percentage."""
    return _share_report(df, {c: F.col(c).isNull() for c in cols}, "nulls").where("nulls > 0")


def sentinel_report(df: DataFrame, cols: Sequence[str], sentinel: str = "unknown") -> DataFrame:
    return _share_report(df, {c: F.col(c) == sentinel for c in cols}, "n").where("n > 0")


def _share_report(df, conditions, name):
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(cond).alias(c) for c, cond in conditions.items()])
    return rows_from(wide, [], [
        F.struct(F.lit(c).alias("column"), F.col(c).alias(name),
                 F.try_divide(100.0 * F.col(c), F.col("__n")).alias("pct")) for c in conditions])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value, most frequent first."""
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), col)


def imbalance(df: DataFrame, label: str = "y") -> DataFrame:
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(neg.alias("negatives"), pos.alias("positives"),
                  F.try_divide(neg, pos).alias("ratio"))


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal-width bins over the overall range, empty ones included; the last is closed."""
    x = F.col(col).cast("double")
    lims = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")))
    lo, hi = lims.scalar()["lo"], lims.scalar()["hi"]
    flat = lo == hi
    lo, hi = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    keys = [by] if by else []
    counted = (df.where(x.isNotNull())
                 .withColumns({"__lo": lo, "__w": (hi - lo) / bins})
                 .withColumn("bin", F.least(F.floor((x - F.col("__lo")) / F.col("__w")),
                                            F.lit(bins - 1)).cast("int"))
                 .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    frame = (df.where(x.isNotNull()).select(*keys).distinct() if by
             else df.sparkSession.range(1)).select(*keys, grid)
    return (match(frame, counted, [*keys, "bin"], "left")
                 .select(*keys, "bin", (lo + F.col("bin") * (hi - lo) / bins).alias("left_edge"),
                         F.coalesce("n", F.lit(0)).alias("n")))


def box_stats(df: DataFrame, col: str, by: str | None = None, strategy: str = "auto") -> DataFrame:
    """Quartiles, whiskers (furthest point within 1.5 IQR) and outlier count."""
    keys = [by] if by else []
    fences = exact_quantiles(df, [col], QUARTILES, keys, strategy).drop("column")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    fences = fences.withColumns({"__low": F.col("q25") - reach, "__high": F.col("q75") + reach})
    x = F.col(col).cast("double")
    # values are counted first, so the join sees distinct values, not rows
    values = df.where(x.isNotNull()).groupBy(*keys, x.alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        placed = match(values, few_or_many(fences), keys)
    else:
        one = fences.select(F.struct("*")).scalar()
        placed = values.withColumn("__f", one).select("__x", "__n", "__f.*")
    inside = (F.col("__x") >= F.col("__low")) & (F.col("__x") <= F.col("__high"))
    return placed.groupBy(*keys, *QUARTILES).agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("__n"))).alias("outliers"),
        F.sum("__n").alias("n"))


def density(df: DataFrame, col: str, by: str, bin_width: float = 1.0, points: int = 200) -> DataFrame:
    """Gaussian density per class on an even grid between the class's extremes.

    Values are first counted in bins of ``bin_width``. A bin then meets the grid
    points within eight bandwidths only: what is further off adds less than 2e-14
    of its weight. Points that no bin reaches have density 0.
    """
    value = F.col(col).cast("double")
    width = float(bin_width)
    present = df.where(value.isNotNull()).select(by, value.alias("__v"))
    b = F.floor(F.col("__v") / width) * width
    binned = present.groupBy(by, b.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    n, s1 = F.sum("__c"), F.sum(F.col("__b") * F.col("__c"))
    s2 = F.sum(F.col("__b") * F.col("__b") * F.col("__c"))
    stats = binned.groupBy(by).agg(n.alias("__n"), F.min("__b").alias("__lo"), F.max("__b").alias("__hi"),
                                   ((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0))).alias("__var"))
    stats = stats.where("__var > 0").withColumn(
        "__h", F.sqrt("__var") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    classes = few_or_many(stats)
    step = (F.col("__hi") - F.col("__lo")) / float(points - 1)
    first = F.greatest(F.ceil((F.col("__b") - REACH * F.col("__h") - F.col("__lo")) / step), F.lit(0))
    last = F.least(F.floor((F.col("__b") + REACH * F.col("__h") - F.col("__lo")) / step), F.lit(points - 1))
    near = (match(binned, classes, [by]).withColumns({"__first": first, "__last": last}).where("__first <= __last")
            .select("*", F.explode(F.sequence("__first", "__last")).alias("point")).drop("__first", "__last"))
    every = (classes.withColumns({"__b": F.col("__lo"), "__c": F.lit(0).cast("long")})
             .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point")))
    z = (F.col("x") - F.col("__b")) / F.col("__h")
    return (near.unionByName(every).withColumn("x", F.col("__lo") + F.col("point") * step)
                .groupBy(by, F.col("point").cast("int").alias("point"), "x", "__n", "__h")
                .agg(F.sum(F.when(F.col("__c") > 0, F.col("__c") * F.exp(-z * z / 2)).otherwise(0.0)).alias("__k"))
                .select(by, "point", "x",
                        (F.col("__k") / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi)))
                        .alias("density")))
