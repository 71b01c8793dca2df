"""Aggregations over leads and over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.operators.comoments import pair_moments
from dialwise.operators.profile import describe_numeric, rows_from
from dialwise.operators.joins import match
from dialwise.operators.quantiles import exact_quantiles


def fixed_order(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """Put a grouped result in a given order, with nulls for missing groups."""
    dim = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{by} string, pos int")
    return dim.join(df, by, "left").orderBy("pos")


def group_count(df: DataFrame, by: str, order: Sequence[str] | None = None) -> DataFrame:
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return fixed_order(counted, by, order) if order else counted.orderBy(F.desc("n"), by)


def group_rate(df: DataFrame, by: str, label: str = "y", order: Sequence[str] | None = None) -> DataFrame:
    """Positive rate in percent per group, highest first or in a given order."""
    rated = df.groupBy(by).agg((F.avg(label) * 100).alias("rate"))
    return fixed_order(rated, by, order) if order else rated.orderBy(F.desc("rate"), by)


def group_describe(df: DataFrame, cols: Sequence[str], by: Sequence[str], strategy: str = "auto") -> DataFrame:
    return describe_numeric(df, cols, by, strategy)


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence, normalize: bool = False) -> DataFrame:
    """Counts of ``b`` values per ``a`` with an ``All`` margin, or row percentages."""
    cells = [F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in b_values]
    known = df.where(F.col(a).isNotNull())
    if normalize:
        wide = known.groupBy(a).agg(*cells, F.count(b).alias("__n"))
        return wide.select(a, *[F.round(100.0 * F.col(f"{b}_{v}") / F.col("__n"), 2).alias(f"{b}_{v}")
                                for v in b_values])
    wide = known.rollup(F.col(a).alias(a)).agg(*cells, F.count(b).alias("All"))
    return wide.withColumn(a, F.coalesce(a, F.lit("All")))


def pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are known; null when either is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, cols: Sequence[str], min_abs: float | None = None) -> DataFrame:
    """Pearson matrix in long form; with ``min_abs`` only the strong pairs, each once.

    Over rows where both columns are known; null when either is constant there.
    """
    names = F.array(*[F.lit(c) for c in cols])
    r = F.try_divide("cov", F.sqrt("var_i") * F.sqrt("var_j"))
    made = pair_moments(df, cols).select(names[F.col("i")].alias("f1"), names[F.col("j")].alias("f2"), r.alias("r"), "i", "j")
    apart = made.where("i <> j")
    if min_abs is not None:
        return apart.where(F.abs("r") > min_abs).select("f1", "f2", "r")
    mirrored = apart.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "r")
    return made.select("f1", "f2", "r").unionByName(mirrored)


def target_correlations(df: DataFrame, cols: Sequence[str], label: str = "y") -> DataFrame:
    """Signed and absolute correlation with the label, strongest first."""
    wide = df.agg(*[pearson(c, label).alias(c) for c in cols])
    long = rows_from(wide, [], [F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])
    return long.withColumn("abs_r", F.abs("r")).orderBy(F.desc_nulls_last("abs_r"), "feature")


def conditional_shares(df: DataFrame, conditions: dict[str, Column], label: str = "y") -> DataFrame:
    """Rows meeting each condition: count, share of all, and count per class."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[
        F.struct(F.count_if(c).alias("n"), F.count_if(c & (F.col(label) == 1)).alias("positives"),
                 F.count_if(c & (F.col(label) == 0)).alias("negatives")).alias(name)
        for name, c in conditions.items()])
    return rows_from(wide, [], [
        F.struct(F.lit(name).alias("condition"), F.col(name)["n"].alias("n"),
                 F.try_divide(100.0 * F.col(name)["n"], F.col("__n")).alias("pct"),
                 F.col(name)["positives"].alias("positives"), F.col(name)["negatives"].alias("negatives"))
        for name in conditions])


def fold_summary(metrics: DataFrame, keys: Sequence[str] = ("model", "strategy", "metric")) -> DataFrame:
    """Mean, population std, min and max over folds."""
    return metrics.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def strategy_means(metrics: DataFrame, metric: str) -> DataFrame:
    """Mean over models of the fold mean, per strategy, best first."""
    per_model = (metrics.where(F.col("metric") == metric).groupBy("strategy", "model")
                        .agg(F.avg("value").alias("v")))
    return per_model.groupBy("strategy").agg(F.avg("v").alias("mean")).orderBy(F.desc("mean"), "strategy")


def best_row(df: DataFrame, by: str, ties: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The row with the largest ``by``; the first in ``ties`` order wins a tie.

    A plain aggregate, so each task passes on one row per group.
    """
    picked = df.where(F.col(by).isNotNull()).groupBy(*group).agg(
        F.min_by(F.struct("*"), F.struct(-F.col(by), *ties)).alias("__best"))
    return picked.where("__best IS NOT NULL").select("__best.*")


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` and share of each class."""
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")))
    n, k = totals.scalar()["n"], totals.scalar()["k"]
    return counted.select(
        label, "n", (n / (k * F.col("n"))).alias("weight"), (100.0 * F.col("n") / n).alias("pct"))


def class_shares(df: DataFrame, part: str, label: str = "y") -> DataFrame:
    """Share of each class, in percent, within each part of the data."""
    counted = df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(part).agg(F.sum("n").alias("__t"))
    return match(counted, totals, [part]).select(part, label, "n", (100.0 * F.col("n") / F.col("__t")).alias("pct"))


def median_split(df: DataFrame, col: str, strategy: str = "auto") -> DataFrame:
    return exact_quantiles(df, [col], {"median": 0.5}, strategy=strategy)


def at_or_above(df: DataFrame, col: str, thresholds: Sequence[float]) -> DataFrame:
    """Each row once per threshold it reaches."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return df.select("*", steps).where(F.col(col) >= F.col("threshold"))


def votes(selections: dict[str, DataFrame], key: str = "feature") -> DataFrame:
    """How many of the named selections contain each key, with one flag per selection."""
    tagged = [s.select(key).distinct().withColumn("__set", F.lit(name)) for name, s in selections.items()]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    flags = [F.max(F.when(F.col("__set") == n, 1).otherwise(0)).alias(f"by_{n}") for n in selections]
    return union.groupBy(key).agg(*flags, F.count(F.lit(1)).alias("votes"))


def mark_selected(df: DataFrame, selected: DataFrame, key: str, out: str = "selected") -> DataFrame:
    """Keep all rows with a flag telling whether the key is in ``selected``."""
    marks = selected.select(F.col(key).alias("__key")).distinct()
    return (df.join(marks, F.col(key) == F.col("__key"), "left")
              .withColumn(out, F.col("__key").isNotNull()).drop("__key"))


def segment_metrics(leads: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Long metric table over leads: model = job, strategy = contact, five hash folds."""
    hit = F.col("score") >= threshold
    right = (hit & (F.col("y") == 1)) | (~hit & (F.col("y") == 0))
    wide = leads.groupBy(F.col("job").alias("model"), F.col("contact").alias("strategy"),
                         (F.col("h") % 5).cast("int").alias("fold")).agg(
        F.round(F.avg("y"), 6).alias("response"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"),
        F.round(F.try_divide(F.count_if(hit & (F.col("y") == 1)), F.count_if(F.col("y") == 1)), 6)
         .alias("recall"))
    return wide.unpivot(["model", "strategy", "fold"], ["response", "accuracy", "recall"], "metric", "value")
