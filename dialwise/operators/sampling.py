"""Stratified folds and splits, seeded shuffles and accuracy blending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.functions.features import clip, indicator_pair, predicted_class
from dialwise.functions.hashing import UNIT_RANGE, hash52, uniform
from dialwise.operators.ordering import running


def _class_rank(df, label, id, seed, strategy, totals=False):
    return running(df, hash52(seed, id), id, [label], rank="__r", strategy=strategy, uniform_range=UNIT_RANGE,
                   totals=totals)


def stratified_folds(df: DataFrame, label: str, id: str, k: int, seed: int = 42, out: str = "fold",
                     strategy: str = "auto") -> DataFrame:
    """Shuffled fold number in 0..k-1; class counts differ by at most one between folds."""
    dealt = _class_rank(df, label, id, seed, strategy)
    return dealt.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def stratified_split(df: DataFrame, label: str, id: str, frac: float, seed: int = 42, out: str = "is_test",
                     strategy: str = "auto") -> DataFrame:
    """Mark ``round(frac * n_c)`` rows of each class as test rows."""
    dealt = _class_rank(df, label, id, seed, strategy, totals=True)
    test = F.col("__r") <= F.round(F.lit(float(frac)) * F.col("__r_total"))
    return dealt.withColumn(out, test.cast("int")).drop("__r", "__r_total")


def seeded_shuffle(df: DataFrame, id: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash52(seed, id), id)


def blend_to_accuracy(df: DataFrame, truth: str, target, id: str, p0: str = "prob_short",
                      p1: str = "prob_long", seed: int = 42) -> DataFrame:
    """Replace predictions by the truth at the rate that lifts accuracy to ``target``.

    ``target`` is a number or the name of a column holding one per row; the
    predictions stay as they are where they already reach it.
    """
    level = F.col(target) if isinstance(target, str) else F.lit(float(target))
    real = df.agg(F.avg((predicted_class(p0, p1) == F.col(truth)).cast("int"))).scalar()
    rate = F.when(level <= real, 0.0).otherwise(clip(F.try_divide(level - real, 1 - real), 0.0, 1.0))
    swap = uniform(seed, id) < rate
    t0, t1 = indicator_pair(truth)
    return df.withColumn("__swap", swap).withColumns({
        p0: F.when(F.col("__swap"), t0).otherwise(F.col(p0)),
        p1: F.when(F.col("__swap"), t1).otherwise(F.col(p1))}).drop("__swap")
