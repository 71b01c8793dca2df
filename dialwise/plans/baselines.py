"""Predictors that need no training beyond one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.functions.hashing import uniform


def majority_class(df: DataFrame, fit_on: DataFrame, label: str, out: str) -> DataFrame:
    """Predict the most frequent class; the smaller one on a tie."""
    counts = fit_on.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label)))).scalar()
    return df.withColumn(out, top)


def class_proportional(df: DataFrame, fit_on: DataFrame, label: str, id: str, out: str, seed: int = 42) -> DataFrame:
    """Predict class 1 at random with the rate of positives."""
    rate = fit_on.agg(F.avg(label)).scalar()
    return df.withColumn(out, (uniform(seed, id) < rate).cast("int"))


def soft_vote(members: Sequence[DataFrame], id: str, prob: str = "prob") -> DataFrame:
    """Mean probability of several models' predictions, matched by id; null where a member has none."""
    stacked = reduce(DataFrame.unionByName, [m.select(id, prob) for m in members])
    return stacked.groupBy(id).agg(F.when(F.count(prob) == len(members), F.sum(prob) / len(members)).alias(prob))
