"""Feature scores and selections that are plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dialwise.operators.groups import mark_selected
from dialwise.operators.ordering import running


def _xlnx(x):
    return F.when(x > 0, x * F.ln(x.cast("double"))).otherwise(0.0)


def mutual_information(df: DataFrame, discrete: Sequence[str] = (), continuous: Sequence[str] = (),
                       label: str = "y", bins: int = 256, strategy: str = "auto") -> DataFrame:
    """Mutual information of each feature with a 0/1 label, in nats.

    Discrete features are exact. Continuous ones are cut into ``bins`` by the
    share of rows with a smaller value, so equal values share a bin.
    """
    counts = [F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")]
    parts = []
    if discrete:
        long = df.select(label, *[F.col(c).cast("string").alias(c) for c in discrete]) \
                 .unpivot([label], list(discrete), "feature", "bin")
        parts.append(long.groupBy("feature", "bin").agg(*counts))
    if continuous:
        long = df.select(label, *[F.col(c).cast("double").alias(c) for c in continuous]) \
                 .unpivot([label], list(continuous), "feature", "value").where("value IS NOT NULL")
        values = long.groupBy("feature", "value").agg(*counts).withColumn("n", F.col("n0") + F.col("n1"))
        placed = running(values, "value", "value", ["feature"], sums={"upto": "n"}, strategy=strategy,
                         totals=True)
        bin_ = F.floor((F.col("upto") - F.col("n")) * bins / F.col("upto_total")).cast("string")
        parts.append(placed.groupBy("feature", bin_.alias("bin")).agg(F.sum("n0").alias("n0"),
                                                                      F.sum("n1").alias("n1")))
    binned = reduce(DataFrame.unionByName, parts)
    n0, n1 = F.col("n0"), F.col("n1")
    s0, s1 = F.sum("n0"), F.sum("n1")
    within = F.sum(_xlnx(n0) + _xlnx(n1) - _xlnx(n0 + n1))
    mi = (within - _xlnx(s0) - _xlnx(s1) + _xlnx(s0 + s1)) / (s0 + s1)
    return binned.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mutual_information"))


def combined_ranking(scores: DataFrame, names: Sequence[str], key: str = "feature") -> DataFrame:
    """Mean of min-max scaled scores, joined by feature name, best first.

    The table has one row per feature, so one window over all of it is enough.
    """
    every = W.partitionBy()
    scaled = [F.coalesce(F.try_divide(F.col(n) - F.min(n).over(every),
                                      F.max(n).over(every) - F.min(n).over(every)), F.lit(0.0)) for n in names]
    mean = sum(scaled[1:], scaled[0]) / len(names)
    return scores.withColumn("combined", mean).orderBy(F.desc("combined"), key)


def selection_summary(importance: DataFrame, selections: dict[str, DataFrame], key: str = "feature") -> DataFrame:
    """Importance with one flag per selection and the number of selections that agree."""
    out = importance
    for name, chosen in selections.items():
        out = mark_selected(out, chosen, key, f"by_{name}")
    return out.withColumn("votes", sum((F.col(f"by_{n}").cast("int") for n in selections), F.lit(0)))
