"""Exact quantiles (linear interpolation) that do not gather values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.operators.ordering import running
from dialwise.scale import is_small


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: dict[str, float],
                    group: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """One row per group and column with a double per entry of ``probs``.

    ``percentile`` keeps every distinct value of a group in one task, so past
    the size gate values are first counted and then ordered across buckets.
    """
    group = list(group)
    if strategy == "auto":
        strategy = "plain" if is_small(df) else "bucketed"
    if strategy == "plain":
        wide = df.groupBy(*group).agg(*[
            F.percentile(c, F.array(*[F.lit(p) for p in probs.values()])).alias(c) for c in cols])
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), *[F.col(c)[i].alias(name) for i, name in enumerate(probs)])
            for c in cols])
        return wide.select(*group, F.inline(rows))

    values = df.select(*group, *[F.col(c).cast("double").alias(c) for c in cols]) \
               .unpivot(group, list(cols), "column", "value").where("value IS NOT NULL")
    keys = [*group, "column"]
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counted, "value", "value", group=keys, sums={"upto": "n"}, strategy="bucketed",
                     totals=True).withColumnRenamed("upto_total", "total")
    picks, final = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("upto") > pos) & (F.col("upto") - F.col("n") <= pos)
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"{name}_{side}"))
        part = F.lit(float(p)) * (F.col("total") - 1)
        part = part - F.floor(part)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        final.append((lo * (1 - part) + hi * part).alias(name))
    return placed.groupBy(*keys, "total").agg(*picks).select(*keys, *final)
