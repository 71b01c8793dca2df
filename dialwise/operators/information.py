"""Mutual information of continuous features with a class, by nearest neighbours in one dimension.

For a row, the distance to its k-th neighbour within its class sets a reach, and
the number of rows of all classes within it, beside the sizes of the whole and
of the class, gives the row's share of the information. On a line both are
questions of order: neighbours are at most k distinct values away, and counts
are differences of running totals. So equal values are summed first, ranks and
totals come from the distributed order, and no row meets another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.operators.ordering import running

NEIGHBOURS = 3
#: the digamma series is used from here on, and steps down from there
_SERIES_FROM = 6


def digamma(n: Column) -> Column:
    """Of a positive whole number, to about 1e-10."""
    x = n.cast("double") + _SERIES_FROM
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return series - sum((1 / (n.cast("double") + i) for i in range(_SERIES_FROM)), F.lit(0.0))


def neighbour_information(df: DataFrame, continuous: Sequence[str], label: str = "y", k: int = NEIGHBOURS, strategy: str = "auto") -> DataFrame:
    """``feature, mutual_information`` in nats, never below 0.

    Rows within the reach are nearer than the k-th neighbour of the class; if
    that has the same value, they are the rows of this value. Null values and
    labels are left out, as are classes of a single row. A feature without rows
    gives none.
    """
    long = df.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(c) for c in continuous]) \
        .unpivot(["label"], list(continuous), "feature", "value").where("value IS NOT NULL AND label IS NOT NULL")
    counts = long.groupBy("feature", "label", "value").agg(F.count("value").alias("n"))
    # as many rows as there are features and classes
    classes = counts.groupBy("feature", "label").agg(F.sum("n").alias("n_class")).where("n_class > 1")
    counts = counts.join(classes, ["feature", "label"])
    ranked = running(counts, "value", "value", ["feature", "label"], rank="r", strategy=strategy)

    around = ranked.select("feature", "label", F.explode(F.sequence(F.col("r") - k, F.col("r") + k)).alias("at"), "r", "value", "n", "n_class")
    own = lambda c: F.max(F.when(F.col("r") == F.col("at"), F.col(c))).alias(c)
    met = around.groupBy("feature", "label", "at").agg(own("value"), own("n"), own("n_class"), F.collect_list(F.struct("value", "n")).alias("near")) \
        .where("value IS NOT NULL").withColumn("k", F.least(F.lit(k), F.col("n_class") - 1).cast("int"))
    others = F.array_sort(F.transform("near", lambda e: F.struct(
        F.abs(e["value"] - F.col("value")).alias("far"), (e["n"] - (e["value"] == F.col("value")).cast("long")).alias("n"))))
    start = F.struct(F.col("k").cast("long").alias("left"), F.lit(0.0).alias("reach"))
    walked = F.aggregate(others, start, lambda s, e: F.struct(
        (s["left"] - e["n"]).alias("left"), F.when(s["left"] > 0, F.when(e["n"] > 0, e["far"]).otherwise(s["reach"])).otherwise(s["reach"]).alias("reach")))
    reached = met.select("feature", "label", "value", "n", "n_class", "k", walked["reach"].alias("reach"))

    # a mark before (0) or after (2) the rows (1) of a value takes the running total there
    mark = lambda sign, kind, at: F.struct(F.lit(sign).alias("sign"), kind.alias("kind"), at.alias("at"))
    tied = F.col("reach") == 0
    marks = reached.select("*", F.inline(F.array(
        mark(1, F.when(tied, 2).otherwise(0), F.col("value") + F.col("reach")), mark(-1, F.when(tied, 0).otherwise(2), F.col("value") - F.col("reach"))))) \
        .withColumns({"weight": F.col("n"), "n": F.lit(0).cast("long")})
    rows = counts.groupBy("feature", F.col("value").alias("at")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit(1))
    every = marks.unionByName(rows, allowMissingColumns=True)
    name = F.concat_ws(":", "kind", "sign", F.col("label").cast("string"), F.col("value").cast("string"))
    passed = running(every.withColumn("name", name), "at", "name", ["feature"], sums={"upto": "n"}, rank="place", strategy=strategy)
    within = passed.where("sign IS NOT NULL").groupBy("feature", "label", "value").agg(
        F.sum(F.col("sign") * F.col("upto")).alias("m"), F.first("weight").alias("n"), F.first("n_class").alias("n_class"), F.first("k").alias("k"))
    share = digamma(F.col("k")) - digamma(F.col("n_class")) - digamma(F.col("m"))
    found = within.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * share).alias("shares"))
    return found.select("feature", F.greatest(digamma(F.col("rows")) + F.col("shares") / F.col("rows"), F.lit(0.0)).alias("mutual_information"))
