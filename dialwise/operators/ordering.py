"""Ranks, running totals and previous-row values without a one-task window.

``running`` gives every row its 1-based position in ``(order, id)`` within
its group, running totals, and values of the preceding row. Small inputs use
one ordinary window. Beyond that:

1. rows get a bucket, ascending in ``(order, id)``. Cut points are collected
   once and become literals, so a recomputed task puts a row in the same
   bucket. A key shared by very many rows is cut further by id;
2. one map-side-combined aggregate gives each ``(group, bucket)`` its count,
   sums and last row. Running totals over that table give each bucket's start;
3. the start enters its bucket as a header row ahead of the data, so one
   window over ``(group, bucket)`` yields the final numbers: the data is
   shuffled once and never joined.

Cut points are quantiles over all rows, so no ``(group, bucket)`` exceeds
about ``rows / buckets`` however the groups are skewed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from dialwise.scale import bucket_count, input_bytes, is_narrow, is_small, materialise

BUCKET = ["__major", "__minor"]


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(
    df: DataFrame,
    order,
    id: str,
    group: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    prior: Mapping[str, str] | None = None,
    rank: str = "rank",
    strategy: str = "auto",
    uniform_range: int | None = None,
    keep: Callable[[], Column] | None = None,
    buckets: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add ``rank``, running ``sums`` and ``prior``-row values to ``df``.

    With ``totals`` each row also gets ``<rank>_total`` and ``<sum>_total``,
    the final values of its group.

    ``order`` is a numeric column or expression, ascending, nulls last; ``id``
    is unique within a group and breaks ties and splits a single hot key. ``uniform_range`` states that the
    key is uniform over ``[0, uniform_range)`` and saves the sampling pass.
    ``keep`` builds a condition over ``<name>_before`` (totals ahead of a
    bucket), ``<name>_within`` and ``<name>_total`` (of the group); only buckets meeting it are sorted, so it
    must hold for every bucket with rows the caller wants.
    """
    sums, prior = dict(sums or {}), dict(prior or {})
    df = df.withColumn("__key", _as_col(order))
    if strategy == "auto":
        strategy = "plain" if buckets is None and is_small(df) else "bucketed"
    if strategy == "plain":
        return _plain(df, id, group, sums, prior, rank, totals).drop("__key")
    # the passes below each read the input, so anything dearer than a scan is stored first
    df = df if is_narrow(df) else materialise(df)
    return _bucketed(df, id, group, sums, prior, rank, uniform_range, keep, buckets, totals)


def _plain(df, id, group, sums, prior, rank, totals):
    w = W.partitionBy(*group).orderBy(F.col("__key").asc_nulls_last(), F.col(id))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols = {rank: F.row_number().over(w).cast("bigint")}
    cols.update({out: F.sum(c).over(upto) for out, c in sums.items()})
    cols.update({out: F.lag(c).over(w) for out, c in prior.items()})
    if totals:
        whole = W.partitionBy(*group)
        cols[f"{rank}_total"] = F.count(F.lit(1)).over(whole)
        cols.update({f"{out}_total": F.sum(c).over(whole) for out, c in sums.items()})
    return df.withColumns(cols)


def _bucketed(df, id, group, sums, prior, rank, uniform_range, keep, buckets, totals):
    group = list(group)
    spark = df.sparkSession
    original = df.columns
    if uniform_range is not None:
        n = buckets or bucket_count(spark, int(input_bytes(df) / 16))
        major = F.floor(F.col("__key").cast("double") * n / float(uniform_range)).cast("int")
        placed = df.withColumn("__major", major).withColumn("__minor", F.lit(0))
    else:
        placed = _place_by_quantiles(df, id, buckets)

    measures = {rank: F.count(F.lit(1)), **{out: F.sum(c) for out, c in sums.items()}}
    aggs = [agg.alias(f"{out}_within") for out, agg in measures.items()]
    if prior:
        last = F.max_by(F.struct(*[F.col(c) for c in prior.values()]), F.struct("__key", F.col(id)))
        aggs.append(last.alias("__last"))
    per_bucket = placed.groupBy(*group, *BUCKET).agg(*aggs)

    across = W.partitionBy(*group).orderBy(*BUCKET)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.withColumns(
        {f"{out}_before": F.coalesce(F.sum(f"{out}_within").over(before), F.lit(0)) for out in measures}
        | {f"{out}_total": F.sum(f"{out}_within").over(W.partitionBy(*group)) for out in measures})
    if prior:
        starts = starts.withColumn("__last", F.lag("__last").over(across))
    if keep is not None:
        starts = starts.where(keep())
        wanted = starts.select(*group, *BUCKET)
        # without groups this table has a bounded number of buckets
        wanted = wanted if group else F.broadcast(wanted)
        placed = _semi(placed, wanted, group + BUCKET)

    # a running sum skips nulls, as a running total of costs must
    header = starts.select(
        *group, *BUCKET, F.lit(0).alias("__body"),
        F.col(f"{rank}_before").alias("__n"),
        *[F.col(f"{out}_before").alias(f"__s_{out}") for out in sums],
        *[F.col("__last")[c].alias(f"__p_{out}") for out, c in prior.items()],
        *[F.col(f"{out}_total").alias(f"__t_{out}") for out in measures if totals])
    body = placed.withColumns({
        "__body": F.lit(1), "__n": F.lit(1).cast("bigint"),
        **{f"__s_{out}": F.col(c) for out, c in sums.items()},
        **{f"__p_{out}": F.col(c) for out, c in prior.items()}})
    both = body.unionByName(header, allowMissingColumns=True)

    w = W.partitionBy(*group, *BUCKET).orderBy("__body", F.col("__key").asc_nulls_last(), F.col(id))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    cols = {rank: F.sum("__n").over(upto)}
    cols.update({out: F.sum(f"__s_{out}").over(upto) for out in sums})
    cols.update({out: F.lag(f"__p_{out}").over(w) for out in prior})
    if totals:
        cols.update({f"{out}_total": F.max(f"__t_{out}").over(upto) for out in measures})
    made = both.withColumns(cols).where("__body = 1")
    return made.select(*[c for c in original if c != "__key" and c not in cols], *cols)


def _semi(df, wanted, keys):
    renamed = wanted.select(*[F.col(k).alias(f"__w_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in keys])
    return df.join(renamed, on, "left_semi")


def _place_by_quantiles(df, id, buckets):
    """Add ``__major``/``__minor`` from quantiles of a bounded hash sample.

    The sample only balances the buckets; it has no bearing on the result.
    """
    spark = df.sparkSession
    key = F.col("__key").cast("double")
    rows = df.count()
    n = buckets or bucket_count(spark, rows)
    every = max(1, rows // max(100_000, 20 * n))
    sample = df.select(key.alias("k"), F.col(id).alias("i")).where("k is not null")
    if every > 1:
        sample = sample.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0)
    shares = [i / n for i in range(1, n)]
    cuts = []
    if shares:
        cuts = sample.agg(F.percentile_approx("k", shares, 50 * n)).first()[0] or []
    heavy = _repeated(cuts)
    edges = sorted(set(cuts) | {math.nextafter(v, math.inf) for v in heavy})
    splits = [-math.inf, *edges, math.inf]

    placed = _bucketize(df.withColumn("__bk", key), "__bk", "__major", splits)
    numeric_id = isinstance(df.schema[id].dataType, T.NumericType)
    if not heavy:
        return placed.withColumn("__minor", F.lit(0)).drop("__bk")

    parts = sum(1 for c in cuts if c in set(heavy)) + 1
    at_heavy = sample.where(F.col("k").isin(heavy))
    if numeric_id:
        id_cuts = at_heavy.agg(
            F.percentile_approx(F.col("i").cast("double"), [i / parts for i in range(1, parts)], 50 * parts)
        ).first()[0] or []
        id_splits = [-math.inf, *sorted(set(id_cuts)), math.inf]
        placed = _bucketize(placed.withColumn("__bi", F.col(id).cast("double")), "__bi", "__minor", id_splits)
    else:
        # quantiles of the text, from the same bounded sample
        texts = sorted(r["i"] for r in at_heavy.select(F.col("i").cast("string").alias("i")).where("i is not null").collect())
        steps = sorted({texts[len(texts) * i // parts] for i in range(1, parts)}) if texts else []
        above = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: F.col(id).cast("string") >= s)
        placed = placed.withColumn("__bi", F.lit(0)).withColumn("__minor", F.size(above) if steps else F.lit(0))
    heavy_majors = [splits.index(v) for v in heavy]
    minor = F.when(F.col("__major").isin(heavy_majors), F.col("__minor")).otherwise(F.lit(0))
    return placed.withColumn("__minor", minor).drop("__bk", "__bi")


def _repeated(values):
    seen, twice = set(), set()
    for v in values:
        (twice if v in seen else seen).add(v)
    return sorted(twice)


def _bucketize(df, source, target, splits):
    """Index of the half-open interval holding ``source``; nulls go last."""
    if len(splits) == 2:
        index = F.lit(0)
    else:
        df = Bucketizer(splits=splits, inputCol=source, outputCol="__idx",
                        handleInvalid="keep").transform(df)
        index = F.col("__idx").cast("int")
    index = F.when(F.col(source).isNull(), F.lit(len(splits))).otherwise(index)
    return df.withColumn(target, index).drop("__idx")
