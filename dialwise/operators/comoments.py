"""Means, deviations and co-moments of all pairs of columns in one pass.

Each task keeps one matrix per moment and merges batches into it around their
own means, so large offsets lose no digits; the tasks' matrices are small tables
that Spark adds up per pair. The plan holds no expression per pair, so it is the
same for six columns and for hundreds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.operators.joins import match
from dialwise.scale import materialise

PARTIAL = ("i int, j int, n double, bad double, mean_i double, mean_j double, "
           "m2_i double, m2_j double, c double, top_i double, top_j double")
#: a deviation below this share of the column's largest value counts as none
FLAT = 1e-13
#: a sum of squares is what is left of larger ones; below this share of those it is rounding
ROUNDING = 1e-13


def _batch_moments(x, known):
    """(n, bad, mean, m2, c) of one batch; entry [i, j] is about column i where j is known too."""
    bad = known & ~np.isfinite(x)
    k = known.astype(float)
    x = np.where(known & ~bad, x, 0.0)
    n_bad = bad.astype(float).T @ k
    # the first value is taken off before anything is averaged, so a constant stays exact
    first = np.array([x[known[:, i] & ~bad[:, i], i][:1].sum() for i in range(x.shape[1])])
    x = np.where(known & ~bad, x - first, 0.0)
    middle = x.sum(0) / np.maximum(k.sum(0), 1)
    x = np.where(known & ~bad, x - middle, 0.0)
    if known.all():
        d = x.shape[1]
        n = np.full((d, d), float(len(x)))
        s, q = np.repeat(x.sum(0)[:, None], d, 1), np.repeat((x * x).sum(0)[:, None], d, 1)
    else:
        n, s, q = k.T @ k, x.T @ k, (x * x).T @ k
    some = np.maximum(n, 1)
    m2 = q - s * s / some
    return n, n_bad + n_bad.T, (first + middle)[:, None] + s / some, np.where(m2 <= ROUNDING * q, 0.0, m2), x.T @ x - s * s.T / some


def _merge(a, b):
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[2] - a[2], 0.0)
    mean = np.where(a[0] > 0, a[2] + gap * share, b[2])
    return n, a[1] + b[1], mean, a[3] + b[3] + gap * gap * a[0] * share, a[4] + b[4] + gap * gap.T * a[0] * share


def _task_moments(batches, d):
    held, top = None, np.zeros(d)
    for batch in batches:
        if not batch.num_rows:
            continue
        known = np.column_stack([np.asarray(batch.column(i).is_valid()) for i in range(d)])
        x = np.column_stack([batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(d)])
        top = np.maximum(top, np.where(np.isfinite(x), np.abs(x), 0.0).max(0))
        made = _batch_moments(x, known)
        held = made if held is None else _merge(held, made)
    if held is None:
        return
    i, j = np.triu_indices(d)
    n, bad, mean, m2, c = held
    yield pa.RecordBatch.from_arrays(
        [pa.array(i.astype("int32")), pa.array(j.astype("int32")), *[pa.array(v) for v in (
            n[i, j], bad[i, j], mean[i, j], mean[j, i], m2[i, j], m2[j, i], c[i, j], top[i], top[j])]],
        names=["i", "j", "n", "bad", "mean_i", "mean_j", "m2_i", "m2_j", "c", "top_i", "top_j"])


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``i, j, n, var_i, var_j, cov`` for every pair ``i <= j`` of positions in ``cols``.

    ``n`` counts the rows where both are known; the moments are over those
    rows (population form), null without one, NaN where one of the two is
    not finite. Pairs are there for an empty table too.
    """
    d = len(cols)
    plain = df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"c{p}") for p, c in enumerate(cols)])
    partial = materialise(plain.mapInArrow(lambda batches: _task_moments(batches, d), PARTIAL))
    whole = partial.where("n > 0").groupBy("i", "j").agg(
        *[(F.sum(F.col("n") * F.col(f"mean_{s}")) / F.sum("n")).alias(f"at_{s}") for s in "ij"])
    off = {s: F.col(f"mean_{s}") - F.col(f"at_{s}") for s in "ij"}
    total = F.sum("n")
    spread = lambda s: F.sum(F.col(f"m2_{s}") + F.col("n") * off[s] * off[s]) / total
    flat = lambda s: F.pow(F.lit(FLAT) * F.max(f"top_{s}"), 2)
    unsound = F.sum("bad") > 0
    kept = lambda value: F.when(unsound, F.lit(float("nan"))).otherwise(value)
    merged = match(partial.where("n > 0"), whole, ["i", "j"]).groupBy("i", "j").agg(
        total.cast("long").alias("n"),
        *[kept(F.when(spread(s) <= flat(s), 0.0).otherwise(spread(s))).alias(f"var_{s}") for s in "ij"],
        kept(F.sum(F.col("c") + F.col("n") * off["i"] * off["j"]) / total).alias("cov"))
    places = df.sparkSession.range(d).select(F.col("id").cast("int").alias("i"))
    pairs = places.select("i", F.explode(F.sequence("i", F.lit(d - 1))).alias("j")) if d else places.select("i", F.col("i").alias("j"))
    return match(pairs, merged, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
