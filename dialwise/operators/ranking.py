"""Lift, gains, ROC and precision-recall tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dialwise.operators.ordering import running


def ranked(df: DataFrame, score: str, label: str, id: str, group: Sequence[str] = (),
           strategy: str = "auto", keep=None) -> DataFrame:
    """Rank by score, highest first, with cumulative positives, rows ``n`` and ``positives``."""
    rows = running(df, -F.col(score), id, group, sums={"cum_positives": label},
                   strategy=strategy, keep=keep, totals=True)
    return rows.withColumnsRenamed({"rank_total": "n", "cum_positives_total": "positives"})


def lift_rows(df: DataFrame, score: str, label: str, id: str, group: Sequence[str] = (),
              strategy: str = "auto") -> DataFrame:
    """Population share and lift at every rank."""
    rows = ranked(df, score, label, id, group, strategy)
    share = F.col("rank") / F.col("n")
    gained = F.try_divide(F.col("cum_positives"), F.col("positives"))
    return rows.withColumns({"population_share": share, "lift": gained / share})


def alift_mean(df, score, label, id, group=(), strategy="auto") -> DataFrame:
    """Mean of the per-rank lift; about 1 for a random order."""
    return lift_rows(df, score, label, id, group, strategy).groupBy(*group).agg(F.avg("lift").alias("alift_mean"))


def _cuts_up_to(rank, n):
    """How many of the 100 percent cuts fall at or before ``rank``."""
    ceiling = F.expr(f"(({rank} + 1) * 100 + {n} - 1) div {n}")
    return F.least(F.lit(100), ceiling - 1)


def lift_curve(df: DataFrame, score: str, label: str, id: str, group: Sequence[str] = (),
               strategy: str = "auto") -> DataFrame:
    """Lift and cumulative gain at 1..100 percent of the population.

    Only buckets holding one of the cut ranks are sorted.
    """
    holds_cut = lambda: (_cuts_up_to("rank_before + rank_within", "rank_total")
                         > _cuts_up_to("rank_before", "rank_total"))
    rows = ranked(df.select(*group, id, score, label), score, label, id, group, strategy, keep=holds_cut)
    # the percentages that a rank answers: n * pct div 100 = rank, at most 100 of them
    low, high = F.expr("(rank * 100 + n - 1) div n"), F.expr("((rank + 1) * 100 + n - 1) div n - 1")
    cut = F.least(high, F.lit(100))
    points = rows.where(low <= cut).select("*", F.explode(F.sequence(low, cut)).alias("pct"))
    rate = F.col("positives") / F.col("n")
    lift = F.when(F.col("positives") > 0, (F.col("cum_positives") / F.col("rank")) / rate).otherwise(1.0)
    gain = F.when(F.col("positives") > 0, 100.0 * F.col("cum_positives") / F.col("positives")).otherwise(0.0)
    return points.select(*group, F.col("pct").cast("int").alias("pct"), F.col("rank").alias("contacted"),
                         F.col("cum_positives").alias("captured"), lift.alias("lift"), gain.alias("gain"))


def alift_area(df, score, label, id, group=(), strategy="auto") -> DataFrame:
    """Trapezoid of (lift - 1) over the percent grid, divided by 100; about 0 for a random order."""
    curve = lift_curve(df, score, label, id, group, strategy)
    ends = curve.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pct", "lift"))).alias("p"))
    strips = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1),
                        lambda a, b: (b["pct"] - a["pct"]) * (a["lift"] + b["lift"] - 2) / 2)
    area = F.when(F.size("p") > 1, F.aggregate(strips, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    return ends.select(*group, (area / 100).alias("alift_area"))


def reference_curves(df: DataFrame, label: str) -> DataFrame:
    """Gains of a perfect and of a random order."""
    share = df.agg((100.0 * F.avg(label)).alias("s"))
    point = lambda curve, x, y: F.struct(F.lit(curve).alias("curve"), x.cast("double").alias("population_pct"),
                                         y.cast("double").alias("gain"))
    zero, full = F.lit(0.0), F.lit(100.0)
    return share.select(F.inline(F.array(
        point("perfect", zero, zero), point("perfect", F.col("s"), full), point("perfect", full, full),
        point("random", zero, zero), point("random", full, full))))


def score_steps(df: DataFrame, score: str, label: str, group: Sequence[str] = (),
                strategy: str = "auto") -> DataFrame:
    """One row per distinct score with cumulative true and false positives.

    Equal scores are summed first, so a score shared by very many rows costs
    one row from there on.
    """
    steps = df.groupBy(*group, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    rows = running(steps, -F.col("threshold"), "threshold", group,
                   sums={"tp": "pos", "fp": "neg"}, rank="step", strategy=strategy, totals=True)
    return rows.withColumnsRenamed({"tp_total": "positives", "fp_total": "negatives"}).drop("step_total")



def roc_points(df, score, label, group=(), strategy="auto", drop_collinear=False) -> DataFrame:
    """ROC points at distinct scores, with the leading (0, 0)."""
    group = list(group)
    rows = score_steps(df, score, label, group, strategy)
    if drop_collinear:
        rows = running(rows, "threshold", "threshold", group, rank="__back",
                       prior={"__np": "pos", "__nn": "neg"}, strategy=strategy)
        rows = rows.where("__np IS NULL OR __np <> pos OR __nn <> neg")
    points = rows.select(*group, "threshold", F.try_divide("fp", "negatives").alias("fpr"),
                         F.try_divide("tp", "positives").alias("tpr"))
    start = df.select(*group).groupBy(*group).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                   F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(df, score, label, group=(), strategy="auto") -> DataFrame:
    """Precision-recall points at distinct scores, with the final (1, 0)."""
    group = list(group)
    rows = score_steps(df, score, label, group, strategy)
    points = rows.select(*group, "threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                         F.try_divide("tp", "positives").alias("recall"))
    end = df.groupBy(*group).agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                                 F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def auc(df, score, label, group=(), strategy="auto") -> DataFrame:
    """ROC-AUC with ties counted half; null when a class is empty."""
    steps = score_steps(df, score, label, group, strategy)
    pos, neg, tp = (F.col(c).cast("double") for c in ("pos", "neg", "tp"))
    area = F.sum(neg * (tp - pos / 2))
    return steps.groupBy(*group).agg(
        F.try_divide(area, F.sum(pos) * F.sum(neg)).alias("auc"))


#: rows whose scores one task sorts at a time, and rows of the sample that the cuts come from
SLICE_ROWS, SAMPLE_ROWS = 500_000, 200_000


def aucs(df: DataFrame, scores: str | Callable, label: str, id: str, group: Sequence[str], inputs: Sequence[str] = ()) -> DataFrame:
    """``auc`` of every element ``at`` of the array ``scores``, per group, in one job.

    Instead of a column, ``scores`` can be a function of a group's values and the
    arrays of the ``inputs``, which gives a matrix with a row for each.

    Scores are cut into slices that follow one another, by quantiles of a sample
    that only balances them. Tasks pass on sorted slices with equal scores counted;
    what is in order within a slice is counted there, and the rest follows from
    the slices' totals. A missing score is lower than any other.
    """
    group, spark = list(group), df.sparkSession
    inputs, score = ([scores], lambda key, columns: columns[0]) if isinstance(scores, str) else (list(inputs), scores)
    keys = df.select(*group).groupBy(*group).agg(F.count(F.lit(1)).alias("n")).collect()  # folds and parts
    names = [tuple(r[g] for g in group) for r in keys]
    same = lambda r: reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.lit(r[g])) for g in group], F.lit(True))
    place = F.coalesce(*[F.when(same(r), F.lit(i)) for i, r in enumerate(keys)]) if keys else F.lit(None)
    lean = df.select(place.cast("int").alias("of"), F.col(label).cast("int").alias("y"), *[F.col(c).alias(f"x_{i}") for i, c in enumerate(inputs)],
                     F.col(id).alias("id"))
    most, cuts = max((math.ceil(r["n"] / SLICE_ROWS) for r in keys), default=1), {}
    if most > 1:
        every = max(1, max(r["n"] for r in keys) // max(SAMPLE_ROWS, 200 * most))
        drawn = lean.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).drop("id").mapInArrow(
            lambda batches: _listed(batches, names, score), "of int, at int, p double").where("p > double('-inf')")
        shares = [i / most for i in range(1, most)]
        for r in drawn.groupBy("of", "at").agg(F.percentile_approx("p", shares, 50 * most).alias("c")).collect():
            cuts[r["of"], r["at"]] = np.unique(np.array(r["c"], dtype=float))

    runs = lean.drop("id").mapInArrow(lambda batches: _runs(batches, names, score, cuts), "of int, at int, slice int, pos binary, neg binary")
    slots = runs.groupBy("of", "at", "slice").applyInArrow(_slice, "of int, at int, slice int, pos bigint, neg bigint, inner double")
    above = W.partitionBy("of", "at").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = F.sum(F.col("inner") + neg * F.col("over"))
    found = slots.withColumn("over", F.coalesce(F.sum(pos).over(above), F.lit(0.0))).groupBy("of", "at").agg(
        F.try_divide(area, F.sum(pos) * F.sum(neg)).alias("auc"))
    named = spark.createDataFrame([(i, *key) for i, key in enumerate(names)], T.StructType([T.StructField("of", T.IntegerType()), *[df.schema[g] for g in group]]))
    return found.join(F.broadcast(named), "of").select(*group, "at", "auc")


def _scored(batches, names, score):
    """``group number, labels, scores`` of each group in a batch; a missing label is -1, a missing score below all others."""
    for batch in batches:
        if not len(batch):
            continue
        of, y = batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy()
        columns = []
        for c in batch.columns[2:]:
            flat = (c.flatten() if pa.types.is_list(c.type) else c).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            columns.append(flat.reshape(len(y), -1) if pa.types.is_list(c.type) else flat)
        for g in np.unique(of):
            mine = slice(None) if (of == g).all() else of == g
            table = score(names[g], [c[mine] for c in columns])
            yield int(g), y[mine], np.where(np.isnan(table), -np.inf, table)


def _listed(batches, names, score):
    for g, y, table in _scored(batches, names, score):
        n, width = table.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * width, g, "i4")), pa.array(np.tile(np.arange(width, dtype="i4"), n)),
                                          pa.array(table.ravel())], names=["of", "at", "p"])


def _counted(scores, counts=None):
    """Distinct scores, ascending, and how often they occur."""
    if counts is None:
        scores = np.sort(scores)
    else:
        order = np.argsort(scores)
        scores, counts = scores[order], counts[order]
    if not len(scores):
        return scores, np.zeros(0, "i8")
    first = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
    return scores[first], np.diff(np.r_[first, len(scores)]) if counts is None else np.add.reduceat(counts, first)


def _runs(batches, names, score, cuts):
    """Sorted runs of a task's scores, one for each class, cut into slices."""
    def flush(held):
        out = []
        for (of, at), parts in held.items():
            y, scores = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            edges, cut = cuts.get((of, at), np.zeros(0)), []
            for c in (1, 0):
                values, counts = _counted(scores[y == c])
                bounds = np.r_[0, np.searchsorted(values, edges), len(values)]
                cut.append([values[a:b].tobytes() + counts[a:b].astype("i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])])
            out += [(of, at, i, pos, neg) for i, (pos, neg) in enumerate(zip(*cut)) if pos or neg]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["of", "at", "slice", "pos", "neg"])

    held, rows = {}, 0
    for g, y, table in _scored(batches, names, score):
        for at in range(table.shape[1]):
            held.setdefault((g, at), []).append((y, np.ascontiguousarray(table[:, at])))
        rows += table.size
        if rows > 2_000_000:
            yield flush(held)
            held, rows = {}, 0
    if held:
        yield flush(held)


def _slice(table):
    """The totals of a slice, and how many of its positives stand above its negatives, ties by half."""
    classes = []
    for c in ("pos", "neg"):
        runs = [(r, len(r) // 12) for r in table[c].to_pylist()]
        scores = np.concatenate([np.frombuffer(r, "f8", n) for r, n in runs])
        classes.append(_counted(scores, np.concatenate([np.frombuffer(r, "i4", n, 8 * n) for r, n in runs]).astype("i8")))
    (scores, pos), (at, neg) = classes
    upto = np.r_[0, np.cumsum(pos)]
    above = upto[-1] - (upto[np.searchsorted(scores, at, "left")] + upto[np.searchsorted(scores, at, "right")]) / 2
    one = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("of", "at", "slice")]
    return pa.Table.from_arrays([*one, pa.array([int(pos.sum())]), pa.array([int(neg.sum())]), pa.array([float(np.sum(neg * above))])],
                                names=["of", "at", "slice", "pos", "neg", "inner"])


def average_precision(df, score, label, group=(), strategy="auto") -> DataFrame:
    steps = score_steps(df, score, label, group, strategy)
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*group).agg(F.try_divide(gain, F.sum("pos")).alias("average_precision"))


def ranking_metrics(df, score, label, group=(), strategy="auto") -> DataFrame:
    """AUC and average precision from one pass over the distinct scores."""
    steps = score_steps(df, score, label, group, strategy)
    pos, neg, tp = (F.col(c).cast("double") for c in ("pos", "neg", "tp"))
    return steps.groupBy(*group).agg(
        F.try_divide(F.sum(neg * (tp - pos / 2)), F.sum(pos) * F.sum(neg)).alias("auc"),
        F.try_divide(F.sum(pos * tp / (tp + F.col("fp"))), F.sum(pos)).alias("average_precision"))
