"""Synthetic minority rows, interpolated between near neighbours, up to class parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.functions.hashing import hex_int, md5_of
from dialwise.operators.joins import by_row
from dialwise.operators.neighbours import nearest_neighbours, neighbours_by_fold
from dialwise.operators.ordering import running
from dialwise.scale import materialise

SEED_DIGITS, PICK_DIGITS = 13, 6  # of one md5; the remaining 13 give the position between the two


def smote(df: DataFrame, features: Sequence[str], label: str, id: str, k: int = 5, seed: int = 42,
          **search) -> DataFrame:
    """``df`` reduced to id, label and double features, plus synthetic minority rows.

    Each new row takes a random minority row and a random one of its ``k``
    nearest minority neighbours, and lies at a random point between them. New
    ids are negative. Apply it to training rows only. ``search`` goes to the
    neighbour search.
    """
    features = list(features)
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    base = df.select(id, label, *[F.col(f).cast("double").alias(f) for f in features])
    if len(sizes) < 2:
        return base
    minority = min(sizes, key=lambda c: (sizes[c], c))
    few, missing = sizes[minority], max(sizes.values()) - sizes[minority]
    k = min(k, few - 1)
    if missing == 0 or k < 1:
        return base

    rare = materialise(base.where(F.col(label) == minority))
    lists = nearest_neighbours(rare, id, features, k, **search)
    seeds = running(rare.select(F.col(id).alias("__seed"), F.array(*features).alias("__x")),
                    "__seed", "__seed", rank="__rank")

    draws = _draws(df.sparkSession, missing, seed, F.lit(few), k)
    picked = by_row(draws, seeds, "__rank")
    near = lists.select(F.col(id).alias("__seed"), "rank", "vector")
    # a seed without a list has only copies of itself as neighbours
    paired = by_row(picked, near, ["__seed", "rank"], "left")
    made = paired.withColumn("__target", F.coalesce("vector", "__x")).select(*_made(id, label, minority, features))
    return base.unionByName(made)


def _draws(spark, most, seed, few, k, numbered=()):
    """``j, __rank, rank, __u`` of as many draws: the minority row, its neighbour, the place between the two."""
    digest = md5_of(F.lit(str(seed)), "j")
    unit = lambda start, digits: hex_int(digest, start, digits) / F.lit(float(16 ** digits))
    drawn = spark.range(most).select(F.col("id").alias("j")).select(
        "j", unit(1, SEED_DIGITS).alias("__s"), (F.floor(unit(1 + SEED_DIGITS, PICK_DIGITS) * k) + 1).cast("int").alias("rank"),
        unit(1 + SEED_DIGITS + PICK_DIGITS, 13).alias("__u"), *numbered)
    return drawn.withColumn("__rank", F.floor(F.col("__s") * few) + 1).drop("__s")


def _made(id, label, minority, features):
    return [(-F.col("j") - 1).alias(id), F.lit(minority).alias(label),
            *[(F.col("__x")[i] + F.col("__u") * (F.col("__target")[i] - F.col("__x")[i])).alias(f)
              for i, f in enumerate(features)]]


def smote_by_fold(df: DataFrame, features: Sequence[str], label: str, id: str, fold: str = "fold", k: int = 5,
                  seed: int = 42, **search) -> dict[int, DataFrame]:
    """For every fold, ``smote`` of the rows outside it, in the same rows and values.

    The folds share one neighbour search, and their new rows one table. Where
    folds differ in their minority or lack rows for ``k`` neighbours, each has a
    search of its own.
    """
    features = list(features)
    sizes = {(r[fold], r[label]): r["n"] for r in df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n")).collect()}
    folds = sorted({f for f, _ in sizes})
    outside = {f: {c: sum(n for (g, d), n in sizes.items() if d == c and g != f) for c in {c for g, c in sizes if g != f}} for f in folds}
    rare = {f: min(by, key=lambda c: (by[c], c), default=None) for f, by in outside.items()}
    few = {f: by[rare[f]] if by else 0 for f, by in outside.items()}
    missing = {f: max(by.values(), default=0) - few[f] for f, by in outside.items()}
    if len(set(rare.values())) > 1 or any(len(by) < 2 or few[f] <= k or not missing[f] for f, by in outside.items()):
        return {f: materialise(smote(df.where(F.col(fold) != f), features, label, id, k, seed, **search)) for f in folds}

    minority = rare[folds[0]]
    base = df.select(id, label, fold, *[F.col(f).cast("double").alias(f) for f in features])
    points = materialise(base.where(F.col(label) == minority))
    pools = neighbours_by_fold(points, id, features, k, fold, folds, **search)
    marked = points.select(F.col(id).alias("__seed"), F.col(fold).alias("__own"), F.array(*features).alias("__x"),
                           *[(F.col(fold) == f).cast("int").alias(f"__in_{i}") for i, f in enumerate(folds)])
    placed = materialise(running(marked, "__seed", "__seed", rank="__rank",
                                 sums={f"__upto_{i}": f"__in_{i}" for i in range(len(folds))}))
    # a row's rank among those outside a fold
    ranks = F.array(*[F.struct(F.lit(f).alias("__held"), (F.col("__rank") - F.col(f"__upto_{i}")).alias("__rank")) for i, f in enumerate(folds)])
    seeds = placed.select("__seed", F.inline(F.filter(ranks, lambda r: r["__held"] != F.col("__own"))))
    wanted = F.array(*[F.struct(F.lit(f).alias("__held"), F.lit(few[f]).alias("__few"), F.lit(missing[f]).alias("__missing")) for f in folds])
    draws = _draws(df.sparkSession, max(missing.values()), seed, F.col("__few"), k,
                   [F.inline(F.filter(wanted, lambda w: F.col("j") < w["__missing"]))]).drop("__few", "__missing")
    known = by_row(placed.select("__seed", "__x"), pools.withColumnRenamed(id, "__seed"), "__seed", "left")
    picked = by_row(draws, seeds, ["__held", "__rank"]).select("j", "__held", "__seed", "rank", "__u")
    picked = by_row(picked, known, "__seed")
    # a seed without a list has only copies of itself as neighbours
    near = F.get(F.filter("pool", lambda e: e["fold"] != F.col("__held")), F.col("rank") - 1)["vector"]
    made = materialise(picked.withColumn("__target", F.coalesce(near, "__x")).select("__held", *_made(id, label, minority, features)))
    columns = [id, label, *features]
    return {f: base.where(F.col(fold) != f).select(*columns).unionByName(made.where(F.col("__held") == f).select(*columns)) for f in folds}
