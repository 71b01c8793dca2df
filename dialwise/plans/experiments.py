"""Cross-validation, searches and feature selection as Spark jobs.

The driver holds loop state and one number per fit; data stays in tables. The
feature table is written once, resampled training folds once per fold, and
out-of-fold scores once, so no step is recomputed by the jobs that follow it.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.functions.features import flag
from dialwise.operators import metrics as mt
from dialwise.operators import ranking
from dialwise.operators.groups import class_weights
from dialwise.operators.sampling import stratified_folds, stratified_split
from dialwise.operators.smote import smote, smote_by_fold
from dialwise.plans.bayes import GaussianBayesModel, score_each
from dialwise.plans.models import SEARCH_SPACE, SEED, Fitted, fit, fit_each
from dialwise.scale import materialise

WEIGHT = "class_weight"
PARALLEL_FITS = 4


def together(spark, jobs: Iterable, parallelism: int = PARALLEL_FITS) -> list:
    """Run independent driver calls side by side, each submitting its own Spark jobs."""
    jobs = list(jobs)
    if len(jobs) < 2 or parallelism < 2:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)


def folded(frame: DataFrame, k: int, label: str = "y", id: str = "lead_id", seed: int = SEED) -> DataFrame:
    """The feature table with a stratified ``fold`` column, written once."""
    return materialise(stratified_folds(frame, label, id, k, seed))


def rebalance(train: DataFrame, features: Sequence[str], label: str, id: str, strategy: str) -> tuple[DataFrame, str | None]:
    """Training rows under a strategy, and the weight column if it uses one."""
    if strategy == "smote":
        return materialise(smote(train, features, label, id, seed=SEED)), None
    if strategy == "weight":
        return train.join(F.broadcast(class_weights(train, label).select(label, F.col("weight").alias(WEIGHT))), label), WEIGHT
    return train, None


def training_folds(frame, features, label="y", id="lead_id", strategy="none"):
    """``(fold, training rows, weight column, held-out rows)`` for every fold."""
    folds = sorted(r["fold"] for r in frame.select("fold").distinct().collect())
    if strategy == "smote":
        grown = smote_by_fold(frame, features, label, id, seed=SEED)
        return [(i, grown[i], None, frame.where(F.col("fold") == i)) for i in folds]
    build = lambda i: lambda: (i, *rebalance(frame.where(F.col("fold") != i), features, label, id, strategy),
                               frame.where(F.col("fold") == i))
    return together(frame.sparkSession, [build(i) for i in folds])


def oof_scores(frame: DataFrame, learner: str, features: Sequence[str], label: str = "y", id: str = "lead_id",
               params: dict | None = None, strategy: str = "none", folds=None) -> DataFrame:
    """Each row scored by a model that never saw it: id, label, fold, prob."""
    folds = folds or training_folds(frame, features, label, id, strategy)
    score = lambda train, weight, held: lambda: fit(train, learner, features, label, params, weight).transform(held)
    parts = together(frame.sparkSession, [score(train, weight, held) for _, train, weight, held in folds])
    return reduce(DataFrame.unionByName, [p.select(id, label, "fold", "prob") for p in parts])


def score_metrics(scored: DataFrame, keys: Sequence[str], label: str = "y", id: str = "lead_id",
                  threshold: float = 0.5) -> DataFrame:
    """Long metric table over scored rows, all groups in the same jobs."""
    keys = list(keys)
    called = scored.withColumn("__pred", flag(F.col("prob") > threshold))
    wide = mt.rates(mt.confusion(called, "__pred", label, keys)).drop("tn", "fp", "fn", "tp")
    wide = wide.join(ranking.ranking_metrics(scored, "prob", label, keys), keys)
    wide = wide.join(ranking.alift_mean(scored, "prob", label, id, keys), keys)
    wide = wide.join(ranking.alift_area(scored, "prob", label, id, keys), keys)
    wide = wide.join(mt.log_loss(scored, "prob", label, keys), keys)
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, names, "metric", "value")


def cross_validate(frame: DataFrame, features: Sequence[str], learners: dict[str, dict],
                   strategies: Sequence[str] = ("none", "smote", "weight"), label: str = "y",
                   id: str = "lead_id") -> DataFrame:
    """Metrics per learner, strategy and fold. Naive Bayes takes no weights."""
    parts = []
    for strategy in strategies:
        folds = training_folds(frame, features, label, id, strategy)
        for name, params in learners.items():
            if strategy == "weight" and name == "naive_bayes":
                continue
            scored = oof_scores(frame, name, features, label, id, params, folds=folds)
            parts.append(scored.withColumns({"model": F.lit(name), "strategy": F.lit(strategy)}))
    scored = materialise(reduce(DataFrame.unionByName, parts))
    return score_metrics(scored, ["model", "strategy", "fold"], label, id)


def auc_of(model: Fitted, rows: DataFrame, label: str) -> float | None:
    return ranking.auc(model.transform(rows), "prob", label).first()["auc"]


def aucs_of(spark, parts: Sequence[tuple], features: Sequence[str], label: str, id: str) -> DataFrame:
    """``fold, part, at, auc`` for ``((fold, part), models, rows)``: each model on its rows, all in one job."""
    marked = lambda rows, key: rows.withColumns({"fold": F.lit(key[0]), "part": F.lit(key[1])})
    if all(isinstance(m.pipeline, GaussianBayesModel) for _, models, _ in parts for m in models):
        every = reduce(DataFrame.unionByName, [marked(rows.select(id, label, *[F.col(f).cast("double").alias(f) for f in features]), key)
                                               for key, _, rows in parts])
        by_key = {key: [m.pipeline for m in models] for key, models, _ in parts}
        return ranking.aucs(every, lambda key, columns: score_each(by_key[key], columns), label, id, ["fold", "part"], features)

    def scored(models, rows):
        made = rows
        for i, model in enumerate(models):
            made = model.transform(made, f"__prob_{i}")
        return made.select(id, label, F.array(*[F.col(f"__prob_{i}") for i in range(len(models))]).alias("probs"))
    every = reduce(DataFrame.unionByName, [marked(scored(models, rows), key) for key, models, rows in parts])
    return ranking.aucs(every, "probs", label, id, ["fold", "part"])


def grid(choices: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(choices, combo)) for combo in itertools.product(*choices.values())]


def try_settings(frame: DataFrame, learner: str, settings: Sequence[dict], features: Sequence[str],
                 label: str = "y", id: str = "lead_id", strategy: str = "smote") -> DataFrame:
    """Mean held-out and training AUC of each setting: one row per setting, best first."""
    folds = training_folds(frame, features, label, id, strategy)
    spark, settings = frame.sparkSession, list(settings)
    # naive Bayes has all settings from one pass, other learners a fit each
    batches = [settings] if learner == "naive_bayes" else [[p] for p in settings]
    fits = together(spark, [lambda batch=batch, train=train, weight=weight: fit_each(train, learner, features, batch, label, weight)
                            for _, train, weight, _ in folds for batch in batches])
    per_fold = [sum(fits[i * len(batches):(i + 1) * len(batches)], []) for i in range(len(folds))]
    areas = aucs_of(spark, [((fold, part), models, rows) for models, (fold, train, _, held) in zip(per_fold, folds)
                            for part, rows in (("held", held), ("train", train))], features, label, id).collect()
    found = {(r["fold"], r["part"], r["at"]): r["auc"] for r in areas}  # settings x folds x 2
    rows = [(n, found.get((f, "held", n)), found.get((f, "train", n))) for n in range(len(settings)) for f, *_ in folds]
    results = spark.createDataFrame(rows, "trial int, held double, train double")
    named = spark.createDataFrame([(n, learner, json.dumps(p, sort_keys=True)) for n, p in enumerate(settings)],
                                  "trial int, model string, params string")
    means = results.groupBy("trial").agg(F.avg("held").alias("cv_auc"), F.avg("train").alias("train_auc"))
    return named.join(means, "trial").withColumn("gap", F.col("train_auc") - F.col("cv_auc")) \
                .orderBy(F.desc("cv_auc"), "trial")


def grid_search(frame, learner, choices, features, label="y", id="lead_id", strategy="smote") -> DataFrame:
    return try_settings(frame, learner, grid(choices), features, label, id, strategy)


def draw_settings(trials: int, space: dict = SEARCH_SPACE, seed: int = SEED) -> list[dict]:
    """Reproducible settings, drawn evenly from each range."""
    unit = lambda t, name: int(hashlib.md5(f"{seed}:{t}:{name}".encode()).hexdigest()[:13], 16) / 16 ** 13

    def value(t, name, lo, hi):
        if isinstance(lo, int):
            return lo + int(unit(t, name) * (hi - lo + 1))
        return lo + unit(t, name) * (hi - lo)
    return [{name: value(t, name, lo, hi) for name, (lo, hi) in space.items()} for t in range(trials)]


def random_search(frame, learner, features, trials=20, space=None, label="y", id="lead_id", strategy="none") -> DataFrame:
    return try_settings(frame, learner, draw_settings(trials, space or SEARCH_SPACE), features, label, id, strategy)


def importance_table(spark, model: Fitted) -> DataFrame:
    rows = spark.createDataFrame(model.importances(), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def _ordered(importances):
    return [f for f, _ in sorted(importances, key=lambda fv: (-fv[1], fv[0]))]


def recursive_elimination(frame: DataFrame, features: Sequence[str], params: dict, learner: str = "random_forest",
                          label: str = "y", id: str = "lead_id", strategy: str = "none", least: int = 1) -> DataFrame:
    """Drop the least important feature step by step; mean held-out AUC at each size.

    Folds are rebalanced inside the loop, never before it.
    """
    folds = training_folds(frame, features, label, id, strategy)
    current, rows = list(features), []
    while len(current) >= least:
        def one(train, weight, held, names=tuple(current)):
            def job():
                model = fit(train, learner, names, label, params, weight)
                return auc_of(model, held, label), model.importances()
            return job
        done = together(frame.sparkSession, [one(train, weight, held) for _, train, weight, held in folds])
        total = {f: sum(dict(imp)[f] for _, imp in done) for f in current}
        weakest = _ordered(total.items())[-1]
        known = [a for a, _ in done if a is not None]
        rows.append((len(current), sum(known) / len(known) if known else None, ",".join(sorted(current)), weakest))
        current = [f for f in current if f != weakest]
    return frame.sparkSession.createDataFrame(rows, "n_features int, auc double, features string, dropped_next string")


def evaluate_subsets(frame: DataFrame, features: Sequence[str], params: dict, thresholds=(0.01, 0.02, 0.03, 0.04, 0.05),
                     tops=(5, 8, 10, 12, 15, 19), learner: str = "random_forest", label: str = "y",
                     id: str = "lead_id", strategy: str = "smote", held_share: float = 0.3) -> DataFrame:
    """Held-out AUC and lift area of feature sets picked by importance threshold and by rank."""
    split = materialise(stratified_split(frame, label, id, held_share, SEED))
    train, weight = rebalance(split.where("is_test = 0"), features, label, id, strategy)
    held = split.where("is_test = 1")
    importances = fit(train, learner, features, label, params, weight).importances()
    order = _ordered(importances)
    sets = [("threshold", float(t), [f for f in order if dict(importances)[f] >= t]) for t in thresholds]
    sets += [("top_k", float(min(k, len(order))), order[:k]) for k in tops]

    sets = [s for s in sets if s[2]]
    fits = together(frame.sparkSession, [lambda names=names: fit(train, learner, names, label, params, weight) for _, _, names in sets])
    # the metrics read the scores several times, and all sets at once
    parts = [model.transform(held).select(id, label, "prob", F.lit(i).alias("set")) for i, model in enumerate(fits)]
    scored = materialise(reduce(DataFrame.unionByName, parts))
    auc = {r["set"]: r["auc"] for r in ranking.auc(scored, "prob", label, ["set"]).collect()}
    area = {r["set"]: r["alift_area"] for r in ranking.alift_area(scored, "prob", label, id, ["set"]).collect()}
    rows = [(method, setting, len(names), auc.get(i), area.get(i)) for i, (method, setting, names) in enumerate(sets)]
    return frame.sparkSession.createDataFrame(
        rows, "method string, setting double, n_features int, auc double, alift_area double").distinct()
