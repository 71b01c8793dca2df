"""A bounded search whose trials are stored as they end, so a later run goes on from them."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.plans.experiments import auc_of, draw_settings, fit, together, training_folds
from dialwise.sources.sinks import exists

RUN_SCHEMA = "params string, auc double, trial int, fold int"
#: fits between two looks at the clock
AT_ONCE = 8


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """``trial, fold, params, auc`` of every fit that has ended; none if the search is new."""
    if not exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).option("basePath", path).parquet(path)


def _survivors(aucs: dict[int, list], kept: int) -> list[int]:
    mean = lambda trial: sum(aucs[trial]) / len(aucs[trial]) if aucs[trial] else 0.0
    return sorted(sorted(aucs, key=lambda t: (-mean(t), t))[:kept])


def resumable_search(frame: DataFrame, learner: str, features: Sequence[str], path: str, trials: int = 20,
                     space: dict | None = None, settings: Sequence[dict] | None = None, seconds: float | None = None,
                     label: str = "y", id: str = "lead_id", strategy: str = "none") -> DataFrame:
    """``trial, model, params, folds, cv_auc``: seeded settings by successive halving over the folds.

    All settings meet the first fold, the better half of them the second, and
    so on; ties go to the smaller trial number. ``folds`` says how far a
    setting came, and those that came furthest are first. Each fit is written
    to a folder of its own under ``path`` when it ends: a run that was lost or
    stopped by ``seconds`` is taken up by calling again, and a finished search
    fits nothing more. A path that holds other settings is refused. A fold
    without both classes has no AUC and leaves the means as they are.
    """
    spark = frame.sparkSession
    started = time.monotonic()
    settings = list(settings) if settings is not None else draw_settings(trials, *([space] if space else []))
    named = [json.dumps(s, sort_keys=True) for s in settings]
    done: dict[tuple[int, int], float | None] = {}
    for r in stored_runs(spark, path).collect():  # trials x folds
        if r.trial >= len(named) or r.params != named[r.trial]:
            raise ValueError(f"{path} holds trials of another search")
        done[r.trial, r.fold] = r.auc

    def run(trial, fold, train, weight, held):
        def job():
            auc = auc_of(fit(train, learner, features, label, settings[trial], weight), held, label)
            one = spark.createDataFrame([(named[trial], auc)], "params string, auc double")
            one.coalesce(1).write.mode("overwrite").parquet(f"{path}/trial={trial}/fold={fold}")
            return (trial, fold), auc
        return job

    numbers = sorted(r.fold for r in frame.select("fold").distinct().collect())  # the folds
    alive, aucs, parts = list(range(len(settings))), defaultdict(list), None
    for rung, fold in enumerate(numbers):
        wanted = [t for t in alive if (t, fold) not in done]
        if wanted and parts is None:
            parts = {f: rest for f, *rest in training_folds(frame, features, label, id, strategy)}
        for at in range(0, len(wanted), AT_ONCE):
            if seconds is not None and time.monotonic() - started > seconds:
                return _report(spark, learner, named, done)
            done.update(together(spark, [run(t, fold, *parts[fold]) for t in wanted[at:at + AT_ONCE]]))
        for t in alive:
            aucs[t] += [done[t, fold]] if done[t, fold] is not None else []
        alive = _survivors({t: aucs[t] for t in alive}, max(1, -(-len(settings) // 2 ** (rung + 1))))
    return _report(spark, learner, named, done)


def _report(spark, learner, named, done) -> DataFrame:
    rows = [(t, learner, named[t], f, a) for (t, f), a in done.items()]
    runs = spark.createDataFrame(rows, "trial int, model string, params string, fold int, auc double")
    return (runs.groupBy("trial", "model", "params")
                .agg(F.count("fold").cast("int").alias("folds"), F.avg("auc").alias("cv_auc"))
                .orderBy(F.desc("folds"), F.desc_nulls_last("cv_auc"), "trial"))
