"""Tree ensembles scored at every size in one pass, and grids that fit only the largest.

A fitted forest or boosting run holds all its smaller versions: the mean of its
first n trees, or the sum of its first n steps. Spark names the leaf that a row
reaches in each tree (``leafCol``); the leaves' values come from the saved model.
A row then becomes an array of values, one per tree, and each size is a fold
over its beginning. So the number of trees costs a grid no further fit.

For boosting the first n steps are what a fit of n rounds gives. A forest draws
its rows and features in another order at every size, so its first n trees are
a forest of n trees, but not the one that a separate fit would draw.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.functions.hashing import UNIT_RANGE, hash52
from dialwise.operators import ranking
from dialwise.plans.experiments import together, training_folds
from dialwise.plans.models import SEED, Fitted, fit
from dialwise.scale import materialise, remove_at_exit, shared_dir

SIZE = "n_estimators"
#: sums of leaves that agree to so many digits are ties, whatever the order of addition
TIE_DIGITS = 12


@dataclass(frozen=True)
class StagedEnsemble:
    """A fitted ensemble and, per tree, the value of each leaf in Spark's order of leaves."""

    fitted: Fitted
    leaves: list[list[float]]
    boosted: bool

    @classmethod
    def of(cls, spark, fitted: Fitted) -> StagedEnsemble:
        model = fitted.pipeline.stages[-1]
        path = f"{shared_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
        remove_at_exit(spark, path)
        model.write().save(path)
        boosted, voting = isinstance(model, GBTClassificationModel), isinstance(model, RandomForestClassificationModel)
        stats = F.col("nodeData.impurityStats")
        value = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b) if voting else F.col("nodeData.prediction")
        nodes = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0").select("treeID", "nodeData.id", value.alias("value"))
        # nodes are numbered from the left, as leaves are; the model's own size bounds this table
        rows = nodes.groupBy("treeID").agg(F.sort_array(F.collect_list(F.struct("id", "value")))["value"].alias("values")).orderBy("treeID").collect()
        weights = list(model.treeWeights) if boosted else [1.0] * len(rows)
        return cls(fitted, [[float(v) * w for v in r["values"]] for r, w in zip(rows, weights)], boosted)

    def __len__(self) -> int:
        return len(self.leaves)

    def transform(self, df: DataFrame, sizes: Sequence[int], out: str = "probs") -> DataFrame:
        """Adds the probabilities of class 1 after each of ``sizes`` trees, as an array."""
        if any(not 1 <= n <= len(self) for n in sizes):
            raise ValueError(f"sizes lie between 1 and {len(self)}")
        model = self.fitted.pipeline.stages[-1].copy({})
        model.setLeafCol("__leaf")
        made = PipelineModel([*self.fitted.pipeline.stages[:-1], model]).transform(df).select(*df.columns, vector_to_array("__leaf").alias("__leaf"))
        # the values come as a broadcast table of one row, as large as the model
        held = df.sparkSession.createDataFrame([(0, self.leaves)], "__one int, __values array<array<double>>")
        joined = made.withColumn("__one", F.lit(0)).join(F.broadcast(held), "__one")
        each = F.zip_with("__values", "__leaf", lambda values, leaf: F.get(values, leaf.cast("int")))
        return joined.withColumn("__each", each).withColumn(out, F.array(*[self._score(n) for n in sizes])).select(*df.columns, out)

    def _score(self, n: int) -> Column:
        total = F.aggregate(F.slice("__each", 1, n), F.lit(0.0), lambda a, b: a + b)
        return 1 / (1 + F.exp(-2 * total)) if self.boosted else total / n


def fit_staged(train: DataFrame, learner: str, features: Sequence[str], label: str = "y", params: dict | None = None,
               weight: str | None = None) -> StagedEnsemble:
    return StagedEnsemble.of(train.sparkSession, fit(train, learner, features, label, params, weight))


def by_size(model: StagedEnsemble, rows: DataFrame, sizes: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """``columns``, ``size`` and ``prob``: every row once for each size."""
    scored = model.transform(rows, sizes)
    numbered = F.arrays_zip(F.array(*map(F.lit, sizes)).alias("size"), F.col("probs").alias("prob"))
    return scored.select(*columns, F.inline(numbered))


def bounded(train: DataFrame, id: str, most: int | None, seed: int = SEED) -> DataFrame:
    """About ``most`` rows, drawn by a hash of the id; all rows where there are no more, or no bound is given."""
    if most is None:
        return train
    rows = train.count()
    return train if rows <= most else train.where(hash52(seed, id) < F.lit(int(UNIT_RANGE * (most / rows))))


def staged_grid(frame: DataFrame, learner: str, settings: Sequence[dict], features: Sequence[str], label: str = "y", id: str = "lead_id",
                strategy: str = "smote", max_labelled: int | None = None) -> DataFrame:
    """``trial, model, params, cv_auc, train_auc, gap, n_fits, seconds`` per setting, best first.

    Settings that differ in the number of trees alone share a fit, whose
    seconds and number are those of the group. ``max_labelled`` bounds the rows
    that a model is fitted on; held-out rows are all scored. Scores of all
    settings, folds and parts go into one table, and their AUCs come from one job.
    """
    spark = frame.sparkSession
    kept = frame if max_labelled is None else materialise(bounded(frame, id, max_labelled))
    held_rows = {r["fold"]: frame.where(F.col("fold") == r["fold"]) for r in frame.select("fold").distinct().collect()}
    folds = [(f, train, weight, held_rows[f]) for f, train, weight, _ in training_folds(kept, features, label, id, strategy)]
    groups: dict[str, list[int]] = {}
    for number, params in enumerate(settings):
        rest = {k: v for k, v in params.items() if k != SIZE}
        groups.setdefault(json.dumps(rest, sort_keys=True) if SIZE in params else f"alone {number}", []).append(number)

    def one(group, numbers, fold, train, weight, held):
        def job():
            began = time.perf_counter()
            sizes = [settings[n].get(SIZE, 1) for n in numbers]
            params = {**settings[numbers[0]]} | ({SIZE: max(sizes)} if SIZE in settings[numbers[0]] else {})
            model = fit(train, learner, features, label, params, weight)
            took = time.perf_counter() - began
            staged = StagedEnsemble.of(spark, model) if SIZE in params else None
            parts = []
            for part, rows in (("held", held), ("train", train)):
                lean = [F.lit(fold).alias("fold"), F.lit(part).alias("part"), F.col(label)]
                if staged is None:
                    parts.append(model.transform(rows).select(F.lit(numbers[0]).alias("trial"), *lean, "prob"))
                    continue
                trial = F.element_at(F.create_map(*[F.lit(x) for n, s in zip(numbers, sizes) for x in (s, n)]), F.col("size"))
                parts.append(by_size(staged, rows, sorted(set(sizes)), lean).select(trial.alias("trial"), "fold", "part", label, "prob"))
            return group, took, materialise(reduce(DataFrame.unionByName, parts))
        return job

    done = together(spark, [one(g, numbers, *fold) for g, numbers in groups.items() for fold in folds],
                    spark.sparkContext.defaultParallelism)
    scored = reduce(DataFrame.unionByName, [rows for _, _, rows in done])
    areas = ranking.auc(scored.withColumn("prob", F.round("prob", TIE_DIGITS)), "prob", label, ["trial", "fold", "part"])
    mean = lambda part: F.avg(F.when(F.col("part") == part, F.col("auc")))
    means = areas.groupBy("trial").agg(mean("held").alias("cv_auc"), mean("train").alias("train_auc"))
    took = {g: [t for h, t, _ in done if h == g] for g in groups}
    named = spark.createDataFrame([(n, learner, json.dumps(settings[n], sort_keys=True), len(took[g]), sum(took[g]))
                                   for g, numbers in groups.items() for n in numbers],
                                  "trial int, model string, params string, n_fits int, seconds double")
    return named.join(means, "trial").select("trial", "model", "params", "cv_auc", "train_auc", (F.col("train_auc") - F.col("cv_auc")).alias("gap"),
                                             "n_fits", "seconds").orderBy(F.desc("cv_auc"), "trial")
