"""Learners on Spark ML behind one call: ``fit`` returns something that adds ``prob``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.operators.encode import collect_levels, label_encode, one_hot, ordinal_encode
from dialwise.functions.features import derive_features
from dialwise.plans.bayes import fit_gaussian_bayes, fit_gaussian_bayes_each
from dialwise.scale import ensure_checkpoint_dir, is_narrow, materialise
from dialwise.sources.leads import CATEGORICAL, FEATURES

SEED = 42
DEEPEST = 30  # an unlimited tree, as far as Spark goes


def _depth(value):
    if value is not None and int(value) > DEEPEST:
        raise ValueError(f"trees go to depth {DEEPEST} at most")
    return DEEPEST if value is None else int(value)


# On a 0/1 label the variance of a regression tree is half the gini impurity, so
# the splits are the same and a leaf predicts its share of positives. Spark's
# classification trees merge sibling leaves that agree on the class, which on
# rare positives leaves nothing to rank by; they serve the entropy criterion only.


def _decision_tree(p, rows):
    shared = dict(maxDepth=_depth(p.get("max_depth")), minInstancesPerNode=p.get("min_samples_leaf", 1),
                  seed=SEED, cacheNodeIds=True)
    entropy, subset = p.get("criterion", "gini") == "entropy", p.get("max_features")
    if subset is None:
        return DecisionTreeClassifier(impurity="entropy", **shared) if entropy else DecisionTreeRegressor(**shared)
    one = dict(numTrees=1, bootstrap=False, featureSubsetStrategy=subset, **shared)
    return RandomForestClassifier(impurity="entropy", **one) if entropy else RandomForestRegressor(**one)


def _random_forest(p, rows):
    shared = dict(
        numTrees=p.get("n_estimators", 100), maxDepth=_depth(p.get("max_depth")),
        minInstancesPerNode=p.get("min_samples_leaf", 1), featureSubsetStrategy=p.get("max_features", "sqrt"),
        bootstrap=p.get("bootstrap", True), seed=SEED, cacheNodeIds=True)
    if p.get("criterion", "gini") == "entropy":
        return RandomForestClassifier(impurity="entropy", **shared)
    return RandomForestRegressor(**shared)


def _logistic_regression(p, rows):
    return LogisticRegression(
        maxIter=p.get("max_iter", 1000), elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0,
        regParam=1.0 / (p.get("C", 1.0) * max(rows, 1)))


def _boosting(p, rows):
    return GBTClassifier(
        maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1),
        maxDepth=_depth(p.get("max_depth", 6)), minInstancesPerNode=p.get("min_child_samples", 1),
        subsamplingRate=p.get("subsample", 1.0), featureSubsetStrategy=str(p.get("colsample", "all")),
        seed=SEED, cacheNodeIds=True, checkpointInterval=10)


BUILDERS: dict[str, Callable] = {
    "decision_tree": _decision_tree, "random_forest": _random_forest,
    "logistic_regression": _logistic_regression, "boosting": _boosting}

# Search grids per learner. Settings without a counterpart in
# Spark ML (smallest node to split, leaf counts, solver) are left out.
GRIDS: dict[str, dict[str, list]] = {
    "decision_tree": {"criterion": ["gini", "entropy"], "max_depth": [None, 10, 20],
                      "min_samples_leaf": [1, 5, 10], "max_features": [None, "sqrt"]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [None, 15, 30],
                      "min_samples_leaf": [1, 4], "max_features": ["sqrt", "log2"], "bootstrap": [True]},
    "logistic_regression": {"penalty": ["l2", "l1"], "C": [0.01, 0.1, 1.0, 10.0], "max_iter": [1000]},
    "naive_bayes": {"var_smoothing": [1e-9, 1e-8, 1e-5, 1e-4]},
    "boosting": {"n_estimators": [100, 200, 300], "max_depth": [3, 6, 9],
                 "learning_rate": [0.01, 0.1, 0.2], "subsample": [0.8, 1.0]},
}

# Ranges of the bounded random search over boosting settings.
SEARCH_SPACE = {"n_estimators": (100, 500), "learning_rate": (0.01, 0.2), "max_depth": (3, 12),
                "min_child_samples": (5, 100), "subsample": (0.5, 1.0), "colsample": (0.5, 1.0)}


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline and the columns it reads."""

    pipeline: Any
    features: list[str]

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        if not isinstance(self.pipeline, PipelineModel):
            return self.pipeline.transform(df, out)
        made = self.pipeline.transform(df)
        chance = vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
        return made.withColumn(out, chance).drop("features", "rawPrediction", "probability", "prediction")

    def importances(self) -> list[tuple[str, float]]:
        last = self.pipeline.stages[-1]
        return [(f, float(v)) for f, v in zip(self.features, last.featureImportances.toArray())]


def fit(train: DataFrame, learner: str, features: Sequence[str], label: str = "y",
        params: dict | None = None, weight: str | None = None) -> Fitted:
    params, features = dict(params or {}), list(features)
    ensure_checkpoint_dir(train.sparkSession)
    if learner == "naive_bayes":
        if weight:
            raise ValueError("naive Bayes takes no row weights")
        return Fitted(fit_gaussian_bayes(train, features, label, params.get("var_smoothing", 1e-9),
                                         standardised=True), features)
    rows = train.count() if learner == "logistic_regression" else 0
    model = BUILDERS[learner](params, rows).setLabelCol(label).setFeaturesCol("features")
    if weight:
        model = model.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    columns = [*features, label, *([weight] if weight else [])]
    return Fitted(Pipeline(stages=[assembler, model]).fit(train.select(*columns)), features)


def fit_each(train: DataFrame, learner: str, features: Sequence[str], settings: Sequence[dict], label: str = "y",
             weight: str | None = None) -> list[Fitted]:
    """``fit`` for each of ``settings``; naive Bayes reads the rows once for all of them."""
    if learner != "naive_bayes" or weight:
        return [fit(train, learner, features, label, p, weight) for p in settings]
    smoothing = [p.get("var_smoothing", 1e-9) for p in settings]
    return [Fitted(m, list(features)) for m in fit_gaussian_bayes_each(train, list(features), smoothing, label, standardised=True)]


def design_matrix(leads: DataFrame, derived: Sequence[str] = (), style: str = "onehot", label: str = "y",
                  id: str = "lead_id", carry: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric features of leads, the call length left out, and their names.

    ``onehot`` orders education and expands the other categories; ``label``
    codes every category alphabetically. ``carry`` keeps further columns.
    """
    # the levels are read before the rows, so a joined input is stored first
    leads = leads if is_narrow(leads) else materialise(leads)
    present = [c for c in FEATURES if c in leads.columns]
    numeric = [c for c in present if c not in CATEGORICAL]
    cats = [c for c in present if c in CATEGORICAL]
    df = derive_features(leads, derived)
    made = [d for d in derived if d in df.columns]
    kept = {f"__{c}": F.col(c) for c in carry}
    df = df.select(id, *([label] if label in df.columns else []), *[v.alias(k) for k, v in kept.items()],
                   *numeric, *cats, *made)
    if style == "label":
        coded = label_encode(df, cols=cats)
    else:
        ordered = ordinal_encode(df) if "education" in cats else df
        wide = [c for c in cats if c != "education"]
        coded = one_hot(ordered, wide, collect_levels(df, wide)) if wide else ordered
    fixed = {id, label, *kept}
    features = [c for c in coded.columns if c not in fixed]
    coded = coded.select(*[F.col(c) for c in coded.columns if c in {id, label}],
                         *[F.col(k).alias(k[2:]) for k in kept], *[F.col(f).cast("double").alias(f) for f in features])
    return coded, features
