"""Ensembles by size against separate fits and against their own trees."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dialwise.functions.hashing import uniform
from dialwise.operators import ranking
from dialwise.plans import experiments as ex
from dialwise.plans import staged
from dialwise.plans.models import fit

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(400).withColumnRenamed("id", "lead_id")
    y = (uniform(1, "lead_id") < 0.3).cast("int")
    return rows.select("lead_id", y.alias("y"), (y * 0.4 + uniform(2, "lead_id")).alias("a"), (uniform(3, "lead_id") - y * 0.2).alias("b"),
                       uniform(4, "lead_id").alias("c"), (F.col("lead_id") % 2).cast("int").alias("fold")).cache()


def by_id(df, column="prob"):
    return {r["lead_id"]: r[column] for r in df.collect()}


def test_first_boosting_steps_equal_shorter_fits(frame):
    params = {"max_depth": 3, "learning_rate": 0.3, "subsample": 0.8}
    model = staged.fit_staged(frame, "boosting", FEATURES, params={**params, "n_estimators": 6})
    got = staged.by_size(model, frame, [2, 4, 6], ["lead_id"])
    for n in (2, 4, 6):
        want = by_id(fit(frame, "boosting", FEATURES, params={**params, "n_estimators": n}).transform(frame))
        assert by_id(got.where(F.col("size") == n)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_first_trees_of_a_forest(frame, criterion):
    model = staged.fit_staged(frame, "random_forest", FEATURES, params={"n_estimators": 5, "max_depth": 4, "criterion": criterion})
    whole = by_id(model.fitted.transform(frame))
    got = staged.by_size(model, frame, [1, 3, 5], ["lead_id"])
    assert by_id(got.where("size = 5")) == pytest.approx(whole, abs=1e-9)
    assembled = model.fitted.pipeline.stages[0].transform(frame)
    trees = model.fitted.pipeline.stages[-1].trees[:3]
    chance = lambda t: vector_to_array("probability")[1] if criterion == "entropy" else F.col("prediction")
    each = [by_id(t.transform(assembled).select("lead_id", chance(t).alias("prob"))) for t in trees]
    assert by_id(got.where("size = 3")) == pytest.approx({i: sum(e[i] for e in each) / 3 for i in each[0]}, abs=1e-9)
    with pytest.raises(ValueError):
        model.transform(frame, [6])


def test_grid_shares_fits_and_equals_separate_ones(frame):
    settings = ex.grid({"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.3]})
    got = {r["params"]: r for r in staged.staged_grid(frame, "boosting", settings, FEATURES, strategy="none").collect()}
    assert len(got) == 4 and all(r["n_fits"] == 2 and r["seconds"] > 0 for r in got.values())
    for params in settings:
        held, train = [], []
        for f in (0, 1):
            model = fit(frame.where(F.col("fold") != f), "boosting", FEATURES, params=params)
            for found, rows in ((held, frame.where(F.col("fold") == f)), (train, frame.where(F.col("fold") != f))):
                found.append(ranking.auc(model.transform(rows).withColumn("prob", F.round("prob", staged.TIE_DIGITS)), "prob", "y").first()["auc"])
        r = got[json.dumps(params, sort_keys=True)]
        assert (r["cv_auc"], r["train_auc"]) == (pytest.approx(sum(held) / 2, abs=1e-9), pytest.approx(sum(train) / 2, abs=1e-9))


def test_bound_on_labelled_rows(frame):
    assert staged.bounded(frame, "lead_id", None).count() == staged.bounded(frame, "lead_id", 400).count() == 400
    assert 60 < staged.bounded(frame, "lead_id", 100).count() < 140
    got = staged.staged_grid(frame, "decision_tree", [{"max_depth": 3}], FEATURES, strategy="none", max_labelled=200).first()
    assert 0.5 < got["cv_auc"] <= 1 and got["n_fits"] == 2
    model = fit(staged.bounded(frame, "lead_id", 200).where("fold = 1"), "decision_tree", FEATURES, params={"max_depth": 3})
    first = ranking.auc(model.transform(frame.where("fold = 0")), "prob", "y").first()["auc"]
    other = fit(staged.bounded(frame, "lead_id", 200).where("fold = 0"), "decision_tree", FEATURES, params={"max_depth": 3})
    assert got["cv_auc"] == pytest.approx((first + ranking.auc(other.transform(frame.where("fold = 1")), "prob", "y").first()["auc"]) / 2)
