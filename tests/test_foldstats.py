"""Fold-wise naive Bayes against one fit per fold."""

import pytest
from pyspark.sql import functions as F

from dialwise.functions.hashing import uniform
from dialwise.operators import ranking
from dialwise.plans import experiments as ex
from dialwise.plans import foldstats as fs

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(600).withColumnRenamed("id", "lead_id")
    y = (uniform(1, "lead_id") < 0.3).cast("int")
    made = rows.select("lead_id", y.alias("y"), (1e6 + y * 0.4 + uniform(2, "lead_id")).alias("a"), (uniform(3, "lead_id") * 100 - y).alias("b"),
                       F.lit(5.0).alias("c"), (F.col("lead_id") % 4).cast("int").alias("fold"))
    return made.cache()


def test_scores_equal_a_fit_per_fold(frame):
    want = ex.oof_scores(frame, "naive_bayes", FEATURES, params={"var_smoothing": 1e-3})
    got = fs.bayes_oof(frame, FEATURES, 1e-3)
    both = got.join(want.select("lead_id", "fold", F.col("prob").alias("want")), ["lead_id", "fold"])
    assert both.count() == 600
    assert both.agg(F.max(F.abs(F.col("prob") - F.col("want")))).first()[0] < 1e-6


def test_grid_equals_a_fit_per_setting_and_fold(frame):
    smoothing = [1e-9, 1e-2, 1.0]
    got = {r.var_smoothing: r for r in fs.bayes_grid(frame, FEATURES, smoothing, digits=7).collect()}
    for s in smoothing:
        held, train = [], []
        for f in range(4):
            model = ex.fit(frame.where(F.col("fold") != f), "naive_bayes", FEATURES, params={"var_smoothing": s})
            area = lambda rows: ranking.auc(model.transform(rows).withColumn("prob", F.round("prob", 7)), "prob", "y").first()["auc"]
            held.append(area(frame.where(F.col("fold") == f)))
            train.append(area(frame.where(F.col("fold") != f)))
        assert (got[s].cv_auc, got[s].train_auc) == (pytest.approx(sum(held) / 4, abs=1e-4), pytest.approx(sum(train) / 4, abs=1e-4))
        assert got[s].gap == pytest.approx(got[s].train_auc - got[s].cv_auc)


def test_what_cannot_be_learnt_is_refused(frame):
    with pytest.raises(ValueError, match="both classes"):
        fs.fold_statistics(frame.where("y = 1 OR fold = 0"), FEATURES).model(0, 1e-9)
    with pytest.raises(ValueError, match="nulls"):
        fs.fold_statistics(frame.withColumn("a", F.when(F.col("lead_id") > 5, F.col("a"))), FEATURES)
    with pytest.raises(ValueError, match="labels"):
        fs.fold_statistics(frame.withColumn("y", F.col("y") + 1), FEATURES)
