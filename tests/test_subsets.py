"""Feature sets scored in one table against one at a time."""

import pytest
from pyspark.sql import functions as F

from dialwise.functions.hashing import uniform
from dialwise.operators import ranking
from dialwise.operators.sampling import stratified_split
from dialwise.plans import experiments as ex


def test_sets_are_scored_together(spark, monkeypatch):
    y = (uniform(1, "id") < 0.3).cast("int")
    frame = spark.range(600).select(F.col("id").alias("lead_id"), y.alias("y"), (uniform(2, "id") + y * 0.5).alias("a"),
                                    (uniform(3, "id") + y * 0.2).alias("b"), uniform(4, "id").alias("c")).cache()
    params, names = {"max_depth": 3}, ["a", "b", "c"]
    split = stratified_split(frame, "y", "lead_id", 0.3, ex.SEED).cache()
    train, held = split.where("is_test = 0"), split.where("is_test = 1")
    order = ex._ordered(ex.fit(train, "decision_tree", names, params=params).importances())
    jobs, auc = [], ranking.auc
    monkeypatch.setattr(ranking, "auc", lambda *a: (jobs.append(1), auc(*a))[1])
    got = {(r["method"], r["setting"]): r for r in ex.evaluate_subsets(
        frame, names, params, thresholds=(0.0,), tops=(1, 2, 3), learner="decision_tree", strategy="none").collect()}
    assert len(got) == 4 and len(jobs) == 1
    for k in (1, 2, 3):
        scored = ex.fit(train, "decision_tree", order[:k], params=params).transform(held)
        r = got["top_k", float(k)]
        assert r["auc"] == pytest.approx(ranking.auc(scored, "prob", "y").first()["auc"], abs=1e-12)
        assert r["alift_area"] == pytest.approx(ranking.alift_area(scored, "prob", "y", "lead_id").first()["alift_area"], abs=1e-12)
