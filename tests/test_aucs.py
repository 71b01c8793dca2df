"""AUCs of many scores at once against one at a time."""

import pytest
from pyspark.sql import functions as F

from dialwise.functions.hashing import uniform
from dialwise.operators import ranking
from dialwise.plans import experiments as ex
from dialwise.plans.bayes import fit_gaussian_bayes, fit_gaussian_bayes_each


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.range(3000)
    y = F.when(F.col("id") % 97 == 0, None).otherwise((uniform(1, "id") < 0.2).cast("int"))
    noise, tied = uniform(2, "id"), F.floor(uniform(3, "id") * 4) / 4
    return rows.select("id", y.alias("y"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("part"), (F.col("id") % 2).cast("int").alias("fold"),
                       F.array(noise + F.coalesce(y, F.lit(0)) * 0.2, tied, F.lit(0.5), F.when(F.col("id") % 7 > 0, noise)).alias("p")).cache()


@pytest.mark.parametrize("rows", [500_000, 100])
def test_aucs_equal_one_at_a_time(scored, rows, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", rows)
    got = {(r["fold"], r["part"], r["at"]): r["auc"] for r in ranking.aucs(scored, "p", "y", "id", ["fold", "part"]).collect()}
    assert len(got) == 16
    for at in range(4):
        one = scored.withColumn("score", F.col("p")[at])
        for r in ranking.auc(one, "score", "y", ["fold", "part"]).collect():
            assert got[r["fold"], r["part"], at] == pytest.approx(r["auc"], abs=1e-12)


def test_aucs_without_a_class_are_null(scored):
    got = ranking.aucs(scored.where("y = 0"), "p", "y", "id", ["fold"]).collect()
    assert len(got) == 8 and all(r["auc"] is None for r in got)
    assert ranking.aucs(scored.where("false"), "p", "y", "id", ["fold"]).count() == 0


def test_a_grid_of_naive_bayes_reads_each_training_fold_once(spark, monkeypatch):
    rows = spark.range(900).withColumnRenamed("id", "lead_id")
    y = (uniform(5, "lead_id") < 0.25).cast("int")
    frame = rows.select("lead_id", y.alias("y"), (uniform(6, "lead_id") + y * 0.3).alias("a"), F.floor(uniform(7, "lead_id") * 9).cast("double").alias("b"),
                        (F.col("lead_id") % 3).cast("int").alias("fold")).cache()
    settings, names = [{"var_smoothing": s} for s in (1e-9, 1e-2, 1.0)], ["a", "b"]
    want = []
    folds = ex.training_folds(frame, names, strategy="smote")
    for p in settings:
        models = [(ex.fit(train, "naive_bayes", names, params=p), train, held) for _, train, _, held in folds]
        want.append([sum(ex.auc_of(m, part, "y") for m, *both in models for part in [both[i]]) / 3 for i in (1, 0)])
    passes, one_pass = [], ex.fit_each
    monkeypatch.setattr(ex, "fit_each", lambda *a: (passes.append(len(a[3])), one_pass(*a))[1])
    got = {r["trial"]: r for r in ex.try_settings(frame, "naive_bayes", settings, names).collect()}
    assert passes == [3, 3, 3]
    for n, (held, train) in enumerate(want):
        assert (got[n]["cv_auc"], got[n]["train_auc"]) == (pytest.approx(held, abs=1e-9), pytest.approx(train, abs=1e-9))


def test_naive_bayes_of_each_smoothing_value(scored):
    df = scored.select("y", F.col("p")[0].alias("a"), (F.col("p")[1] * 1e5).alias("b")).where("y IS NOT NULL")
    variance = df.agg(F.var_pop("a"), F.var_pop("b")).first()
    for standardised in (True, False):
        for s, model in zip((1e-9, 0.5), fit_gaussian_bayes_each(df, ["a", "b"], [1e-9, 0.5], "y", standardised)):
            assert model == fit_gaussian_bayes(df, ["a", "b"], "y", s, standardised)
            plain = fit_gaussian_bayes(df, ["a", "b"], "y", 0.0, standardised)
            for c in (0, 1):
                extra = [s * (v if standardised else max(variance)) for v in variance]
                assert model.variances[c] == pytest.approx([v + e for v, e in zip(plain.variances[c], extra)], rel=1e-12)
