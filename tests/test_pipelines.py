"""Saved pipelines keep the encoders of their training rows."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dialwise.operators.encode import one_hot
from dialwise.plans import pipelines as pl
from dialwise.plans.models import design_matrix, fit
from dialwise.sources import sinks
from dialwise.sources.leads import FEATURES

LOGIT = {"C": 1.0, "max_iter": 10}


@pytest.fixture(scope="module")
def rows(leads):
    return leads.select("lead_id", "y", "duration", *FEATURES)


def gap(a, b):
    both = a.select("lead_id", F.col("prob").alias("p")).join(b.select("lead_id", "prob"), "lead_id")
    return both.count(), both.agg(F.max(F.abs(F.col("p") - F.col("prob")))).first()[0]


@pytest.mark.parametrize("learner, params, style", [
    ("naive_bayes", {"var_smoothing": 1e-5}, "label"), ("decision_tree", {"max_depth": 4}, "label"),
    ("logistic_regression", LOGIT, "onehot"), ("random_forest", {"n_estimators": 3, "max_depth": 4}, "onehot")])
def test_a_loaded_pipeline_scores_a_batch_that_lacks_levels(spark, rows, tmp_path, learner, params, style):
    model = pl.fit_pipeline(rows, learner, params, style, derived=["previous_success"])
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    batch = rows.where("contact = 'telephone' AND job <> 'BUILDING'").drop("y")
    scored = loaded.transform(batch)
    assert scored.columns == [*batch.columns, "prob"]
    n, worst = gap(model.transform(rows), scored)
    assert (n, worst) == (batch.count(), 0.0) and n > 0


@pytest.mark.parametrize("learner, params", [("naive_bayes", {"var_smoothing": 1e-5}), ("decision_tree", {"max_depth": 4})])
def test_scores_equal_those_of_a_coded_table(rows, learner, params):
    frame, features = design_matrix(rows, style="label")
    want = fit(frame, learner, features, params=params).transform(frame)
    n, worst = gap(want, pl.fit_pipeline(rows, learner, params, "label").transform(rows))
    assert n == rows.count() and worst < 1e-9


def test_one_hot_vectors_hold_the_columns_of_one_hot(rows):
    stages, _, _ = pl.encoder_stages(["job", "month"])
    vectors = Pipeline(stages=stages).fit(rows).transform(rows)
    wide = one_hot(rows.select("lead_id", "job", "month"), ["job", "month"])
    flat = F.concat(F.reverse(vector_to_array("job__onehot")), F.reverse(vector_to_array("month__onehot")))
    both = vectors.select("lead_id", flat.alias("v")).join(
        wide.select("lead_id", F.array(*[F.col(c).cast("double") for c in wide.columns[1:]]).alias("w")), "lead_id")
    assert both.where("v <> w").isEmpty() and both.count() == rows.count()


def test_unknown_levels_and_nulls_have_a_stated_code(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "job string")
    later = spark.createDataFrame([("b",), ("new",), (None,)], "job string")
    plain = pl.LevelCodes(inputCols=["job"], outputCols=["code"]).fit(train).transform(later)
    assert {r.job: r.code for r in plain.collect()} == {"b": 1.0, "new": -1.0, None: -1.0}
    back = pl.LevelCodes(inputCols=["job"], outputCols=["code"], reverse=True).fit(train).transform(later)
    assert {r.job: r.code for r in back.collect()} == {"b": 1.0, "new": 2.0, None: 2.0}
    ordered = pl.OrderedLevels(inputCol="job", outputCol="code", levels=["c", "b"]).transform(later)
    assert {r.job: r.code for r in ordered.collect()} == {"b": 1.0, "new": -1.0, None: -1.0}


def test_a_column_without_any_level(spark, tmp_path):
    train = spark.createDataFrame([(None, "x"), (None, "y")], "job string, month string")
    stages, _, _ = pl.encoder_stages(train.columns)
    model = Pipeline(stages=stages).fit(train)
    model.write().save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(train).select("month", vector_to_array("job__onehot").alias("v"))
    assert {(r.month, tuple(r.v)) for r in got.collect()} == {("x", ()), ("y", ())}


def test_many_levels(spark, tmp_path):
    train = spark.range(40_000).select(F.concat(F.lit("https://"), F.col("id") % 20_000).alias("job"))
    stages, features, _ = pl.encoder_stages(["job"])
    model = Pipeline(stages=stages).fit(train)
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    got = loaded.transform(train.limit(3)).first()["job__onehot"]
    assert features == ["job__onehot"] and got.size == 19_999
    assert loaded.stages[0].levels.count() == 20_000


def test_what_cannot_be_fitted_is_refused(rows):
    with pytest.raises(ValueError, match="label style"):
        pl.fit_pipeline(rows, "naive_bayes")
    with pytest.raises(ValueError, match="style"):
        pl.encoder_stages(["job"], style="other")
    with pytest.raises(ValueError, match="source columns"):
        pl.fit_pipeline(rows.drop("age"), "decision_tree", derived=["age_campaign"])
    with pytest.raises(ValueError, match="both classes"):
        pl.fit_pipeline(rows.where("y = 0"), "naive_bayes", style="label")


def test_a_save_that_was_cut_short_is_made_anew(spark, rows, tmp_path):
    made = []
    def make():
        made.append(1)
        return pl.fit_pipeline(rows.select("y", "age", "job"), "naive_bayes", style="label")
    path = str(tmp_path / "model")
    make().stages[0].write().save(path + "/stages/0_half")
    sinks.load_or_fit(path, make)
    sinks.load_or_fit(path, make)
    assert len(made) == 2


def test_a_repeated_report_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "report")
    log = lambda run, section, value: spark.createDataFrame(
        [(run, section, "k", value), (run, section, "m", value)], sinks.LOG_SCHEMA)
    for run, section, value in [("007", "a", "1"), ("007", "b/c d", "2"), ("008", "a", "3"), ("007", "a", "4"), ("007", "a", "4")]:
        sinks.append_log(log(run, section, value), path)
    got = sorted(tuple(r) for r in sinks.read_log(spark, path).collect())
    assert got == sorted((r, s, k, v) for r, s, v in [("007", "a", "4"), ("007", "b/c d", "2"), ("008", "a", "3")] for k in "km")
