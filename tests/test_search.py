"""A search that is taken up again."""

import pytest
from pyspark.sql import functions as F

from dialwise.functions.hashing import uniform
from dialwise.plans import experiments as ex
from dialwise.plans import search

SPACE = {"var_smoothing": (1e-9, 2.0)}


@pytest.fixture(scope="module")
def frame(spark):
    y = (uniform(1, "lead_id") < 0.4).cast("int")
    return spark.range(240).withColumnRenamed("id", "lead_id").select(
        "lead_id", y.alias("y"), (uniform(2, "lead_id") + 0.3 * y).alias("a"), (uniform(3, "lead_id") * (1 + y)).alias("b"),
        (F.col("lead_id") % 3).cast("int").alias("fold")).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_halving_and_a_second_run_that_adds_none(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "trials")
    first = rows(search.resumable_search(frame, "naive_bayes", ["a", "b"], path, trials=5, space=SPACE))
    assert [r[3] for r in first] == [3, 3, 2, 1, 1]
    assert search.stored_runs(spark, path).count() == 5 + 3 + 2
    # the mean of a setting that met every fold is that of separate fits
    best = first[0]
    params = ex.draw_settings(5, SPACE)[best[0]]
    want = []
    for f in range(3):
        model = ex.fit(frame.where(F.col("fold") != f), "naive_bayes", ["a", "b"], params=params)
        want.append(ex.auc_of(model, frame.where(F.col("fold") == f), "y"))
    assert best[3] == 3 and best[4] == pytest.approx(sum(want) / 3)

    def never(*args, **kwargs):
        raise AssertionError("fitted again")
    monkeypatch.setattr(search, "fit", never)
    assert rows(search.resumable_search(frame, "naive_bayes", ["a", "b"], path, trials=5, space=SPACE)) == first
    with pytest.raises(ValueError, match="another search"):
        search.resumable_search(frame, "naive_bayes", ["a", "b"], path, trials=4, space=SPACE)


def test_a_search_out_of_time_is_taken_up(spark, frame, tmp_path):
    path = str(tmp_path / "trials")
    settings = [{"var_smoothing": 1e-9}, {"var_smoothing": 1.0}]
    go = lambda seconds: rows(search.resumable_search(frame, "naive_bayes", ["a", "b"], path, settings=settings, seconds=seconds))
    assert go(-1.0) == [] and search.stored_runs(spark, path).isEmpty()
    assert [r[3] for r in go(None)] == [3, 1]
    assert [r[3] for r in go(-1.0)] == [3, 1]
