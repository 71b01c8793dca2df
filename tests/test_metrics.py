"""Published numbers, invariants and edge cases of metrics and schedules."""

import pytest
from pyspark.sql import functions as F

from dialwise.functions import features as fx
from dialwise.operators import encode, groups, metrics, profile, ranking, sampling, schedule, selection
from dialwise.plans import experiments as ex
from dialwise.plans.models import GRIDS, design_matrix
from dialwise.sources import delimited, sinks
from tests.conftest import same


def test_confusion_counts_give_published_rates(spark):
    counts = spark.createDataFrame([(6025, 1285, 54, 874)], "tn bigint, fp bigint, fn bigint, tp bigint")
    r = metrics.rates(counts).first()
    want = {"recall": .9418, "precision": .4048, "f1": .5662, "accuracy": .8375, "fnr": .0582}
    assert {k: round(r[k], 4) for k in want} == want


def test_class_report_gives_published_accuracy(spark):
    counts = spark.createDataFrame([(11164, 9541, 7756, 12727)], "tn bigint, fp bigint, fn bigint, tp bigint")
    report = {r["class"]: r for r in metrics.class_report(counts).collect()}
    assert round(report["accuracy"]["f1"], 4) == 0.5800
    assert report["weighted avg"]["support"] == 41188


def test_published_sweep_crosses_at_three_quarters(spark):
    sales = [(0.58, 60), (0.60, 60), (0.65, 65), (0.70, 70), (0.75, 85), (1.00, 112)]
    df = spark.createDataFrame([(l, s, 74) for l, s in sales], "level double, efficiency bigint, probability bigint")
    out = schedule.first_crossing(df, "level", "efficiency", "probability", current=0.58).first()
    assert out["crossing"] == 0.75 and round(out["gap_points"], 6) == 17
    never = schedule.first_crossing(df.where("level < 0.7"), "level", "efficiency", "probability").first()
    assert never["crossing"] is None


@pytest.mark.parametrize("strategy", ["plain", "bucketed"])
def test_ranking_invariants(leads, strategy):
    df = leads.select("lead_id", "score", "y", (1 - F.col("score")).alias("flipped"), F.lit(0.3).alias("flat"))
    auc = lambda c: ranking.auc(df, c, "y", strategy=strategy).first()["auc"]
    assert auc("score") + auc("flipped") == pytest.approx(1)
    assert auc("flat") == pytest.approx(0.5)
    curve = ranking.lift_curve(df, "score", "y", "lead_id", strategy=strategy).orderBy("pct").collect()
    gains = [r["gain"] for r in curve]
    assert len(curve) == 100 and gains == sorted(gains) and gains[-1] == 100 and curve[-1]["lift"] == pytest.approx(1)


def test_perfect_and_one_class_scores(leads):
    df = leads.select("lead_id", F.col("y").cast("double").alias("score"), "y")
    assert ranking.auc(df, "score", "y").first()["auc"] == 1
    assert ranking.average_precision(df, "score", "y").first()["average_precision"] == 1
    for only in (0, 1):
        one = df.where(F.col("y") == only)
        assert ranking.auc(one, "score", "y").first()["auc"] is None
    none = ranking.lift_curve(df.where("y = 0"), "score", "y", "lead_id").agg(F.max("gain"), F.min("lift")).first()
    assert tuple(none) == (0.0, 1.0)


def test_lift_curve_of_few_rows_skips_empty_cuts(leads):
    few = leads.orderBy("lead_id").limit(7).select("lead_id", "score", "y")
    rows = ranking.lift_curve(few, "score", "y", "lead_id").collect()
    assert sorted(r["pct"] for r in rows) == [p for p in range(1, 101) if 7 * p // 100 > 0]
    assert all(r["contacted"] == 7 * r["pct"] // 100 for r in rows)


@pytest.mark.parametrize("strategy", ["plain", "bucketed"])
def test_budget_stops_at_first_lead_that_exceeds(spark, strategy):
    rows = [(1, 100, 1), (2, 50, 0), (3, None, None), (4, 60, 1), (5, 1, 1)]
    df = spark.createDataFrame(rows, "lead_id bigint, duration int, y int")
    out = schedule.select_within_budget(df, "lead_id", "lead_id", budget=200, strategy=strategy)
    assert [r["lead_id"] for r in out.orderBy("lead_id").collect()] == [1, 2, 3]
    assert tuple(schedule.outcome(out).first()) == (3, 1, 150)
    assert schedule.select_within_budget(df.where("lead_id <> 3"), "lead_id", "lead_id", budget=0, strategy=strategy).isEmpty()


def test_negative_cost_is_refused(spark):
    df = spark.createDataFrame([(1, -5, 1)], "lead_id bigint, duration int, y int")
    with pytest.raises(Exception, match="negative cost"):
        schedule.select_within_budget(df, "lead_id", "lead_id").collect()


def test_random_trials_widen_until_the_budget_is_passed(leads):
    # nearly all cost sits in few leads, so the first cutoff is too small for some trials
    skewed = leads.select("lead_id", "y", F.when(F.col("h") % 200 == 0, 20_000).otherwise(1).alias("duration"))
    got = schedule.random_order_trials(skewed, "lead_id", trials=6)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("trial"), k.alias("key"))
                               for t, k in enumerate(schedule.trial_keys("lead_id", 6, 42))])).alias("e")
    whole = skewed.select("lead_id", "y", "duration", keys).select("*", "e.*") \
        .withColumn("key", F.conv("key", 16, 10).cast("bigint"))
    want = schedule.outcome(schedule.select_within_budget(whole, "key", "lead_id", group=["trial"]), group=["trial"])
    assert same(got, want)


def test_folds_are_even_per_class(leads):
    sizes = sampling.stratified_folds(leads, "y", "lead_id", 5).groupBy("y", "fold").count().groupBy("y") \
        .agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in sizes)
    few = sampling.stratified_folds(leads.limit(3), "y", "lead_id", 10)
    assert few.where("fold < 0 OR fold > 9").isEmpty() and few.count() == 3


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0,), (180,), (181,), (None,), (-5,)], "duration int")
    got = [r[0] for r in df.select(fx.duration_class()).collect()]
    assert got == [0, 0, 1, None, None]


def test_recode_and_indicator_edge_cases(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("unknown",)], "v string")
    assert [r[0] for r in df.select(fx.yes_no("v")).collect()] == [1, 0, None]
    tie = spark.createDataFrame([(0.5, 0.5)], "a double, b double")
    assert tie.select(fx.predicted_class("a", "b")).first()[0] == 0


def test_blend_reaches_the_target(leads):
    df = leads.select("lead_id", fx.duration_class().alias("cls"), "prob_short", "prob_long").withColumn(
        "prob_long", F.when(F.col("lead_id") % 2 == 0, F.col("prob_short")).otherwise(F.col("prob_long"))) \
        .withColumn("prob_short", 1 - F.col("prob_long"))
    accuracy = lambda d: d.agg(F.avg((fx.predicted_class("prob_short", "prob_long") == F.col("cls")).cast("int"))).first()[0]
    real = accuracy(df)
    assert accuracy(sampling.blend_to_accuracy(df, "cls", 0.9, "lead_id")) == pytest.approx(0.9, abs=0.03)
    assert accuracy(sampling.blend_to_accuracy(df, "cls", 1.0, "lead_id")) == 1
    assert same(df, sampling.blend_to_accuracy(df, "cls", real / 2, "lead_id"))


def test_constant_columns(leads):
    df = leads.select("lead_id", "y", F.lit(3).alias("c"))
    assert encode.standardise(df, ["c"]).where("c <> 0").isEmpty()
    assert fx.min_max(df, "c", "s").where("s IS NOT NULL").isEmpty()
    assert groups.target_correlations(df, ["c"]).first()["r"] is None
    assert selection.mutual_information(df, ["c"]).first()["mutual_information"] == pytest.approx(0, abs=1e-12)
    assert profile.histogram(df, "c", 4).agg(F.sum("n")).first()[0] == df.count()
    assert profile.density(df, "c", "y").isEmpty()


def test_label_codes_follow_text_order_on_both_paths(leads):
    text = leads.select(F.concat(F.lit("common-"), F.md5(F.col("lead_id").cast("string"))).alias("t"), "job")
    assert same(encode.level_table(text, ["t", "job"], "plain"),
                encode.level_table(text, ["t", "job"], "bucketed"))


def test_large_dictionaries_are_joined(leads, monkeypatch):
    plain = encode.label_encode(leads.select("lead_id", "job"), ["job"])
    monkeypatch.setattr(encode, "INLINE_LEVELS", 1)
    assert same(plain, encode.label_encode(leads.select("lead_id", "job"), ["job"]))
    monkeypatch.setattr(encode, "DICTIONARY_LIMIT", 2)
    assert same(plain, encode.label_encode(leads.select("lead_id", "job"), ["job"]))
    with pytest.raises(ValueError):
        encode.collect_levels(leads, ["job"], limit=2)


def test_lead_file_reader(spark, tmp_path):
    head = ";".join(f'"{f.name}"' for f in delimited.LEAD_SCHEMA)
    row = ('{age};"{job}";"married";"basic.4y";"{d}";"no";"no";"telephone";"may";"mon";{dur};1;999;0;"nonexistent";'
           '1.1;93.994;-36.4;4.857;5191;"{y}"')
    lines = [row.format(age=30 + i, job="admin.", d="unknown" if i == 1 else "no", dur=[180, 0, 250][i % 3],
                        y="yes" if i % 4 == 0 else "no") for i in range(12)]
    file = tmp_path / "leads.csv"
    file.write_text("\n".join([head, *lines, "not;a;row"]) + "\n")
    df = delimited.read_delimited(spark, str(file), delimited.LEAD_SCHEMA, corrupt="_corrupt").cache()
    assert df.count() == 13 and "nr_employed" in df.columns
    assert df.where("_corrupt IS NOT NULL").count() == 1
    good = df.where("_corrupt IS NULL")
    assert good.where("pdays = 999 AND nr_employed = 5191").count() == 12
    assert good.where(fx.duration_class() == 1).count() == 4
    with pytest.raises(FileNotFoundError):
        delimited.read_delimited(spark, str(tmp_path / "missing.csv"), delimited.LEAD_SCHEMA)


def test_pipeline_paths_differ_by_run():
    a = sinks.pipeline_path("/m", "baseline", ["x", "y"])
    assert a != sinks.pipeline_path("/m", "enhanced", ["x", "y"]) and a != sinks.pipeline_path("/m", "baseline", ["x"])


def test_grids_and_draws():
    assert len(ex.grid(GRIDS["random_forest"])) == 36 and len(ex.grid(GRIDS["boosting"])) == 54
    assert len(ex.grid(GRIDS["logistic_regression"])) == 8 and len(ex.grid(GRIDS["naive_bayes"])) == 4
    draws = ex.draw_settings(20)
    assert draws == ex.draw_settings(20) and all(100 <= d["n_estimators"] <= 500 for d in draws)


def test_learners_beat_a_coin_flip(spark, leads):
    frame, features = design_matrix(leads.drop("duration"), style="label")
    frame = ex.folded(frame, 3)
    for learner, params in {"decision_tree": {"max_depth": 5, "min_samples_leaf": 20}, "naive_bayes": {},
                            "logistic_regression": {"max_iter": 30},
                            "random_forest": {"n_estimators": 5, "max_depth": 5},
                            "boosting": {"n_estimators": 5, "max_depth": 3}}.items():
        scored = ex.oof_scores(frame, learner, features, params=params)
        assert scored.count() == leads.count() == scored.select("lead_id").distinct().count()
        assert ranking.auc(scored, "prob", "y").first()["auc"] > 0.55, learner


def test_wide_one_hot_names_and_order(leads):
    frame, features = design_matrix(leads.drop("duration"), derived=["contact_intensity"])
    assert "contact_intensity" in features and "duration" not in features and "education" in features
    assert "marital_divorced" not in features and "marital_married" in features
