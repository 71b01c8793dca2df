"""Registered learning, experiment and storage queries."""

import uuid

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.functions import features as fx
from dialwise.operators import groups, ranking, schedule
from dialwise.operators.sampling import stratified_split
from dialwise.plans import experiments as ex
from dialwise.plans import staged
from dialwise.plans import twostage as ts
from dialwise.plans.models import GRIDS, design_matrix, fit
from dialwise.plans.pipelines import fit_pipeline
from dialwise.plans.search import resumable_search
from dialwise.scale import materialise, remove_at_exit, shared_dir
from dialwise.sources import delimited, sinks
from dialwise.sources.leads import FEATURES, build_leads

INPUTS = [*FEATURES, "y"]
TREE = {"max_depth": 6, "min_samples_leaf": 5}
FOREST = {"n_estimators": 10, "max_depth": 6}
FULL_FOREST = {"n_estimators": 100, "max_depth": 6}
BOOST = {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.3}
LOGIT = {"C": 1.0, "max_iter": 30}


def coded(spark, sf, style="label", k=3):
    frame, features = design_matrix(build_leads(spark, sf, INPUTS), style=style)
    return ex.folded(frame, k), features


def holdout(learner, params):
    """Train on 80 %, score the held-out 20 %, report its metrics."""
    def run(spark, sf):
        frame, features = design_matrix(build_leads(spark, sf, INPUTS), style="label")
        split = materialise(stratified_split(frame, "y", "lead_id", 0.2))
        model = fit(split.where("is_test = 0"), learner, features, params=params)
        scored = materialise(model.transform(split.where("is_test = 1"))
                             .select("lead_id", "y", "prob", F.lit(learner).alias("model")))
        return ex.score_metrics(scored, ["model"])
    return run


for name, learner, params in [("l01_decision_tree", "decision_tree", TREE),
                              ("l01_decision_tree_feature_subset", "decision_tree", {**TREE, "max_features": "sqrt"}),
                              ("l02_random_forest", "random_forest", FULL_FOREST),
                              ("l03_naive_bayes_holdout", "naive_bayes", {"var_smoothing": 1e-5}),
                              ("l04_logistic_regression", "logistic_regression", {**LOGIT, "penalty": "l1"}),
                              ("l05_gradient_boosting", "boosting", {**BOOST, "subsample": 0.8, "colsample": 0.8})]:
    query(name)(holdout(learner, params))


@query("l08_cross_validation")
def l08(spark, sf):
    frame, features = coded(spark, sf)
    learners = {"decision_tree": TREE, "naive_bayes": {}, "logistic_regression": LOGIT}
    return groups.fold_summary(ex.cross_validate(frame, features, learners))


@query("l09_oof_scores")
def l09(spark, sf):
    frame, features = coded(spark, sf, k=5)
    return ex.oof_scores(frame, "logistic_regression", features, params=LOGIT)


@query("l10_grid_search")
def l10(spark, sf):
    frame, features = coded(spark, sf)
    choices = {"criterion": ["gini", "entropy"], "max_depth": [4, 8], "min_samples_leaf": [5]}
    return ex.grid_search(frame, "decision_tree", choices, features)


@query("l10_grid_search_naive_bayes")
def l10_bayes(spark, sf):
    frame, features = coded(spark, sf, k=5)
    return ex.grid_search(frame, "naive_bayes", GRIDS["naive_bayes"], features)


#: labelled rows that a grid's models are fitted on, at most; all held-out rows are scored
GRID_LABELLED = 1000


def full_grid(learner, labelled=GRID_LABELLED):
    """All settings of a learner's grid, five folds."""
    def run(spark, sf):
        frame, features = coded(spark, sf, k=5)
        return staged.staged_grid(frame, learner, ex.grid(GRIDS[learner]), features, max_labelled=labelled)
    return run


query("l10_grid_search_decision_tree")(full_grid("decision_tree"))


def holdout_by_size(learner, params, sizes):
    """AUC on the held-out 20 % after each number of trees, from one fit."""
    def run(spark, sf):
        frame, features = design_matrix(build_leads(spark, sf, INPUTS), style="label")
        split = materialise(stratified_split(frame, "y", "lead_id", 0.2))
        model = staged.fit_staged(split.where("is_test = 0"), learner, features, params={**params, "n_estimators": max(sizes)})
        scored = materialise(staged.by_size(model, split.where("is_test = 1"), sizes, ["lead_id", "y"]).withColumn("prob", F.round("prob", staged.TIE_DIGITS)))
        facts = scored.groupBy("size").agg(F.count("y").alias("n"), F.sum("y").alias("positives"))
        return facts.join(ranking.auc(scored, "prob", "y", ["size"]), "size")
    return run


query("l02_forest_by_size")(holdout_by_size("random_forest", FULL_FOREST, [10, 25, 50, 100]))
query("l05_boosting_by_rounds")(holdout_by_size("boosting", BOOST, [5, 10, 20, 30]))


@query("l11_random_search")
def l11(spark, sf):
    frame, features = coded(spark, sf)
    space = {"n_estimators": (3, 8), "learning_rate": (0.05, 0.3), "max_depth": (3, 5), "subsample": (0.5, 1.0)}
    return ex.random_search(frame, "boosting", features, trials=3, space=space)


@query("l11_resumable_search")
def l11_resumable(spark, sf):
    """Twenty settings over five folds; the second call finds every fit of the first."""
    frame, features = coded(spark, sf, k=5)
    path = fresh(spark, "trials")
    search = lambda: resumable_search(frame, "naive_bayes", features, path, space={"var_smoothing": (1e-9, 1.0)})
    search()
    return search()


@query("l12_importances")
def l12(spark, sf):
    frame, features = design_matrix(build_leads(spark, sf, INPUTS), style="label")
    return ex.importance_table(spark, fit(frame, "random_forest", features, params=FULL_FOREST))


@query("l15_recursive_elimination")
def l15(spark, sf):
    frame, features = coded(spark, sf)
    return ex.recursive_elimination(frame, features, {"n_estimators": 5, "max_depth": 5}, least=len(features) - 4)


@query("l16_feature_subsets")
def l16(spark, sf):
    frame, features = design_matrix(build_leads(spark, sf, INPUTS), style="label")
    return ex.evaluate_subsets(materialise(frame), features, FOREST, thresholds=(0.01, 0.05), tops=(5, 10, 15))


@query("l18_feature_ablation")
def l18(spark, sf):
    results = ts.ablation(build_leads(spark, sf, INPUTS), ts.ABLATIONS, folds=3, learner="decision_tree",
                          params=TREE, strategy="none")
    summary = ts.ablation_summary(materialise(results))
    return summary.withColumn("verdict", fx.five_way_verdict("diff"))


@query("l18_version_comparison")
def l18_versions(spark, sf):
    results = ts.ablation(build_leads(spark, sf, INPUTS), ts.VERSIONS, folds=3, learner="decision_tree",
                          params=TREE, strategy="smote")
    pairs = schedule.paired_differences(materialise(results), "v1", "v2")
    return schedule.win_count(pairs).withColumn("verdict", fx.version_verdict("mean_diff"))


STAGES = [*INPUTS, "duration"]


@query("l19_two_stage")
def l19(spark, sf):
    table, _ = ts.two_stage(build_leads(spark, sf, STAGES), folds=3, params=BOOST)
    return table


@query("l19_two_stage_metrics")
def l19_metrics(spark, sf):
    _, metrics = ts.two_stage(build_leads(spark, sf, STAGES), folds=3, learner="logistic_regression",
                              params=LOGIT, strategy="none")
    return metrics


@query("l20_perfect_information")
def l20(spark, sf):
    table, _ = ts.two_stage(build_leads(spark, sf, STAGES), folds=3, learner="logistic_regression", params=LOGIT,
                            perfect_lengths=True)
    return table


@query("l21_accuracy_sweep")
def l21(spark, sf):
    levels = [0.58, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00]
    return ts.accuracy_sweep(build_leads(spark, sf, STAGES), levels, folds=3, learner="logistic_regression",
                             params=LOGIT, strategy="none")


# storage


def fresh(spark, name):
    """A folder of this run's own, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def saved(spark, leads, learner, params, style, derived=()):
    """The pipeline as fitted and as a later run finds it in the shared folder."""
    path = sinks.pipeline_path(fresh(spark, "models"), f"outcome, {learner}, {style}", [*FEATURES, *derived])
    make = lambda: fit_pipeline(leads, learner, params, style, derived)
    return sinks.load_or_fit(path, make), sinks.load_or_fit(path, make)


def in_batches(model, leads):
    """Scores of two batches, each without a level that the model was fitted with."""
    batches = [leads.where("contact = 'cellular'"), leads.where("contact <> 'cellular'")]
    first, second = [model.transform(b.drop("y")).select("lead_id", "prob") for b in batches]
    return first.unionByName(second)


@query("l22_batch_scoring")
def l22(spark, sf):
    leads = materialise(build_leads(spark, sf, INPUTS))
    _, loaded = saved(spark, leads, "logistic_regression", LOGIT, "onehot", ["previous_success", "financial_stress"])
    return in_batches(loaded, leads)


@query("s06_save_and_load_pipeline", lead_sql="SELECT count(*) AS n, count(*) AS equal FROM leads")
def s06(spark, sf):
    leads = materialise(build_leads(spark, sf, INPUTS))
    made, loaded = saved(spark, leads, "logistic_regression", LOGIT, "onehot")
    whole = made.transform(leads).select("lead_id", F.col("prob").alias("whole"))
    both = whole.join(in_batches(loaded, leads), "lead_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("whole") == F.col("prob")).alias("equal"))


@query("s01_read_delimited", lead_sql="""
  SELECT lead_id, age, job, "default", pdays, euribor3m AS nr_employed, y FROM leads""")
def s01(spark, sf):
    leads = build_leads(spark, sf, ["age", "job", "default", "pdays", "euribor3m", "y"])
    path = fresh(spark, "leads-csv")
    named = leads.withColumnRenamed("euribor3m", "nr.employed")
    sinks.write_result(named, path, "csv", sep=";")
    return delimited.read_delimited(spark, path, named.schema)


@query("s02_write_result", lead_sql="SELECT job, count(*) AS n, sum(y)::BIGINT AS positives FROM leads GROUP BY job")
def s02(spark, sf):
    path = fresh(spark, "result")
    made = build_leads(spark, sf, ["job", "y"]).groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    sinks.write_result(made, path)
    return sinks.read_result(spark, path, made.schema, "parquet")


@query("s03_parameters_as_json", lead_sql="""
  SELECT job, '{"max_age":"' || max(age) || '","positives":"' || sum(y)::BIGINT || '"}' AS json FROM leads GROUP BY job""")
def s03(spark, sf):
    path = fresh(spark, "params")
    per_job = build_leads(spark, sf, ["job", "age", "y"]).groupBy("job").agg(
        F.create_map(F.lit("max_age"), F.max("age").cast("string"),
                     F.lit("positives"), F.sum("y").cast("string")).alias("params"))
    sinks.write_params(per_job, "job", path)
    return spark.read.schema("job string, json string").json(path)


@query("s04_append_report", lead_sql="""
  SELECT 'r1' AS run_id, 'jobs' AS section, job AS key, count(*)::VARCHAR AS value FROM leads GROUP BY job
  UNION ALL SELECT 'r1', 'contacts', contact, count(*)::VARCHAR FROM leads GROUP BY contact""")
def s04(spark, sf):
    path = fresh(spark, "report")
    leads = build_leads(spark, sf, ["job", "contact"])
    for section, col in [("jobs", "job"), ("contacts", "contact")] * 2:  # a repeated run
        sinks.append_log(leads.groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("value"))
                              .withColumns({"run_id": F.lit("r1"), "section": F.lit(section)}), path)
    return sinks.read_log(spark, path)


@query("s05_read_result", lead_sql="""
  SELECT month, count(*) AS n, round(avg(duration), 6) AS mean_duration FROM leads GROUP BY month""")
def s05(spark, sf):
    path = fresh(spark, "result-csv")
    made = build_leads(spark, sf, ["month", "duration"]).groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("mean_duration"))
    sinks.write_result(made, path, "csv")
    return sinks.read_result(spark, path, made.schema)
