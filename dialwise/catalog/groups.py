"""Registered aggregation, join, sort and set queries."""

from itertools import combinations

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.catalog.profile import DESCRIBE, STATS, each, rounded
from dialwise.functions import features as fx
from dialwise.operators import groups, profile
from dialwise.operators.encode import EDUCATION_LEVELS
from dialwise.sources.leads import MONTHS, NUMERIC, WEEKDAYS, build_leads
from dialwise.sources.tables import table

METRICS_CTE = """, m0 AS (
  SELECT job AS model, contact AS strategy, (h % 5)::INTEGER AS fold,
    round(avg(y), 6) AS response, round(avg(CASE WHEN (score >= 0.45) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy,
    round(count(*) FILTER (score >= 0.45 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall
  FROM leads GROUP BY ALL),
metrics AS (
  SELECT model, strategy, fold, 'response' AS metric, response AS value FROM m0
  UNION ALL SELECT model, strategy, fold, 'accuracy', accuracy FROM m0
  UNION ALL SELECT model, strategy, fold, 'recall', recall FROM m0)
"""


def segment_metrics(spark, sf):
    return groups.segment_metrics(build_leads(spark, sf, ["job", "contact", "h", "score", "y"]))


def ordered_values(values):
    return ", ".join(f"('{v}', {i})" for i, v in enumerate(values))


@query("a01_count_fixed_order", lead_sql=f"""
  SELECT month, pos, n FROM (VALUES {ordered_values(MONTHS)}) d(month, pos)
  LEFT JOIN (SELECT month, count(*) AS n FROM leads GROUP BY month) USING (month)""")
def a01(spark, sf):
    return groups.group_count(build_leads(spark, sf, ["month"]), "month", MONTHS)


@query("a02_group_rate", lead_sql="SELECT job, round(avg(y) * 100, 6) AS rate FROM leads GROUP BY job")
def a02(spark, sf):
    return rounded(groups.group_rate(build_leads(spark, sf, ["job", "y"]), "job"), "rate")


@query("a03_rate_fixed_order", lead_sql=f"""
  SELECT day_of_week, pos, rate FROM (VALUES {ordered_values(WEEKDAYS)}) d(day_of_week, pos)
  LEFT JOIN (SELECT day_of_week, round(avg(y) * 100, 6) AS rate FROM leads GROUP BY 1) USING (day_of_week)""")
def a03(spark, sf):
    return rounded(groups.group_rate(build_leads(spark, sf, ["day_of_week", "y"]), "day_of_week",
                                     order=WEEKDAYS), "rate")


@query("a04_group_describe", lead_sql=each(
    ["duration", "age"], "SELECT y, '{c}' AS \"column\", " + DESCRIBE + " FROM leads GROUP BY y"))
def a04(spark, sf):
    leads = build_leads(spark, sf, ["duration", "age", "y"])
    return rounded(groups.group_describe(leads, ["duration", "age"], ["y"]), *STATS)


@query("a05_crosstab_margins", lead_sql="""
  SELECT coalesce(marital, 'All') AS marital, count(*) FILTER (y = 0) AS y_0, count(*) FILTER (y = 1) AS y_1,
    count(*) AS "All" FROM leads GROUP BY ROLLUP (marital)""")
def a05(spark, sf):
    return groups.crosstab(build_leads(spark, sf, ["marital", "y"]), "marital", "y", [0, 1])


@query("a06_crosstab_percent", lead_sql="""
  SELECT poutcome, round(100.0 * count(*) FILTER (y = 0) / count(*), 2) AS y_0,
    round(100.0 * count(*) FILTER (y = 1) / count(*), 2) AS y_1 FROM leads GROUP BY poutcome""")
def a06(spark, sf):
    return groups.crosstab(build_leads(spark, sf, ["poutcome", "y"]), "poutcome", "y", [0, 1], normalize=True)


CORR = [*NUMERIC, "duration"]


@query("a07_correlation_matrix", lead_sql=" UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) AS r FROM leads" for a in CORR for b in CORR))
def a07(spark, sf):
    return rounded(groups.correlations(build_leads(spark, sf, CORR), CORR), "r")


@query("a08_strong_pairs", lead_sql="SELECT f1, f2, round(r, 6) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM leads"
    for a, b in combinations(["previous", "pdays", "euribor3m", "age", "neg_age"], 2)
    ).replace("FROM leads", "FROM (SELECT *, -age AS neg_age FROM leads)") + ") WHERE abs(r) > 0.3")
def a08(spark, sf):
    leads = build_leads(spark, sf, ["previous", "pdays", "euribor3m", "age"]).withColumn("neg_age", -F.col("age"))
    cols = ["previous", "pdays", "euribor3m", "age", "neg_age"]
    return rounded(groups.correlations(leads, cols, min_abs=0.3), "r")


@query("a09_target_correlations", lead_sql=each(
    CORR, "SELECT '{c}' AS feature, round(corr({q}, y), 6) AS r, round(abs(corr({q}, y)), 6) AS abs_r FROM leads"))
def a09(spark, sf):
    return rounded(groups.target_correlations(build_leads(spark, sf, [*CORR, "y"]), CORR), "r", "abs_r")


CONDITIONS = {"contacted_before": "previous > 0", "first_contact": "pdays = 999", "no_call": "duration = 0"}


@query("a10_conditional_shares", lead_sql=" UNION ALL ".join(
    f"""SELECT '{name}' AS condition, count(*) FILTER ({c}) AS n,
      round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS pct, count(*) FILTER ({c} AND y = 1) AS positives,
      count(*) FILTER ({c} AND y = 0) AS negatives FROM leads""" for name, c in CONDITIONS.items()))
def a10(spark, sf):
    leads = build_leads(spark, sf, ["previous", "pdays", "duration", "y"])
    return rounded(groups.conditional_shares(leads, {n: F.expr(c) for n, c in CONDITIONS.items()}), "pct")


@query("a11_fold_summary", lead_sql=METRICS_CTE + """
  SELECT model, strategy, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    min(value) AS min, max(value) AS max FROM metrics GROUP BY ALL""")
def a11(spark, sf):
    return rounded(groups.fold_summary(segment_metrics(spark, sf)), "mean", "std")


@query("a12_strategy_means", lead_sql=METRICS_CTE + """
  SELECT strategy, round(avg(v), 6) AS mean FROM (
    SELECT strategy, model, avg(value) AS v FROM metrics WHERE metric = 'accuracy' GROUP BY ALL) GROUP BY strategy""")
def a12(spark, sf):
    return rounded(groups.strategy_means(segment_metrics(spark, sf), "accuracy"), "mean")


@query("a13_best_row", lead_sql=METRICS_CTE + """
  SELECT model, strategy, metric, fold, value FROM metrics WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, model, strategy, fold) = 1""")
def a13(spark, sf):
    return groups.best_row(segment_metrics(spark, sf), "value", ["model", "strategy", "fold"], ["metric"])


@query("a14_class_weights", lead_sql="""
  SELECT y, count(*) AS n, round((SELECT count(*) FROM leads) / (2 * count(*)), 6) AS weight,
    round(100.0 * count(*) / (SELECT count(*) FROM leads), 6) AS pct FROM leads GROUP BY y""")
def a14(spark, sf):
    return rounded(groups.class_weights(build_leads(spark, sf, ["y"])), "weight", "pct")


@query("a14_class_weights_labels", sql="""
  SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / (2 * count(*)), 6) AS weight,
    round(100.0 * count(*) / (SELECT count(*) FROM labels), 6) AS pct FROM labels GROUP BY quality""")
def a14_labels(spark, sf):
    return rounded(groups.class_weights(table(spark, sf, "labels"), "quality"), "weight", "pct")


@query("a15_mean_cost", lead_sql="""
  SELECT (duration > 180)::INTEGER AS duration_class, round(avg(duration), 6) AS mean_duration, count(*) AS n
  FROM leads GROUP BY ALL""")
def a15(spark, sf):
    leads = build_leads(spark, sf, ["duration"])
    out = leads.groupBy(fx.duration_class().alias("duration_class")).agg(
        F.avg("duration").alias("mean_duration"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "mean_duration")


@query("a16_median_split", lead_sql="""
  SELECT 'duration' AS "column", median(duration)::DOUBLE AS median FROM leads""")
def a16(spark, sf):
    return groups.median_split(build_leads(spark, sf, ["duration"]), "duration")


@query("a17_class_shares", lead_sql="""
  SELECT contact, y, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY contact), 6) AS pct
  FROM leads GROUP BY contact, y""")
def a17(spark, sf):
    return rounded(groups.class_shares(build_leads(spark, sf, ["contact", "y"]), "contact"), "pct")


# joins

@query("j01_attach_predictions", lead_sql="""
  SELECT lead_id, duration, y, score AS prob_success FROM leads""")
def j01(spark, sf):
    predictions = build_leads(spark, sf, ["score"]).withColumnRenamed("score", "prob_success")
    return build_leads(spark, sf, ["duration", "y"]).join(predictions, "lead_id")


@query("j02_align_scores", lead_sql=each(
    CORR, """SELECT '{c}' AS feature, round(corr({q}, y), 6) AS r, round(abs(corr({q}, y)), 6) AS abs_r,
      count(DISTINCT {q}) AS "unique" FROM leads"""))
def j02(spark, sf):
    leads = build_leads(spark, sf, [*CORR, "y"])
    counts = profile.distinct_counts(leads, CORR).withColumnRenamed("column", "feature")
    return rounded(groups.target_correlations(leads, CORR).join(counts, "feature"), "r", "abs_r")


EDUCATION = list(EDUCATION_LEVELS)


@query("j03_dictionary_lookup", lead_sql=f"""
  SELECT lead_id, education, pos AS level FROM leads
  LEFT JOIN (VALUES {ordered_values(EDUCATION)}) d(level_name, pos) ON education = level_name""")
def j03(spark, sf):
    lookup = spark.createDataFrame([(v, i) for i, v in enumerate(EDUCATION)], "education string, level int")
    return build_leads(spark, sf, ["education"]).join(F.broadcast(lookup), "education", "left")


@query("j04_membership_flag", lead_sql="""
  SELECT lead_id, cust_id, cust_id IN (SELECT cust_id FROM leads WHERE y = 1) AS responded FROM leads""")
def j04(spark, sf):
    leads = build_leads(spark, sf, ["cust_id", "y"])
    responders = leads.where("y = 1")
    return groups.mark_selected(leads.select("lead_id", "cust_id"), responders, "cust_id", "responded")


@query("j05_feature_pairs", lead_sql=" UNION ALL ".join(
    f"SELECT '{min(a, b)}' AS f1, '{max(a, b)}' AS f2, round(corr({a}, {b}), 6) AS r FROM leads"
    for a, b in combinations(CORR, 2)))
def j05(spark, sf):
    matrix = groups.correlations(build_leads(spark, sf, CORR), CORR)
    return rounded(matrix.where("f1 < f2"), "r")


# sorts and top-k

@query("t01_sorted_table", lead_sql=METRICS_CTE + """
  SELECT model, strategy, metric, round(avg(value), 6) AS mean FROM metrics GROUP BY ALL ORDER BY mean DESC""")
def t01(spark, sf):
    summary = groups.fold_summary(segment_metrics(spark, sf)).select("model", "strategy", "metric", "mean")
    return rounded(summary.orderBy(F.desc("mean"), "model", "strategy", "metric"), "mean")


@query("t02_top_leads", lead_sql="SELECT lead_id, score FROM leads ORDER BY score DESC, lead_id LIMIT 15")
def t02(spark, sf):
    return build_leads(spark, sf, ["score"]).orderBy(F.desc("score"), "lead_id").limit(15)


@query("t02_top_events", sql="SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def t02_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@query("t03_above_thresholds", lead_sql="""
  SELECT t AS threshold, count(*) AS n, sum(y)::BIGINT AS positives
  FROM leads, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(t) WHERE score >= t GROUP BY t""")
def t03(spark, sf):
    kept = groups.at_or_above(build_leads(spark, sf, ["score", "y"]), "score", [0.2, 0.4, 0.6, 0.8])
    return kept.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


# sets

@query("u01_append_results", lead_sql="""
  SELECT 'contact' AS run, contact AS level, count(*) AS n, sum(y)::BIGINT AS positives FROM leads GROUP BY ALL
  UNION ALL SELECT 'loan', loan, count(*), sum(y)::BIGINT FROM leads GROUP BY ALL""")
def u01(spark, sf):
    leads = build_leads(spark, sf, ["contact", "loan", "y"])
    runs = [leads.groupBy(F.lit(c).alias("run"), F.col(c).alias("level"))
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")) for c in ("contact", "loan")]
    return runs[0].unionByName(runs[1])


@query("u02_consensus_votes", lead_sql=", r AS (" + each(
    CORR, "SELECT '{c}' AS feature, abs(corr({q}, y)) AS r, count(DISTINCT {q}) AS u, stddev_samp({q}) AS s FROM leads")
    + """), picked AS (
    (SELECT feature, 'corr' AS s FROM r ORDER BY r DESC, feature LIMIT 3)
    UNION ALL (SELECT feature, 'levels' FROM r ORDER BY u DESC, feature LIMIT 3)
    UNION ALL (SELECT feature, 'spread' FROM r ORDER BY s DESC, feature LIMIT 3))
  SELECT feature, max((s = 'corr')::INTEGER) AS by_corr, max((s = 'levels')::INTEGER) AS by_levels,
    max((s = 'spread')::INTEGER) AS by_spread, count(*) AS votes FROM picked GROUP BY feature""")
def u02(spark, sf):
    leads = build_leads(spark, sf, [*CORR, "y"])
    top = lambda df, by: df.orderBy(F.desc(by), "feature").limit(3)
    levels = profile.distinct_counts(leads, CORR).withColumnRenamed("column", "feature")
    spread = leads.agg(*[F.stddev_samp(c).alias(c) for c in CORR]).unpivot([], CORR, "feature", "spread")
    return groups.votes({"corr": top(groups.target_correlations(leads, CORR), "abs_r"),
                         "levels": top(levels, "unique"), "spread": top(spread, "spread")})
