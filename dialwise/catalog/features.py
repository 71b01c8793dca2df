"""Registered projection, filter and scalar-expression queries."""

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.catalog.profile import rounded
from dialwise.functions import features as fx
from dialwise.sources.leads import COLUMNS, FEATURES, build_leads


@query("f00_leads", lead_sql="SELECT * FROM leads")
def f00(spark, sf):
    return build_leads(spark, sf)


@query("f01_drop_leakage", lead_sql="SELECT lead_id, " + ", ".join(f'"{c}"' for c in FEATURES) + " FROM leads")
def f01(spark, sf):
    return build_leads(spark, sf).drop(*[c for c in COLUMNS if c not in FEATURES and c != "lead_id"])


@query("f02_filter", lead_sql="""
  SELECT lead_id, duration, campaign FROM leads WHERE duration >= 120 AND campaign <> 1 AND age < 60 AND pdays = 999""")
def f02(spark, sf):
    leads = build_leads(spark, sf, ["duration", "campaign", "age", "pdays"])
    kept = leads.where("duration >= 120 AND campaign <> 1 AND age < 60 AND pdays = 999")
    return kept.select("lead_id", "duration", "campaign")


def projection(name, sql, columns, **exprs):
    """Register a query that adds expressions to the lead id."""
    @query(name, lead_sql=f"SELECT lead_id, {sql} FROM leads")
    def run(spark, sf):
        leads = build_leads(spark, sf, columns)
        return leads.select("lead_id", *[make().alias(out) for out, make in exprs.items()])
    return run


projection("f03_recode", "CASE housing WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END::INTEGER AS housing_code",
           ["housing"], housing_code=lambda: fx.yes_no("housing"))
projection("f04_flag", "(contact = 'cellular')::INTEGER AS is_cellular", ["contact"],
           is_cellular=lambda: fx.flag(F.col("contact") == "cellular"))
projection("f05_age_campaign", "age * campaign AS age_campaign", ["age", "campaign"],
           age_campaign=fx.age_campaign)
projection("f06_is_first_contact", "(pdays = 999)::INTEGER AS is_first_contact", ["pdays"],
           is_first_contact=fx.is_first_contact)
projection("f07_contact_intensity", "campaign::DOUBLE / (pdays + 1) AS contact_intensity",
           ["campaign", "pdays"], contact_intensity=fx.contact_intensity)
projection("f08_financial_stress",
           "(housing = 'yes')::INTEGER + (loan = 'yes')::INTEGER + (\"default\" = 'yes')::INTEGER AS financial_stress",
           ["housing", "loan", "default"], financial_stress=fx.financial_stress)
projection("f09_previous_success", "(poutcome = 'success')::INTEGER AS previous_success", ["poutcome"],
           previous_success=fx.previous_success)
projection("f10_duration_class", "CASE WHEN duration <= 180 THEN 0 ELSE 1 END AS duration_class",
           ["duration"], duration_class=fx.duration_class)
projection("f11_replace_sentinel", "CASE WHEN pdays = 999 THEN -1 ELSE pdays END AS pdays", ["pdays"],
           pdays=lambda: fx.replace_value("pdays", 999, -1))
projection("f12_fill_null", "coalesce(nullif(pdays, 999), -1) AS pdays", ["pdays"],
           pdays=lambda: fx.fill_null(F.expr("nullif(pdays, 999)"), -1))
projection("f14_clip", "greatest(0.2::DOUBLE, least(0.6::DOUBLE, score)) AS clipped", ["score"],
           clipped=lambda: fx.clip("score", 0.2, 0.6))
projection("f15_indicator_pair",
           "CASE WHEN duration <= 180 THEN 1.0 ELSE 0.0 END::DOUBLE AS prob_short, "
           "CASE WHEN duration <= 180 THEN 0.0 ELSE 1.0 END::DOUBLE AS prob_long", ["duration"],
           prob_short=lambda: fx.indicator_pair(fx.duration_class())[0],
           prob_long=lambda: fx.indicator_pair(fx.duration_class())[1])
projection("f16_predicted_class", "(prob_long > prob_short)::INTEGER AS predicted", ["prob_short", "prob_long"],
           predicted=lambda: fx.predicted_class("prob_short", "prob_long"))


@query("f13_min_max", lead_sql="""
  SELECT lead_id, round((duration - (SELECT min(duration) FROM leads)) /
    ((SELECT max(duration) FROM leads) - (SELECT min(duration) FROM leads))::DOUBLE, 9) AS scaled FROM leads""")
def f13(spark, sf):
    scaled = fx.min_max(build_leads(spark, sf, ["duration"]), "duration", "scaled")
    return rounded(scaled.select("lead_id", "scaled"), "scaled", digits=9)


@query("f17_split_configuration", lead_sql="""
  , c AS (SELECT CASE WHEN poutcome = 'nonexistent' THEN job
                      ELSE job || ' (x) (' || poutcome || ')' END AS configuration FROM leads)
  SELECT configuration, CASE WHEN configuration LIKE '%)'
      THEN regexp_extract(configuration, '^(.*) \\((.*)\\)$', 1) ELSE configuration END AS model,
    CASE WHEN configuration LIKE '%)' THEN regexp_extract(configuration, '^(.*) \\((.*)\\)$', 2)
      ELSE 'Unknown' END AS strategy, count(*) AS n FROM c GROUP BY ALL""")
def f17(spark, sf):
    joined = F.concat("job", F.lit(" (x) ("), "poutcome", F.lit(")"))
    name = F.when(F.col("poutcome") == "nonexistent", F.col("job")).otherwise(joined)
    leads = build_leads(spark, sf, ["job", "poutcome"]).select(name.alias("configuration"))
    counted = leads.groupBy("configuration").agg(F.count(F.lit(1)).alias("n"))
    model, strategy = fx.split_configuration("configuration")
    return counted.withColumns({"model": model, "strategy": strategy})


@query("f18_mean_std_text", lead_sql="""
  SELECT job, printf('%.4f ± %.4f', round(avg(duration), 8), round(stddev_pop(duration), 8)) AS text
  FROM leads GROUP BY job""")
def f18(spark, sf):
    grouped = build_leads(spark, sf, ["job", "duration"]).groupBy("job").agg(
        F.round(F.avg("duration"), 8).alias("m"), F.round(F.stddev_pop("duration"), 8).alias("s"))
    return grouped.select("job", fx.mean_std_text("m", "s").alias("text"))


JOB_RATES = """, r AS (SELECT job, round(avg(y), 6) AS rate, round((SELECT avg(y) FROM leads), 6) AS base
  FROM leads GROUP BY job), d AS (SELECT *, round(rate - base, 6) AS diff FROM r)"""


def job_differences(spark, sf):
    leads = build_leads(spark, sf, ["job", "y"])
    base = F.round(leads.agg(F.avg("y")).scalar(), 6)
    rates = leads.groupBy("job").agg(F.round(F.avg("y"), 6).alias("rate")).withColumn("base", base)
    return rates.withColumn("diff", F.round(fx.difference("rate", "base"), 6))


@query("f19_verdicts", lead_sql=JOB_RATES + """
  SELECT job, diff,
    CASE WHEN abs(diff) < 0.001 THEN 'NEGLIGIBLE' WHEN diff > 0.003 THEN 'STRONG POSITIVE'
         WHEN diff > 0 THEN 'WEAK POSITIVE' WHEN diff < -0.003 THEN 'STRONG NEGATIVE' ELSE 'WEAK NEGATIVE' END AS five_way,
    CASE WHEN diff > 0.003 THEN 'SIGNIFICANTLY BETTER' WHEN diff > 0 THEN 'SLIGHTLY BETTER'
         WHEN diff > -0.003 THEN 'EQUIVALENT' ELSE 'WORSE' END AS version,
    CASE WHEN abs(diff) < 0.001 THEN 'NEGLIGIBLE' WHEN diff > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS impact,
    CASE WHEN diff > 0.001 THEN 'HELPS' WHEN diff < -0.001 THEN 'HURTS' ELSE 'NEGLIGIBLE' END AS addon FROM d""")
def f19(spark, sf):
    return job_differences(spark, sf).select(
        "job", "diff", fx.five_way_verdict("diff").alias("five_way"), fx.version_verdict("diff").alias("version"),
        fx.impact_verdict("diff").alias("impact"), fx.addon_verdict("diff").alias("addon"))


@query("f20_differences", lead_sql=JOB_RATES + """
  SELECT job, diff, round((rate - base) / nullif(base, 0) * 100, 6) AS pct_diff FROM d""")
def f20(spark, sf):
    out = job_differences(spark, sf).withColumn("pct_diff", fx.pct_difference("rate", "base"))
    return rounded(out.select("job", "diff", "pct_diff"), "pct_diff")


@query("f21_gap_class", lead_sql="""
  , g AS (SELECT job, round(max(score) - avg(score) - 0.5, 6) AS gap FROM leads GROUP BY job)
  SELECT job, gap, CASE WHEN gap < 0.05 THEN 'green' WHEN gap < 0.1 THEN 'orange' ELSE 'red' END AS light FROM g""")
def f21(spark, sf):
    gaps = build_leads(spark, sf, ["job", "score"]).groupBy("job").agg(
        F.round(F.max("score") - F.avg("score") - 0.5, 6).alias("gap"))
    return gaps.withColumn("light", fx.gap_class("gap"))


@query("f22_efficiency", lead_sql="""
  SELECT lead_id, round(prob_short * 101.3::DOUBLE + prob_long * 417.0::DOUBLE, 8) AS expected_duration,
    round(score / (prob_short * 101.3::DOUBLE + prob_long * 417.0::DOUBLE), 12) AS efficiency FROM leads""")
def f22(spark, sf):
    leads = build_leads(spark, sf, ["score", "prob_short", "prob_long"])
    return leads.select("lead_id", F.round(fx.expected_duration(), 8).alias("expected_duration"),
                        F.round(fx.efficiency(), 12).alias("efficiency"))

