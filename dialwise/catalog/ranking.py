"""Registered ranking, metric, schedule and sampling queries."""

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.catalog.groups import METRICS_CTE, segment_metrics
from dialwise.catalog.profile import rounded
from dialwise.functions import features as fx
from dialwise.operators import groups, metrics, ranking, sampling, schedule
from dialwise.operators.joins import few
from dialwise.operators.ordering import running
from dialwise.scale import materialise
from dialwise.sources.leads import build_leads
from dialwise.sources.tables import table

RANKED = """, ranked AS (
  SELECT *, row_number() OVER w AS rank, sum(y) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_positives,
    count(*) OVER () AS n, sum(y) OVER () AS positives FROM leads WINDOW w AS (ORDER BY score DESC, lead_id))
"""
SCORED = ["score", "y"]


@query("w01_rank", lead_sql=RANKED + "SELECT lead_id, score, rank FROM ranked")
def w01(spark, sf):
    return ranking.ranked(build_leads(spark, sf, SCORED), "score", "y", "lead_id").select("lead_id", "score", "rank")


@query("w01_rank_events", sql="""
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
  FROM events""")
def w01_events(spark, sf):
    events = table(spark, sf, "events").select("event_type", "event_id", "value")
    return running(events, -F.col("value"), "event_id", ["event_type"]).drop("value")


@query("w02_cumulative", lead_sql=RANKED + """
  SELECT lead_id, rank, cum_positives, round(rank / n, 9) AS population_share FROM ranked""")
def w02(spark, sf):
    rows = ranking.lift_rows(build_leads(spark, sf, SCORED), "score", "y", "lead_id")
    return rounded(rows.select("lead_id", "rank", "cum_positives", "population_share"), "population_share", digits=9)


@query("w03_row_lift", lead_sql=RANKED + """
  SELECT lead_id, round((cum_positives / positives) / (rank / n), 9) AS lift FROM ranked""")
def w03(spark, sf):
    rows = ranking.lift_rows(build_leads(spark, sf, SCORED), "score", "y", "lead_id")
    return rounded(rows.select("lead_id", "lift"), "lift", digits=9)


CURVE = RANKED + """, curve AS (
  SELECT pct::INTEGER AS pct, rank AS contacted, cum_positives AS captured,
    (cum_positives / rank) / (positives / n) AS lift, 100.0 * cum_positives / positives AS gain
  FROM ranked JOIN range(1, 101) g(pct) ON rank = n * pct // 100)
"""


@query("w04_lift_curve", lead_sql=CURVE + """
  SELECT pct, contacted, captured, round(lift, 9) AS lift, round(gain, 9) AS gain FROM curve""")
def w04(spark, sf):
    return rounded(ranking.lift_curve(build_leads(spark, sf, SCORED), "score", "y", "lead_id"),
                   "lift", "gain", digits=9)


@query("w05_reference_curves", lead_sql="""
  , s AS (SELECT round(100.0 * avg(y), 9) AS s FROM leads)
  SELECT 'perfect' AS curve, 0::DOUBLE AS population_pct, 0::DOUBLE AS gain
  UNION ALL SELECT 'perfect', s, 100 FROM s UNION ALL SELECT 'perfect', 100, 100
  UNION ALL SELECT 'random', 0, 0 UNION ALL SELECT 'random', 100, 100""")
def w05(spark, sf):
    return rounded(ranking.reference_curves(build_leads(spark, sf, ["y"]), "y"), "population_pct", digits=9)


STEPS = """, steps AS (
  SELECT score AS threshold, sum(y)::BIGINT AS pos, count(*) - sum(y)::BIGINT AS neg FROM leads GROUP BY score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM steps WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
"""


@query("w06_roc_points", lead_sql=STEPS + """
  SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM cum
  UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""")
def w06(spark, sf):
    return rounded(ranking.roc_points(build_leads(spark, sf, SCORED), "score", "y"), "fpr", "tpr", digits=9)


@query("w06_roc_points_thinned", lead_sql=STEPS + """
  , nxt AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM cum WINDOW w AS (ORDER BY threshold DESC))
  SELECT threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM nxt
  WHERE np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0""")
def w06_thin(spark, sf):
    return rounded(ranking.roc_points(build_leads(spark, sf, SCORED), "score", "y", drop_collinear=True),
                   "fpr", "tpr", digits=9)


@query("w07_pr_points", lead_sql=STEPS + """
  SELECT threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM cum
  UNION ALL SELECT NULL, 1, 0""")
def w07(spark, sf):
    return rounded(ranking.pr_points(build_leads(spark, sf, SCORED), "score", "y"), "precision", "recall", digits=9)


# schedules and budgets; keys are rounded so that both engines break ties alike

EFFICIENT = """, eff AS (
  SELECT *, round(prob_short * 101.3::DOUBLE + prob_long * 417.0::DOUBLE, 8) AS expected_duration,
    round(score / (prob_short * 101.3::DOUBLE + prob_long * 417.0::DOUBLE), 12) AS efficiency FROM leads)
"""
COSTED = ["score", "prob_short", "prob_long", "duration", "y"]


def efficient_leads(spark, sf):
    scored = schedule.score_efficiency(build_leads(spark, sf, COSTED))
    return rounded(rounded(scored, "expected_duration", digits=8), "efficiency", digits=12)


@query("w08_schedule", lead_sql=EFFICIENT + """
  SELECT lead_id, expected_duration, efficiency, row_number() OVER (ORDER BY efficiency DESC, lead_id) AS position
  FROM eff""")
def w08(spark, sf):
    out = schedule.schedule(efficient_leads(spark, sf), "lead_id")
    return out.select("lead_id", "expected_duration", "efficiency", "position")


@query("w08_schedule_per_agent", lead_sql="""
  SELECT contact, lead_id, score, row_number() OVER (PARTITION BY contact ORDER BY score DESC, lead_id) AS position
  FROM leads""")
def w08_agent(spark, sf):
    return schedule.schedule(build_leads(spark, sf, ["contact", "score"]), "lead_id", "score", ["contact"])


def spent_sql(source, order, partition=""):
    return f"""SELECT *, sum(coalesce(duration, 0)) OVER ({partition} ORDER BY {order}, lead_id
      ROWS UNBOUNDED PRECEDING)::BIGINT AS spent,
      row_number() OVER ({partition} ORDER BY {order}, lead_id) AS position FROM {source}"""


@query("w09_budget_selection", lead_sql=EFFICIENT + f"""
  SELECT lead_id, duration, y, efficiency, position, spent FROM ({spent_sql('eff', 'efficiency DESC')})
  WHERE spent <= 28800""")
def w09(spark, sf):
    leads = efficient_leads(spark, sf).select("lead_id", "duration", "y", "efficiency")
    return schedule.select_within_budget(leads, -F.col("efficiency"), "lead_id")


@query("w09_budget_by_probability", lead_sql=f"""
  SELECT count(*) AS calls, sum(y)::BIGINT AS sales, max(spent) AS seconds
  FROM ({spent_sql('leads', 'score DESC')}) WHERE spent <= 28800""")
def w09_probability(spark, sf):
    leads = build_leads(spark, sf, ["score", "duration", "y"])
    return schedule.outcome(schedule.select_within_budget(leads, -F.col("score"), "lead_id"))


@query("w09_budget_per_agent", lead_sql=f"""
  SELECT job, count(*) AS calls, sum(y)::BIGINT AS sales, max(spent) AS seconds
  FROM ({spent_sql('leads', 'score DESC', 'PARTITION BY job')}) WHERE spent <= 28800 GROUP BY job""")
def w09_agents(spark, sf):
    leads = build_leads(spark, sf, ["score", "duration", "y", "job"])
    chosen = schedule.select_within_budget(leads, -F.col("score"), "lead_id", group=["job"])
    return schedule.outcome(chosen, group=["job"])


TRIALS = """, keyed AS (
  SELECT t AS trial, lead_id, duration, y,
    ('0x' || substr(md5((42 + t // 2) || ':' || lead_id), 1 + 15 * (t % 2)::INTEGER, 15))::BIGINT AS key
  FROM leads, range(50) r(t)),
walked AS (SELECT *, sum(duration) OVER (PARTITION BY trial ORDER BY key, lead_id ROWS UNBOUNDED PRECEDING)
  ::BIGINT AS spent FROM keyed),
trials AS (SELECT trial, count(*) AS calls, sum(y)::BIGINT AS sales FROM walked WHERE spent <= 28800 GROUP BY trial)
"""


@query("w10_random_baseline", lead_sql=TRIALS + """
  SELECT avg(calls) AS mean_calls, avg(sales) AS mean_sales FROM trials""")
def w10(spark, sf):
    return schedule.random_order_baseline(build_leads(spark, sf, ["duration", "y"]), "lead_id")


VARIANTS = METRICS_CTE + """, v AS (
  SELECT strategy, fold, avg(value) AS value FROM metrics WHERE metric = 'accuracy' GROUP BY ALL),
pairs AS (SELECT fold, max(value) FILTER (strategy = 'cellular') AS a, max(value) FILTER (strategy = 'telephone') AS b
  FROM v GROUP BY fold)
"""


def variant_folds(spark, sf):
    return (segment_metrics(spark, sf).where("metric = 'accuracy'").groupBy("strategy", "fold")
            .agg(F.avg("value").alias("value")))


@query("w11_paired_differences", lead_sql=VARIANTS + """
  SELECT fold, round(a, 9) AS a, round(b, 9) AS b, round(b - a, 9) AS diff, (b > a)::INTEGER AS b_wins FROM pairs""")
def w11(spark, sf):
    return rounded(schedule.paired_differences(variant_folds(spark, sf), "cellular", "telephone", "strategy"),
                   "a", "b", "diff", digits=9)


@query("w11_win_count", lead_sql=VARIANTS + """
  SELECT round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(b - a), 9) AS mean_diff,
    count(*) FILTER (b > a) AS wins, count(*) AS folds FROM pairs""")
def w11_wins(spark, sf):
    pairs = schedule.paired_differences(variant_folds(spark, sf), "cellular", "telephone", "strategy")
    return rounded(schedule.win_count(pairs), "mean_a", "mean_b", "mean_diff", digits=9)


# accuracy sweep over the stand-in scores

LEVELS = [0.58, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00]

# the stand-in duration probabilities are pulled towards a coin flip so that real accuracy is near 0.6
BLEND_LEADS = """, weak AS (
  SELECT lead_id, score, duration, y, CASE WHEN duration <= 180 THEN 0 ELSE 1 END AS duration_class,
    CASE WHEN h2 % 5 < 3 THEN prob_short ELSE 1 - prob_short END AS prob_short,
    CASE WHEN h2 % 5 < 3 THEN prob_long ELSE 1 - prob_long END AS prob_long FROM leads),
real AS (SELECT avg(CASE WHEN (prob_long > prob_short)::INTEGER = duration_class THEN 1 ELSE 0 END) AS acc FROM weak),
levels AS (SELECT unnest([0.58, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00]::DOUBLE[]) AS level),
rates AS (SELECT level, CASE WHEN level <= acc THEN 0
  ELSE greatest(0::DOUBLE, least(1::DOUBLE, (level - acc) / (1 - acc))) END AS rate FROM levels, real),
drawn AS (SELECT *, ('0x' || substr(md5('42:' || lead_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE < rate AS swap
  FROM weak, rates),
blended AS (SELECT level, lead_id, score, duration, y, duration_class,
    CASE WHEN swap THEN 1 - duration_class ELSE prob_short END AS prob_short,
    CASE WHEN swap THEN duration_class ELSE prob_long END AS prob_long FROM drawn)
"""


def weak_leads(spark, sf):
    leads = build_leads(spark, sf, ["score", "duration", "y", "prob_short", "prob_long", "h2"])
    honest = F.col("h2") % 5 < 3
    return leads.withColumn("duration_class", fx.duration_class()).withColumns({
        c: F.when(honest, F.col(c)).otherwise(1 - F.col(c)) for c in ("prob_short", "prob_long")}).drop("h2")


@query("r06_blend_to_accuracy", lead_sql=BLEND_LEADS + """
  SELECT lead_id, prob_short, prob_long FROM blended WHERE level = 0.75::DOUBLE""")
def r06(spark, sf):
    blended = sampling.blend_to_accuracy(weak_leads(spark, sf), "duration_class", 0.75, "lead_id")
    return blended.select("lead_id", "prob_short", "prob_long")


SWEEP = BLEND_LEADS + """, eff AS (SELECT *, round(score / (prob_short * 101.3::DOUBLE + prob_long * 417.0::DOUBLE), 12)
    AS efficiency FROM blended),
effwalk AS (SELECT *, sum(duration) OVER (PARTITION BY level ORDER BY efficiency DESC, lead_id
  ROWS UNBOUNDED PRECEDING) AS spent FROM eff),
probwalk AS (SELECT *, sum(duration) OVER (ORDER BY score DESC, lead_id ROWS UNBOUNDED PRECEDING) AS spent FROM weak),
standard AS (SELECT count(*) AS probability_calls, sum(y)::BIGINT AS probability_sales FROM probwalk WHERE spent <= 28800),
acc AS (SELECT level, round(avg(CASE WHEN (prob_long > prob_short)::INTEGER = duration_class THEN 1 ELSE 0 END), 9)
  AS actual_accuracy FROM blended GROUP BY level),
sweep AS (SELECT level, actual_accuracy, count(*) AS efficiency_calls, sum(y)::BIGINT AS efficiency_sales,
    probability_calls, probability_sales
  FROM effwalk JOIN acc USING (level), standard WHERE spent <= 28800 GROUP BY ALL)
"""


def accuracy_sweep(spark, sf):
    """Efficiency order at each accuracy level against the probability order."""
    weak = weak_leads(spark, sf)
    steps = F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level")
    blended = sampling.blend_to_accuracy(weak.select("*", steps), "duration_class", "level", "lead_id")
    scored = rounded(schedule.score_efficiency(blended), "efficiency", digits=12)
    right = (fx.predicted_class("prob_short", "prob_long") == F.col("duration_class")).cast("int")
    accuracy = blended.groupBy("level").agg(F.round(F.avg(right), 9).alias("actual_accuracy"))
    walked = schedule.select_within_budget(
        scored.select("level", "lead_id", "duration", "y", "efficiency"), -F.col("efficiency"), "lead_id",
        group=["level"])
    made = schedule.outcome(walked, group=["level"]).select(
        "level", F.col("calls").alias("efficiency_calls"), F.col("sales").alias("efficiency_sales"))
    base = schedule.outcome(schedule.select_within_budget(weak, -F.col("score"), "lead_id"))
    one = base.select(F.struct(F.col("calls").alias("probability_calls"),
                               F.col("sales").alias("probability_sales"))).scalar()
    out = accuracy.join(made, "level").withColumn("__b", one)
    return out.select("level", "actual_accuracy", "efficiency_calls", "efficiency_sales", "__b.*")


@query("l21_accuracy_sweep_given_scores", lead_sql=SWEEP + """
  SELECT *, efficiency_sales - probability_sales AS sales_diff, efficiency_calls - probability_calls AS calls_diff,
    efficiency_sales > probability_sales AS efficiency_wins FROM sweep""")
def l21_given(spark, sf):
    return accuracy_sweep(spark, sf).withColumns({
        "sales_diff": F.col("efficiency_sales") - F.col("probability_sales"),
        "calls_diff": F.col("efficiency_calls") - F.col("probability_calls"),
        "efficiency_wins": F.col("efficiency_sales") > F.col("probability_sales")})


@query("w12_first_crossing", lead_sql=SWEEP + """
  SELECT min(level) FILTER (efficiency_sales > probability_sales) AS crossing,
    round((min(level) FILTER (efficiency_sales > probability_sales) - 0.58::DOUBLE) * 100, 9) AS gap_points FROM sweep""")
def w12(spark, sf):
    return rounded(schedule.first_crossing(accuracy_sweep(spark, sf), "level", "efficiency_sales",
                                           "probability_sales", current=0.58), "gap_points", digits=9)


# folds and splits

@query("r01_stratified_folds", lead_sql="""
  SELECT lead_id, y, ((row_number() OVER (PARTITION BY y ORDER BY
    ('0x' || substr(md5('42:' || lead_id), 1, 13))::BIGINT, lead_id) - 1) % 5)::INTEGER AS fold FROM leads""")
def r01(spark, sf):
    return sampling.stratified_folds(build_leads(spark, sf, ["y"]), "y", "lead_id", 5)


@query("r01_stratified_folds_labels", sql="""
  SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY
    ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT, doc_id) - 1) % 3)::INTEGER AS fold FROM labels""")
def r01_labels(spark, sf):
    docs = table(spark, sf, "labels").select("doc_id", "quality")
    return sampling.stratified_folds(docs, "quality", "doc_id", 3)


@query("r02_stratified_split", lead_sql="""
  SELECT lead_id, y, (row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('42:' || lead_id), 1, 13))::BIGINT,
    lead_id) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY y)))::INTEGER AS is_test FROM leads""")
def r02(spark, sf):
    return sampling.stratified_split(build_leads(spark, sf, ["y"]), "y", "lead_id", 0.2)


@query("r03_seeded_shuffle", lead_sql="""
  SELECT lead_id, y, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || lead_id), 1, 13))::BIGINT, lead_id) AS position
  FROM leads""")
def r03(spark, sf):
    # ids rise with the partition and within it, so the gaps of their ranks show the order that came out
    shuffled = sampling.seeded_shuffle(build_leads(spark, sf, ["y"]), "lead_id")
    placed = materialise(shuffled.withColumn("__at", F.monotonically_increasing_id()))
    return running(placed, "__at", "lead_id", rank="position").select("lead_id", "y", "position")


@query("r05_class_weight_column", lead_sql="""
  SELECT lead_id, y, round((SELECT count(*) FROM leads) / (2 * count(*) OVER (PARTITION BY y)), 9) AS weight FROM leads""")
def r05(spark, sf):
    leads = build_leads(spark, sf, ["y"])
    weighted = leads.join(few(groups.class_weights(leads).select("y", "weight")), "y")
    return rounded(weighted, "weight", digits=9)


# metrics

PRED = ", p AS (SELECT *, (score >= 0.45::DOUBLE)::INTEGER AS pred FROM leads)"
COUNTS = PRED + """, c AS (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM p)"""


def predicted(spark, sf, *more):
    leads = build_leads(spark, sf, ["score", "y", *more])
    return leads.withColumn("pred", fx.flag(F.col("score") >= 0.45))


def counts(spark, sf):
    return metrics.confusion(predicted(spark, sf), "pred", "y")


@query("m01_confusion_matrix", lead_sql=PRED + """
  SELECT y, count(*) FILTER (pred = 0) AS predicted_0, count(*) FILTER (pred = 1) AS predicted_1,
    round(100.0 * count(*) FILTER (pred = 0) / count(*), 6) AS pct_0,
    round(100.0 * count(*) FILTER (pred = 1) / count(*), 6) AS pct_1 FROM p GROUP BY y""")
def m01(spark, sf):
    return rounded(metrics.confusion_matrix(predicted(spark, sf), "pred", "y"), "pct_0", "pct_1")


@query("m01_confusion_labels", sql="""
  SELECT count(*) FILTER (toxic = 0 AND quality = 0) AS tn, count(*) FILTER (toxic = 0 AND quality = 1) AS fp,
    count(*) FILTER (toxic = 1 AND quality = 0) AS fn, count(*) FILTER (toxic = 1 AND quality = 1) AS tp FROM labels""")
def m01_labels(spark, sf):
    return metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("m02_accuracy_precision_recall", lead_sql=COUNTS + """
  SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def m02(spark, sf):
    cols = ["accuracy", "precision", "recall", "f1"]
    return rounded(metrics.rates(counts(spark, sf)).select(*cols), *cols)


@query("m03_error_rates", lead_sql=COUNTS + """
  SELECT round(fn / (fn + tp), 6) AS fnr, round(fp / (fp + tn), 6) AS fpr FROM c""")
def m03(spark, sf):
    return rounded(metrics.rates(counts(spark, sf)).select("fnr", "fpr"), "fnr", "fpr")


@query("m04_auc", lead_sql=STEPS + "SELECT round(sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)), 9) AS auc FROM cum")
def m04(spark, sf):
    return rounded(ranking.auc(build_leads(spark, sf, SCORED), "score", "y"), "auc", digits=9)


@query("m04_auc_per_job", lead_sql="""
  , s AS (SELECT job, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM leads GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER (PARTITION BY job ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM s)
  SELECT job, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM c GROUP BY job""")
def m04_job(spark, sf):
    return rounded(ranking.auc(build_leads(spark, sf, ["job", *SCORED]), "score", "y", ["job"]), "auc", digits=9)


@query("m05_average_precision", lead_sql=STEPS + """
  SELECT round(sum(pos * tp / (tp + fp)) / any_value(p), 9) AS average_precision FROM cum""")
def m05(spark, sf):
    return rounded(ranking.average_precision(build_leads(spark, sf, SCORED), "score", "y"),
                   "average_precision", digits=9)


@query("m06_log_loss", lead_sql="""
  SELECT round(-avg(ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN y = 1 THEN score ELSE 1 - score END)))), 9)
    AS log_loss FROM leads""")
def m06(spark, sf):
    return rounded(metrics.log_loss(build_leads(spark, sf, SCORED), "score", "y"), "log_loss", digits=9)


@query("m07_class_report", lead_sql=COUNTS + """, r AS (SELECT *, tn + fp AS n0, tp + fn AS n1, tn + fp + tp + fn AS n,
    tn / (tn + fn) AS p0, tp / (tp + fp) AS p1, tn / (tn + fp) AS r0, tp / (tp + fn) AS r1,
    2 * tn / (2 * tn + fn + fp) AS f0, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c)
  SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0 AS support FROM r
  UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM r
  UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), n FROM r
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM r
  UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / n, 6), round((r0 * n0 + r1 * n1) / n, 6),
    round((f0 * n0 + f1 * n1) / n, 6), n FROM r""")
def m07(spark, sf):
    return rounded(metrics.class_report(counts(spark, sf)), "precision", "recall", "f1")


@query("m08_alift_mean", lead_sql=RANKED + """
  SELECT round(avg((cum_positives / positives) / (rank / n)), 9) AS alift_mean FROM ranked""")
def m08(spark, sf):
    return rounded(ranking.alift_mean(build_leads(spark, sf, SCORED), "score", "y", "lead_id"), "alift_mean", digits=9)


@query("m09_alift_area", lead_sql=CURVE + """
  , t AS (SELECT pct, lift, lag(pct) OVER w AS pp, lag(lift) OVER w AS pl FROM curve WINDOW w AS (ORDER BY pct))
  SELECT round(sum((pct - pp) * (lift + pl - 2) / 2) / 100, 9) AS alift_area FROM t WHERE pp IS NOT NULL""")
def m09(spark, sf):
    return rounded(ranking.alift_area(build_leads(spark, sf, SCORED), "score", "y", "lead_id"), "alift_area", digits=9)


@query("m10_extra_contacts", lead_sql=COUNTS + "SELECT round(fp / tp, 6) AS extra_per_success FROM c")
def m10(spark, sf):
    return rounded(metrics.contact_cost(counts(spark, sf)).select("extra_per_success"), "extra_per_success")


@query("m11_overfit_gap", lead_sql=METRICS_CTE + """
  , g AS (SELECT model, avg(value) FILTER (fold <> 0) AS train, avg(value) FILTER (fold = 0) AS validation
    FROM metrics WHERE metric = 'accuracy' GROUP BY model)
  SELECT model, round(train, 9) AS train, round(validation, 9) AS validation, round(train - validation, 9) AS gap FROM g""")
def m11(spark, sf):
    accuracy = segment_metrics(spark, sf).where("metric = 'accuracy'")
    parts = accuracy.groupBy("model").agg(F.avg(F.when(F.col("fold") != 0, F.col("value"))).alias("train"),
                                          F.avg(F.when(F.col("fold") == 0, F.col("value"))).alias("validation"))
    return rounded(metrics.overfit_gap(parts), "train", "validation", "gap", digits=9)


@query("m12_strategy_comparison", lead_sql=EFFICIENT + TRIALS + f""", r AS (
  SELECT 'efficiency' AS strategy, count(*)::DOUBLE AS calls, sum(y)::DOUBLE AS sales
    FROM ({spent_sql('eff', 'efficiency DESC')}) WHERE spent <= 28800
  UNION ALL SELECT 'probability', count(*)::DOUBLE, sum(y)::DOUBLE FROM ({spent_sql('eff', 'score DESC')}) WHERE spent <= 28800
  UNION ALL SELECT 'random', avg(calls), avg(sales) FROM trials),
  b AS (SELECT calls AS bc, sales AS bs FROM r WHERE strategy = 'probability')
  SELECT strategy, calls, sales, round(calls - bc, 6) AS calls_diff, round(sales - bs, 6) AS sales_diff,
    round((sales - bs) / bs * 100, 6) AS sales_pct FROM r, b""")
def m12(spark, sf):
    leads = efficient_leads(spark, sf)
    made = {"efficiency": -F.col("efficiency"), "probability": -F.col("score")}
    runs = [schedule.outcome(schedule.select_within_budget(leads, order, "lead_id"))
            .select(F.lit(name).alias("strategy"), F.col("calls").cast("double"), F.col("sales").cast("double"))
            for name, order in made.items()]
    randomly = schedule.random_order_baseline(build_leads(spark, sf, ["duration", "y"]), "lead_id")
    runs.append(randomly.select(F.lit("random").alias("strategy"), F.col("mean_calls").alias("calls"),
                                F.col("mean_sales").alias("sales")))
    # three rows, read three times
    table_ = schedule.compare_strategies(materialise(runs[0].unionByName(runs[1]).unionByName(runs[2])), "probability")
    return rounded(table_, "calls_diff", "sales_diff", "sales_pct")


@query("m13_captured_missed", lead_sql=PRED + """
  SELECT job, count(*) FILTER (y = 1 AND pred = 1) AS captured, count(*) FILTER (y = 1 AND pred = 0) AS missed,
    count(*) FILTER (y = 1) AS positives,
    round(100.0 * count(*) FILTER (y = 1 AND pred = 1) / count(*) FILTER (y = 1), 6) AS captured_pct FROM p GROUP BY job""")
def m13(spark, sf):
    per_job = metrics.confusion(predicted(spark, sf, "job"), "pred", "y", ["job"])
    out = metrics.contact_cost(per_job).select("job", "captured", "missed", "positives", "captured_pct")
    return rounded(out, "captured_pct")
