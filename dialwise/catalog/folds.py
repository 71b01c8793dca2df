"""Registered cross-validation of naive Bayes from fold-wise statistics, with SQL twins."""

from pyspark.sql import functions as F

from dialwise.catalog.base import query
from dialwise.catalog.models import in_batches, saved
from dialwise.catalog.profile import rounded
from dialwise.catalog.ranking import TRIALS, spent_sql
from dialwise.operators import groups
from dialwise.operators.sampling import stratified_split
from dialwise.plans import experiments as ex
from dialwise.plans import foldstats as fs
from dialwise.plans import twostage as ts
from dialwise.plans.models import GRIDS, design_matrix
from dialwise.scale import materialise
from dialwise.sources.leads import CATEGORICAL, FEATURES, NUMERIC, build_leads

SMOOTHING = GRIDS["naive_bayes"]["var_smoothing"]
#: probabilities that agree to so many digits are ties, in either engine
DIGITS = 9


def matrix(spark, sf):
    return design_matrix(build_leads(spark, sf, [*FEATURES, "y"]), style="label")


def folded(spark, sf, k):
    frame, features = matrix(spark, sf)
    return ex.folded(frame, k), features


HASHED = "('0x' || substr(md5('42:' || lead_id), 1, 13))::BIGINT, lead_id"


def scored_sql(fold, smoothing, train=False):
    """CTEs up to ``scored`` (trial, held, part, lead_id, y, prob); ``fold`` is an expression over ``coded`` rows."""
    codes = ", ".join([f'"{c}"::DOUBLE AS "{c}"' for c in NUMERIC] + [f'(dense_rank() OVER (ORDER BY "{c}") - 1)::DOUBLE AS "{c}"' for c in CATEGORICAL])
    values = ", ".join(f"({t}, {s!r}::DOUBLE)" for t, s in enumerate(smoothing))
    return f""", coded AS (SELECT lead_id, y, {codes} FROM leads),
      dealt AS (SELECT *, {fold} AS fold FROM coded),
      long AS (UNPIVOT dealt ON COLUMNS(* EXCLUDE (lead_id, y, fold)) INTO NAME f VALUE x),
      held AS (SELECT DISTINCT fold AS held FROM dealt),
      stat AS (SELECT held, f, y, avg(x) AS m, var_pop(x) AS v FROM long JOIN held ON fold <> held GROUP BY ALL),
      every AS (SELECT held, f, var_pop(x) AS v FROM long JOIN held ON fold <> held GROUP BY ALL),
      prior AS (SELECT held, ln(avg(1 - y)) - ln(avg(y)) AS p FROM dealt JOIN held ON fold <> held GROUP BY held),
      trials(trial, s) AS (VALUES {values}),
      params AS (
        SELECT trial, held, f, n.m AS m0, n.v + s * every.v AS v0, p.m AS m1, p.v + s * every.v AS v1
        FROM trials, every JOIN stat n USING (held, f) JOIN stat p USING (held, f) WHERE n.y = 0 AND p.y = 1),
      gaps AS (
        SELECT trial, held, fold, lead_id, y,
          sum(0.5 * (ln(v1) - ln(v0)) - pow(x - m0, 2) / (2 * v0) + pow(x - m1, 2) / (2 * v1)) AS g
        FROM params JOIN long USING (f) WHERE {'true' if train else 'fold = held'} GROUP BY ALL),
      scored AS (
        SELECT trial, held, CASE WHEN fold = held THEN 'held' ELSE 'train' END AS part, lead_id, y,
          round(1 / (1 + exp(least(greatest(g + p, -700), 700))), {DIGITS}) AS prob
        FROM gaps JOIN prior USING (held))"""


def folds_sql(k):
    return f"((row_number() OVER (PARTITION BY y ORDER BY {HASHED}) - 1) % {k})::INTEGER"


AUC_SQL = """, placed AS (SELECT *, rank() OVER (PARTITION BY trial, held, part ORDER BY prob)
        + (count(*) OVER (PARTITION BY trial, held, part, prob) - 1) / 2 AS r FROM scored),
      areas AS (SELECT trial, held, part, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc
        FROM placed GROUP BY ALL)"""

#: every metric of ``score_metrics`` for the scored rows of a trial and fold
METRICS_SQL = AUC_SQL + """, ranked AS (SELECT *, row_number() OVER w AS k, sum(y) OVER w AS cum, count(*) OVER g AS n, sum(y) OVER g AS p
        FROM scored WINDOW w AS (PARTITION BY held ORDER BY prob DESC, lead_id ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY held)),
      counts AS (SELECT held, count(*) FILTER (y = 0 AND prob <= 0.5::DOUBLE) AS tn, count(*) FILTER (y = 0 AND prob > 0.5::DOUBLE) AS fp,
        count(*) FILTER (y = 1 AND prob <= 0.5::DOUBLE) AS fn, count(*) FILTER (y = 1 AND prob > 0.5::DOUBLE) AS tp,
        -avg(ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, CASE WHEN y = 1 THEN prob ELSE 1 - prob END)))) AS log_loss FROM scored GROUP BY held),
      steps AS (SELECT held, sum(d) AS pos, sum(sum(d)) OVER w AS tp, sum(sum(1 - d)) OVER w AS fp, sum(sum(d)) OVER (PARTITION BY held) AS p
        FROM (SELECT held, prob, y AS d FROM scored) GROUP BY held, prob WINDOW w AS (PARTITION BY held ORDER BY prob DESC)),
      precisions AS (SELECT held, sum(pos * tp / (tp + fp)) / max(p) AS average_precision FROM steps GROUP BY held),
      lifts AS (SELECT held, avg((cum / p) / (k / n)) AS alift_mean FROM ranked GROUP BY held),
      curve AS (SELECT held, pct, (cum / k) / (p / n) AS lift FROM ranked, range(1, 101) g(pct) WHERE k = n * pct // 100),
      strips AS (SELECT held, (pct - lag(pct) OVER w) * (lift + lag(lift) OVER w - 2) / 2 AS strip FROM curve WINDOW w AS (PARTITION BY held ORDER BY pct)),
      strip_sums AS (SELECT held, sum(strip) / 100 AS alift_area FROM strips GROUP BY held),
      wide AS (SELECT held, (tp + tn) / (tn + fp + fn + tp) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
        coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
        coalesce(fn / nullif(fn + tp, 0), 0) AS fnr, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, auc, average_precision, alift_mean, alift_area, log_loss
        FROM counts JOIN areas USING (held) JOIN precisions USING (held) JOIN lifts USING (held) JOIN strip_sums USING (held)),
      metrics AS (UNPIVOT (SELECT held, COLUMNS(* EXCLUDE held)::DOUBLE FROM wide) ON COLUMNS(* EXCLUDE held) INTO NAME metric VALUE "value")"""


@query("l09_oof_scores_naive_bayes", lead_sql=scored_sql(folds_sql(5), [1e-9]) + """
  SELECT lead_id, y, held AS fold, round(prob, 6) AS prob FROM scored""")
def l09_bayes(spark, sf):
    frame, features = folded(spark, sf, 5)
    return rounded(rounded(fs.bayes_oof(frame, features), "prob", digits=DIGITS), "prob")


@query("l08_cross_validation_naive_bayes", lead_sql=scored_sql(folds_sql(10), [1e-9]) + METRICS_SQL + """
  SELECT 'naive_bayes' AS model, 'none' AS strategy, metric, round(avg("value"), 6) AS mean, round(stddev_pop("value"), 6) AS std,
    round(min("value"), 6) AS "min", round(max("value"), 6) AS "max" FROM metrics GROUP BY metric""")
def l08_bayes(spark, sf):
    frame, features = folded(spark, sf, 10)
    scored = materialise(rounded(fs.bayes_oof(frame, features), "prob", digits=DIGITS)
                         .withColumns({"model": F.lit("naive_bayes"), "strategy": F.lit("none")}))
    return rounded(groups.fold_summary(ex.score_metrics(scored, ["model", "strategy", "fold"])), "mean", "std", "min", "max")


@query("l10_grid_naive_bayes_fold_statistics", lead_sql=scored_sql(folds_sql(5), SMOOTHING, train=True) + AUC_SQL + """
  SELECT s AS var_smoothing, round(avg(auc) FILTER (part = 'held'), 6) AS cv_auc, round(avg(auc) FILTER (part = 'train'), 6) AS train_auc,
    round(avg(auc) FILTER (part = 'train') - avg(auc) FILTER (part = 'held'), 6) AS gap FROM areas JOIN trials USING (trial) GROUP BY s""")
def l10_bayes_folds(spark, sf):
    frame, features = folded(spark, sf, 5)
    return rounded(fs.bayes_grid(frame, features, SMOOTHING, digits=DIGITS), "cv_auc", "train_auc", "gap")


@query("l03_naive_bayes_holdout_metrics", lead_sql=scored_sql(
    f"(row_number() OVER (PARTITION BY y ORDER BY {HASHED}) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY y)))::INTEGER", [1e-5])
    .replace("scored AS (", "all_scored AS (") + ", scored AS (SELECT * FROM all_scored WHERE held = 1)" + METRICS_SQL + """
  SELECT 'naive_bayes' AS model, metric, round("value", 6) AS "value" FROM metrics""")
def l03_holdout(spark, sf):
    frame, features = matrix(spark, sf)
    split = materialise(stratified_split(frame, "y", "lead_id", 0.2))
    stats = fs.fold_statistics(split, features, fold="is_test")
    scored = fs.bayes_scores(split.where("is_test = 1"), stats, [1e-5], fold="is_test")
    named = materialise(rounded(scored.select("lead_id", "y", "prob", F.lit("naive_bayes").alias("model")), "prob", digits=DIGITS))
    return rounded(ex.score_metrics(named, ["model"]), "value")


# trained on every row: the one fold is held out of nothing
@query("l22_batch_scoring_naive_bayes", lead_sql=scored_sql("0", [1e-5], train=True)
       .replace("held AS (SELECT DISTINCT fold AS held FROM dealt)", "held AS (SELECT 1 AS held)") + """
  SELECT lead_id, round(prob, 6) AS prob FROM scored""")
def l22_bayes(spark, sf):
    leads = materialise(build_leads(spark, sf, [*FEATURES, "y"]))
    _, loaded = saved(spark, leads, "naive_bayes", {"var_smoothing": 1e-5}, "label")
    return rounded(rounded(in_batches(loaded, leads), "prob", digits=DIGITS), "prob")


#: shares that agree to so many digits are ties of a schedule, in either engine
SCHEDULE_DIGITS = 6


def oof_sql(name, rows, label):
    """CTEs up to ``name`` (lead_id, prob): out-of-fold naive Bayes over the features of ``rows``."""
    return f""", {name}_long AS (UNPIVOT {rows} ON COLUMNS(* EXCLUDE (lead_id, y, duration, duration_class, fold)) INTO NAME f VALUE x),
      {name}_stat AS (SELECT held, f, {label} AS c, avg(x) AS m, var_pop(x) AS v FROM {name}_long JOIN held ON fold <> held GROUP BY ALL),
      {name}_every AS (SELECT held, f, var_pop(x) AS v FROM {name}_long JOIN held ON fold <> held GROUP BY ALL),
      {name}_prior AS (SELECT held, ln(avg(1 - {label})) - ln(avg({label})) AS p FROM {rows} JOIN held ON fold <> held GROUP BY held),
      {name}_model AS (SELECT held, f, n.m AS m0, n.v + 1e-9::DOUBLE * e.v AS v0, p.m AS m1, p.v + 1e-9::DOUBLE * e.v AS v1
        FROM {name}_every e JOIN {name}_stat n USING (held, f) JOIN {name}_stat p USING (held, f) WHERE n.c = 0 AND p.c = 1),
      {name}_gap AS (SELECT held, lead_id, sum(0.5 * (ln(v1) - ln(v0)) - pow(x - m0, 2) / (2 * v0) + pow(x - m1, 2) / (2 * v1)) AS g
        FROM {name}_model JOIN {name}_long USING (f) WHERE fold = held GROUP BY ALL),
      {name} AS (SELECT lead_id, round(1 / (1 + exp(least(greatest(g + p, -700), 700))), {SCHEDULE_DIGITS}) AS prob
        FROM {name}_gap JOIN {name}_prior USING (held))"""


def two_stage_sql(perfect):
    codes = ", ".join([f'"{c}"::DOUBLE AS "{c}"' for c in NUMERIC] + [f'(dense_rank() OVER (ORDER BY "{c}") - 1)::DOUBLE AS "{c}"' for c in CATEGORICAL])
    length = "" if perfect else oof_sql("length", "dealt", "duration_class")
    source, long = ("dealt", "duration_class") if perfect else ("dealt JOIN length USING (lead_id)", "prob")
    extra = "" if perfect else " EXCLUDE (prob)"
    return f""", coded AS (SELECT lead_id, y, duration, (duration > 180)::INTEGER AS duration_class, {codes} FROM leads),
      dealt AS (SELECT *, {folds_sql(5)} AS fold FROM coded), held AS (SELECT DISTINCT fold AS held FROM dealt){length},
      enhanced AS (SELECT *{extra}, (1 - {long})::DOUBLE AS prob_short, {long}::DOUBLE AS prob_long FROM {source})
      {oof_sql("paired", "enhanced", "y")} {oof_sql("alone", "dealt", "y")},
      eff AS (SELECT lead_id, y, duration, alone.prob AS standard,
        round(paired.prob / (prob_short * 101.3::DOUBLE + prob_long * 417.0::DOUBLE), {SCHEDULE_DIGITS + 6}) AS efficiency
        FROM enhanced JOIN paired USING (lead_id) JOIN alone USING (lead_id))
      {TRIALS}, r AS (
      SELECT 'efficiency' AS strategy, count(*)::DOUBLE AS calls, sum(y)::DOUBLE AS sales FROM ({spent_sql('eff', 'efficiency DESC')}) WHERE spent <= 28800
      UNION ALL SELECT 'probability', count(*)::DOUBLE, sum(y)::DOUBLE FROM ({spent_sql('eff', 'standard DESC')}) WHERE spent <= 28800
      UNION ALL SELECT 'random', avg(calls), avg(sales) FROM trials),
      b AS (SELECT calls AS bc, sales AS bs FROM r WHERE strategy = 'probability')
      SELECT strategy, calls, sales, round(calls - bc, 6) AS calls_diff, round(sales - bs, 6) AS sales_diff,
        round((sales - bs) / bs * 100, 6) AS sales_pct FROM r, b"""


def two_stage_bayes(perfect):
    """Both stages with naive Bayes on label codes, five folds."""
    def run(spark, sf):
        leads = build_leads(spark, sf, [*FEATURES, "y", "duration"])
        table, _ = ts.two_stage(leads, folds=5, learner="naive_bayes", strategy="none", perfect_lengths=perfect,
                                style="label", derived=(), digits=SCHEDULE_DIGITS)
        return rounded(table, "calls_diff", "sales_diff", "sales_pct")
    return run


query("l19_two_stage_naive_bayes", lead_sql=two_stage_sql(False))(two_stage_bayes(False))
query("l20_perfect_information_naive_bayes", lead_sql=two_stage_sql(True))(two_stage_bayes(True))
