"""Cost-aware schedules and selections under a time budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.functions.features import MEAN_LONG, MEAN_SHORT, efficiency, expected_duration
from dialwise.functions.hashing import hex_int, md5_of
from dialwise.operators.ordering import running
from dialwise.scale import ROWS_PER_BUCKET, is_narrow, is_small, materialise, setting

SHIFT_SECONDS = 28_800


def score_efficiency(df: DataFrame, p_success="score", p_short="prob_short", p_long="prob_long",
                     means=(MEAN_SHORT, MEAN_LONG)) -> DataFrame:
    return df.withColumns({"expected_duration": expected_duration(p_short, p_long, means),
                           "efficiency": efficiency(p_success, p_short, p_long, means)})


def schedule(df: DataFrame, id: str, by: str = "efficiency", group: Sequence[str] = (),
             strategy: str = "auto") -> DataFrame:
    """Call position of every lead, best first; per agent when ``group`` names one."""
    return running(df, -F.col(by), id, group, rank="position", strategy=strategy)


def select_within_budget(df: DataFrame, order: Column | str, id: str, cost: str = "duration",
                         budget: float = SHIFT_SECONDS, group: Sequence[str] = (),
                         strategy: str = "auto") -> DataFrame:
    """The longest prefix in ``order`` whose total cost stays within ``budget``.

    Stops at the first lead that would exceed it, without skipping. That makes
    it a running total only if no cost is negative, so a negative one raises.
    Buckets that begin past the budget are never sorted.
    """
    paid = F.coalesce(F.col(cost), F.lit(0))
    checked = F.when(paid < 0, F.raise_error(F.lit("negative cost"))).otherwise(paid)
    out = running(df.withColumn("__cost", checked), order, id, group, sums={"spent": "__cost"},
                  rank="position", strategy=strategy, keep=lambda: F.col("spent_before") <= budget)
    return out.where(F.col("spent") <= budget).drop("__cost")


def outcome(selected: DataFrame, label: str = "y", group: Sequence[str] = ()) -> DataFrame:
    """Calls made, sales and seconds used by a selection."""
    return selected.groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(label), F.lit(0)).alias("sales"),
        F.coalesce(F.max("spent"), F.lit(0)).alias("seconds"))


KEY_DIGITS = 15


def trial_keys(id: str, trials: int, seed: int) -> list[Column]:
    """One 60-bit order key per trial, as hex text; each digest serves two trials."""
    digests = [md5_of(F.lit(str(seed + t)), F.col(id)) for t in range((trials + 1) // 2)]
    return [F.substring(digests[t // 2], 1 + KEY_DIGITS * (t % 2), KEY_DIGITS) for t in range(trials)]


def random_order_trials(df: DataFrame, id: str, cost: str = "duration", label: str = "y",
                        budget: float = SHIFT_SECONDS, trials: int = 50, seed: int = 42) -> DataFrame:
    """Calls and sales of ``trials`` shifts worked in random order.

    A shift reaches only the leads with the smallest keys. Each row drops the
    trials for which its key is past a cutoff before anything is shuffled; the
    cutoff widens until every trial's kept cost passes the budget.
    """
    spark = df.sparkSession
    paid = F.coalesce(F.col(cost), F.lit(0))
    lean = df.select(id, paid.alias("cost"), F.coalesce(F.col(label), F.lit(0)).alias("label"))
    if not is_narrow(lean) or is_small(lean):
        lean = materialise(lean)
    n, total = lean.agg(F.count(F.lit(1)), F.sum("cost")).first()
    needed = (2 * budget * n / total + 100) if total else n
    share = min(1.0, needed / n) if n else 1.0
    keys = F.array(*[F.struct(F.lit(t).alias("trial"), k.alias("key"))
                     for t, k in enumerate(trial_keys(id, trials, seed))])
    while True:
        # hex text of one length compares like the number
        cutoff = f"{int(share * 16 ** KEY_DIGITS):0{KEY_DIGITS}x}"
        near = keys if share >= 1 else F.filter(keys, lambda k: k["key"] < cutoff)
        kept = lean.select(id, "cost", "label", F.inline(near)) \
                   .withColumn("key", hex_int(F.col("key"), 1, KEY_DIGITS))
        if share >= 1:
            break
        kept = materialise(kept)
        spent = kept.groupBy("trial").agg(F.sum("cost").alias("c")).where(F.col("c") > budget)
        if spent.count() == trials:
            break
        share = min(1.0, share * 4)
    strategy = "plain" if n * share <= setting(spark, ROWS_PER_BUCKET) else "bucketed"
    worked = select_within_budget(kept, "key", id, "cost", budget, ["trial"], strategy)
    made = outcome(worked, "label", ["trial"])
    every = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    return every.join(made, "trial", "left").na.fill(0, ["calls", "sales", "seconds"])


def random_order_baseline(df, id, cost="duration", label="y", budget=SHIFT_SECONDS, trials=50, seed=42):
    return random_order_trials(df, id, cost, label, budget, trials, seed).agg(
        F.avg("calls").alias("mean_calls"), F.avg("sales").alias("mean_sales"))


def compare_strategies(results: DataFrame, standard: str) -> DataFrame:
    """Calls and sales per strategy with the difference to the standard one."""
    base = results.where(F.col("strategy") == standard)
    calls, sales = (base.select(F.max(c)).scalar() for c in ("calls", "sales"))
    return results.withColumns({
        "calls_diff": F.col("calls") - calls, "sales_diff": F.col("sales") - sales,
        "sales_pct": F.try_divide(F.col("sales") - sales, sales) * 100})


def paired_differences(metrics: DataFrame, a: str, b: str, variant: str = "variant",
                       fold: str = "fold") -> DataFrame:
    """Fold-by-fold value of two variants, ``b - a``, and whether b wins."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col("value")))
    return (metrics.groupBy(fold).agg(pick(a).alias("a"), pick(b).alias("b"))
                   .withColumn("diff", F.col("b") - F.col("a"))
                   .withColumn("b_wins", (F.col("b") > F.col("a")).cast("int")))


def win_count(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("mean_diff"),
                     F.count_if(F.col("b_wins") == 1).alias("wins"), F.count(F.lit(1)).alias("folds"))


def first_crossing(df: DataFrame, level: str, a: str, b: str, current: float | None = None) -> DataFrame:
    """Smallest level at which ``a`` strictly beats ``b``; null if it never does."""
    at = F.min(F.when(F.col(a) > F.col(b), F.col(level)))
    gap = (at - F.lit(current)) * 100 if current is not None else F.lit(None).cast("double")
    return df.agg(at.alias("crossing"), gap.alias("gap_points"))
