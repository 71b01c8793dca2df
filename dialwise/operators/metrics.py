"""Classification metrics from predicted classes and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, pred: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    p, y = F.col(pred), F.col(label)
    return df.groupBy(*group).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_matrix(df: DataFrame, pred: str, label: str) -> DataFrame:
    """One row per true class with counts and row percentages."""
    p = F.col(pred)
    rows = df.groupBy(label).agg(F.count_if(p == 0).alias("predicted_0"), F.count_if(p == 1).alias("predicted_1"))
    n = F.col("predicted_0") + F.col("predicted_1")
    return rows.withColumns({f"pct_{c}": F.try_divide(100.0 * F.col(f"predicted_{c}"), n) for c in (0, 1)})


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, FNR and FPR from confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fnr": _ratio(fn, fn + tp), "fpr": _ratio(fp, fp + tn)})


def log_loss(df: DataFrame, prob: str, label: str, group: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    true = F.when(F.col(label) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), true))
    return df.groupBy(*group).agg((-F.avg(F.ln(clipped))).alias("log_loss"))


def class_report(counts: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1 and support, with accuracy, macro and weighted rows."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, tp + fn
    p0, p1, r0, r1 = _ratio(tn, tn + fn), _ratio(tp, tp + fp), _ratio(tn, n0), _ratio(tp, n1)
    f0, f1 = _ratio(2 * tn, 2 * tn + fn + fp), _ratio(2 * tp, 2 * tp + fp + fn)
    n = n0 + n1
    mean = lambda a, b: (a + b) / 2
    weighted = lambda a, b: _ratio(a * n0 + b * n1, n)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                                            f.alias("f1"), s.alias("support"))
    accuracy = _ratio(tp + tn, n)
    return counts.select(F.inline(F.array(
        row("0", p0, r0, f0, n0), row("1", p1, r1, f1, n1), row("accuracy", accuracy, accuracy, accuracy, n),
        row("macro avg", mean(p0, p1), mean(r0, r1), mean(f0, f1), n),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n))))


def contact_cost(counts: DataFrame) -> DataFrame:
    """Captured, missed and total positives, and wasted contacts per success."""
    return counts.withColumns({
        "captured": F.col("tp"), "missed": F.col("fn"), "positives": F.col("tp") + F.col("fn"),
        "captured_pct": F.try_divide(100.0 * F.col("tp"), F.col("tp") + F.col("fn")),
        "extra_per_success": F.try_divide(F.col("fp"), F.col("tp"))})


def overfit_gap(df: DataFrame, train: str = "train", validation: str = "validation") -> DataFrame:
    return df.withColumn("gap", F.col(train) - F.col(validation))
