"""Scalar feature expressions. Each takes column names and returns a Column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_CALL_SECONDS = 180
# Mean seconds of a short and of a long call.
MEAN_SHORT, MEAN_LONG = 101.3, 417.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(col, mapping: Mapping) -> Column:
    """Dictionary recode; a value outside the mapping gives null."""
    out = F.lit(None)
    for value, code in mapping.items():
        out = F.when(_c(col) == value, F.lit(code)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def yes_no(col) -> Column:
    return recode(col, {"yes": 1, "no": 0})


def age_campaign() -> Column:
    return F.col("age") * F.col("campaign")


def is_first_contact(sentinel: int = 999) -> Column:
    return flag(F.col("pdays") == sentinel)


def contact_intensity() -> Column:
    return F.col("campaign").cast("double") / (F.col("pdays") + 1)


def financial_stress() -> Column:
    return reduce(add, [flag(F.col(c) == "yes") for c in ("housing", "loan", "default")])


def previous_success() -> Column:
    return flag(F.col("poutcome") == "success")


DERIVED = {"age_campaign": age_campaign, "is_first_contact": is_first_contact,
           "contact_intensity": contact_intensity, "financial_stress": financial_stress,
           "previous_success": previous_success}

DERIVED_INPUTS = {"age_campaign": ["age", "campaign"], "is_first_contact": ["pdays"],
                  "contact_intensity": ["campaign", "pdays"],
                  "financial_stress": ["housing", "loan", "default"], "previous_success": ["poutcome"]}


def derive_features(df: DataFrame, which: Sequence[str]) -> DataFrame:
    """Add the named features whose source columns are all present."""
    present = set(df.columns)
    return df.withColumns({f: DERIVED[f]() for f in which if present >= set(DERIVED_INPUTS[f])})


def right_closed_bin(col, edges: Sequence[float]) -> Column:
    """Index of the interval ``(edges[i], edges[i+1]]``; null outside all of them."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (_c(col) > edges[i]) & (_c(col) <= edges[i + 1])
        out = F.when(inside, i).otherwise(out)
    return out


def duration_class(col="duration") -> Column:
    return right_closed_bin(col, [-1, SHORT_CALL_SECONDS, float("inf")])


def replace_value(col, old, new) -> Column:
    return F.when(_c(col) == old, F.lit(new)).otherwise(_c(col))


def fill_null(col, value=-1) -> Column:
    return F.coalesce(_c(col), F.lit(value))


def clip(col, lo, hi) -> Column:
    """Bounded value; null stays null."""
    return F.when(_c(col).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), _c(col))))


def indicator_pair(cls) -> tuple[Column, Column]:
    """Certain probabilities for a known class: 0 gives (1, 0), 1 gives (0, 1)."""
    return (F.when(_c(cls) == 0, 1.0).when(_c(cls) == 1, 0.0),
            F.when(_c(cls) == 0, 0.0).when(_c(cls) == 1, 1.0))


def predicted_class(p0, p1) -> Column:
    """Class of the larger probability; a tie goes to class 0."""
    return (_c(p1) > _c(p0)).cast("int")


def split_configuration(col) -> tuple[Column, Column]:
    """``Model (Strategy)`` into its parts; the strategy defaults to Unknown."""
    pattern = r"^(.*) \((.*)\)$"
    matched = _c(col).rlike(pattern)
    return (F.when(matched, F.regexp_extract(_c(col), pattern, 1)).otherwise(_c(col)),
            F.when(matched, F.regexp_extract(_c(col), pattern, 2)).otherwise("Unknown"))


def mean_std_text(mean, std) -> Column:
    return F.format_string("%.4f ± %.4f", _c(mean), _c(std))


# Limits and names of the verdicts below.


def five_way_verdict(diff) -> Column:
    d = _c(diff)
    return (F.when(F.abs(d) < 0.001, "NEGLIGIBLE").when(d > 0.003, "STRONG POSITIVE")
             .when(d > 0, "WEAK POSITIVE").when(d < -0.003, "STRONG NEGATIVE").otherwise("WEAK NEGATIVE"))


def version_verdict(diff) -> Column:
    d = _c(diff)
    return (F.when(d > 0.003, "SIGNIFICANTLY BETTER").when(d > 0, "SLIGHTLY BETTER")
             .when(d > -0.003, "EQUIVALENT").otherwise("WORSE"))


def impact_verdict(diff) -> Column:
    d = _c(diff)
    return F.when(F.abs(d) < 0.001, "NEGLIGIBLE").when(d > 0, "POSITIVE").otherwise("NEGATIVE")


def addon_verdict(diff) -> Column:
    d = _c(diff)
    return F.when(d > 0.001, "HELPS").when(d < -0.001, "HURTS").otherwise("NEGLIGIBLE")


def difference(value, base) -> Column:
    return _c(value) - _c(base)


def pct_difference(value, base) -> Column:
    return F.try_divide(_c(value) - _c(base), _c(base)) * 100


def gap_class(gap) -> Column:
    return F.when(_c(gap) < 0.05, "green").when(_c(gap) < 0.1, "orange").otherwise("red")


def expected_duration(p_short="prob_short", p_long="prob_long", means=(MEAN_SHORT, MEAN_LONG)) -> Column:
    return _c(p_short) * F.lit(means[0]) + _c(p_long) * F.lit(means[1])


def efficiency(p_success="score", p_short="prob_short", p_long="prob_long",
               means=(MEAN_SHORT, MEAN_LONG)) -> Column:
    return F.try_divide(_c(p_success), expected_duration(p_short, p_long, means))


def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """Scale to 0..1 over the whole column; a constant column gives null."""
    lims = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")))
    lo, hi = lims.scalar()["lo"], lims.scalar()["hi"]
    return df.withColumn(out, F.try_divide(F.col(col) - lo, hi - lo))
