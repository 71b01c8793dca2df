"""Gaussian naive Bayes with a smoothing share, as one aggregate and one projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GaussianBayesModel:
    features: list[str]
    priors: dict[int, float]
    means: dict[int, list[float]]
    variances: dict[int, list[float]]

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Add the probability of class 1."""
        like = {}
        for c in (0, 1):
            fixed = math.log(self.priors[c]) - 0.5 * sum(math.log(2 * math.pi * v) for v in self.variances[c])
            spread = F.lit(0.0)
            for f, m, v in zip(self.features, self.means[c], self.variances[c]):
                spread = spread + F.pow(F.col(f) - F.lit(m), 2) / F.lit(2 * v)
            like[c] = F.lit(fixed) - spread
        gap = F.least(F.greatest(like[0] - like[1], F.lit(-700.0)), F.lit(700.0))
        return df.withColumn(out, 1 / (1 + F.exp(gap)))


def score_each(models: Sequence[GaussianBayesModel], columns: Sequence[np.ndarray]) -> np.ndarray:
    """The probabilities of class 1 by each model for a batch of rows; a missing feature gives NaN.

    As an expression, several models are a method that the JVM does not compile.
    """
    out = np.empty((len(columns[0]), len(models)))
    squares: dict[tuple[int, float], np.ndarray] = {}  # models of one fit share their means
    for at, m in enumerate(models):
        like = {}
        for c in (0, 1):
            fixed = math.log(m.priors[c]) - 0.5 * sum(math.log(2 * math.pi * v) for v in m.variances[c])
            spread = np.zeros(len(out))
            for i, (x, mean, variance) in enumerate(zip(columns, m.means[c], m.variances[c])):
                if (i, mean) not in squares:
                    squares[i, mean] = (x - mean) ** 2
                spread += squares[i, mean] * (1 / (2 * variance))
            like[c] = fixed - spread
        out[:, at] = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700.0, 700.0)))
    return out


def fit_gaussian_bayes(df: DataFrame, features, label: str = "y", var_smoothing: float = 1e-9,
                       standardised: bool = False) -> GaussianBayesModel:
    """Class means and variances, each variance raised by ``var_smoothing`` times the largest one.

    With ``standardised`` the result is that of z-scored features: every
    variance is raised by that share of its own feature's overall variance.
    """
    return fit_gaussian_bayes_each(df, features, [var_smoothing], label, standardised)[0]


def fit_gaussian_bayes_each(df: DataFrame, features, smoothing: Sequence[float], label: str = "y",
                            standardised: bool = False) -> list[GaussianBayesModel]:
    """A model for every smoothing value, from one aggregate."""
    per_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(f).alias("m"), F.var_pop(f).alias("v"), F.count(f).alias("k")).alias(f"s_{i}")
                               for i, f in enumerate(features)]).collect()  # one row per class
    if {r[label] for r in per_class} != {0, 1}:
        raise ValueError("both classes must be present")
    total = sum(r["n"] for r in per_class)
    pick = lambda r, k: [r[f"s_{i}"][k] for i in range(len(features))]
    overall = [_pooled([r[f"s_{i}"] for r in per_class]) for i in range(len(features))]

    def model(var_smoothing):
        extra = [var_smoothing * (v if standardised else max(overall)) for v in overall]
        return GaussianBayesModel(
            list(features), {r[label]: r["n"] / total for r in per_class},
            {r[label]: pick(r, "m") for r in per_class},
            {r[label]: [max(v + e, 1e-300) for v, e in zip(pick(r, "v"), extra)] for r in per_class})
    return [model(s) for s in smoothing]


def _pooled(parts) -> float:
    """Variance of all rows from the number, mean and variance of each part."""
    n = sum(p["k"] for p in parts)
    mean = sum(p["k"] * p["m"] for p in parts) / n
    return sum(p["k"] * (p["v"] + (p["m"] - mean) ** 2) for p in parts) / n
