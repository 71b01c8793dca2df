"""Co-moments of all pairs against pandas; truncated densities against the full sum."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialwise.operators import groups, profile
from dialwise.operators.comoments import pair_moments


def matrix(df, cols):
    return {(r.f1, r.f2): r.r for r in groups.correlations(df, cols).collect()}


def test_pairs_with_nulls_and_large_offsets_equal_pandas(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5_000, 4))
    frame = pd.DataFrame({"a": 1e9 + base[:, 0], "b.x": base[:, 0] * 0.5 + base[:, 1], "c": 1e6 * base[:, 2] - 5e8, "d": base[:, 3]})
    for c, share in (("b.x", 0.3), ("c", 0.05)):
        frame[c] = frame[c].where(rng.random(5_000) >= share)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, `b.x` double, c double, d double").repartition(7)
    got, want = matrix(df, list(frame.columns)), frame.corr()
    assert len(got) == 16
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-7)
    counts = {(r.i, r.j): r.n for r in pair_moments(df, ["a", "b.x", "c"]).collect()}
    assert counts[0, 1] == frame["b.x"].notna().sum() and counts[1, 2] == frame[["b.x", "c"]].notna().all(axis=1).sum()
    strong = groups.correlations(df, list(frame.columns), min_abs=0.3).collect()
    assert {(r.f1, r.f2) for r in strong} == {("a", "b.x")}


def test_constant_empty_and_unsound_columns(spark):
    rows = [(0.1, float(i), float("nan") if i == 5 else float(i), None) for i in range(90)]
    df = spark.createDataFrame(rows, "k double, v double, w double, z double").repartition(5)
    got = matrix(df, ["k", "v", "w", "z"])
    assert got["k", "k"] is None and got["k", "v"] is None and got["v", "v"] == pytest.approx(1)
    assert math.isnan(got["v", "w"]) and math.isnan(got["w", "w"]) and got["v", "z"] is None and got["z", "z"] is None
    assert set(matrix(df.limit(0), ["k", "v"]).values()) == {None}
    # constant where the partner is known
    part = spark.createDataFrame([(0.7 if i % 3 else float(i), float(i) if i % 3 else None) for i in range(60)], "a double, b double")
    assert matrix(part, ["a", "b"])["a", "b"] is None


def test_a_hundred_columns(spark):
    cols = [f"v{i}" for i in range(100)]
    df = spark.range(2_000).select(*[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(cols)])
    got = pd.DataFrame([r.asDict() for r in groups.correlations(df, cols).collect()]).pivot(index="f1", columns="f2", values="r")
    want = df.toPandas().corr()
    assert np.abs(got.loc[cols, cols].to_numpy() - want.to_numpy()).max() < 1e-9


@pytest.mark.parametrize("rows", [
    [(float(v * v % 977), v % 2) for v in range(600)],
    # far apart: most grid points are reached by no bin
    [(float(v % 3), 0) for v in range(500)] + [(1e6 + v % 2, 0) for v in range(500)]])
def test_truncated_density_equals_the_full_sum(spark, rows):
    got = profile.density(spark.createDataFrame(rows, "x double, y int"), "x", "y").collect()
    for cls in {y for _, y in rows}:
        x = np.array([v for v, y in rows if y == cls])
        h = x.std(ddof=1) * len(x) ** -0.2
        mine = sorted((r for r in got if r.y == cls), key=lambda r: r.point)
        assert [r.point for r in mine] == list(range(200))
        grid = np.linspace(x.min(), x.max(), 200)
        full = np.exp(-((grid[:, None] - x) / h) ** 2 / 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
        assert np.allclose([r.density for r in mine], full, atol=1e-9, rtol=1e-9)
