"""Nearest-neighbour mutual information against a comparison of all rows."""

import math
import random

import pytest

from dialwise.operators.information import neighbour_information

GAMMA = 0.57721566490153286


def psi(n):
    return -GAMMA + sum(1 / i for i in range(1, n))


def brute(rows, k=3):
    sizes = {}
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    for _, y in rows:
        sizes[y] = sizes.get(y, 0) + 1
    rows = [(x, y) for x, y in rows if sizes[y] > 1]
    total = 0.0
    for i, (x, y) in enumerate(rows):
        kk = min(k, sizes[y] - 1)
        reach = sorted(abs(b - x) for j, (b, c) in enumerate(rows) if c == y and j != i)[kk - 1]
        m = sum(b == x if reach == 0 else x - reach < b < x + reach for b, _ in rows)
        total += psi(kk) - psi(sizes[y]) - psi(m)
    return max(psi(len(rows)) + total / len(rows), 0.0) if rows else None


@pytest.mark.parametrize("strategy", ["plain", "bucketed"])
def test_equals_a_comparison_of_all_rows(spark, strategy):
    draw = random.Random(6)
    rows = []
    for i in range(260):
        y = draw.choice([0, 0, 1])
        rows.append((y, draw.gauss(y, 1), float(draw.randrange(6) + y), 7.0 if i % 3 else None, draw.uniform(-1, 1) * 1e-9))
    rows += [(None, 1.0, 1.0, 1.0, 1.0), (5, 0.5, 2.0, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "y int, smooth double, tied double, same double, tiny double")
    got = {r.feature: r.mutual_information for r in neighbour_information(df, ["smooth", "tied", "same", "tiny"], strategy=strategy).collect()}
    for at, name in enumerate(["smooth", "tied", "same", "tiny"], 1):
        assert got[name] == pytest.approx(brute([(r[at], r[0]) for r in rows]), abs=1e-8)
    assert got["smooth"] > 0.05 and math.isclose(got["same"], 0, abs_tol=0.05)


def test_small_and_empty_tables(spark):
    kind = "y int, a double"
    assert neighbour_information(spark.createDataFrame([], kind), ["a"]).isEmpty()
    assert neighbour_information(spark.createDataFrame([(0, 1.0), (1, 2.0)], kind), ["a"]).isEmpty()
    rows = [(0, 1.0), (0, 2.0), (1, 5.0), (1, 5.0), (1, 9.0)]
    got = neighbour_information(spark.createDataFrame(rows, kind), ["a"]).first().mutual_information
    assert got == pytest.approx(brute([(x, y) for y, x in rows]), abs=1e-9)
