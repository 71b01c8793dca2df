"""Null groups, colliding names, refused settings, and functions that travel without the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from dialwise.operators import encode, groups, joins, profile
from dialwise.plans.baselines import soft_vote
from dialwise.plans.models import _depth, fit

ROWS = [(1, 1.0, "a", None), (2, 2.0, "a", None), (3, 4.0, "b", 0), (4, 8.0, None, 0), (5, 9.0, "b", 1), (6, 11.0, "b", 1)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, x double, part string, y int")


def test_null_groups_stay(table):
    described = {r.y: r["count"] for r in profile.describe_numeric(table, ["x"], ["y"]).collect()}
    assert described == {None: 2, 0: 2, 1: 2}
    bins = profile.histogram(table, "x", 5, by="y").groupBy("y").sum("n").collect()
    assert {r.y: r["sum(n)"] for r in bins} == {None: 2, 0: 2, 1: 2}
    assert {r.y: r.n for r in profile.box_stats(table, "x", by="y").collect()} == {None: 2, 0: 2, 1: 2}
    shares = {(r.part, r.y): r.pct for r in groups.class_shares(table, "part").collect()}
    assert shares[(None, 0)] == 100.0 and shares[("a", None)] == 100.0
    assert {r.y for r in profile.density(table, "x", "y", points=3).collect()} == {None, 0, 1}


def test_density_keeps_the_stated_width(spark):
    rows = [(float(v), 1) for v in (0, 1, 5_000, 9_999)]
    got = profile.density(spark.createDataFrame(rows, "x double, y int"), "x", "y", points=2).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.point)] == [0.0, 9999.0]


def test_levels_that_differ_in_signs_keep_their_columns(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b.c", "b c", "b-c"])], "id int, v string")
    made = encode.one_hot(df, ["v"])
    assert made.columns == ["id", "v_b_c", "v_b_c_2", "v_b_c_3"]
    assert sorted(sum(r[1:]) for r in made.collect()) == [0, 1, 1, 1]


def test_votes_need_every_member(spark):
    one = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, prob double")
    two = spark.createDataFrame([(1, 1.0)], "id int, prob double")
    assert {r.id: r.prob for r in soft_vote([one, two], "id").collect()} == {1: 0.75, 2: None}


def test_refused_settings(table):
    with pytest.raises(ValueError):
        _depth(31)
    with pytest.raises(ValueError):
        fit(table, "naive_bayes", ["x"], weight="x")
    with pytest.raises(ValueError):
        joins.few(table, 3)


def test_neighbours_run_where_workers_lack_the_package(tmp_path):
    """The driver finds the package by its own path alone; workers start elsewhere."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2')
         .config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate())
spark.sparkContext.setLogLevel('OFF')
import __spark_entry__ as entry
sf = '/root/testdata/sf0.001'
names = ['j06_nearest_neighbours'] if 'j06_nearest_neighbours' in entry.queries() else []
names += [n for n in entry.queries() if n.startswith(('j06', 'r04', 'op6_', 'op10_', 'op7_'))]
for n in dict.fromkeys(names):
    print(n, entry.queries()[n](spark, sf).count())
print('done', len(names))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "done" in done.stdout, done.stderr[-2000:]


def test_many_groups_are_joined_instead_of_refused(spark):
    n = joins.CLASSES + 1
    df = spark.range(2 * n).selectExpr(f"id % {n} AS g", "CAST(id AS double) AS v")
    assert profile.box_stats(df, "v", "g").count() == n
    assert profile.density(df, "v", "g", points=2).select("g").distinct().count() == n
