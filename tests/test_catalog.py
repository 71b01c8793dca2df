"""Every registered query runs; those with a SQL twin equal it."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dialwise import catalog
from tests.conftest import SF

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "spent" in out.columns


def test_published_smoke_values(spark):
    big = "/root/testdata/sf0.01"
    made = QUERIES["w09_budget_by_probability"](spark, big).first()
    assert (made["calls"], made["sales"]) == (157, 78)
    auc = QUERIES["m04_auc"](spark, big).first()["auc"]
    assert auc == pytest.approx(35_689_278 / (2 * 1_687 * 13_313), abs=1e-9)
    ranked = QUERIES["w02_cumulative"](spark, big).where("rank % 150 = 0")
    assert ranked.agg(F.sum("cum_positives")).first()[0] == 129_277


@pytest.mark.parametrize("name", ["l08_cross_validation", "l15_recursive_elimination", "l16_feature_subsets",
                                  "l18_version_comparison", "l20_perfect_information", "l21_accuracy_sweep",
                                  "l22_batch_scoring"])
def test_learning_jobs_give_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()
