"""The registered queries against their SQL twins, and the pipeline against its stages' rules."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline
from dialwise import llm
from dialwise.llm import decontaminate, neardup
from tests.conftest import SF
from tests.test_catalog import rows


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_equals_sql(spark, sf, db, name):
    got, want = llm.QUERIES[name](spark, sf), db.execute(llm.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_operator_is_registered_once():
    assert sorted(int(q[2:].split("_")[0]) for q in llm.QUERIES) == list(range(1, 14))
    assert set(llm.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_pipeline_stages_do_what_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf).cache()
        assert after.columns == docs.columns and 0 < after.count() <= kept.count(), name
        if "near" in name:
            assert neardup.link(after).where("NOT kept").isEmpty()
        if "decontamination" in name:
            assert decontaminate.flag(after, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").isEmpty()
        kept = after
    final = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in kept.collect())
