import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from dialwise.operators import ordering
from dialwise.operators.ordering import running
from dialwise.operators.quantiles import exact_quantiles
from dialwise.sources.leads import build_leads
from tests.conftest import same

KEYS = {
    "continuous": lambda: -F.col("score"), "constant": lambda: F.lit(1.0),
    "tied": lambda: F.floor(F.col("score") * 20),
    "one third on one key": lambda: F.when(F.col("h") % 3 == 0, 0.5).otherwise(F.col("score")),
    "nulls": lambda: F.when(F.col("h") % 3 > 0, F.col("score")),
}


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("group", [[], ["marital"]])
def test_bucketed_equals_plain_window(leads, key, group):
    args = dict(group=group, sums={"c": "y", "d": "duration"}, prior={"before": "job", "was": "y"})
    plain = running(leads, KEYS[key](), "lead_id", strategy="plain", **args)
    split = running(leads, KEYS[key](), "lead_id", strategy="bucketed", buckets=11, **args)
    assert same(plain, split)


def test_hash_keys_need_no_sampling(leads):
    plain = running(leads, "h", "lead_id", ["y"], strategy="plain")
    split = running(leads, "h", "lead_id", ["y"], strategy="bucketed", buckets=9, uniform_range=1 << 32)
    assert same(plain, split)


def test_history_of_leads_is_the_same_either_way(spark, sf):
    assert same(build_leads(spark, sf, strategy="plain"), build_leads(spark, sf, strategy="bucketed"))


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_tiny_inputs(leads, rows):
    few = leads.orderBy("lead_id").limit(rows)
    assert same(running(few, "score", "lead_id", strategy="plain"),
                running(few, "score", "lead_id", strategy="bucketed", buckets=4))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([0.0, 0.25, 0.5, 1e300, -7.0]), st.integers(0, 9)),
                min_size=1, max_size=60), st.integers(1, 9))
def test_random_inputs(spark, rows, buckets):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, g int, k double, m int")
    args = dict(group=["g"], sums={"s": "m"}, prior={"p": "m"})
    assert same(running(df, "k", "id", strategy="plain", **args),
                running(df, "k", "id", strategy="bucketed", buckets=buckets, **args))


def test_hot_key_is_split(leads):
    placed = ordering._place_by_quantiles(leads.withColumn("__key", F.lit(1.0)), "lead_id", 10)
    sizes = [r["count"] for r in placed.groupBy("__major", "__minor").count().collect()]
    assert max(sizes) <= 0.25 * sum(sizes)


def test_hot_group_is_split(leads):
    hot = leads.withColumn("g", F.when(F.col("h") % 3 == 0, 0).otherwise(F.col("cust_id") + 1))
    placed = ordering._place_by_quantiles(hot.withColumn("__key", F.col("score")), "lead_id", 10)
    sizes = [r["count"] for r in placed.groupBy("g", "__major", "__minor").count().collect()]
    assert max(sizes) <= 0.25 * sum(sizes)


def test_bucketed_plan_has_no_single_partition_over_rows(leads):
    plan = running(leads, "score", "lead_id", strategy="bucketed", buckets=5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    body = text[:text.index("Union")]
    assert "SinglePartition" not in body and "hashpartitioning(__major" in body


def test_only_needed_buckets_are_sorted(leads):
    kept = running(leads.select("lead_id", "score", "duration"), "score", "lead_id", sums={"spent": "duration"},
                   strategy="bucketed", buckets=10, keep=lambda: F.col("spent_before") <= 1000)
    whole = running(leads.select("lead_id", "score", "duration"), "score", "lead_id", sums={"spent": "duration"},
                    strategy="plain")
    assert kept.count() < whole.count() / 2
    assert same(kept.where("spent <= 1000"), whole.where("spent <= 1000"))


@pytest.mark.parametrize("group", [[], ["marital"]])
def test_distributed_quantiles_equal_percentile(leads, group):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}
    one = exact_quantiles(leads, ["duration", "score"], probs, group, "plain")
    two = exact_quantiles(leads, ["duration", "score"], probs, group, "bucketed")
    tidy = lambda df: df.withColumns({p: F.round(p, 9) for p in probs})
    assert same(tidy(one), tidy(two))


def test_levels_that_share_a_beginning_are_spread(spark):
    levels = spark.range(4000).select(F.concat(F.lit("https://example.org/"), F.md5(F.col("id").cast("string"))).alias("level"))
    prefix = F.conv(F.hex(F.substring(F.encode("level", "utf-8"), 1, 6)), 16, 10).cast("bigint")
    placed = ordering._place_by_quantiles(levels.withColumn("__key", prefix), "level", 20)
    sizes = [r["count"] for r in placed.groupBy(*ordering.BUCKET).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 1000
    got = running(levels, prefix, "level", strategy="bucketed", buckets=20).orderBy("level").collect()
    assert [r["rank"] for r in got] == list(range(1, 4001))
