import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialwise.operators import neighbours
from dialwise.operators import smote as smotes
from dialwise.operators.joins import by_row
from dialwise.operators.neighbours import nearest_neighbours
from dialwise.operators.smote import smote
from dialwise.scale import materialise
from tests.conftest import same


def brute_force(points, k):
    out = {}
    for i, x in points.items():
        far = sorted((float(sum((a - b) ** 2 for a, b in zip(x, y))), j) for j, y in points.items() if j != i)
        out[i] = far[:k]
    return out


def crowded(points, k):
    """Ids in groups of more than k equal points, which have only copies as neighbours."""
    groups = {}
    for i, x in points.items():
        groups.setdefault(x, []).append(i)
    return {i for g in groups.values() if len(g) > k for i in g}


def frame(spark, points):
    return spark.createDataFrame([(int(i), *map(float, x)) for i, x in points.items()], "id bigint, a double, b double, c double")


@pytest.mark.parametrize("search", [dict(leaf_rows=25), dict(leaf_rows=8, fan=3), {}])
def test_neighbours_equal_brute_force(spark, search):
    rng = np.random.default_rng(1)
    pts = {i: tuple(p) for i, p in enumerate(rng.integers(0, 12, size=(300, 3)))}
    # a third of the rows are copies of one point, and a small group of copies
    for i in range(300, 450):
        pts[i] = (3, 3, 3)
    for i in range(450, 453):
        pts[i] = (50, 50, 50)
    want = brute_force(pts, 4)
    got = {}
    for r in nearest_neighbours(frame(spark, pts), "id", ["a", "b", "c"], 4, **search).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    copies = crowded(pts, 4)
    assert len(copies) >= 150
    assert got == {i: v for i, v in want.items() if i not in copies}
    assert all(d == 0 for i in copies for d, _ in want[i])


def test_tree_splits_rows_that_share_a_value():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    x[:, 1] = np.where(rng.random(4000) < 0.8, 999, rng.integers(0, 900, 4000))
    tree = neighbours._Tree([], [], [], [], [])
    neighbours._grow(tree, x, 20)
    placed = next(neighbours._assign([pd.DataFrame({"v": list(x)})], tree))
    assert tree.leaves == 20 and placed["leaf"].value_counts().max() < 3 * 4000 / 20


def test_neighbours_with_a_dominant_value_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = {i: (int(rng.integers(0, 40)), 999 if i % 5 else int(rng.integers(0, 30)), int(rng.integers(0, 40)))
           for i in range(400)}
    want = brute_force(pts, 3)
    got = {}
    for r in nearest_neighbours(frame(spark, pts), "id", ["a", "b", "c"], 3, leaf_rows=10, fan=4) \
            .orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    assert got == {i: v for i, v in want.items() if i not in crowded(pts, 3)}


@pytest.mark.parametrize("columns", [15, 37])
def test_neighbours_in_many_standardised_columns(spark, columns, monkeypatch):
    rng = np.random.default_rng(columns)
    x = rng.normal(size=(8, columns))[rng.integers(0, 8, 1200)] * 4 + rng.normal(size=(1200, columns))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    sent, visits = [], neighbours._visits
    monkeypatch.setattr(neighbours, "_visits", lambda q, p, k: (sent.append(q.count()), visits(q, p, k))[1])
    names = [f"c{i}" for i in range(columns)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(1200)))
    got = nearest_neighbours(df, "id", names, 3, leaf_rows=30, fan=4).toPandas().sort_values(["id", "rank"])
    far = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert (got["neighbour"].to_numpy().reshape(-1, 3) == np.argsort(far, axis=1, kind="stable")[:, :3]).all()
    # 40 leaves; a point visits those of its own cluster, at most a third
    assert sum(sent) / 1200 < 40 / 3


def test_cells_hold_at_most_two_leaves_rows_at_any_depth(spark):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, [float(a), float(b)], 1) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))],
                                   "id bigint, v array<double>, copy int")
    placed, depth = neighbours.partition(points, 10, 3)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert depth >= 4 and max(sizes) <= 20 and sum(sizes) == 2000


def test_smote_reaches_parity_between_minority_points(leads):
    cols = ["age", "campaign", "duration"]
    out = smote(leads, cols, "y", "lead_id").cache()
    sizes = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert sizes[0] == sizes[1]
    rare = leads.where("y = 1").agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    made = out.where("lead_id < 0")
    assert made.where(" or ".join(f"{c} < {rare['lo_' + c]} or {c} > {rare['hi_' + c]}" for c in cols)).isEmpty()
    assert out.where("lead_id >= 0").count() == leads.count()


def test_smote_is_the_same_for_any_leaf_size(leads):
    cols = ["age", "campaign", "duration"]
    one, many = smote(leads, cols, "y", "lead_id"), smote(leads, cols, "y", "lead_id", leaf_rows=30)
    assert one.exceptAll(many).isEmpty()


def test_smote_of_copies_adds_copies(spark):
    df = spark.createDataFrame([(i, int(i >= 20), 1.0 if i >= 20 else float(i)) for i in range(30)], "id bigint, y int, a double")
    made = smote(df, ["a"], "y", "id").where("id < 0")
    assert made.count() == 10 and made.where("a <> 1").isEmpty()


@pytest.mark.parametrize("positives", [0, 1])
def test_smote_without_enough_minority_rows(spark, positives):
    df = spark.createDataFrame([(i, int(i < positives), float(i)) for i in range(10)], "id bigint, y int, a double")
    assert smote(df, ["a"], "y", "id").count() == 10


@pytest.mark.parametrize("search", [dict(leaf_rows=20, fan=3), {}])
def test_smote_by_fold_is_smote_of_the_rows_outside_it(spark, search, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 4 == 0), int(rng.integers(0, 3)), *map(float, rng.integers(0, 9, 2)), float(rng.normal())) for i in range(1200)]
    rows += [(1200 + i, 1, i % 3, 5.0, 5.0, 0.5) for i in range(40)]  # a group of copies in every fold
    rows += [(1240 + i, 1, 0, 50.0 + i / 100, 5.0, 0.5) for i in range(12)]  # near one another, in one fold
    rows += [(1252 + i, 1, 1, 5.0, 70.0, 0.5) for i in range(5)] + [(1257, 1, 2, 5.0, 70.0, 0.5)]
    df = spark.createDataFrame(rows, "id bigint, y int, fold int, a double, b double, c double").cache()
    names = ["a", "b", "c"]
    want = {f: smote(df.where(F.col("fold") != f), names, "y", "id") for f in range(3)}
    searches, search_of = [], smotes.neighbours_by_fold
    monkeypatch.setattr(smotes, "neighbours_by_fold", lambda *a, **b: (searches.append(1), search_of(*a, **b))[1])
    got = smotes.smote_by_fold(df, names, "y", "id", **search)
    assert sorted(got) == [0, 1, 2] and len(searches) == 1
    for f in got:
        assert same(want[f], got[f]) and got[f].columns == want[f].columns


def test_smote_by_fold_where_a_fold_has_another_minority(spark):
    rows = [(i, int(i % 3 == 0), 0, float(i)) for i in range(30)] + [(30 + i, int(i > 1), 1, float(i % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, y int, fold int, a double")
    got = smotes.smote_by_fold(df, ["a"], "y", "id")
    for f in (0, 1):
        assert same(smote(df.where(F.col("fold") != f), ["a"], "y", "id"), got[f])


def test_few_tasks_for_many_small_groups(spark):
    rows = spark.range(3000).withColumns({"cell": F.col("id"), "v": F.array(F.lit(1.0))})
    _, _, tasks = neighbours._chunked(rows, 10)
    assert tasks <= 3000 / 4


def test_vectors_are_not_broadcast_by_their_estimated_size(spark):
    rows = spark.range(2000)
    wide = materialise(rows.select("id", *[(F.col("id") % (i + 2)).cast("double").alias(f"c{i}") for i in range(40)]))
    vectors = wide.select("id", F.array(*[f"c{i}" for i in range(40)]).alias("v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(rows.join(vectors, "id"))  # by its estimate
    assert "BroadcastHashJoin" not in plan(by_row(rows, vectors, "id"))
    df = rows.select("id", (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"),
                     *[(F.col("id") * 7 % (i + 90)).cast("double").alias(f"c{i}") for i in range(20)])
    names = [f"c{i}" for i in range(20)]
    grown = smote(df, names, "y", "id")
    assert "BroadcastHashJoin" not in plan(grown)
