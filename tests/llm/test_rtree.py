"""Hard negatives against a comparison with all rows, on awkward and on crowded tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from dialwise.llm import rtree

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id int, vector string, tile int"


def brute(rows, every=50, positives=5, negatives=3, scale=256):
    kept = set()
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.add((i, tuple(math.floor(scale * v) for v in x), (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, label in kept:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in kept if len(y) == len(x)]
        for p, (score, positive, _) in enumerate(sorted(s for s in scored if s[2] == label and s[1] != a)[:positives]):
            score = -score
            far = sorted(s for s in scored if s[2] != label and 50 * score <= -100 * s[0] <= 95 * score)[:negatives]
            out += [(a, positive, r + 1, i, score, -n) for r, (n, i, _) in enumerate(far)]
    return sorted(out)


def found(spark, rows, folder, **settings):
    df = spark.createDataFrame([(i, x, label, 1, "x", 2) for i, x, label in rows], SCHEMA)
    got = rtree.hard_negatives(rtree.usable(df), str(folder), **settings).collect()
    return sorted(map(tuple, got))


def crowd(n=700, seed=5, width=6):
    """Neighbours of a few centres, a third of the rows the same vector, many ties, ids below zero."""
    draw = random.Random(seed)
    centres = [[draw.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        x = centres[0] if i % 3 == 0 else [round(v + draw.uniform(-.3, .3), 1) for v in centres[draw.randrange(5)]]
        rows.append((i * 5 - 200, x, draw.randrange(4)))
    return rows


@pytest.mark.parametrize("tile, leaf", [(40, 4), (200, 16), (100_000, 1000)])
def test_equals_a_comparison_with_all_rows(spark, tmp_path, tile, leaf):
    rows = crowd()
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows, tmp_path, tile=tile, leaf=leaf) == want


def test_awkward_rows(spark, tmp_path):
    rows = crowd(60, 9, 3)
    rows += rows[:9] + [(rows[0][0], rows[1][1], 2), (None, [1.0, 1.0, 1.0], 1), (5000, None, 1), (5050, [1.0, None, 1.0], 1), (5100, [1.0, NAN, 1.0], 1),
                        (5150, [INF, 1.0, 1.0], 1), (5200, [1.0, 1.0, 1.0], None), (5251, [], 1), (5300, [], 1), (5301, [], 2), (5350, [1.0, 2.0], 3),
                        (5351, [1.5, 2.0], 3), (5352, [1.0, 1.0], 1), (5400, [0.0, 0.0, 0.0], 1), (5401, [3e5, -3e5, 0.0], 1)]
    want = brute(rows)
    assert {5300, 5350, 5400} <= {r[0] for r in want} and found(spark, rows, tmp_path, tile=16, leaf=4) == want


def test_nothing_to_search(spark, tmp_path):
    assert found(spark, [], tmp_path / "a") == []
    assert found(spark, [(50, [1.0], 1)], tmp_path / "b") == []
    assert found(spark, [(51, [1.0], 1), (52, [1.0], 2)], tmp_path / "c") == []


def test_too_large_products_are_refused(spark, tmp_path):
    with pytest.raises(OverflowError):
        found(spark, [(50, [1e9], 1), (51, [1.0], 1)], tmp_path)


def test_boxes_out_of_reach_are_not_visited(spark, tmp_path):
    """Clusters far apart: an anchor's positives need a part of the leaves only."""
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in draw.normal(0, .02, 4) + np.eye(4)[i % 4]], int(i % 4)) for i in range(2000)]
    df = spark.createDataFrame([(i, x, label, 1, "x", 2) for i, x, label in rows], SCHEMA)
    tree, tiled = rtree.build(rtree.usable(df), str(tmp_path), tile=250, leaf=10)
    own = tiled.where("id = 100").toArrow()
    block = rtree.Search(tree, own["id"].to_numpy(), own["label"].to_numpy(), rtree.lists(own["vector"].combine_chunks(), 4))
    visits, tile = [], tree.tile
    tree.tile = lambda w, t: visits.append(t) or tile(w, t)
    block.positives(5)
    assert 0 < len(visits) < 60  # of 200 leaves and some 28 boxes above them


def test_packing_keeps_every_row_once():
    draw = np.random.default_rng(1)
    for n in (0, 1, 7, 100, 1001):
        keys = [draw.integers(0, 5, n), draw.normal(size=n), draw.normal(size=n)]
        assert sorted(rtree.packed(keys, n, 8).tolist()) == list(range(n))


def test_ties_go_to_the_smaller_id():
    best = rtree.Best(2, 2)
    for ids in ([9, 4], [7, 1], [3, 8]):
        best.take(np.ones((2, 2), bool), np.array([[5, 5], [5, 6]]), np.array(ids))
    assert best.id.tolist() == [[1, 3], [1, 4]] and best.score.tolist() == [[5, 5], [6, 6]]
    assert pa.array(best.id.ravel()).null_count == 0
