import random

import numpy as np
import pytest

from dialwise.llm import neardup
from dialwise.llm.components import components
from dialwise.llm.words import mix
from tests.llm.helpers import TEXTS, awkward, near_groups, nothing


def sketch_of(values):
    return neardup.registers(mix(np.array(sorted(values), np.uint64) + np.uint64(1)))


def test_awkward_table_equals_every_pair(spark):
    got = neardup.link(awkward(spark)).collect()
    want = near_groups(TEXTS)
    rows = sorted((repr(i), n, repr(c), c is None or i == c) for (i, _), (n, c) in zip(TEXTS, want))
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == rows


def test_blocks_find_the_same_links(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(100), rng.randrange(0, 5)):
            w[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = {i: c for (i, _), (_, c) in zip(rows, near_groups(rows))}
    monkeypatch.setattr(neardup, "STARS", 1)
    monkeypatch.setattr(neardup, "LIST_PAIRS", 0)
    for block in (512, 16):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_empty_table(spark):
    assert neardup.link(nothing(spark)).isEmpty()
    assert neardup.keep_one(nothing(spark)).isEmpty()


def test_chains_and_hot_group_equal_every_pair(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(150):  # copies drift from the base, so many link only through others
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(60)]
    for i in range(25):  # neighbours alike, ends not
        rows.append((2000 + i, " ".join(chain[:60 - i] + [f"d{k}" for k in range(i)])))
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, near_groups(rows))}


def test_keep_one_keeps_all_columns_and_one_row_of_a_group(spark):
    docs = awkward(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((repr(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect() if r.text and r.text.strip())
    alone = {k for k, ((i, t), (_, c)) in enumerate(zip(TEXTS, near_groups(TEXTS))) if t and t.strip() and (i is None or i == c)}
    assert ids == sorted({(repr(TEXTS[k][0]), TEXTS[k][1]) for k in alone})
    assert kept.where("text IS NULL").count() == 1


def test_registers_merge_like_sets():
    a, b = set(range(300)), set(range(200, 900))
    assert (neardup.merge(sketch_of(a), sketch_of(b)) == sketch_of(a | b)).all()


@pytest.mark.parametrize("common", [0, 300, 600, 750, 900, 1000])
def test_joint_estimate(common):
    a, b = set(range(1000)), set(range(1000 - common, 2000 - common))
    guess, lost = neardup.estimate(sketch_of(a)[None], sketch_of(b)[None], np.array([1000.0]), np.array([1000.0]))
    truth = common / (2000 - common)
    assert abs(guess[0] - truth) < 0.12
    if truth >= 0.75:
        assert lost[0] < neardup.HOPELESS
    if truth < 0.3:
        assert lost[0] > neardup.HOPELESS


def test_bands_find_threshold_pairs():
    """Pairs at exactly three quarters share a band."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = pool[:140], np.concatenate([pool[20:140], pool[140:160]])
        sketches = np.stack([neardup.registers(a), neardup.registers(b)])
        assert (neardup.band_keys(sketches)[0] == neardup.band_keys(sketches)[1]).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (202, 201), (5, 5), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
