import hashlib
import random

from dialwise.llm import decontaminate
from tests.llm.helpers import LONG, TEXTS, alnum_words, awkward, nothing

ITEMS = [(1, " ".join(LONG.split()[500:530])), (2, "one"), (3, None), (4, ""), (None, "alpha beta"), (5, "w0 w2916 w829"),
         (6, "Alpha, beta; gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (6, "fox jumps over the"),
         (7, " ".join(LONG.split()[510:540])), (8, "a b c d e f g a b c d e f g")]


def brute(text, items):
    w, hit, found = alnum_words(text), set(), set()
    for item, t in items:
        x = alnum_words(t)
        if item is None or not x:
            continue
        size = min(13, len(x))
        windows = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item)
    listed = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_awkward_tables_equal_brute_force(spark):
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(repr((i, *brute(t, ITEMS))) for i, t in TEXTS)
    for block in (decontaminate.BLOCK_BYTES, 40):
        got = decontaminate.flag(awkward(spark), tests, block_bytes=block)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_empty_tables(spark):
    tests = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.flag(nothing(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).isEmpty()
    assert decontaminate.flag(awkward(spark), tests).where("n_hit > 0 OR contaminated").isEmpty()


def test_longest_matches_and_their_places(spark):
    rng = random.Random(1)
    item = [f"t{rng.randrange(50_000)}" for _ in range(40)]
    doc = [f"d{rng.randrange(50_000)}" for _ in range(100)]
    rows = [(1, " ".join(doc[:30] + item[5:35] + doc[30:])), (2, " ".join(item[:12] + doc)), (3, " ".join(item + item))]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame([(9, " ".join(item))], "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 30, 9, 5, 30), (3, 0, 9, 0, 40), (3, 40, 9, 0, 40)]


def test_affected_documents_go_and_columns_stay(spark):
    docs, tests = awkward(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(repr((i, t)) for i, t in TEXTS if not brute(t, ITEMS)[4])
    for block in (decontaminate.BLOCK_BYTES, 40):
        kept = decontaminate.remove_affected(docs, tests, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(repr((r.doc_id, r.text)) for r in kept.select("doc_id", "text").collect()) == want
