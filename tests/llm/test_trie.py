"""The prefix trie against one built node by node in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from dialwise.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, k1 int, range int, n_convs int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: (t[:2], t[2].encode(), t[3].encode()))] for c, turns in own.items()}
    members, made = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if len(made[c]) == len(node))
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(ends(n).encode()).hexdigest()) for n in members)


def found(spark, rows, block=trie.BLOCK):
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], SCHEMA)
    got = trie.trie(*trie.rebuilt(trie.placed(df)), block=block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()))


def chats(n, seed=4, longest=12, words=2):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), f"é{draw.randrange(words)}") for c in range(-n // 4, n) for t in range(draw.randrange(longest))]


@pytest.mark.parametrize("block, chunk, many", [(4, 4096, 1000), (1, 2, 3), (3, 2, 1), (16, 5, 30)])
def test_equals_a_trie_built_node_by_node(spark, monkeypatch, block, chunk, many):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    monkeypatch.setattr(trie, "HOT", 10 ** 9)
    monkeypatch.setattr(trie, "MANY", many)
    draw = random.Random(8)
    rows = chats(60)
    rows += [(100 + c, t, "user", f"t{t}") for c in range(40) for t in range(9)]  # copies
    rows += [(200, t, "user", f"t{t % 7}") for t in range(150)]  # a long one
    rows += [(c, t, "user", f"t{t % 7}") for c, n in ((205, 40), (206, 77), (210, 150)) for t in range(n)]
    draw.shuffle(rows)
    assert found(spark, rows, block) == brute(rows)


def test_awkward_turns(spark):
    rows = chats(12, 2)
    rows += [(None, 1, "user", "lost"), (50, None, None, None), (50, None, "user", None), (50, 3, None, ""), (50, 3, None, None), (50, 3, "b", "x"),
             (50, 3, "a", "x"), (51, -5, "user", "x" * 20_000), (51, -6, "user", "x" * 20_000), (52, 2 ** 60, "user", "late"), (52, 1, "", "user"),
             (52, 1, "user", ""), (55, 1, "a", "b"), (55, 1, "a", "b"), (57, 1, "a", "b"), (10 ** 12 + 3, 0, "user", "far")]
    assert found(spark, rows) == brute(rows)
    assert any(r[1] == 0 and r[4] > 1 for r in found(spark, rows))


def test_turnless_conversations_and_no_conversations(spark):
    # all of a single short conversation's own turns lie before its cut, and its group has no first one
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "too")]
    empty = hashlib.sha256(str(c).encode()).hexdigest()
    assert found(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, empty)]
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "lost")]) == []


def test_divergence_is_refined_only_where_siblings_differ(spark):
    rows = [(c * 5, t, "user", f"t{t}" if t < 11 or c == 0 else f"other{t}") for c in range(2) for t in range(16)]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], SCHEMA)
    turns = trie.placed(df)
    groups = trie.block_groups(trie.blocks(turns, 4)).collect()
    assert sorted((g.turns[0].depth, g.n_convs, g.alone) for g in groups) == [(1, 2, True), (5, 2, True), (9, 1, False), (9, 1, False),
                                                                              (13, 1, True), (13, 1, True)]
