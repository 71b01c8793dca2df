"""Prefix trie of conversations by fixed-length block hashing.

A prefix is named by 128 bits: the exclusive or of hashes of (place, role, text)
over its turns, so longer prefixes follow from shorter ones by running totals.

1. Turns get places, conversations are rebuilt, and texts are left behind.
2. ``BLOCK`` turns make a block, known by the prefixes before and after it.
   Equal blocks are grouped first: a thousand copies are one row from here on.
3. Where all conversations that pass a block's start go on with the same block,
   its turns are nodes as they stand. Only where siblings diverge, its turn
   boundaries are refined: the prefixes after each turn are grouped.
4. Sums over subtrees need no walk. A node belongs to its smallest member; a
   conversation's own nodes are the lower end of its path. So a node's subtree is
   made of its members' own nodes, but for those above it, which only its owner has:
   sums over members of their own totals, by the same grouping of blocks, less a running total.

No step gathers a conversation or a node's members in one place: places and
running totals go by chunks of ``CHUNK``, ids for the digests by ranges of ``PIECE``,
and children of the few parents that have very many look them up in a
broadcast table, of at most ``HOT`` rows by construction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm.common import query, quoted, store, table

BLOCK = 4
CHUNK = 4096
PIECE_BITS = 16
#: parents with more children than ``MANY`` and more than a share of 1 / ``HOT`` of all nodes are few
HOT = 200
MANY = 1000
#: the contract's rebuilding: groups of conversations, and turns taken from the group's first one
GROUP = 5
HEADS = 9


def placed(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, h1, h2, n_bytes``: a row for every turn, places from 0 in order of turn, null first.

    Rows that share a turn number are ordered by role and text; repeated rows
    count as often as they occur. Null roles and texts are empty. Rows without
    a conversation id belong to no conversation and go.
    """
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1 << 60))
    rows = turns.select(F.col(quoted(id_col)).cast("long").alias("conv_id"), F.col(quoted(turn_col)).cast("long").alias("turn"),
                        F.coalesce(F.col(quoted(role_col)).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text")) \
        .where("conv_id IS NOT NULL").withColumn("chunk", chunk)
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    local = rows.withColumn("at", F.row_number().over(inner) - 1) \
        .select("conv_id", "chunk", "at", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"),
                F.octet_length("text").cast("long").alias("n_bytes"))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("role").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return local.join(first, ["conv_id", "chunk"]).select("conv_id", (F.col("at") + F.col("first")).alias("place"), "h1", "h2", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first of their group.

    ``placed`` turns to such turns and ``conv_id, length`` of every conversation, turnless ones included.
    """
    convs = turns.groupBy("conv_id").agg(F.count("place").alias("n")) \
        .select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
                (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = store(convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).drop("n_base"))
    borrowed = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base") \
        .join(convs.select("base", "conv_id", "h"), "base").where("place < h").select("conv_id", "place", "h1", "h2", "n_bytes")
    # a long conversation meets its own row by chunk, not all in one place
    chunk = lambda c: (c / CHUNK).cast("long")
    shifts = convs.where("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), chunk(F.col("n") - 1))).alias("chunk"))
    own = turns.withColumn("chunk", chunk(F.col("place"))).join(shifts, ["conv_id", "chunk"]).where("place >= h") \
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "n_bytes")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return borrowed.unionByName(own), convs.select("conv_id", length.alias("length"))


def running(rows: DataFrame, key: str, order: str, size: int, values: dict[str, Column], fold) -> DataFrame:
    """Adds, per name in ``values``, the fold of the values of all rows of the same key that come before.

    In two levels, so that a key of any size is spread: within ranges of ``size`` of the order, and over the ranges.
    """
    rows = rows.withColumn("range", (F.col(order) / size).cast("long"))
    inner = Window.partitionBy(key, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(key, "range").agg(*[fold(v).alias(f"all_{name}") for name, v in values.items()])
    outer = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(key, "range", *[F.coalesce(fold(f"all_{name}").over(outer), F.lit(0)).alias(f"from_{name}") for name in values])
    local = rows.withColumns({f"in_{name}": F.coalesce(fold(v).over(inner), F.lit(0)) for name, v in values.items()})
    join = lambda name: F.col(f"from_{name}").bitwiseXOR(F.col(f"in_{name}")) if fold is F.bit_xor else F.col(f"from_{name}") + F.col(f"in_{name}")
    return local.join(starts, [key, "range"]).select(*[c for c in rows.columns if c != "range"], *[join(name).alias(name) for name in values])


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, k, b1, b2, a1, a2, turns``: each conversation's blocks, the prefixes before and after them, and for
    each turn its depth, the prefixes before (``p1, p2``) and after it (``k1, k2``), and its bytes."""
    named = turns.select("conv_id", (F.col("place") / block).cast("long").alias("k"),
                         F.struct(F.col("place").alias("place"), F.xxhash64("place", "h1").alias("c1"), F.xxhash64("h2", "place").alias("c2"),
                                  "n_bytes").alias("turn"))
    grouped = named.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list("turn")).alias("raw"), F.bit_xor("turn.c1").alias("x1"),
                                                F.bit_xor("turn.c2").alias("x2"))
    whole = running(store(grouped), "conv_id", "k", CHUNK, {"b1": F.col("x1"), "b2": F.col("x2")}, F.bit_xor)

    def upto(c: str, start: str, n: Column) -> Column:
        return F.aggregate(F.slice("raw", F.lit(1), n), F.col(start), lambda acc, t: acc.bitwiseXOR(t[c]))

    turn = F.transform("raw", lambda t, i: F.struct((t["place"] + 1).alias("depth"), upto("c1", "b1", i).alias("p1"), upto("c2", "b2", i).alias("p2"),
                                                    upto("c1", "b1", i + 1).alias("k1"), upto("c2", "b2", i + 1).alias("k2"), t["n_bytes"].alias("n_bytes")))
    return whole.select("conv_id", "k", "b1", "b2", F.col("b1").bitwiseXOR(F.col("x1")).alias("a1"), F.col("b2").bitwiseXOR(F.col("x2")).alias("a2"),
                        turn.alias("turns"))


def block_groups(parts: DataFrame) -> DataFrame:
    """``a1, a2, conv_id, n_convs, turns, alone``: equal blocks, and whether all that pass their start go on with them."""
    groups = store(parts.groupBy("b1", "b2", "a1", "a2").agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"),
                                                             F.first("turns").alias("turns")))
    after = F.struct("a1", "a2")
    only = groups.groupBy("b1", "b2").agg(F.min(after).alias("lo"), F.max(after).alias("hi")).where("lo = hi") \
        .select("lo.a1", "lo.a2", F.lit(True).alias("only"))
    # joined by the prefix after the block, which is unique, so siblings of one start are not brought together
    return store(groups.join(only, ["a1", "a2"], "left").select("a1", "a2", "conv_id", "n_convs", "turns", F.coalesce("only", F.lit(False)).alias("alone")))


def refined(groups: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``k1, k2`` and ``values`` of every node: as they are inside blocks that stand alone, else folded over equal prefixes."""
    names = [c for c in groups.columns if c not in ("a1", "a2", "turns", "alone")]
    turns = lambda rows: rows.select(*names, F.explode("turns").alias("turn")).select(*names, "turn.*")
    kept = [c for c in turns(groups).columns if c in values]
    direct = turns(groups.where("alone")).select("k1", "k2", *kept)
    return direct.unionByName(turns(groups.where("NOT alone")).groupBy("k1", "k2").agg(*[values[c].alias(c) for c in kept]))


def nodes(groups: DataFrame, convs: DataFrame) -> DataFrame:
    """``k1, k2, p1, p2, depth, n_bytes, conv_id, n_convs``; the root's prefix is 0 and its parent null."""
    same = {c: F.min(c) for c in ("p1", "p2", "depth", "n_bytes")}
    found = refined(groups, {**same, "conv_id": F.min("conv_id"), "n_convs": F.sum("n_convs")})
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs")).where("n_convs > 0") \
        .select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), zero.alias("n_bytes"), "conv_id", "n_convs")
    return found.unionByName(root)


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` from ``k1, k2, conv_id``: ids join in ranges, and a task reads a node's ranges in order."""
    pieces = ends.groupBy("k1", "k2", F.shiftright("conv_id", PIECE_BITS).alias("piece")) \
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["k1", "k2", "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], ["k1", "k2", "ends_sha256"])

    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece") \
        .mapInArrow(run, T.StructType.fromDDL("k1 long, k2 long, ends_sha256 string"))


def parents(found: DataFrame) -> DataFrame:
    """``k1, k2, parent_conv_id`` of all nodes but the root."""
    limit = max(MANY, found.count() // HOT)
    owner = found.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    child, many = found.where("p1 IS NOT NULL").select("k1", "k2", "p1", "p2"), F.broadcast(owner.where(F.col("n_children") > limit))
    few = child.join(many, ["p1", "p2"], "left_anti").join(owner.where(F.col("n_children") <= limit), ["p1", "p2"])
    return child.join(many, ["p1", "p2"]).unionByName(few).select("k1", "k2", "parent_conv_id")


def trie(turns: DataFrame, convs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the conversations (``placed`` turns; ``convs`` has ``conv_id, length``).

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens`` (bytes of last texts that sharing saves, over the
    subtree) and ``ends_sha256`` (of the ids of conversations that end there).
    A table without conversations gives no rows, one with turnless ones only the root.
    """
    parts = store(blocks(turns, block))
    groups = block_groups(parts)
    found = store(nodes(groups, convs))
    children = found.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("depth").alias("n_children"))
    own = (F.col("n_convs") - 1) * F.col("n_bytes")
    found = store(running(found.join(children, ["k1", "k2"], "left").fillna(0, ["n_children"]), "conv_id", "depth", CHUNK, {"above": own}, F.sum))
    totals = store(found.groupBy("conv_id").agg(F.sum(own).alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
                   .where("saved > 0 OR leaves > 0").join(convs, "conv_id"))
    # a conversation's blocks meet its totals by ranges, and the block groups add them up
    chunk = lambda c: (c / CHUNK).cast("long")
    last = ((F.col("length") - 1) / block).cast("long")
    spread = totals.where("length > 0").select("conv_id", "saved", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), chunk(last))).alias("range"))
    summed = parts.select("conv_id", "a1", "a2", chunk(F.col("k")).alias("range")).join(spread, ["conv_id", "range"]) \
        .groupBy("a1", "a2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    sums = refined(groups.drop("conv_id", "n_convs").join(summed, ["a1", "a2"]), {"saved": F.sum("saved"), "leaves": F.sum("leaves")})
    zero = F.lit(0).cast("long")
    sums = sums.unionByName(totals.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(zero.alias("k1"), zero.alias("k2"), "saved", "leaves"))
    ended = convs.where("length > 0").select("conv_id", last.alias("k")).join(parts, ["conv_id", "k"]).select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "conv_id")
    ended = ended.unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    return found.join(sums, ["k1", "k2"]).join(parents(found), ["k1", "k2"], "left").join(end_digests(ended), ["k1", "k2"], "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                (F.col("saved") - F.col("above")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = """
WITH own AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))),
    4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT c FROM own)),
mixed AS (
  SELECT v.c, 0 AS part, place, role, txt FROM convs v JOIN own o ON o.c = v.c - v.c % 5 AND place < h
  UNION ALL SELECT c, 1, place, role, txt FROM convs JOIN own USING (c) WHERE place >= h),
turns AS (
  SELECT c, row_number() OVER turn AS depth, strlen(txt) AS bytes,
    string_agg(md5(strlen(role) || ':' || role || txt), '') OVER turn AS prefix
  FROM mixed WINDOW turn AS (PARTITION BY c ORDER BY part, place)),
member AS (SELECT c, depth, bytes, prefix FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS (SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM member GROUP BY prefix, depth),
child AS (SELECT left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT left(prefix, 32 * up) AS prefix, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM node LEFT JOIN child USING (prefix)) GROUP BY ALL),
ended AS (
  SELECT prefix, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS length FROM member) WHERE depth = length GROUP BY prefix)
SELECT node.conv_id, node.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (prefix) LEFT JOIN child USING (prefix) LEFT JOIN ended USING (prefix)
  LEFT JOIN node parent ON node.depth > 0 AND parent.prefix = left(node.prefix, 32 * (node.depth - 1))
"""


@query("op11_conversation_trie", ORACLE)
def op11(spark, sf_dir):
    return trie(*map(store, rebuilt(store(placed(table(spark, sf_dir, "conversations"))))))
