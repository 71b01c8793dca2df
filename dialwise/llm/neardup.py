"""Near-duplicate documents by SetSketch registers over five-word shingles.

1. One scan makes, per document, the number of distinct shingles, a digest of
   the set, and the registers: exponentially spaced truncated minima, one byte
   each. Registers of a union are the larger of both, so sketches merge.
2. Documents with the same set are one node from here on.
3. Fixed selections of registers are hashed to band keys. Nodes that share a
   key are candidates; a bucket is never listed, only its chosen member.
4. A candidate's similarity is estimated jointly by likelihood from the counts
   of larger, smaller and equal registers; hopeless pairs go.
5. The rest are verified on the full shingle sets of the whole texts.

Links only matter through what they connect. A round compares every member of a
bucket with one chosen member; confirmed links are merged, and the next round
looks only at buckets that still hold several components. At the end all pairs
of different components within a bucket are tested, but for those that cannot
be links because too few of their shingles occur in any other component. So no
connection between candidates is lost, and near misses in a large group are not
compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import batches_of, free_name, id_and_text, map_batches, query, quoted, store, table
from dialwise.llm.components import components, merged
from dialwise.llm.words import SPACED, Chunk, chunks, mix, ngrams, odd_numbers, span_hashes, spans

SHINGLE = 5
PERCENT = 75
REGISTERS = 256
BAND_ROWS = 7
BANDS = 96
BASE = 1.2
RATE = 20.0
TOP = 254
#: twice the drop in log likelihood at which a pair is given up: below 1e-8 for a true link
HOPELESS = 34.0
#: pairs per open band row up to which they are listed without another round of stars
LIST_PAIRS = 4
#: rounds of comparisons with chosen members
STARS = 1
#: members of a bucket that meet in one group of ``every_pair``
BLOCK = 512
#: rows per Arrow batch, so that two workers of an executor stay within a few hundred MB
TEXTS = 1000

_FACTORS = odd_numbers(REGISTERS, 11)
_BAND_PICKS = np.stack([np.random.default_rng(100 + b).choice(REGISTERS, BAND_ROWS, replace=False) for b in range(BANDS)])
_BAND_STEPS = odd_numbers(BAND_ROWS, 12)
_BAND_SALTS = odd_numbers(BANDS, 13)


def shingle_sets(chunk: Chunk) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a short text is one shingle, an empty one none."""
    low = chunk.lower()
    starts, ends, bounds = spans(low, SPACED)
    words = span_hashes(low.data, starts, ends)
    grams = ngrams(words, SHINGLE)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(grams[a:b - SHINGLE + 1]))
        else:
            sets.append(ngrams(words[a:b], b - a) if b > a else words[:0])
    return sets


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    step = 1 << 9
    for at in range(0, len(values), step):
        np.minimum(least, (values[at:at + step][None, :] * _FACTORS[:, None]).min(1), out=least)
    return quantise(least)


def quantise(least: np.ndarray) -> np.ndarray:
    spread = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64 * (1 - 2.0 ** -53)) / RATE
    return np.clip(np.floor(1 - np.log(spread) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for every row of registers."""
    picked = sketches[:, _BAND_PICKS].astype(np.uint64) + np.uint64(1)
    return mix((picked * _BAND_STEPS).sum(2) * np.uint64(0x9E3779B97F4A7C15) + _BAND_SALTS)


def _log_likelihood(more, less, same, u, j):
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-300))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limit: float = PERCENT / 100):
    """Maximum-likelihood similarity of sketch pairs, and twice the log likelihood lost at ``limit``.

    The second is 0 where the estimate is ``limit`` or more.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    most = np.minimum(u / (1 - u), (1 - u) / u)
    low, high = np.zeros(len(u)), most * (1 - 1e-9)
    for _ in range(40):  # the likelihood is concave: halve by thirds
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = _log_likelihood(more, less, same, u, x) < _log_likelihood(more, less, same, u, y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    best = (low + high) / 2
    at = np.minimum(limit, most * (1 - 1e-9))
    lost = 2 * (_log_likelihood(more, less, same, u, best) - _log_likelihood(more, less, same, u, at))
    return best, np.where(best >= at, 0.0, np.maximum(lost, 0.0))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text and a hash of the text, which tells rows apart that repeat an id."""
    return id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """``keyed`` rows to ``doc_id, n_shingles, node, registers, text_key``.

    ``node`` is a digest of the shingle set, null when it is empty.
    """

    def run(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(1)):
            sets = shingle_sets(chunk)
            yield {"doc_id": batch.column(0).slice(chunk.rows.start, len(chunk)), "n_shingles": [len(s) for s in sets],
                   "text_key": batch.column(2).slice(chunk.rows.start, len(chunk)),
                   "node": [int((mix(s).sum() ^ np.bitwise_xor.reduce(s)).astype(np.int64)) if len(s) else None for s in sets],
                   "registers": [registers(s).tobytes() if len(s) else None for s in sets]}

    return map_batches(docs, run, "doc_id long, n_shingles long, node long, registers binary, text_key long")


def banded(nodes: DataFrame) -> DataFrame:
    """``(key, node)`` for every node and band."""

    def run(batch: pa.RecordBatch):
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            yield {"key": band_keys(rows).astype(np.int64).ravel(), "node": np.repeat(part.column(0).to_numpy(), BANDS)}

    return map_batches(nodes.select("node", "registers"), run, "key long, node long")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, guess)`` for the pairs that may be links, by size and by joint likelihood."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    sizes = pairs.join(side("a"), "a").join(side("b"), "b") \
        .where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)") \
        .select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batch: pa.RecordBatch):
        if not len(batch):
            return
        sketches = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (4, 5)]
        guess, lost = estimate(*sketches, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
        keep = pa.array(lost <= HOPELESS)
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep), "guess": guess[lost <= HOPELESS]}

    return map_batches(sizes, run, "a long, b long, guess double")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, linked)`` by intersecting the full shingle sets of both texts."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batch: pa.RecordBatch):
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            left = [s for c in chunks(part.column(2)) for s in shingle_sets(c)]
            right = [s for c in chunks(part.column(3)) for s in shingle_sets(c)]
            linked = []
            for x, y in zip(left, right):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield {"a": part.column(0), "b": part.column(1), "linked": linked}

    return map_batches(both, run, "a long, b long, linked boolean")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, text_key, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that links reach, itself included.
    Texts that are null, empty or without words have no shingles and stay
    alone. Rows without an id take no part: their component is null and they
    are kept. Repeated rows share their component; an empty table gives none.
    """
    slim = keyed(docs, id_col, text_col)
    with batches_of(docs.sparkSession, TEXTS):
        sketched = store(sketch(slim))
    usable = sketched.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = store(usable.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"),
                                             F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
                  .select("node", "first.doc_id", "first.text_key", "n_shingles", "registers"))
    with batches_of(docs.sparkSession, TEXTS):
        roots = connect(nodes, slim)
    members = nodes.select("node", "doc_id").join(roots, "node", "left") \
        .select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    # stored, so that the join deals both sides anew and a large component can be split
    least = store(members.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = members.join(least, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sketched.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")) \
        .join(named, "node", "left") \
        .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def connect(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, root)`` for nodes that are linked with another."""
    bands = banded(nodes)
    shared = bands.groupBy("key").agg(F.count("node").alias("n"), F.min("node").alias("chosen")).where("n > 1")
    rows = store(bands.join(shared, "key").select("key", "node", "chosen"))
    sketches = store(nodes.join(rows.select("node").distinct(), "node", "left_semi"))
    texts = store(sketches.select("node", "doc_id", "text_key").join(docs, ["doc_id", "text_key"])
                  .dropDuplicates(["node"]).select("node", "text"))
    pairs = rows.where("node != chosen").select(F.least("chosen", "node").alias("a"), F.greatest("chosen", "node").alias("b"))
    tested, roots, stars = None, None, 1
    while True:
        ranked = store(likely(untested(pairs, tested), sketches))
        # each node's most promising partner decides; the others follow if they still matter
        best = ranked.groupBy("a").agg(F.max_by("b", F.struct("guess", "b")).alias("b")).unionByName(
            ranked.groupBy("b").agg(F.max_by("a", F.struct("guess", "a")).alias("a"))).distinct()
        found = store(verified(best, texts))
        links = found.where("linked").select("a", "b")
        roots = store(components(links)) if roots is None else merged(roots, links)
        open_rows = store(still_open(rows, roots))
        n_rows, n_pairs = open_size(open_rows)
        if not n_rows:
            return roots
        if stars == STARS or n_pairs <= LIST_PAIRS * n_rows:
            return merged(roots, store(every_pair(open_rows, texts, sketches)))
        tested = found if tested is None else tested.unionByName(found)
        pairs, stars = star_pairs(open_rows), stars + 1


def untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    pairs = pairs.distinct()
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``(key, node, root)`` of the buckets that hold several components."""
    labelled = rows.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    return labelled.join(mixed.select("key"), "key")


def open_size(rows: DataFrame) -> tuple[int, int]:
    """Rows of open buckets, and how many pairs ``every_pair`` would compare."""
    per_key = rows.groupBy("key", "root").agg(F.count("node").alias("n")) \
        .groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    n, pairs = per_key.agg(F.sum("n"), F.sum(F.expr("(n - most) * n"))).first()
    return n or 0, pairs or 0


def star_pairs(rows: DataFrame) -> DataFrame:
    """Every member of an open bucket with one member, another one in every bucket."""
    chosen = rows.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64("node", "key")).alias("chosen"))
    return rows.join(chosen, "key").where("root != chosen.root") \
        .select(F.least("node", "chosen.node").alias("a"), F.greatest("node", "chosen.node").alias("b"))


def common_bound(rows: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(node, n_shingles, common)``: how many of a node's shingles any open node of another component has.

    No pair across components can have more in common than the smaller of the
    two bounds. Copies that were changed in too many places, each in its own,
    are ruled out by it without being compared with each other.
    """
    labelled = rows.select("node", "root").distinct().join(texts, "node")

    def run(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(2)):
            sets = shingle_sets(chunk)
            owner = pa.array(np.repeat(np.arange(len(sets)) + chunk.rows.start, [len(s) for s in sets]))
            yield {"shingle": np.concatenate(sets).astype(np.int64), "node": batch.column(0).take(owner),
                   "root": batch.column(1).take(owner)}

    shingled = map_batches(labelled.select("node", "root", "text"), run, "shingle long, node long, root long")
    shared = store(shingled.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
                   .select("shingle"))
    return store(shingled.join(shared, "shingle").groupBy("node").agg(F.count("shingle").alias("common"))
                 .join(sketches.select("node", "n_shingles"), "node"))


def every_pair(rows: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between all pairs of different components within a bucket that the bounds allow.

    The members outside a bucket's main component meet all its members, both in
    blocks of ``BLOCK``, so that a group of any size is spread over tasks. A pair
    is judged in the first band it shares, by likelihood and then on the full
    sets; only links leave the task.
    """
    # a link needs 100 * common >= PERCENT * (n_a + n_b - common), and n_b is at least as large as common
    able = common_bound(rows, texts, sketches).where(f"100 * common >= {PERCENT} * n_shingles").select("node", "common")
    left = store(still_open(rows.select("key", "node").join(able.select("node"), "node"), rows.select("node", "root").distinct()))
    per_root = left.groupBy("key", "root").agg(F.count("node").alias("n"))
    per_key = per_root.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"),
                                          F.max("n").alias("most")) \
        .select("key", "main", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("blocks"),
                F.expr(f"(n - most + {BLOCK - 1}) div {BLOCK}").alias("few_blocks"))
    placed = left.join(per_key, "key").withColumn("few", F.col("root") != F.col("main"))
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    whole = placed.select("key", "node", "root", "few", of("blocks").alias("block"), F.explode(each("few_blocks")).alias("few_block"),
                          F.lit(False).alias("asks"))
    few = placed.where("few").select("key", "node", "root", "few", F.explode(each("blocks")).alias("block"),
                                     of("few_blocks").alias("few_block"), F.lit(True).alias("asks"))
    payload = sketches.select("node", "n_shingles", "registers").join(able, "node").join(texts, "node")
    rows = whole.unionByName(few).join(payload, "node") \
        .select("key", "block", "few_block", "asks", "few", "node", "root", "n_shingles", "common", "registers", "text")
    dealt = rows.repartition("key", "block", "few_block").sortWithinPartitions("key", "block", "few_block", "asks")
    return dealt.mapInArrow(judge_buckets, "a long, b long").distinct()


def judge_buckets(batches):
    """Rows in order of bucket and blocks, cut between groups and judged one by one."""
    waiting = []
    for batch in batches:
        group = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
        edge = (np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist()
        if waiting and len(batch) and [waiting[-1].column(c)[0].as_py() for c in range(3)] != group[0].tolist():
            yield from judged(waiting)
            waiting = []
        at = 0
        for to in edge:
            yield from judged([*waiting, batch.slice(at, to - at)])
            waiting, at = [], to
        if at < len(batch):
            waiting.append(batch.slice(at))
    if waiting:
        yield from judged(waiting)


def judged(parts: list[pa.RecordBatch]):
    """Links between the rows that ask and the others of one group."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    asks = rows.column("asks").to_numpy()
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(a) or not len(b):
        return
    number = lambda c: rows.column(c).to_numpy()
    node, root, few, n, common = (number(c) for c in ("node", "root", "few", "n_shingles", "common"))
    x, y = a[:, None], b[None]
    able = (root[x] != root[y]) & (~few[y] | (node[x] < node[y])) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) \
        & ((100 + PERCENT) * np.minimum(common[x], common[y]) >= PERCENT * (n[x] + n[y]))
    i, j = np.nonzero(able)
    if not len(i):
        return
    x, y = a[i], b[j]
    sketches = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    keys = band_keys(sketches)
    here = int(np.argmax(keys[0] == np.uint64(rows.column("key")[0].as_py() & 0xFFFFFFFFFFFFFFFF)))
    new = np.concatenate([(keys[x[k:k + 4096]] == keys[y[k:k + 4096]]).argmax(1) for k in range(0, len(x), 4096)]) == here
    x, y = x[new], y[new]
    keep = [np.zeros(0, bool)]
    for k in range(0, len(x), 4096):
        p, q = x[k:k + 4096], y[k:k + 4096]
        keep.append(estimate(sketches[p], sketches[q], n[p].astype(float), n[q].astype(float))[1] <= HOPELESS)
    keep = np.concatenate(keep)
    x, y = x[keep], y[keep]
    used = np.unique(np.concatenate([x, y]))
    sets = dict(zip(used.tolist(), (s for c in chunks(rows.column("text").take(pa.array(used))) for s in shingle_sets(c))))
    links = []
    for p, q in zip(x.tolist(), y.tolist()):
        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        if 100 * both >= PERCENT * (n[p] + n[q] - both):
            links.append((node[p], node[q]))
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([min(l) for l in links], pa.int64()), pa.array([max(l) for l in links], pa.int64())],
                                         ["a", "b"])


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; all columns as they were.

    Rows without an id or without words stay. Of rows that repeat an id
    together with its text one stays.
    """
    linked = store(link(docs, id_col, text_col))
    key = free_name(docs, "text_key")
    marked = docs.withColumn(key, F.xxhash64(F.col(quoted(text_col)).cast("string")))
    gone = linked.where("NOT kept").select(F.col("doc_id").alias(f"{key}id"), F.col("text_key").alias(f"{key}of")).distinct()
    rest = marked.join(gone, (marked[quoted(id_col)].cast("long") == gone[f"{key}id"]) & (marked[key] == gone[f"{key}of"]), "left_anti")
    if not linked.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        lone = f"`{id_col}` IS NULL OR NOT `{text_col}` RLIKE '[^\\\\x20\\\\x09-\\\\x0D]' OR `{text_col}` IS NULL"
        rest = rest.where(lone).unionByName(rest.where(f"NOT ({lone})").dropDuplicates([id_col, key]))
    return rest.drop(key)


@query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    return link(table(spark, sf_dir, "documents")).drop("text_key")
