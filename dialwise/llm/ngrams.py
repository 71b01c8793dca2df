"""Interpolated modified Kneser-Ney bigram model over the whole corpus.

Counted by Spark, stored as sorted hash arrays in the shared folder, mapped by
the workers that score.

* Vocabulary: training tokens with their counts. A token's place in the sorted
  hash array is its number.
* Bigrams: every task adds up the pairs of its own texts and passes them on in
  sorted blocks, one per shard. A shard is named by the context, or by the pair
  where the context alone would fill more than a part of a shard; so no context
  is too large for a task. Shards follow the number of tokens.
* A shard's pairs give its contexts' follower counts and its words' numbers of
  distinct predecessors; these go, again as sorted blocks, to the vocabulary's
  shards.

The lowest order is interpolated with the uniform distribution over the
vocabulary and one unknown token. Sums are taken of integers, log10
probabilities in steps of 1e-7, so they do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm import hasharrays
from dialwise.llm.common import Shared, id_and_text, map_batches, query, shared_path, store, table
from dialwise.llm.hasharrays import HashArrays
from dialwise.llm.words import SPACED, Chunk, chunks, mix, span_hashes, spans

PAIRS_PER_SHARD = 1 << 22
HELD = 1 << 21
UNIT = 1e7
END = np.uint64(0xE4D0_0000_0000_0001)
START = (1 << 32) - 1


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end, and where each text's tokens begin."""
    low = chunk.lower()
    starts, ends, bounds = spans(low, SPACED)
    words = span_hashes(low.data, starts, ends)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


class Counter:
    """Sorted distinct keys with their counts; additions are merged in steps."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n.astype(np.int64)))
        self.waiting += len(found)
        if self.waiting > 2 * HELD:
            self.parts = [self.total()]
            self.waiting = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return add_up(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts \
            else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts, self.waiting = self.total(), [], 0
        return out


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte planes apart, which the shuffle's codec shrinks well."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return planes(steps)


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


BLOCK = "shard int, keys binary, counts binary"


def blocks(shards: np.ndarray, keys: np.ndarray, *counts: np.ndarray) -> dict:
    """A row per shard with its keys in order; several counts stand one after the other."""
    order = np.argsort(shards, kind="stable")
    edge = np.flatnonzero(np.diff(shards[order])) + 1
    cuts = [o for o in np.split(order, edge) if len(o)]
    return {"shard": [int(shards[o[0]]) for o in cuts], "keys": [pack(keys[o]) for o in cuts],
            "counts": [planes(np.concatenate([c[o] for c in counts])) for o in cuts]}


def to_batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), pa.array(rows["keys"], pa.binary()),
                                       pa.array(rows["counts"], pa.binary())], ["shard", "keys", "counts"])


def open_blocks(group: pa.Table, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, counts = [], [[] for _ in range(columns)]
    for k, c in zip(group.column("keys"), group.column("counts")):
        keys.append(unpack(k.as_py()))
        for held, part in zip(counts, np.split(from_planes(c.as_py()), columns)):
            held.append(part)
    return np.concatenate(keys), [np.concatenate(c).astype(np.int64) for c in counts]


def discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from the numbers of keys that occur once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    after = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 * k
    return [after(1, n1, n2), after(2, n2, n3), after(3, n3, n4)]


@dataclass
class Model:
    """Stored arrays: vocabulary with count, continuations and follower counts; pairs by shard."""

    uri: str
    vocabulary: HashArrays
    pair_shards: int
    pair_rows: dict[int, int]
    full_context: int
    n_tokens: int
    n_texts: int
    start_followers: tuple[int, int, int]
    pair_discounts: list[float]
    word_discounts: list[float]
    word_classes: list[int]
    n_pairs: int

    def shard(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        return pair_shard(keys, context_counts, self.full_context, self.pair_shards)

    def pair_counts(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        """Training counts of pairs, 0 where unseen."""
        out, shards = np.zeros(len(keys), np.int64), self.shard(keys, context_counts)
        for s in np.unique(shards).tolist():
            if not self.pair_rows.get(s):
                continue
            rows = np.flatnonzero(shards == s)
            held, counts = self.vocabulary.part("pair", s), self.vocabulary.part("pair-count", s)
            place = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
            out[rows] = np.where(held[place] == keys[rows], counts[place], 0)
        return out

    def score(self, chunk: Chunk) -> dict:
        """Per text: tokens, known tokens, base and model log10 probability."""
        words, bounds = tokens(chunk)
        found, which = np.unique(words, return_inverse=True)
        number = self.vocabulary.find(found)
        known = number >= 0
        held = lambda name: spread(known, self.vocabulary.values(name, number[known]))
        count, before = held("count"), held("before")
        types = len(self.vocabulary)
        base = fixed(np.log10((count + 1) / (self.n_tokens + types + 1)))
        # lowest order: continuation counts, discounted, and the uniform rest
        d = np.array([0.0, *self.word_discounts])
        all_before = max(self.n_pairs, 1)
        left = sum(a * b for a, b in zip(self.word_discounts, self.word_classes)) / all_before if self.n_pairs else 1.0
        low = np.maximum(before - d[np.minimum(before, 3)], 0) / all_before + left / (types + 1)
        # contexts
        follow = np.stack([held(f"follow{k}") for k in (1, 2, 3)], 1)
        follow = np.vstack([follow, np.array(self.start_followers)[None]])
        context_count = np.append(count, self.n_texts)
        context_number = np.append(number, START)
        context = np.empty(len(words), np.int64)
        context[1:] = which[:-1]
        context[bounds[:-1]] = len(found)
        pair = context * len(found) + which
        pairs, pair_of = np.unique(pair, return_inverse=True)
        h, w = pairs // max(len(found), 1), pairs % max(len(found), 1)
        seen = np.flatnonzero((context_number[h] >= 0) & known[w])
        keys = (context_number[h[seen]].astype(np.uint64) << np.uint64(32)) | number[w[seen]].astype(np.uint64)
        order = np.argsort(keys)
        n = np.zeros(len(pairs), np.int64)
        n[seen[order]] = self.pair_counts(keys[order], context_count[h[seen[order]]])
        e = np.array([0.0, *self.pair_discounts])
        rows = np.maximum(context_count, 1)
        gamma = np.where(context_count > 0, follow @ np.array(self.pair_discounts) / rows, 1.0)
        p = np.where(context_count[h] > 0, np.maximum(n - e[np.minimum(n, 3)], 0) / rows[h], 0.0) + gamma[h] * low[w]
        log_p = fixed(np.log10(np.maximum(p, 1e-300)))
        size = np.diff(bounds)
        per_text = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else np.zeros(0, np.int64)
        return {"n_tokens": size, "n_known": per_text(known[which].astype(np.int64)),
                "base_score": per_text(base[which]) / UNIT, "score": per_text(log_p[pair_of]) / UNIT}


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def spread(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(known), np.int64)
    out[known] = values
    return out


def pair_shard(keys: np.ndarray, context_counts: np.ndarray, full: int, shards: int) -> np.ndarray:
    by = np.where(context_counts > full, keys, keys >> np.uint64(32))
    return (mix(by) % np.uint64(shards)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the model over all rows of ``docs``. Null texts count as empty; each text has one end."""
    spark = docs.sparkSession
    uri = shared_path(spark, "ngrams")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        row = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], ["word_key", "n"])
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.add(tokens(chunk)[0])
                if held.waiting > HELD:
                    yield row(*held.take())
        yield row(*held.take())

    counts = store(texts.mapInArrow(count_words, T.StructType.fromDDL("word_key long, n long"))
                   .groupBy("word_key").agg(F.sum("n").alias("n")))
    types, n_tokens = counts.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    end_row = counts.where(F.col("word_key") == F.lit(int(END.astype(np.int64)))).first()
    n_texts = end_row["n"] if end_row else 0
    vocabulary = hasharrays.write(counts, "word_key", types, uri, lambda t: {"count": t.column("n").to_numpy()})
    shards = max(1, -(-n_tokens // PAIRS_PER_SHARD))
    full = PAIRS_PER_SHARD // 16

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def flush() -> pa.RecordBatch:
            keys, n = held.take()
            contexts, back = np.unique(keys >> np.uint64(32), return_inverse=True)
            size = np.full(len(contexts), n_texts, np.int64)
            real = contexts != START
            size[real] = vocabulary.values("count", contexts[real].astype(np.int64))
            return to_batch(blocks(pair_shard(keys, size[back], full, shards), keys, n))

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                words, bounds = tokens(chunk)
                found, which = np.unique(words, return_inverse=True)
                number = vocabulary.find(found).astype(np.uint64)[which]
                context = np.empty_like(number)
                context[1:] = number[:-1]
                context[bounds[:-1]] = START
                held.add((context << np.uint64(32)) | number)
                if held.waiting > HELD:
                    yield flush()
        if held.waiting:
            yield flush()

    bits = vocabulary.bits

    def add_pairs(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        keys, (n,) = open_blocks(group, 1)
        keys, n = add_up(keys, n)
        hasharrays.put(uri, f"pair-{shard}.npy", keys)
        hasharrays.put(uri, f"pair-count-{shard}.npy", n)
        out = []
        contexts, first = np.unique(keys >> np.uint64(32), return_index=True)
        kinds = [np.add.reduceat(((n == k) if k < 3 else (n >= 3)).astype(np.int64), first) for k in (1, 2, 3)]
        special = contexts == START
        head = [int(k[special].sum()) for k in kinds]
        words, before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        of = lambda numbers: np.searchsorted(vocabulary.base, numbers.astype(np.int64), "right") - 1
        rows = blocks(of(contexts[~special]), contexts[~special], *[k[~special] for k in kinds])
        more = blocks(of(words), words, before)
        classes = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        kind = ["follow"] * len(rows["shard"]) + ["before"] * len(more["shard"]) + ["pairs"]
        return pa.table({"kind": kind, "shard": pa.array(rows["shard"] + more["shard"] + [shard], pa.int32()),
                         "keys": pa.array(rows["keys"] + more["keys"] + [b""], pa.binary()),
                         "counts": pa.array(rows["counts"] + more["counts"] + [b""], pa.binary()),
                         "facts": pa.array([None] * (len(kind) - 1) + [[len(keys), *classes, *head]], pa.list_(pa.int64()))})

    pairs = texts.mapInArrow(count_pairs, T.StructType.fromDDL(BLOCK)).groupBy("shard") \
        .applyInArrow(add_pairs, f"kind string, {BLOCK}, facts array<long>")
    pairs = store(pairs)
    facts = {r["shard"]: r["facts"] for r in pairs.where("kind = 'pairs'").select("shard", "facts").collect()}
    total = [sum(f[k] for f in facts.values()) for k in range(8)]

    def add_words(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        n, base = int(vocabulary.base[shard + 1] - vocabulary.base[shard]), int(vocabulary.base[shard])
        columns = {name: np.zeros(n, np.int64) for name in ("before", "follow1", "follow2", "follow3")}
        for kind, names in (("before", ["before"]), ("follow", ["follow1", "follow2", "follow3"])):
            part = group.filter(pa.compute.equal(group.column("kind"), kind))
            if len(part):
                keys, counts = open_blocks(part, len(names))
                for name, values in zip(names, counts):
                    np.add.at(columns[name], keys.astype(np.int64) - base, values)
        for name, values in columns.items():
            hasharrays.put(uri, f"{name}-{shard}.npy", values)
        classes = [int((columns["before"] == k).sum()) for k in (1, 2, 3, 4)] + [int((columns["before"] >= 3).sum())]
        return pa.table({"classes": pa.array([classes], pa.list_(pa.int64()))})

    found = pairs.where("kind != 'pairs'").groupBy("shard").applyInArrow(add_words, "classes array<long>").collect()
    words = [sum(r["classes"][k] for r in found) for k in range(5)]
    return Model(uri, vocabulary, shards, {s: f[0] for s, f in facts.items()}, full, n_tokens, n_texts, tuple(total[5:8]),
                 discounts(total[1:5]), discounts(words[:4]), [words[0], words[1], words[4]], total[0])


def is_held_out(id_column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    shared = Shared(docs.sparkSession, model)

    def run(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(chunk.rows.start, len(chunk)), **shared.value.score(chunk),
                   "train_tokens": np.full(len(chunk), model.n_tokens)}

    return map_batches(id_and_text(docs, id_col, text_col), run,
                       "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds ``perplexity``, ten to the mean negative log10 probability of a text's tokens."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _discount_sql(name: str, k: int) -> str:
    """Of count ``k`` from the counts of counts ``name1`` to ``name4``, as in ``discounts``."""
    a, b = f"{name}{k}", f"{name}{k + 1}"
    share = f"CASE WHEN {name}1 > 0 THEN {name}1 / ({name}1 + 2 * {name}2) ELSE 0 END"
    return f"CASE WHEN {a} > 0 THEN least(greatest({k} - {k + 1} * ({share}) * {b} / {a}, 0), {k}) ELSE 0.5 * {k} END::DOUBLE"


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(crc32_mod, -1) = 2 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+'), ' ') AS w
  FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))),
    4294967295::BIGINT) % 7 AS crc32_mod FROM documents)),
pos AS (SELECT rid, held_out, unnest(w) AS w, unnest(list_prepend('  ', w[1:len(w) - 1])) AS h FROM docs),
uni AS (SELECT w, count(*) AS c FROM pos WHERE NOT held_out GROUP BY w),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM uni),
bi AS (SELECT h, w, count(*) AS n FROM pos WHERE NOT held_out GROUP BY h, w),
cont AS (SELECT w, count(*) AS cc FROM bi GROUP BY w),
ctx AS (
  SELECT h, sum(n) AS t, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2, count(*) FILTER (n >= 3) AS f3
  FROM bi GROUP BY h),
cb AS (
  SELECT count(*) AS pairs, count(*) FILTER (n = 1) AS b1, count(*) FILTER (n = 2) AS b2, count(*) FILTER (n = 3) AS b3,
    count(*) FILTER (n = 4) AS b4 FROM bi),
cw AS (
  SELECT count(*) FILTER (cc = 1) AS w1, count(*) FILTER (cc = 2) AS w2, count(*) FILTER (cc = 3) AS w3,
    count(*) FILTER (cc = 4) AS w4, count(*) FILTER (cc >= 3) AS more FROM cont),
k AS (
  SELECT *, {_discount_sql('b', 1)} AS d1, {_discount_sql('b', 2)} AS d2, {_discount_sql('b', 3)} AS d3,
    {_discount_sql('w', 1)} AS e1, {_discount_sql('w', 2)} AS e2, {_discount_sql('w', 3)} AS e3 FROM cb, cw, size),
seen AS (SELECT DISTINCT h, w FROM pos),
priced AS (
  SELECT seen.h, seen.w, uni.c IS NOT NULL AS known, log10((coalesce(c, 0) + 1) / (k.n + v + 1)) AS base,
    greatest(coalesce(cc, 0) - CASE coalesce(cc, 0) WHEN 0 THEN 0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, 0) / greatest(pairs, 1)
      + (CASE WHEN pairs > 0 THEN (e1 * w1 + e2 * w2 + e3 * more) / pairs ELSE 1 END) / (v + 1) AS low,
    CASE WHEN t > 0 THEN greatest(coalesce(bi.n, 0)
      - CASE coalesce(bi.n, 0) WHEN 0 THEN 0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END, 0) / t ELSE 0 END AS high,
    CASE WHEN t > 0 THEN (d1 * f1 + d2 * f2 + d3 * f3) / t ELSE 1 END AS gamma
  FROM seen CROSS JOIN k LEFT JOIN uni USING (w) LEFT JOIN cont USING (w) LEFT JOIN ctx USING (h) LEFT JOIN bi USING (h, w)),
told AS (
  SELECT rid, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, sum(round(base * {UNIT})::BIGINT) / {UNIT}::DOUBLE AS base_score,
    sum(round(log10(high + gamma * low) * {UNIT})::BIGINT) / {UNIT}::DOUBLE AS score
  FROM pos JOIN priced USING (h, w) GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, (SELECT n FROM size) AS train_tokens, base_score, score FROM docs JOIN told USING (rid)
"""


@query("op5_lm_scoring", ORACLE)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out("doc_id")))
    return score(docs, model).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
