"""Sentencepiece encoding and decoding by a relational lattice.

1. Texts are cut into pre-tokens that no piece reaches across; the distinct
   pre-tokens of the whole table are the words to encode.
2. Every substring of a word up to the longest piece is exploded and equi-joined
   to the piece table, which has a few ten thousand rows by nature and is
   broadcast. A character that is no piece becomes its bytes.
3. The joined edges are grouped by word. Words are spread by key once; the
   explosion, the join and the grouping keep that partitioning.
4. A higher-order ``aggregate`` folds the lattice. For a unigram vocabulary it is
   the Viterbi recursion over end positions. A BPE vocabulary's scores are
   ranks of merges, for which the best sum is not the library's segmentation;
   there the fold goes through the lattice by rank and keeps the set of cut
   points, removing those that merges close.
5. The words' ids are stored as sorted hash arrays and mapped by the workers
   that write out the documents' ids, so texts are never shuffled.

Words of more than ``LONGEST`` characters (runs without any border) don't fit
the fold's 64-bit set of cut points and are merged by a heap in a small helper.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm import hasharrays
from dialwise.llm.common import Shared, batches_of, id_and_text, map_batches, query, shared_path, store, table
from dialwise.llm.pieces import SPACE, WIDE_CHUNK, Vocabulary, distinct_words, hashes, model_path
from dialwise.llm.words import chunks

LONGEST = 60
WORDS_PER_TASK = 20_000
#: rows per Arrow batch where texts are read, to bound a worker's memory
TEXTS = 1000


def piece_table(docs: DataFrame, vocabulary: Vocabulary, odd: set[str]) -> DataFrame:
    """``(piece, id, cost, odd)``."""
    return docs.sparkSession.createDataFrame([(p, i, -float(s), p in odd) for i, p, s in vocabulary.pieces],
                                             "piece string, id int, cost double, odd boolean")


def edges(words: DataFrame, pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(word_key, i, j, ends, inner, cost, odd, ids)``: pieces of a word from character ``i`` up to ``j``,
    which are also given as bits, and the cut points between them.

    Single characters always make an edge: their piece, their bytes, or the unknown piece.
    """
    longest = max((len(p) for _, p, _ in vocabulary.pieces), default=1)
    n = F.char_length("word")
    at = F.explode(F.sequence(F.lit(0), n - 1))
    spans = words.select("word_key", "word", at.alias("i")) \
        .select("word_key", "word", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.char_length("word"), F.col("i") + longest))).alias("j")) \
        .select("word_key", "i", "j", F.expr("substring(word, i + 1, j - i)").alias("piece"))
    joined = spans.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR j = i + 1")
    octets = F.hex(F.encode("piece", "utf-8"))
    as_bytes = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1),
                           lambda k: F.conv(F.substring(octets, 2 * k + 1, 2), 16, 10).cast("int") + (vocabulary.bytes_from or 0))
    fallback = as_bytes if vocabulary.bytes_from is not None else F.array(F.lit(vocabulary.unknown))
    return joined.select("word_key", "i", "j", cuts(F.col("i"), F.col("j")).alias("ends"), inner(F.col("i"), F.col("j")).alias("inner"),
                         "cost", "odd", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(fallback).alias("ids"))


def one_pass(lattice: Column, n: Column) -> Column:
    """The set of cut points, as bits, after all merges of a lattice in order of rank, then from the left.

    Right wherever every piece of the lattice is ``regular``.
    """
    return F.aggregate(lattice, bit(n + 1) - 1, lambda mask, e: F.when(
        (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1),
        mask.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(mask))


def step_by_step(lattice: Column, n: Column) -> Column:
    """As ``one_pass``, but looking for the best merge anew after every merge."""

    def step(mask: Column, _: Column) -> Column:
        fits = F.filter(lattice, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1))
        return F.coalesce(mask.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inner"])), mask)

    return F.aggregate(F.sequence(F.lit(1), n), bit(n + 1) - 1, step)


def irregular(vocabulary: Vocabulary) -> list[str]:
    """Pieces that merges of better-ranked pieces alone do not bring down to two parts.

    Where a word holds none of them, no merge can open up a better one: a
    piece's two parts rank better than the piece itself, and merges within its
    characters are the same in every word. So one pass in order of rank is the
    whole of the merging.
    """
    known = {p: (i, s) for i, p, s in vocabulary.pieces}
    return [p for _, p, s in vocabulary.pieces if len(p) > 1 and len(merge_word(p, known, better_than=s)) != 2]


def cuts(i: Column, j: Column) -> Column:
    return bit(i).bitwiseOR(bit(j))


def inner(i: Column, j: Column) -> Column:
    return bit(j) - bit(i) * 2


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def viterbi_fold(lattice: Column, n: Column, unknown: float) -> Column:
    """The best path's cut points, as bits: the state holds the best sum and path of every position so far."""
    state = F.array(F.struct(F.lit(0.0).cast("double").alias("score"), F.lit(1).cast("long").alias("mask")))

    def step(best: Column, j: Column) -> Column:
        ending = F.filter(lattice, lambda e: e["j"] == j)
        ways = F.transform(ending, lambda e: F.struct(
            (F.element_at(best, e["i"] + 1)["score"] + F.coalesce(-e["cost"], F.lit(unknown))).alias("score"),
            F.element_at(best, e["i"] + 1)["mask"].bitwiseOR(bit(j)).alias("mask")))
        return F.concat(best, F.array(F.array_max(ways)))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), state, step), -1)["mask"]


def encode_words(words: DataFrame, vocabulary: Vocabulary, kind: str = "bpe") -> DataFrame:
    """``(word_key, ids)`` for rows of ``(word_key, word)``; ``kind`` is ``bpe`` or ``unigram``."""
    odd = set(irregular(vocabulary)) if kind == "bpe" else set()
    pieces = piece_table(words, vocabulary, odd)
    short = words.where(F.char_length("word").between(1, LONGEST)).select("word_key", "word")
    # ranked by cost, then from the left; the unranked characters come first and cannot merge anything
    lattice = edges(short, pieces, vocabulary).groupBy("word_key").agg(
        F.sort_array(F.collect_list(F.struct("cost", "i", "j", "ends", "inner", "ids"))).alias("lattice"),
        F.max("j").alias("n"), F.coalesce(F.bool_or("odd"), F.lit(False)).alias("odd"))
    if kind == "bpe":
        mask = F.when(F.col("odd"), step_by_step(F.col("lattice"), F.col("n"))).otherwise(one_pass(F.col("lattice"), F.col("n")))
    else:
        worst = min((s for _, _, s in vocabulary.pieces), default=0.0)
        mask = viterbi_fold(F.col("lattice"), F.col("n"), worst - 10.0)
    used = lambda e: (F.col("mask").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("mask").bitwiseAND(e["inner"]) == 0)
    path = F.array_sort(F.transform(F.filter("lattice", used), lambda e: F.struct(e["i"].alias("i"), e["ids"].alias("ids"))))
    folded = lattice.withColumn("mask", mask).select("word_key", F.flatten(F.transform(path, lambda e: e["ids"])).alias("ids"))
    return folded.unionByName(encode_long(words, vocabulary, kind))


def encode_long(words: DataFrame, vocabulary: Vocabulary, kind: str) -> DataFrame:
    """Words that are too long for the fold, by the same rule."""
    rest = words.where(F.char_length("word") > LONGEST).select("word_key", "word")

    def run(batch: pa.RecordBatch):
        if not len(batch):
            return
        known = {p: (i, s) for i, p, s in vocabulary.pieces}
        encode = merge_word if kind == "bpe" else best_word
        yield {"word_key": batch.column(0), "ids": [ids_of(encode(w, known), known, vocabulary) for w in batch.column(1).to_pylist()]}

    return map_batches(rest, run, "word_key long, ids array<int>")


def merge_word(word: str, known: dict[str, tuple[int, float]], better_than: float = -np.inf) -> list[str]:
    """BPE merges of one word by pieces that score above ``better_than``, best first, leftmost on ties."""
    n = len(word)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := known.get(word[i:ends[j]])) and found[1] > better_than:
            heapq.heappush(heap, (-found[1], i, ends[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [word[i:ends[i]] for i in range(n) if alive[i]]


def best_word(word: str, known: dict[str, tuple[int, float]]) -> list[str]:
    """The path of best sum through one word."""
    longest, worst = max(map(len, known), default=1), min((s for _, s in known.values()), default=0.0) - 10.0
    best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            score = known.get(word[i:j], (0, worst if j == i + 1 else -np.inf))[1]
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
    out, j = [], len(word)
    while j:
        out.append(word[back[j]:j])
        j = back[j]
    return out[::-1]


def ids_of(pieces: list[str], known: dict[str, tuple[int, float]], vocabulary: Vocabulary) -> list[int]:
    out: list[int] = []
    for p in pieces:
        if p in known:
            out.append(known[p][0])
        elif vocabulary.bytes_from is not None:
            out.extend(vocabulary.bytes_from + b for b in p.encode())
        else:
            out.append(vocabulary.unknown)
    return out


Batches = Iterator[pa.RecordBatch]


def encoding(docs: DataFrame, path: str, text_col: str = "text", kind: str = "bpe") -> Callable[[Batches], Batches]:
    """Encodes the words of a table once; gives what turns batches of (id, text) into batches of ``doc_id, ids``."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(path)
    borders = Shared(spark, vocabulary.borders())
    with batches_of(spark, TEXTS):
        words = store(distinct_words(docs, borders, text_col).select("word_key", "word"))
    n_words = words.count()

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        lists = t.column("ids").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.int32()))
        return {"ids": lists.flatten().to_numpy(), "ids-ends": np.cumsum(pc.list_value_length(lists).to_numpy())}

    # one exchange spreads the words; lattice and grouping stay in place
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, n_words // WORDS_PER_TASK + 1), "word_key")
    held = hasharrays.write(encode_words(spread, vocabulary, kind), "word_key", n_words, shared_path(spark, "pieces"), columns)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for chunk in chunks(batch.column(1), WIDE_CHUNK):
                chars, starts, ends, bounds = borders.value.cut(chunk)
                found, which = np.unique(hashes(chars, starts, ends), return_inverse=True)
                number = held.find(found)
                if (number < 0).any():
                    raise RuntimeError("a word of the table is missing from the dictionary")
                flat, cut = held.lists("ids", number)
                size = np.diff(cut)[which]
                ids = flat[hasharrays.ranges(cut[:-1][which], size)].astype(np.int32)
                total = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.rows.start, len(chunk)), pa.ListArray.from_arrays(pa.array(total), pa.array(ids))],
                    ["doc_id", "ids"])

    return run


def decoding(path: str, at: int, text_col: str = "text") -> Callable[[Batches], Batches]:
    """What adds the text of the ids in column ``at`` to batches."""
    vocabulary = Vocabulary.load(path)
    table = {i: p.replace(chr(SPACE), " ").encode() for i, p, _ in vocabulary.pieces}
    if vocabulary.bytes_from is not None:
        table |= {vocabulary.bytes_from + b: bytes([b]) for b in range(256)}
    blob, place = b"".join(table.values()), np.zeros((max(table, default=0) + 1, 2), np.int64)
    size = np.array([len(b) for b in table.values()])
    place[list(table)] = np.stack([np.cumsum(size) - size, size], 1)
    raw = np.frombuffer(blob, np.uint8)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                start, n = place[ids.values.to_numpy(zero_copy_only=False)].T if len(ids) else np.zeros((2, 0), np.int64)
                text = raw[hasharrays.ranges(start, n)].tobytes().decode("utf-8", "replace")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return run


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """``doc_id, ids`` of every row. Null and empty texts have no ids; repeated rows are encoded alike."""
    return id_and_text(docs, id_col, text_col).mapInArrow(encoding(docs, path, text_col, kind), T.StructType.fromDDL("doc_id long, ids array<int>"))


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of the ids: pieces and bytes in order, spaces restored, the leading one dropped.

    Null ids give null; no ids give the empty text.
    """
    kind = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    return encoded.mapInArrow(decoding(path, encoded.columns.index(ids_col), text_col), kind)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """``doc_id, ids, text``: encoded and decoded in one pass, so that a task has one worker and passes small batches on."""
    there, back = encoding(docs, path, text_col, kind), decoding(path, 1)
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)),
                                                          T.StructType.fromDDL("doc_id long, ids array<int>, text string"))


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), model_path()) \
        .select("doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2("text", 256).alias("text_sha256"))
