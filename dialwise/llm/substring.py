"""Substring dedup: repeated units of text go, all but their earliest occurrence.

Units are compared as lower-case words without punctuation. There are three kinds.

* A line, cut after every sentence of ``min_words`` words or more; shorter
  sentences join the next one of their line.
* A line or rest of a line under ``min_words`` words is no unit by itself. It is
  one together with the whole lines or sentences after it that it needs to reach
  ``min_words``, and another with those before it. A short line between others
  that do not repeat stays.
* Every run of ``WINDOW`` words, wherever lines end, unless it is one word
  repeated. So a passage of that length or more goes to its last word, also where
  its copies are wrapped in other ways. Runs that follow one another, and whose
  kept occurrences do too, are reported as one.

Units may overlap; each removed word has an earlier copy that stays.

Runs are many, so they are looked for in two steps. A run's smallest gram of
``GRAM`` words is its anchor, about one in five words. Only runs whose anchor
stands in two places of the table or more can repeat, and only those are listed.
Runs with the same anchor follow one another and make a stretch. Where an anchor
stands in the same stretch everywhere, all its runs have the same occurrences, and
the stretch is listed in their place. Only the others are listed one by one.

Digests are counted over the whole table with partial aggregates. The occurrence
that ranks first by document id, text (by its hash) and place stays. Others are
removed from the text, and reported with their offsets in the original, in characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm.common import batches_of, free_name, id_and_text, map_batches, query, quoted, shuffles_removed, store, table
from dialwise.llm.words import ALNUM, Chunk, chunks, mix, odd_numbers, owners, span_hashes, spans

MIN_WORDS = 8
#: words of a run that is compared wherever it stands
WINDOW = 16
GRAM = 8
#: texts that a worker gets, or holds as Python strings, at a time
ROWS = 1000
_NEWLINE = np.array([b == 10 for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])
_POWER = odd_numbers(1, 21)[0]

DOC = "doc_id long, text_key long"
UNIT = f"{DOC}, digest long, at int, n_words int, start int, end int"
#: rows in the order of texts: differences of places take a byte each
DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


class Words:
    """The words of a chunk's texts: hashes, owners, digests of any span of them, and their places in characters."""

    def __init__(self, chunk: Chunk):
        low = chunk.lower()
        self.chunk = chunk
        self.starts, self.ends, self.bounds = spans(low, ALNUM)
        self.hashes, self.doc = span_hashes(low.data, self.starts, self.ends), owners(self.bounds)
        n = len(self.hashes)
        # order-dependent hash of a span's words, by running sums as for bytes
        power, inverse = np.full(n + 1, _POWER), np.full(n + 1, np.uint64(pow(int(_POWER), -1, 1 << 64)))
        power[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * np.multiply.accumulate(power)[:n])])

    def __len__(self) -> int:
        return len(self.hashes)

    def digests(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mix((self.sums[to] - self.sums[at]) * self.inverse[at] + (to - at).astype(np.uint64))

    def gap(self, table: np.ndarray) -> np.ndarray:
        """Whether the bytes between a word and the next hold one of the table."""
        seen = np.concatenate([[0], np.cumsum(table[self.chunk.data])])
        return seen[np.append(self.starts[1:], len(self.chunk.data))] > seen[self.ends]

    def units(self, at: np.ndarray, to: np.ndarray, digest: np.ndarray) -> dict:
        """``doc, digest, at, n_words, start, end`` of spans of words.

        A unit reaches to the start of the next word after it, or to the end of the text.
        """
        # characters before a byte: those that are no continuation bytes
        chars = np.concatenate([[0], np.cumsum((self.chunk.data & 0xC0) != 0x80)])
        owner, offsets = self.doc[at], self.chunk.offsets
        after = np.where(to == self.bounds[owner + 1], offsets[owner + 1], np.append(self.starts, 0)[to])
        base = chars[offsets[owner]]
        return {"doc": owner, "digest": digest, "at": at - self.bounds[owner], "n_words": to - at,
                "start": chars[self.starts[at]] - base, "end": chars[after] - base}


def line_units(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of every line or sentence of enough words, and of short ones with their neighbours."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.zeros(n, bool)
    last[words.bounds[1:][np.diff(words.bounds) > 0] - 1] = True
    line_end = words.gap(_NEWLINE) | last
    stop = words.gap(_STOP) | line_end
    sentence = np.concatenate([[0], np.cumsum(stop[:-1])])
    size = np.bincount(sentence)[sentence]
    to = np.flatnonzero(line_end | (stop & (size >= min_words))) + 1
    at = np.concatenate([[0], to[:-1]])
    return distinct_spans([(at[to - at >= min_words], to[to - at >= min_words]), *with_neighbours(at, to, words.doc, min_words)], n)


def with_neighbours(at: np.ndarray, to: np.ndarray, doc: np.ndarray, min_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spans of words that join every part under ``min_words`` words to as many whole parts after it, and before it, as it needs."""
    short = to - at < min_words
    first, last = at[short], to[short]
    j = np.searchsorted(to, first + min_words)
    inside = j < len(to)
    ahead = first[inside], to[j[inside]]
    k = np.searchsorted(at, last - min_words, "right") - 1
    inside = k >= 0
    behind = at[k[inside]], last[inside]
    return [(a[same], b[same]) for a, b in (ahead, behind) for same in [doc[a] == doc[b - 1]]]


def distinct_spans(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([a * (n + 1) + b for a, b in found]))
    return key // (n + 1), key % (n + 1)


def runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all runs of ``WINDOW`` words that are not one word repeated, where their anchors begin, and the anchors' digests."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = words.digests(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1)
    first = np.arange(n - WINDOW + 1)
    changes = np.concatenate([[0, 0], np.cumsum(words.hashes[1:] != words.hashes[:-1])])
    good = (words.doc[first] == words.doc[first + WINDOW - 1]) & (changes[first + WINDOW] > changes[first + 1])
    first = first[good]
    anchor = first + least[good]
    return first, anchor, grams[anchor]


def stretches(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and word after the last of the runs that share an anchor's place, and the anchors' digests."""
    first, anchor, digest = runs(words)
    if not len(first):
        return first, first, digest
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(first) != 1)])
    return first[new], first[np.append(new[1:], True)] + WINDOW, digest[new]


def with_text_key(df: DataFrame, id: Column, text: Column, name: str) -> DataFrame:
    """``df`` and ``name``: a hash of the text for rows that share their id with another text or have none, else 0.

    Nearly all ids name one text, and a constant costs next to nothing in a shuffle.
    """
    several = store(df.select(id.alias("k_id"), F.xxhash64(text).alias("k")).where("k_id IS NOT NULL").groupBy("k_id")
                    .agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a != b").select(F.col("k_id").alias(name)))
    key = F.when(id.isNull() | several[name].isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    return df.join(several, id == several[name], "left").select(*[df[quoted(c)] for c in df.columns], key.alias(name))


def _rows(batch: pa.RecordBatch, chunk: Chunk, owner: np.ndarray) -> dict:
    rows = pa.array(owner + chunk.rows.start)
    return {"doc_id": batch.column(0).take(rows), "text_key": batch.column(2).take(rows)}


def _listed(batch: pa.RecordBatch, chunk: Chunk, u: dict) -> dict:
    return _rows(batch, chunk, u["doc"]) | {"digest": u["digest"].astype(np.int64)} | {
        c: u[c].astype(np.int32) for c in ("at", "n_words", "start", "end")}


def as_lines(words: Words, at: np.ndarray, to: np.ndarray, min_words: int) -> np.ndarray:
    """Whether a run of each stretch is a line's unit too."""
    first, after = line_units(words, min_words)
    lines = np.sort(first[after - first == WINDOW])
    return np.searchsorted(lines, to - WINDOW, "right") > np.searchsorted(lines, at)


def anchors(slim: DataFrame) -> DataFrame:
    """``doc_id, text_key, digest``: the anchors of every text."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in chunks(batch.column(1)):
            words = Words(chunk)
            at, _, digest = stretches(words)
            doc = words.doc[at]
            # in the order of texts, which a shuffle packs better
            place = np.sort(np.unique(doc.astype(np.uint64) + digest, return_index=True)[1])
            yield _rows(batch, chunk, doc[place]) | {"digest": digest[place].astype(np.int64)}

    return map_batches(slim, run, f"{DOC}, digest long")


def anchor_stretches(slim: DataFrame, min_words: int) -> DataFrame:
    """``digest, whole, as_line``: the anchor of every stretch, the digest of all its words, and whether a run of it is a line's unit too."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in chunks(batch.column(1)):
            words = Words(chunk)
            at, to, digest = stretches(words)
            yield {"digest": digest.astype(np.int64), "whole": words.digests(at, to).astype(np.int64), "as_line": as_lines(words, at, to, min_words)}

    return map_batches(slim.select("doc_id", "text"), run, "digest long, whole long, as_line boolean")


def run_table(slim: DataFrame, min_words: int) -> DataFrame:
    """Units of the runs whose anchor stands in two places or more, stretches in the place of runs where no place differs.

    A run that a line's unit can equal is listed by itself in every text.
    """
    # stored, so that the join deals both sides anew and a hot digest can be split
    repeated = store(anchor_stretches(slim, min_words).groupBy("digest").agg(
        F.count("whole").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"), F.bool_or("as_line").alias("as_line"))
        .where("n > 1").select("digest", F.expr("a != b OR as_line").alias("apart")))
    # the last bit of a listed anchor tells whether its runs are listed one by one
    listed = F.col("digest").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("apart").cast("long"))
    lists = anchors(slim).join(repeated, "digest").select("doc_id", "text_key", listed.alias("anchor")).repartition("doc_id", "text_key") \
        .groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors")) \
        .withColumnsRenamed({"doc_id": "l_doc_id", "text_key": "l_text_key"})
    texts = slim.join(lists, slim["doc_id"].eqNullSafe(lists["l_doc_id"]) & (slim["text_key"] == lists["l_text_key"])) \
        .select("doc_id", "text", "text_key", "anchors")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in chunks(batch.column(1)):
            words = Words(chunk)
            at, to, digest = stretches(words)
            # a repeated anchor is listed with every text that holds it, so the texts of a chunk can share their lists
            known = np.unique(batch.column(3)[chunk.rows.start:chunk.rows.stop].flatten().to_numpy(zero_copy_only=False).astype(np.uint64))
            one, apart = (np.isin(digest & ~np.uint64(1) | np.uint64(bit), known) for bit in (0, 1))
            n = (to - at - WINDOW + 1)[apart]
            # every first word from a stretch's first to its last run's
            each = np.repeat(at[apart] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, to = np.concatenate([at[one], each]), np.concatenate([to[one], each + WINDOW])
            order = np.argsort(at)
            at, to = at[order], to[order]
            digest = words.digests(at, to)
            # a longer stretch is never compared with lines
            yield _listed(batch, chunk, words.units(at, to, np.where(to - at > WINDOW, ~digest, digest)))

    return map_batches(texts, run, UNIT)


def line_table(slim: DataFrame, min_words: int) -> DataFrame:
    """Units of lines, sentences and short lines with their neighbours."""
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for chunk in chunks(batch.column(1)):
            words = Words(chunk)
            at, to = line_units(words, min_words)
            yield _listed(batch, chunk, words.units(at, to, words.digests(at, to)))

    return map_batches(slim, run, UNIT)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: ``doc_id, text_key, start, end, n_words, kept_doc_id, kept_start``.

    ``text_key`` is 0 where an id has one text only. Rows without an id rank before all others. Rows that repeat an id together
    with its text are one document and keep the same units. Null, empty and
    wordless texts have no units; an empty table gives no rows.
    """
    with shuffles_removed(docs.sparkSession), batches_of(docs.sparkSession, ROWS):
        slim = with_text_key(id_and_text(docs, id_col, text_col), F.col("doc_id"), F.col("text"), "text_key")
        found = store(run_table(slim, min_words), **DELTAS)
        lines = store(line_table(slim, min_words), **DELTAS)
        units = lines.withColumn("is_run", F.lit(False)).unionByName(found.withColumn("is_run", F.lit(True)))
        place = ("doc_id", "text_key", "start", "at")
        groups = store(units.groupBy("digest").agg(F.count("start").alias("n"), F.min(F.struct(*place)).alias("first")).where("n > 1")
                       .select("digest", *[F.col(f"first.{c}").alias(f"kept_{c}") for c in place]))
    # a line or run that overlaps its kept occurrence stays as well, or it would cut into that
    gone = units.join(groups, "digest").where(
        f"NOT (doc_id <=> kept_doc_id AND text_key <=> kept_text_key AND at >= kept_at AND at < kept_at + IF(is_run, {WINDOW}, n_words))")
    shown = ("doc_id", "text_key", "start", "end", "n_words", "kept_doc_id", "kept_start")
    return gone.where("NOT is_run").select(*shown).unionByName(merged(gone.where("is_run")).select(*shown))


def merged(gone: DataFrame) -> DataFrame:
    """Removed runs and stretches of them, joined where they touch or overlap and their kept occurrences do so alike.

    A group is no larger than a text: repeated rows meet in a set.
    """
    one = F.struct("at", "n_words", "start", "end", "kept_start")
    groups = gone.groupBy("doc_id", "text_key", "kept_doc_id", "kept_text_key", (F.col("kept_at") - F.col("at")).alias("shift")) \
        .agg(F.array_sort(F.collect_set(one)).alias("runs"))
    apart = lambda a, b: b["at"] - a["at"] > a["n_words"]
    firsts = F.filter("runs", lambda r, i: (i == 0) | apart(F.get("runs", i - 1), r))
    lasts = F.filter("runs", lambda r, i: (i == F.size("runs") - 1) | apart(r, F.get("runs", i + 1)))
    pairs = F.explode(F.arrays_zip(firsts.alias("a"), lasts.alias("b"))).alias("p")
    return groups.select("doc_id", "text_key", "kept_doc_id", pairs).select(
        "doc_id", "text_key", "kept_doc_id", F.col("p")["a"]["start"].alias("start"), F.col("p")["b"]["end"].alias("end"),
        (F.col("p")["b"]["at"] - F.col("p")["a"]["at"] + F.col("p")["b"]["n_words"]).alias("n_words"), F.col("p")["a"]["kept_start"].alias("kept_start"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units cut out of the text; every row and every other column stays.

    A text that consists of repeats alone becomes empty; a null text stays null.
    """
    cuts, key = free_name(docs, "cuts"), free_name(docs, "text_key")
    found = repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words).select("doc_id", "text_key", "start", "end")
    with shuffles_removed(docs.sparkSession):
        gone = store(found.distinct())
    lists = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts)) \
        .select(F.col("doc_id").alias(key + "_id"), F.col("text_key").alias(key), cuts)
    id, own = F.col(quoted(id_col)).cast("long"), free_name(docs, "own_key")
    keyed = with_text_key(docs, id, F.col(quoted(text_col)).cast("string"), own)
    wide = keyed.join(lists, id.eqNullSafe(lists[key + "_id"]) & (keyed[own] == lists[key]), "left") \
        .select(*[keyed[quoted(c)] for c in docs.columns], cuts)
    place, n = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                texts, listed = batch.column(place).to_pylist(), batch.column(n)
                for i in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)):
                    kept, at = [], 0
                    for cut in listed[i].as_py():
                        kept.append(texts[i][at:cut["start"]])
                        at = max(at, cut["end"])
                    texts[i] = "".join([*kept, texts[i][at:]])
                columns = batch.columns[:n]
                columns[place] = pa.array(texts, type=columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n])

    return wide.mapInArrow(run, T.StructType(list(docs.schema.fields)))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents")).drop("text_key")
