"""Benchmark decontamination with suffix arrays over shards of the training text.

Every Arrow chunk of documents is one shard. Its suffix array is the shard's
word positions in the order of the words that follow; every suffix of the test
set is binary-searched in it, and neighbouring hits on one diagonal make the
longest verbatim match with its location. Positions whose first words begin no
test suffix can match nothing and never enter the array, so the sort is small.
Shards are independent: one scan of the documents, no shuffle.

The test set is broadcast up to ``block_bytes`` of text. Beyond that the documents
are searched for one block after the other, and the matches are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import Shared, free_name, id_and_text, map_batches, query, quoted, store, table
from dialwise.llm.words import ALNUM, Chunk, chunks, ngrams, owners, span_hashes, spans

WINDOW = 13
BLOCK_BYTES = 32 << 20
_HEAD = 3
_FILTER_BITS = 22


class TestSet:
    """Distinct windows of the test items, by length, with the items that hold each.

    An item of fewer words than ``window`` is one window of its own; an item
    without words has none.
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.lengths, self.ids = window, {}, []
        rows: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            chunk = Chunk(raw, np.array([0, len(raw)]), slice(0, 1)).lower()
            starts, ends, _ = spans(chunk, ALNUM)
            words = span_hashes(chunk.data, starts, ends)
            size = min(window, len(words))
            if item is None or not size:
                continue
            number = len(self.ids)
            self.ids.append(item)
            rows.setdefault(size, []).extend((words[s:s + size], number, s) for s in range(len(words) - size + 1))
        for size, found in rows.items():
            keys = sort_keys(np.array([w for w, _, _ in found], np.uint64))
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            head = np.array([found[i][0] for i in order[first]], np.uint64)[:, :_HEAD]
            gate = np.zeros(1 << _FILTER_BITS, bool)
            gate[head_hash(head) >> np.uint64(64 - _FILTER_BITS)] = True
            self.lengths[size] = {
                "keys": distinct, "gate": gate, "first": np.append(first, len(order)),
                "item": np.array([found[i][1] for i in order]), "start": np.array([found[i][2] for i in order])}


def sort_keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of word hashes as byte strings that compare like the rows."""
    matrix = np.ascontiguousarray(matrix.astype(">u8"))
    return matrix.view(f"S{8 * matrix.shape[1]}").ravel()


def head_hash(matrix: np.ndarray) -> np.ndarray:
    return ngrams(matrix.ravel(), matrix.shape[1])[::matrix.shape[1]]


def search(chunk: Chunk, tests: TestSet) -> dict:
    """Matches of one shard: arrays ``doc, word, item, start, length``, and words of each text.

    A row says that ``length`` words of document ``doc`` from ``word`` on equal
    those of ``item`` from ``start`` on, and that neither end can be extended
    by a further window.
    """
    low = chunk.lower()
    starts, ends, bounds = spans(low, ALNUM)
    words = span_hashes(low.data, starts, ends)
    doc = owners(bounds)
    found = []
    for size, t in tests.lengths.items():
        head = min(size, _HEAD)
        if len(words) < size:
            continue
        grams = ngrams(words, head)[:len(words) - size + 1]
        places = np.flatnonzero(t["gate"][grams >> np.uint64(64 - _FILTER_BITS)])
        places = places[doc[places] == doc[places + size - 1]]
        if not len(places):
            continue
        suffixes = sort_keys(words[places[:, None] + np.arange(size)])
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        low_end, high_end = np.searchsorted(array, t["keys"], "left"), np.searchsorted(array, t["keys"], "right")
        hit = np.flatnonzero(high_end > low_end)
        if not len(hit):
            continue
        n = high_end[hit] - low_end[hit]
        at = places[order[np.repeat(low_end[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
        key = np.repeat(hit, n)
        uses = t["first"][key + 1] - t["first"][key]
        use = np.repeat(t["first"][key] - np.cumsum(uses) + uses, uses) + np.arange(uses.sum())
        found.append(longest(np.repeat(at, uses), t["item"][use], t["start"][use], doc, size))
    made = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return {"n_words": np.diff(bounds), "bounds": bounds, "doc": doc[made[:, 0]] if len(made) else made[:, 0],
            "word": made[:, 0], "item": made[:, 1], "start": made[:, 2], "length": made[:, 3]}


def longest(at, item, start, doc, size) -> np.ndarray:
    """Join hits that follow each other on one diagonal of one document and item."""
    diagonal = at - start
    order = np.lexsort((at, diagonal, item, doc[at]))
    at, item, start, diagonal = at[order], item[order], start[order], diagonal[order]
    new = np.ones(len(at), bool)
    new[1:] = ((at[1:] != at[:-1] + 1) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
               | (doc[at[1:]] != doc[at[:-1]]))
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    return np.stack([at[first], item[first], start[first], run + size - 1], 1)


def covered(found: dict) -> np.ndarray:
    """Per text, the number of words inside at least one match."""
    change = np.zeros(found["bounds"][-1] + 1, np.int64)
    np.add.at(change, found["word"], 1)
    np.add.at(change, found["word"] + found["length"], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return inside[found["bounds"][1:]] - inside[found["bounds"][:-1]]


def item_lists(found: dict, ids: list) -> dict[int, list]:
    pairs = np.unique(np.stack([found["doc"], found["item"]], 1), axis=0)
    lists: dict[int, list] = {}
    for d, i in pairs.tolist():
        lists.setdefault(d, []).append(ids[i])
    return lists


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, set(items)))).encode()).hexdigest()


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestSet]:
    """The test set in blocks of bounded size, one at a time. An item over the bound makes a block of its own."""
    items = benchmark.select(F.col(quoted(id_col)).alias("item"), F.col(quoted(text_col)).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held, used = [], 0
    for r in items.collect() if size <= block_bytes else items.toLocalIterator():
        n = len((r["text"] or "").encode())
        if held and used + n > block_bytes:
            yield TestSet(held, window)
            held, used = [], 0
        held.append((r["item"], r["text"]))
        used += n
    yield TestSet(held, window)


def one_or_more(blocks: Iterator[TestSet]) -> tuple[TestSet, Iterator[TestSet] | None]:
    """The only block, or the first and all of them."""
    first, second = next(blocks), next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches ``(doc_id, word, item_id, item_word, n_words)``.

    Null or empty texts match nothing; a repeated document is reported as often
    as it occurs; ties (one passage in several items) give one row per item.
    """
    slim = id_and_text(docs, id_col, text_col)
    return block_matches(slim, test_blocks(benchmark, item_col, item_text_col, window, block_bytes),
                         benchmark.schema[item_col].dataType.simpleString())


def block_matches(slim: DataFrame, blocks: Iterator[TestSet], kind: str) -> DataFrame:
    """The matches of every block, stored before the next block is made."""
    out = None
    for block in blocks:
        shared = Shared(slim.sparkSession, block)

        def found(batch: pa.RecordBatch, shared=shared):
            for chunk in chunks(batch.column(1)):
                f = search(chunk, shared.value)
                first = f["bounds"][f["doc"]]
                yield {"doc_id": batch.column(0).slice(chunk.rows.start, len(chunk)).take(pa.array(f["doc"])),
                       "word": f["word"] - first, "item_id": [str(i) if kind == "string" else i for i in map(shared.value.ids.__getitem__, f["item"])],
                       "item_word": f["start"], "n_words": f["length"]}

        part = store(map_batches(slim, found, f"doc_id long, word long, item_id {kind}, item_word long, n_words long"))
        out = part if out is None else out.unionByName(part)
    return out


def flag(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``contaminated`` means that the matches cover a twentieth of the words or
    more. Null and empty texts have no words and are clean; an empty test set
    leaves everything clean; repeated rows are judged one by one.
    """
    block, more = one_or_more(test_blocks(benchmark, item_col, item_text_col, window, block_bytes))
    slim = id_and_text(docs, id_col, text_col)
    if more is not None:
        numbered = store(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
        judged = merged(numbered.select(F.col("row").alias("doc_id"), "text"), more)
        return numbered.select("row", "doc_id").join(judged, "row").drop("row")
    shared = Shared(docs.sparkSession, block)

    def judge(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(chunk.rows.start, len(chunk)), **verdicts(chunk, shared.value)}

    return map_batches(slim, judge, f"doc_id long, {VERDICT}")


def merged(rows: DataFrame, blocks: Iterator[TestSet]) -> DataFrame:
    """``row`` and the columns of ``VERDICT``, from the matches of several blocks. ``rows`` hold a unique number and a text."""

    def count(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(1)):
            yield {"row": batch.column(0).slice(chunk.rows.start, len(chunk)), "n_words": np.diff(spans(chunk.lower(), ALNUM)[2])}

    found = block_matches(rows, blocks, "string")
    told = found.groupBy(F.col("doc_id").alias("row")).agg(
        F.sort_array(F.collect_set(F.struct("word", (F.col("word") + F.col("n_words")).alias("end")))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"))
    # words covered by at least one match: spans in order, each from where the former ones end
    cover = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
                        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["word"], s["reach"]), F.lit(0))).alias("n"),
                                              F.greatest(s["reach"], x["end"]).alias("reach")), lambda s: s["n"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return map_batches(rows, count, "row long, n_words long").join(
        told.select("row", cover.alias("n_hit"), F.size("items").alias("n_items"), F.array_join("items", ",").alias("items")), "row", "left") \
        .select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
                ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def verdicts(chunk: Chunk, tests: TestSet) -> dict:
    """The contract's columns for the texts of one chunk."""
    found = search(chunk, tests)
    items, n_words, n_hit, none = item_lists(found, tests.ids), found["n_words"], covered(found), digest([])
    return {"n_words": n_words, "n_hit": n_hit, "n_items": [len(set(items.get(d, ()))) for d in range(len(chunk))],
            "items_sha256": [digest(items[d]) if d in items else none for d in range(len(chunk))],
            "contaminated": (n_hit > 0) & (20 * n_hit >= n_words)}


def remove_affected(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows; all columns as they were."""
    block, more = one_or_more(test_blocks(benchmark, "item_id", "text", window, block_bytes))
    if more is not None:
        row = free_name(docs, "row")
        numbered = store(docs.withColumn(row, F.monotonically_increasing_id()))
        judged = merged(numbered.select(F.col(row).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")), more)
        return numbered.join(judged.where("contaminated").select(F.col("row").alias(row)), row, "left_anti").select(*map(quoted, docs.columns))
    shared, place = Shared(docs.sparkSession, block), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(place)):
                bad = verdicts(chunk, shared.value)["contaminated"]
                yield batch.slice(chunk.rows.start, len(chunk)).filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)


ORACLE = """
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k,
    unnest(list_transform(generate_series(1, len(w) - k + 1), lambda s: array_to_string(w[s:s + k - 1], ' '))) AS g
  FROM sized),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (
  SELECT rid, k, unnest(generate_series(1, len(w) - k + 1)) AS s,
    unnest(list_transform(generate_series(1, len(w) - k + 1), lambda s: array_to_string(w[s:s + k - 1], ' '))) AS g
  FROM docs, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hits AS (SELECT rid, s, k, item_id FROM places JOIN win USING (k, g)),
inside AS (SELECT rid, count(DISTINCT place) AS n_hit
  FROM (SELECT rid, unnest(generate_series(s, s + k - 1)) AS place FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM docs LEFT JOIN inside USING (rid) LEFT JOIN named USING (rid)
"""


@query("op10_benchmark_decontamination", ORACLE)
def op10(spark, sf_dir):
    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
