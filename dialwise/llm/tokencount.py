"""Token counts from pre-token frequencies.

1. Distinct pre-tokens of the whole table with their frequencies.
2. The library counts the pieces of each distinct pre-token once.
3. Per document, frequencies are joined to these counts and summed. The most
   frequent pre-tokens, at most ``HOT``, are broadcast, so that every document
   is reduced to one number and its rare pre-tokens before any shuffle. The
   rare ones, none of which can be a hot key, go through a join.

Ids are never kept.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import Shared, batches_of, id_and_text, map_batches, query, store, table
from dialwise.llm.pieces import SPACE, WIDE_CHUNK, Vocabulary, distinct_words, hashes, model_path
from dialwise.llm.words import chunks, owners

HOT = 1 << 19
LIMIT = 4096
#: rows per Arrow batch while the vocabulary is counted, to bound a worker's memory
TEXTS = 1000


def counted(words: DataFrame, path: str) -> DataFrame:
    """``(word_key, n, n_pieces)``: the pieces the library makes of each distinct pre-token."""
    model = Path(path).read_bytes()

    def run(batch: pa.RecordBatch):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a line end before the pre-token keeps the library's leading space away from it
        texts = ["\n" + w.replace(chr(SPACE), " ") for w in batch.column(1).to_pylist()]
        lead = len(sp.encode("\n"))
        yield {"word_key": batch.column(0), "n": batch.column(2),
               "n_pieces": [len(ids) - lead for ids in sp.encode(texts, num_threads=1)]}

    return map_batches(words.select("word_key", "word", "n"), run, "word_key long, n long, n_pieces long")


def frequency_floor(counts: DataFrame, most: int) -> int:
    """The lowest frequency that at most ``most`` pre-tokens reach, from a histogram by sixteenths of powers of two."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("n").alias("n"), F.min("n").alias("least")) \
        .orderBy(F.desc("bin")).collect()
    floor, seen = None, 0
    for b in bins:
        seen += b["n"]
        if seen > most:
            break
        floor = b["least"]
    return floor if floor is not None else 1 << 62


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat an id and
    its text are counted once and returned as often as they occur.
    """
    spark = docs.sparkSession
    borders = Shared(spark, Vocabulary.load(path).borders())
    slim = id_and_text(docs, id_col, text_col)
    with batches_of(spark, TEXTS):
        counts = store(counted(distinct_words(slim, borders), path))
    floor = frequency_floor(counts, hot)
    top = counts.where(F.col("n") >= floor).select("word_key", "n_pieces").toPandas()
    order = np.argsort(top["word_key"].to_numpy().astype(np.uint64))
    frequent = Shared(spark, (top["word_key"].to_numpy().astype(np.uint64)[order], top["n_pieces"].to_numpy()[order].astype(np.int32)))
    keyed = slim.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def reduce(batch: pa.RecordBatch):
        keys, pieces = frequent.value
        for chunk in chunks(batch.column(1), WIDE_CHUNK):
            chars, starts, ends, bounds = borders.value.cut(chunk)
            found, which = np.unique(hashes(chars, starts, ends), return_inverse=True)
            place = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            known = keys[place] == found if len(keys) else np.zeros(len(found), bool)
            size = np.where(known, pieces[place] if len(keys) else 0, 0)
            doc = owners(bounds)
            total = np.bincount(doc, size[which], len(chunk)).astype(np.int64)
            rare = ~known[which]
            pairs, n = np.unique(np.stack([doc[rare], which[rare]], 1), axis=0, return_counts=True) if rare.any() \
                else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            ids, text_keys = (batch.column(c).slice(chunk.rows.start, len(chunk)) for c in (0, 2))
            where, none = pa.array(pairs[:, 0]), len(chunk)
            join = lambda a, b: pa.concat_arrays([a, b])
            # first a row for every text, with what is known; its join key meets nothing
            yield {"doc_id": join(ids, ids.take(where)), "text_key": join(text_keys, text_keys.take(where)),
                   "word_key": np.concatenate([text_keys.to_numpy(), found[pairs[:, 1]].astype(np.int64)]),
                   "rare": np.arange(none + len(n)) >= none, "n": np.concatenate([total, n]),
                   "n_bytes": np.concatenate([np.diff(chunk.offsets), np.zeros(len(n), np.int64)])}

    parts = map_batches(keyed, reduce, "doc_id long, text_key long, word_key long, rare boolean, n long, n_bytes long")
    rest = counts.where(F.col("n") < floor).select("word_key", "n_pieces", F.lit(True).alias("rare"))
    whole = parts.join(rest, ["word_key", "rare"], "left") \
        .groupBy("doc_id", "text_key") \
        .agg(F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(1))).alias("n_tokens"),
             F.max("n_bytes").alias("n_bytes"), F.count_if(~F.col("rare")).alias("times"))
    tokens = F.expr("n_tokens div times")
    return whole.select("doc_id", F.col("n_bytes"), tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"),
                        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


@query("op7_token_counts")
def op7(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), model_path())
