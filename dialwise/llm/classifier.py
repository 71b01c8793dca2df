"""Quality classifier: nearest labelled documents in a latent-semantic space vote.

Terms are byte pairs (hashed into ``PAIR_BINS``) and binned shape measures of
the whole text. A bounded sample of labelled rows gives term weights, a
truncated singular value decomposition and the labelled vectors. These are a
few MB whatever the corpus size, so they are broadcast; every document is then
compared with every labelled vector by blocked matrix products in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import Shared, id_and_text, map_batches, query, quoted, table
from dialwise.llm.words import SPACED, Chunk, chunks, mix, owners, span_hashes, spans

MAX_LABELLED = 8192
DIMENSIONS = 64
NEIGHBOURS = 24
PAIR_BINS = 1024
SHAPE_BINS = 12
CUT = 0.3
_SHAPES = 8
_PAIR_OF = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIR_BINS)).astype(np.int64)
_KIND = np.array([0 if 0x41 <= b <= 0x5A else 1 if 0x30 <= b <= 0x39 else 2 if b < 0x80 and not chr(b).isalnum() and b > 0x20
                  else 3 for b in range(256)])
_NOT_NEWLINE = np.array([b != 10 for b in range(256)])


def terms(chunk: Chunk) -> np.ndarray:
    """Weighted term vectors: square roots of byte-pair shares, then one-hot shape bins."""
    n, data, offsets = len(chunk), chunk.data, chunk.offsets
    out = np.zeros((n, PAIR_BINS + _SHAPES * SHAPE_BINS), np.float32)
    size = np.diff(offsets)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    first, second = data[:-1].astype(np.int64), data[1:]
    whole = doc[:-1] == doc[1:]
    pairs = np.bincount((doc[:-1] * PAIR_BINS + _PAIR_OF[first * 256 + second])[whole], minlength=n * PAIR_BINS)
    pairs = pairs.reshape(n, PAIR_BINS)
    out[:, :PAIR_BINS] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    share = np.bincount(doc * 4 + _KIND[data], minlength=n * 4).reshape(n, 4) / np.maximum(size, 1)[:, None]
    starts, ends, bounds = spans(chunk, SPACED)
    words = np.diff(bounds)
    mean_word = np.bincount(owners(bounds), ends - starts, n) / np.maximum(words, 1)
    line_from, line_to, line_bounds = spans(chunk, _NOT_NEWLINE)
    lines, owner = np.diff(line_bounds), owners(line_bounds)
    distinct = np.bincount(np.unique(np.stack([owner.astype(np.uint64), span_hashes(data, line_from, line_to)], 1), axis=0)[:, 0]
                           .astype(np.int64), minlength=n) if len(owner) else np.zeros(n)
    measures = np.stack([share[:, 0] * 8, share[:, 1] * 8, share[:, 2] * 6, np.log2(1 + size) / 18, mean_word / 14,
                         1 - distinct / np.maximum(lines, 1), words / np.maximum(lines, 1) / 120, np.log2(1 + words) / 16], 1)
    place = np.clip(measures, 0, 1) * (SHAPE_BINS - 1)
    low = np.minimum(place.astype(np.int64), SHAPE_BINS - 2)
    shapes = np.zeros((n, _SHAPES, SHAPE_BINS), np.float32)
    rows, cols = np.arange(n)[:, None], np.arange(_SHAPES)[None]
    shapes[rows, cols, low], shapes[rows, cols, low + 1] = 1 - (place - low), place - low
    out[:, PAIR_BINS:] = shapes.reshape(n, -1) * 0.35
    out[words == 0] = 0
    return out


@dataclass
class Voters:
    """Projection into the latent space, labelled vectors there, and their labels."""

    mean: np.ndarray
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int) -> Voters:
        seen = (features > 0).sum(0)
        weights = np.log((1 + len(features)) / (1 + seen)).astype(np.float32) + 0.5
        weighted = features * weights
        mean = weighted.mean(0) if len(weighted) else np.zeros(features.shape[1], np.float32)
        weighted -= mean
        _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions], np.float32)
        return cls(mean, weights, axes, unit(weighted @ axes), labels.astype(np.float32), neighbours)

    def score(self, features: np.ndarray, block: int = 256) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors.

        Texts without words get the share of label 1 in the sample, and
        everything gets 0.5 when nothing is labelled.
        """
        if not len(self.labels):
            return np.full(len(features), 0.5)
        base, k = float(self.labels.mean()), min(self.neighbours, len(self.labels))
        out = np.full(len(features), base)
        known = np.flatnonzero(features.any(1))
        for at in range(0, len(known), block):
            rows = known[at:at + block]
            near = unit((features[rows] * self.weights - self.mean) @ self.axes) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64) ** 4
            out[rows] = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def held_out(id_column) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Voters:
    """Learn from at most ``max_labelled`` labelled rows that are not held out.

    The rows with the smallest id hashes are taken, so the sample does not
    depend on file order. Null ids and labels are ignored; several labels of
    one id are averaged; of repeated documents one counts.
    """
    slim = id_and_text(docs, id_col, text_col)
    known = (labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(label)).cast("double").alias("y"))
             .dropna().where(~held_out("doc_id")).groupBy("doc_id").agg(F.avg("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toPandas())
    y = dict(zip(known["doc_id"].tolist(), known["y"].tolist()))
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in y], "doc_id long"))

    def featured(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(1)):
            rows = terms(chunk).astype(np.float16)
            yield {"doc_id": batch.column(0).slice(chunk.rows.start, len(chunk)), "terms": [r.tobytes() for r in rows]}

    rows = map_batches(slim.join(chosen, "doc_id", "left_semi"), featured, "doc_id long, terms binary") \
        .dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    width = PAIR_BINS + _SHAPES * SHAPE_BINS
    features = np.array([np.frombuffer(r["terms"], np.float16) for r in rows], np.float32).reshape(-1, width)
    return Voters.fit(features, np.array([y[r["doc_id"]] for r in rows]), dimensions, neighbours)


def score(docs: DataFrame, voters: Voters, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id, score, predicted`` for every row; the sums of similarities decide, never an id or a label."""
    shared = Shared(docs.sparkSession, voters)

    def vote(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(1)):
            got = shared.value.score(terms(chunk))
            yield {"doc_id": batch.column(0).slice(chunk.rows.start, len(chunk)), "score": got,
                   "predicted": (got >= cut).astype(np.int32)}

    return map_batches(id_and_text(docs, id_col, text_col), vote, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, voters: Voters, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score below ``cut``; all columns as they were."""
    shared, place = Shared(docs.sparkSession, voters), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(place)):
                good = shared.value.score(terms(chunk)) >= cut
                yield batch.slice(chunk.rows.start, len(chunk)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    voters = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, voters).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
