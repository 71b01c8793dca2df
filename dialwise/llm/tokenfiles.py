"""Token ids as flat binary files, written and read by Spark tasks.

A folder holds, for every part ``p`` (ranges of ids in ascending order):

* ``ids-p.bin``: the ids of its documents one after the other, unsigned
  little-endian, 2 bytes each where the vocabulary has at most 65,536 ids, else 4;
* ``offsets-p.bin``: where each document begins within the part, counted in ids,
  64 bits, and one more value for the end;
* ``docs-p.bin``: the documents' ids, 64 bits; null ids come first and are 0 here;

and ``index.json`` with the parts' sizes. A part's base, the number of ids
before it, is a prefix sum over these, so no file is written twice.

Texts are sorted into ranges of (document id, hash of the text), so an id that
very many rows share is split, and a task encodes and writes its range at one go.
Files get their name by an atomic rename and their content from a total order: a
task that runs twice leaves the same files.
Readers map the files; a folder that is not mounted is read through Arrow.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm.bytepairs import encoder
from dialwise.llm.common import batches_of, id_and_text, query, shared_path, table
from dialwise.llm.hasharrays import local_path
from dialwise.llm.words import chunks

END_ID = 0
PART_BYTES = 64 << 20
#: rows per Arrow batch where texts are read, to bound a worker's memory
TEXTS = 1000
#: documents per Arrow batch, and ids held at once, where files are read
DOCUMENTS = 4096
BLOCK = 1 << 22


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def written(uri: str, name: str):
    """A file to write; it gets its name when all went well."""
    folder, part = local_path(uri), f".{name}-{uuid.uuid4().hex}"
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{part}", "wb") as f:
            yield f
        os.replace(f"{folder}/{part}", f"{folder}/{name}")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{part}") as f:
        yield f
    system.move(f"{path}/{part}", f"{path}/{name}")


def mapped(uri: str, name: str, kind: np.dtype) -> np.ndarray:
    """The values of a file, mapped into memory."""
    folder = local_path(uri)
    if folder is not None:
        size = os.path.getsize(f"{folder}/{name}")
        return np.memmap(f"{folder}/{name}", kind, "r") if size else np.zeros(0, kind)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(f"{path}/{name}") as f:
        while block := f.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, kind, "r") if copy.tell() else np.zeros(0, kind)  # stays mapped after the name is gone


@dataclass
class TokenFiles:
    """``uri`` of the folder, type of the ids, and for each part its documents, those without an id, and its ids."""

    uri: str
    kind: str
    documents: np.ndarray
    nulls: np.ndarray
    ids: np.ndarray

    @property
    def bases(self) -> np.ndarray:
        """Ids before each part, and of all."""
        return np.concatenate([[0], np.cumsum(self.ids)])

    @classmethod
    def open(cls, uri: str) -> TokenFiles:
        index = json.loads(mapped(uri, "index.json", np.dtype(np.uint8)).tobytes())
        return cls(uri, index["kind"], *(np.array(index[k], np.int64) for k in ("documents", "nulls", "ids")))

    def save(self) -> TokenFiles:
        with written(self.uri, "index.json") as f:
            f.write(json.dumps({"kind": self.kind} | {k: getattr(self, k).tolist() for k in ("documents", "nulls", "ids")}).encode())
        return self

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, offsets and ids of a part."""
        return (mapped(self.uri, f"docs-{p}.bin", np.dtype("<i8")), mapped(self.uri, f"offsets-{p}.bin", np.dtype("<u8")).astype(np.int64),
                mapped(self.uri, f"ids-{p}.bin", np.dtype(self.kind)))

    def rows(self, spark: SparkSession, ids: bool = True) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` of every document in order of the files, and its ``ids`` if wanted.

        ``start`` is the number of ids of all documents before it; the checksum
        is of its ids as little-endian unsigned 32-bit integers. One task a part.
        """
        bases, nulls, names = self.bases, self.nulls, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in (p for b in batches for p in b.column(0).to_pylist()):
                if not self.documents[p]:
                    continue
                docs, offsets, flat = self.part(p)
                a = 0
                while a < len(docs):
                    b = min(a + DOCUMENTS, max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1), len(docs))
                    at = offsets[a:b + 1]
                    columns = [pa.array(docs[a:b], mask=np.arange(a, b) < nulls[p]), pa.array(bases[p] + at[:-1]), pa.array(np.diff(at)),
                               pa.array([checksum(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(flat[at[0]:at[-1]].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    a = b

        parts = max(1, len(self.documents))
        return spark.range(0, len(self.documents), 1, parts).mapInArrow(run, T.StructType.fromDDL(schema))


def checksum(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for k in range(0, len(ids), BLOCK):
        crc = zlib.crc32(ids[k:k + BLOCK].astype("<u4").tobytes(), crc)
    return crc


def write(docs: DataFrame, path: str, uri: str, *, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text",
          part_bytes: int = PART_BYTES) -> TokenFiles:
    """Encode all texts and write them in ascending order of id, null ids first, ``part_bytes`` of text to a part.

    Null and empty texts have no ids but ``end_id``. Rows that share an id follow
    by a hash of their text, and equal rows are written as often as they occur.
    An empty table gives an index without parts.
    """
    spark, kind = docs.sparkSession, encoder(path).kind
    slim = id_and_text(docs, id_col, text_col)
    n, size = slim.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not n:
        none = np.zeros(0, np.int64)
        return TokenFiles(uri, kind.str, none, none, none).save()
    parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // part_bytes))))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n, nulls, total = TaskContext.get().partitionId(), 0, 0, 0
        with ExitStack() as stack:
            docs, offsets, ids = (stack.enter_context(written(uri, f"{name}-{p}.bin")) for name in ("docs", "offsets", "ids"))
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                docs.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n, nulls = n + len(batch), nulls + batch.column(0).null_count
                for chunk in chunks(batch.column(1)):
                    flat, at = encoder(path).encode(chunk, end_id)
                    offsets.write((total + at[1:]).astype("<u8").tobytes())
                    ids.write(flat.tobytes())
                    total += len(flat)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (p, n, nulls, total)], ["part", "documents", "nulls", "ids"])

    dealt = slim.withColumn("text_key", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "text_key") \
        .sortWithinPartitions("doc_id", "text_key", "text").select("doc_id", "text")
    with batches_of(spark, TEXTS):
        # one row a part, so a few numbers for every 64 MB of text
        found = dealt.mapInArrow(save, "part long, documents long, nulls long, ids long").toPandas()
    index = np.zeros((3, int(found["part"].max()) + 1), np.int64)
    index[:, found["part"]] = found[["documents", "nulls", "ids"]].to_numpy().T
    return TokenFiles(uri, kind.str, *index).save()


@query("op12_token_files")
def op12(spark, sf_dir):
    files = write(table(spark, sf_dir, "documents"), tokenizer_path(), shared_path(spark, "tokens"))
    return files.rows(spark, ids=False)
