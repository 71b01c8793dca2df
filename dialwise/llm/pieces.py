"""A sentencepiece vocabulary as data, and texts cut where no piece can reach across.

Two neighbouring characters that stand side by side in no piece can never be
merged, so a text may be cut between them and its parts encoded apart. These
parts are the pre-tokens here. The rule is derived from the vocabulary alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.llm.common import quoted
from dialwise.llm.words import Chunk, chunks, span_hashes

SPACE = 0x2581
WIDE_CHUNK = 1 << 20
#: distinct pre-tokens that a task holds before it passes them on
HELD = 1 << 18


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    """``pieces``: (id, text, score) of the ordinary pieces; ``bytes_from``: id of byte 0, or None."""

    pieces: list[tuple[int, str, float]]
    bytes_from: int | None
    unknown: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
        found = [i for i in every if sp.is_byte(i)]
        if found and (len(found) != 256 or found != list(range(found[0], found[0] + 256))):
            raise ValueError("byte pieces are expected to have consecutive ids")
        if any(sp.id_to_piece(i) == "\n" for i in every):
            raise ValueError("a line end is expected to be no piece")
        return cls([(i, sp.id_to_piece(i), sp.get_score(i)) for i in every if not special(i)],
                   found[0] if found else None, sp.unk_id())

    def borders(self) -> Borders:
        inside = sorted({c for _, p, _ in self.pieces if len(p) > 1 for c in p})
        number = np.zeros(0x110000, np.uint16)
        number[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        joined = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for _, p, _ in self.pieces:
            for a, b in zip(p, p[1:]):
                joined[number[ord(a)], number[ord(b)]] = True
        return Borders(number, joined)


@dataclass
class Borders:
    """Which characters occur in longer pieces, and which pairs of them stand side by side."""

    number: np.ndarray
    joined: np.ndarray

    def cut(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters with the leading and escaped spaces of the library, starts and ends of
        the pre-tokens, and where each text's pre-tokens begin (one more than texts)."""
        chars = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
        filled = np.diff(before) > 0
        chars = np.insert(np.where(chars == 0x20, np.uint32(SPACE), chars), before[:-1][filled], SPACE)
        first = before + np.concatenate([[0], np.cumsum(filled)])
        if not len(chars):
            none = np.zeros(0, np.int64)
            return chars, none, none, np.zeros(len(first), np.int64)
        kind = self.number[chars]
        new = np.ones(len(chars), bool)
        new[1:] = ~self.joined[kind[:-1], kind[1:]]
        new[first[:-1][filled]] = True
        starts = np.flatnonzero(new)
        return chars, starts, np.append(starts[1:], len(chars)), np.searchsorted(starts, first)


def hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(chars, starts, ends)


def words_of(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    text = chars.tobytes().decode("utf-32-le", "replace")
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def distinct_words(docs: DataFrame, borders, text_col: str = "text") -> DataFrame:
    """``(word_key, word, n)``: every distinct pre-token of the table and how often it occurs.

    Tasks add up their own counts first, holding at most ``HELD`` pre-tokens.
    """
    schema = "word_key long, word string, n long"
    names = ["word_key", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(words, pa.string()), pa.array(counts)], names)
        for batch in batches:
            for chunk in chunks(batch.column(0), WIDE_CHUNK):
                chars, starts, ends, _ = borders.value.cut(chunk)
                found, first, n = np.unique(hashes(chars, starts, ends), return_index=True, return_counts=True)
                place = np.searchsorted(keys, found)
                known = np.zeros(len(found), bool)
                inside = place < len(keys)
                known[inside] = keys[place[inside]] == found[inside]
                counts[place[known]] += n[known]
                fresh = first[~known]
                text = np.array(words_of(chars, starts[fresh], ends[fresh]) + [None], object)[:-1]
                keys, at = np.insert(keys, place[~known], found[~known]), place[~known]
                counts, words = np.insert(counts, at, n[~known]), np.insert(words, at, text)
                if len(keys) > HELD:
                    yield out()
                    keys, counts, words = keys[:0], counts[:0], words[:0]
        if len(keys):
            yield out()

    return docs.select(F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, T.StructType.fromDDL(schema)) \
        .groupBy("word_key").agg(F.first("word").alias("word"), F.sum("n").alias("n"))
