"""Ids of a byte-level BPE tokenizer for whole texts, with the library called once per new pre-token.

The library's merges never reach across its pre-tokens, so a text's ids are its
pre-tokens' ids in order. Texts are cut into pre-tokens over whole Arrow batches
from a table of character classes, which is asked of the library's own
pre-tokenizer for every character that turns up. A task keeps the ids of the
pre-tokens it has met, ``HELD`` of them at most. Texts that hold an added token
go to the library whole, as do all texts where the tokenizer is of another make.
"""

from __future__ import annotations

import json
import os
from functools import cache, reduce
from itertools import chain

import numpy as np

from dialwise.llm.hasharrays import ranges
from dialwise.llm.pieces import hashes, words_of
from dialwise.llm.words import Chunk

HELD = 1 << 19
BLANK, LETTER, NUMBER, OTHER, UNSEEN = range(5)
SPACE, QUOTE = 0x20, 0x27
#: fixed values: what may follow the quote of a contraction
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


class Cutter:
    """Pre-tokens of the byte-level pre-tokenizer."""

    def __init__(self, pre_tokenizer):
        self.ask, self.kinds = pre_tokenizer.pre_tokenize_str, np.full(0x110000, UNSEEN, np.uint8)

    def kinds_of(self, chars: np.ndarray) -> np.ndarray:
        kind = self.kinds[chars]
        if (kind == UNSEEN).any():
            for c in np.unique(chars[kind == UNSEEN]).tolist():
                joins = [k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.ask(before + chr(c))) == 1]
                self.kinds[c] = joins[0] if joins else BLANK
            kind = self.kinds[chars]
        return kind

    def cut(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters, starts and ends of the pre-tokens, and where each text's pre-tokens begin (one more than texts)."""
        chars = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
        n = len(chars)
        if not n:
            none = np.zeros(0, np.int64)
            return chars, none, none, np.zeros(len(first), np.int64)
        kind = self.kinds_of(chars)
        opens = np.zeros(n + 1, bool)  # the first character of a text, and the place after the last
        opens[first] = True
        new = opens[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        # the last blank before something else stands alone, a space goes with what follows
        last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~opens[1:-1])
        new[last] = True
        new[last[chars[last] == SPACE] + 1] = False
        self._contract(chars, opens, new)
        starts = np.flatnonzero(new)
        return chars, starts, np.append(starts[1:], n), np.searchsorted(starts, first)

    @staticmethod
    def _contract(chars: np.ndarray, opens: np.ndarray, new: np.ndarray) -> None:
        """A quote that opens a pre-token takes the letters of a contraction with it."""
        padded = np.concatenate([chars, np.zeros(3, np.uint32)])
        quotes = np.flatnonzero((chars == QUOTE) & new)
        quotes = quotes[~opens[quotes + 1]]
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = reduce(np.logical_or, [(one == ord(a)) & (two == ord(b)) for a, b in LONG_ENDINGS])
        long &= ~opens[np.minimum(quotes + 2, len(chars))]
        quotes, size = quotes[short | long], np.where(short, 2, 3)[short | long]
        new[quotes + 1] = False
        after = (quotes + size)[quotes + size < len(chars)]
        new[after] = True


class Encoder:
    """``ids`` of whole texts as the library gives them, without tokens it would add around a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        split = made.get("pre_tokenizer") or {}
        plain = made.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) \
            and not split.get("add_prefix_space") and not made.get("truncation") and not made.get("padding")
        self.cutter = Cutter(self.library.pre_tokenizer) if plain else None
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of them of each text, by the library."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum())), sizes

    def _slots_of(self, found: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each pre-token are, for ascending keys; new ones are asked of the library."""
        if len(self.keys) > HELD:
            self._forget()
        place = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == found[inside]
        slots = np.zeros(len(found), np.int64)
        slots[known] = self.slots[place[known]]
        if not known.all():
            flat, sizes = self._whole(words_of(chars, starts[~known], ends[~known]))
            slots[~known] = len(self.ends) - 1 + np.arange(len(sizes))
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.keys = np.insert(self.keys, place[~known], found[~known])
            self.slots = np.insert(self.slots, place[~known], slots[~known])
        return slots

    def encode(self, chunk: Chunk, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a chunk's texts and their offsets; ``end_id`` closes every text."""
        odd = self._library_only(chunk)
        (whole, whole_sizes), (flat, sizes) = self._whole([chunk.text(i) for i in np.flatnonzero(odd).tolist()]), self._cut_ids(without(chunk, odd))
        sizes[odd] = whole_sizes
        closing = int(end_id is not None)
        total = np.concatenate([[0], np.cumsum(sizes + closing)])
        out = np.empty(total[-1], self.kind)
        for rows, ids in ((odd, whole), (~odd, flat)):
            out[ranges(total[:-1][rows], sizes[rows])] = ids
        if closing:
            out[total[1:] - 1] = end_id
        return out, total

    def _library_only(self, chunk: Chunk) -> np.ndarray:
        """Which texts must not be cut."""
        if self.cutter is None:
            return np.ones(len(chunk), bool)
        data = chunk.data.tobytes()
        if not any(a.encode() in data for a in self.added):
            return np.zeros(len(chunk), bool)
        return np.array([any(a in t for a in self.added) for t in map(chunk.text, range(len(chunk)))], bool)
    def _cut_ids(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of them of each text, from its pre-tokens."""
        if self.cutter is None or not len(chunk.data):
            return np.zeros(0, self.kind), np.zeros(len(chunk), np.int64)
        chars, starts, ends, bounds = self.cutter.cut(chunk)
        found, first, which = np.unique(hashes(chars, starts, ends), return_index=True, return_inverse=True)
        slots = self._slots_of(found, chars, starts[first], ends[first])
        at = self.ends[slots]
        size = self.ends[slots + 1] - at
        flat = self.flat[ranges(at[which], size[which])]
        return flat, np.diff(np.concatenate([[0], np.cumsum(size[which])])[bounds])


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def without(chunk: Chunk, rows: np.ndarray) -> Chunk:
    """The chunk with the texts of ``rows`` emptied."""
    if not rows.any():
        return chunk
    sizes = np.diff(chunk.offsets) * ~rows
    return Chunk(chunk.data[ranges(chunk.offsets[:-1], sizes)], np.concatenate([[0], np.cumsum(sizes)]), chunk.rows)
