"""Token files against the tokenizers library, and reading back what was written."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dialwise.llm import tokenfiles
from dialwise.llm.bytepairs import Encoder
from dialwise.llm.words import chunks
from tests.llm.helpers import TEXTS, awkward, nothing

PATH = tokenfiles.tokenizer_path()
SCRAPS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "　", "\xa0", "a", "Z", "é", "1", "٣", "Ⅷ", "!", "?", "\U0001f642",
          "́", "'s", "<|endoftext|>", "<|", "\x00", "ſ", "日", "\r\n", " ", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode_all(texts, **kind):
    made, out = Encoder(PATH), []
    for chunk in chunks(pa.array(texts, pa.string()), **kind):
        flat, offsets = made.encode(chunk, 0)
        out += [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def test_cut_texts_get_the_library_s_ids(library):
    draw = random.Random(3)
    texts = ["".join(draw.choice(SCRAPS) for _ in range(draw.randint(0, 25))) for _ in range(8000)]
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode_all(texts) == want
    assert encode_all(texts[:500], limit=40) == want[:500]


def test_every_character_is_classed_as_the_library_does(library):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!" for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    assert encode_all(texts) == [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_pre_tokens_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("dialwise.llm.bytepairs.HELD", 10)
    texts = [f"word{i % 50} and {i}" for i in range(300)]
    assert encode_all(texts, limit=100) == [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(library, rows, end_id=0):
    """(doc_id, ids) in the order of the files, but for rows that share an id."""
    return sorted(((i, library.encode(t or "", add_special_tokens=False).ids + ([end_id] if end_id is not None else [])) for i, t in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("part_bytes", [1 << 26, 2000])
def test_files_hold_all_documents_in_order(spark, library, tmp_path, part_bytes):
    uri = f"file://{tmp_path}/tokens"
    files = tokenfiles.write(awkward(spark), PATH, uri, part_bytes=part_bytes)
    again = tokenfiles.TokenFiles.open(uri)
    assert again.bases.tolist() == files.bases.tolist() and again.kind == "<u2"
    got = again.rows(spark).collect()
    want = expected(library, TEXTS)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((i is not None, i or 0, ids) for i, ids in want)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    raw = b"".join((tmp_path / f"tokens/ids-{p}.bin").read_bytes() for p in range(len(files.ids)))
    assert np.frombuffer(raw, "<u2").tolist() == [x for r in got for x in r.ids]


def test_texts_come_back_from_the_ids(spark, library, tmp_path):
    files = tokenfiles.write(awkward(spark), PATH, str(tmp_path / "t"), end_id=None)
    got = {(r.doc_id, library.decode(r.ids, skip_special_tokens=False)) for r in files.rows(spark).collect()}
    assert got == {(i, t or "") for i, t in TEXTS}


def test_an_empty_table_gives_no_parts(spark, tmp_path):
    files = tokenfiles.write(nothing(spark), PATH, str(tmp_path / "t"))
    assert files.rows(spark).isEmpty() and tokenfiles.TokenFiles.open(str(tmp_path / "t")).bases.tolist() == [0]


def test_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in tokenfiles.op12(spark, sf).orderBy("doc_id").collect():
        ids = library.encode(docs.pop(r.doc_id), add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not docs
