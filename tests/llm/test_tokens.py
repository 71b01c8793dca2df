"""Counting, encoding and decoding against the library; folds against brute force."""

import itertools

import pytest
import sentencepiece

from dialwise.llm import lattice, tokencount
from dialwise.llm.pieces import Vocabulary, model_path
from tests.llm.helpers import TEXTS, awkward, nothing

HARD = ["", " ", "  two  spaces ", "a\nb\tc", "\x00a", "▁x▁▁ y", "ａｂ日本語", "<s> hi </s> <unk> <0x41>", "x" * 300, "ab" * 200 + " ",
        "1234567890 3.14", "don't   stop\r\n", "\U0001f600\U0001f601", "é" * 90, " leading", "trailing ", "=" * 130 + "-" * 70]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def hard(spark):
    return spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")


def test_counts_equal_the_library(spark, library):
    for docs, rows in ((hard(spark), list(enumerate(HARD))), (awkward(spark), TEXTS)):
        for most in (tokencount.HOT, 5, 0):
            got = tokencount.token_counts(docs, model_path(), limit=50, hot=most).collect()
            want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 50) for i, t in rows]
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokencount.token_counts(nothing(spark), model_path()).isEmpty()


def test_ids_equal_the_library_and_decode_back(spark, library):
    for docs, rows in ((hard(spark), list(enumerate(HARD))), (awkward(spark), TEXTS)):
        got = lattice.decode(lattice.encode(docs, model_path()), model_path()).collect()
        assert sorted(repr((r.doc_id, r.ids, r.text)) for r in got) \
            == sorted(repr((i, library.encode(t or ""), library.decode(library.encode(t or "")))) for i, t in rows)
        both = lattice.round_trip(docs, model_path()).collect()
        assert sorted(map(repr, map(tuple, both))) == sorted(map(repr, map(tuple, got)))
    assert lattice.encode(nothing(spark), model_path()).isEmpty() and lattice.round_trip(nothing(spark), model_path()).isEmpty()


def test_round_trip_is_exact(spark):
    rows = {i: t for i, t in enumerate(HARD) if "▁" not in t}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in lattice.decode(lattice.encode(docs, model_path()), model_path()).collect()} == rows


def test_null_ids_decode_to_null(spark):
    got = lattice.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), model_path()).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, None), (2, "")]


UNIGRAM = Vocabulary([(10, "a", -3.0), (11, "b", -3.1), (12, "ab", -4.0), (13, "ba", -4.3), (14, "aba", -5.1), (15, "bab", -6.7)], None, 0)


def test_viterbi_fold_equals_all_paths(spark):
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)] + ["aQb", "Q"]
    scores = {p: (i, s) for i, p, s in UNIGRAM.pieces}

    def best(word):
        ways = []
        for cut in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cut) if c], len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(p in scores or len(p) == 1 for p in parts):
                ways.append((sum(scores.get(p, (0, -16.7))[1] for p in parts), [scores.get(p, (0, 0))[0] for p in parts]))
        return max(w[0] for w in ways), ways

    frame = spark.createDataFrame(list(enumerate(words)), "word_key long, word string")
    value = {i: s for i, _, s in UNIGRAM.pieces} | {0: -16.7}
    for r in lattice.encode_words(frame, UNIGRAM, "unigram").collect():
        top, ways = best(words[r.word_key])
        assert r.ids in [w for _, w in ways] and sum(value[i] for i in r.ids) == pytest.approx(top)


def test_long_words_take_the_helper_with_the_same_result():
    known = {p: (i, s) for i, p, s in UNIGRAM.pieces}
    assert lattice.best_word("aba", known) == ["aba"]
    assert lattice.merge_word("abab", known) == ["ab", "ab"]
