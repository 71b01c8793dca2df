"""The language model against plain Python, the classifier on held-out labels."""

import collections
import math

import pytest

from dialwise.llm import chat, classifier, ngrams
from tests.llm.helpers import TEXTS, awkward, nothing, words


class PlainModel:
    def __init__(self, texts):
        self.c, self.b = collections.Counter(), collections.Counter()
        for t in texts:
            w = [*words(t), 0]
            self.c.update(w)
            self.b.update(zip([None, *w], w))
        self.before = collections.Counter(w for _, w in self.b)
        self.context = collections.Counter()
        self.follow = collections.defaultdict(lambda: [0, 0, 0])
        for (h, _), n in self.b.items():
            self.context[h] += n
            self.follow[h][min(n, 3) - 1] += 1
        of = lambda values: ngrams.discounts([sum(v == k for v in values) for k in (1, 2, 3, 4)])
        self.d, self.e = of(self.b.values()), of(self.before.values())

    def low(self, w):
        if not self.b:
            return 1 / (len(self.c) + 1)
        n, left = self.before.get(w, 0), sum(self.e[min(v, 3) - 1] for v in self.before.values())
        return ((n - self.e[min(n, 3) - 1] if n else 0) + left / (len(self.c) + 1)) / len(self.b)

    def p(self, h, w):
        if not self.context[h]:
            return self.low(w)
        n = self.b.get((h, w), 0)
        rest = sum(a * b for a, b in zip(self.d, self.follow[h]))
        return ((n - self.d[min(n, 3) - 1] if n else 0) + rest * self.low(w)) / self.context[h]

    def row(self, t):
        w = [*words(t), 0]
        total = sum(self.c.values())
        base = sum(math.log10((self.c.get(x, 0) + 1) / (total + len(self.c) + 1)) for x in w)
        return len(w), sum(x in self.c for x in w), total, base, sum(math.log10(self.p(h, x)) for h, x in zip([None, *w], w))


@pytest.mark.parametrize("shards", [1 << 22, 3])
def test_scores_equal_plain_python(spark, monkeypatch, shards):
    monkeypatch.setattr(ngrams, "PAIRS_PER_SHARD", 1 << 16 if shards == 3 else shards)
    monkeypatch.setattr(ngrams, "HELD", 1 << 10 if shards == 3 else 1 << 21)
    docs = awkward(spark)
    model = ngrams.train(docs.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    plain = PlainModel([t for i, t in TEXTS if i is None or i % 2 == 0])
    got = sorted(ngrams.score(docs, model).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.score))
    want = sorted(((i, *plain.row(t)) for i, t in TEXTS), key=lambda r: (repr(r[0]), r[1], r[5]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:4] == w[:4]
        assert (g.base_score, g.score) == (pytest.approx(w[4], rel=1e-6), pytest.approx(w[5], rel=1e-6))


def test_probabilities_add_up():
    plain = PlainModel(["a b a c d a b", "b c a", "e f a b c"])
    for h in ("a", "b", None, "unseen"):
        assert sum(plain.p(h, w) for w in plain.c) + plain.p(h, "unknown") == pytest.approx(1)


def test_model_of_nothing(spark):
    model = ngrams.train(nothing(spark))
    rows = ngrams.score(awkward(spark), model).collect()
    assert len(rows) == len(TEXTS) and all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in rows)
    assert ngrams.score(nothing(spark), ngrams.train(awkward(spark))).isEmpty()


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = classifier.held_out("doc_id")
    some = docs.join(labels, "doc_id", "left_semi")
    voters = classifier.fit(docs, labels)
    assert len(voters.labels) <= classifier.MAX_LABELLED
    rows = classifier.score(some.where(held), voters).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in rows if r.quality) / sum(r.quality for r in rows) > 0.99


def test_classifier_on_awkward_tables(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (2, 1, "y"), (None, 1, "z"), (9, None, "z"), (99, 1, "z")],
                                   "doc_id long, quality int, text string")
    for known in (labels, labels.limit(0)):
        voters = classifier.fit(docs, known)
        rows = classifier.score(docs, voters).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert classifier.keep_good(docs, voters).columns == docs.columns
        assert classifier.score(nothing(spark), voters).isEmpty()


def test_conversations_collapse(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "hello"), (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, 2, "user", "bye"),
             (3, 0, "user", "hi"), (3, 1, "bot", "hello"), (3, 2, "user", "bye"), (4, 0, "user", "hi"), (4, 1, "bot", "other"),
             (5, 0, None, None), (6, 0, "", ""), (7, None, "user", "hi"), (7, 0, "user", "hi"), (None, 0, "user", "lost"),
             (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    docs = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, place string, chunk string")
    got = {r.conv_id: r for r in chat.render(chat.maximal(docs)).collect()}
    assert set(got) == {2, 4, 5, 6, 7}
    assert got[2].rendered == "<|user|>\nhi\n<|end|>\n<|bot|>\nhello\n<|end|>\n<|user|>\nbye\n<|end|>\n" and got[2].n_turns == 3
    assert got[7].n_turns == 2 and got[5].rendered == "<||>\n\n<|end|>\n"
    assert chat.render(chat.maximal(docs.limit(0))).isEmpty()


def test_long_conversations_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    rows = [(c, k, "user", f"t{k}" if k < n - c else f"own{c}") for c, n in ((1, 50), (2, 31), (3, 90)) for k in range(n)]
    rows += [(4, k, "user", f"t{k}") for k in range(29)]
    got = {r.conv_id: r.n_turns for r in chat.render(chat.maximal(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: 50, 2: 31, 3: 90}
