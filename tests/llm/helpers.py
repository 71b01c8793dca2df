"""Plain-Python versions of the operators and awkward tables to run them on."""

import collections
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
SENTENCE = "The quick brown fox jumps over the lazy dog while seven other animals look on. "
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi other"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi"),
    (4, None), (5, ""), (6, " \t\n\x0b\f\r "), (7, "one"), (8, "one"), (9, "ONE two three four"),
    (10, LONG), (11, LONG + " tail"), (12, "x" * 5000),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi"),
    (13, "Ünïcödé — 日本語 \U0001f600 naïve words\n\nnew line\ttab ▁under"), (14, "a b c d e f g a b c d e f g a b c d e f g"),
    (14, "a b c d e f g a b c d e f g a b c d e f g"), (14, "same id, other text altogether"),
    (15, SENTENCE * 3), (16, "Before it. " + SENTENCE + "After it comes a long closing sentence with enough words to count."),
    (17, "a\x00b \x1f mixed 0x41 #*$%&|<>"),
]


def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeats and clashing extra columns."""
    rows = [(i, t, "en" if i and i % 2 else None, f"s{i % 3}" if i else None, len(t) if t else None) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = ["text_key", "cuts", "node", "digest", "score", "word_key", "words", "n", "host", "places", "kept", "key", "ids"]
    return docs.select("*", *[F.lit(c).alias(c) for c in clash])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_groups(rows):
    """Row number to (set size, component id) by comparing every pair."""
    sets = [shingles(t) if i is not None else None for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    least = collections.defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least[find(k)], i)
    return [(len(shingles(t)), least[find(k)] if i is not None else None) for k, (i, t) in enumerate(rows)]
