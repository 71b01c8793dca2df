"""Quality rules per document and per host, with built-in functions only.

Counts of a text come from array functions on its own words, so no text and no
window is ever shuffled. The narrow counts are stored once; rule failures are
added up per host with partial aggregates, each host's rate is drawn towards
the mean of all hosts by a beta prior fitted to the hosts' rates by moments,
and the few hosts whose shrunk rate passes ``LIMIT`` are joined back. A small
host therefore needs more evidence than a large one. The join is left to
adaptive execution, which broadcasts the rejected hosts or splits a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import query, quoted, store, table

WINDOW = 5
LIMIT = 0.5
#: rule of a text: condition over its counts, the same in Spark and ANSI SQL
RULES = {
    "few_words": "n_words < 10",
    "repeated": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeated")
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_WORD_CHARS = "[^\\x20\\x09-\\x0D]"


def repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more, from the word hashes."""
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))


def covered(hashes: Column) -> Column:
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # equal neighbours in the sorted windows; every window is seen beside the one before and after it
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ordered)
    after = F.concat(F.slice(ordered, F.lit(2), F.size(ordered)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    trio = F.arrays_zip(ordered.alias("x"), before.alias("a"), after.alias("b"))
    twice = F.filter(trio, lambda t: F.coalesce(t["x"]["h"] == t["a"]["h"], F.lit(False))
                     | F.coalesce(t["x"]["h"] == t["b"]["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda t: t["x"]["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda s, p: F.struct(
        (s["n"] + F.least(p - s["last"], F.lit(WINDOW))).alias("n"), p.alias("last")), lambda s: s["n"])


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host`` and ``COUNTS`` per row; a null text has no words and no lines."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(host_col)).cast("string").alias("host"), text.alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    parts = base.select(
        "doc_id", "host", F.transform(words, lambda w: F.xxhash64(w)).alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    windowed = parts.select("doc_id", "host", n.cast("long").alias("n_words"), "word_chars", "n_symbols",
                            F.size("lines").cast("long").alias("n_lines"),
                            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                            windows.alias("windows"))
    return windowed.select("doc_id", "host", *[repeat_words(F.col("windows"), F.col("n_words")).alias(c) if c == "n_repeat_words"
                                               else F.col(c) for c in COUNTS])


def rejected_hosts(counts: DataFrame) -> DataFrame:
    """``host`` of the hosts whose shrunk failure rate passes ``LIMIT`` under some rule."""
    hosts = store(counts.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]))
    rate = lambda name: F.col(name) / F.col("n")
    facts = hosts.agg(*[f(rate(name)).alias(f"{kind}_{name}") for name in RULES
                        for kind, f in (("mean", F.avg), ("var", F.var_samp))]).first()
    bad = F.lit(False)
    for name in RULES:
        a, b = beta_prior(facts[f"mean_{name}"], facts[f"var_{name}"])
        bad = bad | ((F.col(name) + a) / (F.col("n") + (a + b)) > LIMIT)
    return hosts.where(bad).select("host")


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Parameters by moments; a strong prior where the hosts do not differ."""
    mean = mean or 0.0
    strength = max(mean * (1 - mean) / variance - 1, 1.0) if variance else 1000.0
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed, host_rejected, kept`` for every row.

    Documents without a host have no host verdict. Null and empty texts have no
    words and fail the base rule; repeated rows are judged one by one and all
    count for their host; an empty table gives no rows.
    """
    counts = store(text_counts(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    bad = rejected_hosts(counts).withColumn("host_rejected", F.lit(True))
    failed = F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))
    return counts.join(bad, "host", "left").withColumn("base_failed", failed) \
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))) \
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")) \
        .select("doc_id", *COUNTS, "base_failed", "host_rejected", "kept")


def _oracle() -> str:
    sums = ", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in RULES.items())
    priors = ", ".join(
        f"avg({r} / n) AS m_{r}, coalesce(CASE WHEN var_samp({r} / n) > 0 THEN "
        f"greatest(avg({r} / n) * (1 - avg({r} / n)) / var_samp({r} / n) - 1, 1.0) END, 1000.0::DOUBLE) AS s_{r}" for r in RULES)
    bad = " OR ".join(f"({r} + m_{r} * s_{r}) / (n + s_{r}) > {LIMIT}::DOUBLE" for r in RULES)
    failed = " OR ".join(f"({RULES[r]})" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT rid, regexp_extract_all(t, '{_WORD_CHARS}+') AS w FROM docs),
win AS (
  SELECT rid, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s,
    unnest(list_transform(generate_series(1, len(w) - {WINDOW - 1}), lambda s: array_to_string(w[s:s + {WINDOW - 1}], ' '))) AS g
  FROM split WHERE len(w) >= {WINDOW}),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
inside AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(generate_series(s, s + {WINDOW - 1})) AS p FROM twice) GROUP BY rid),
line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '{_WORD_CHARS}') GROUP BY rid),
counts AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM docs JOIN split USING (rid) LEFT JOIN inside USING (rid) LEFT JOIN line USING (rid)),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM counts WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT {priors} FROM hosts),
bad AS (SELECT source FROM hosts, prior WHERE {bad})
SELECT doc_id, {", ".join(COUNTS)}, {failed} AS base_failed,
  coalesce(source IN (SELECT source FROM bad), false) AS host_rejected,
  NOT ({failed}) AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept
FROM counts
"""


@query("op3_quality_rules", _oracle())
def op3(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
