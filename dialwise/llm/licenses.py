"""License scan by ordered signature rules, with built-in functions only.

A text is searched as its lower-case words. Every rule is a regular expression
over a run of words and begins with two literal words, its keyword. A prefilter
on the raw text finds the texts that hold any keyword at all; in these, each
place where a keyword stands is joined to the rules that begin with it, and a
rule is tried on the ``REACH`` words from there on, as many as the longest rule
has. The SQL twin tries 16 words and so misses longer wordings. So the work follows the
number of keyword places, and no text is multiplied by rules.

Detections are resolved per text in one ordered pass: by start, longest first,
then by priority. What lies inside an earlier interval is suppressed. The base
phrases are rules too, but their places and labels are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialwise.llm.common import query, quoted, store, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANY_CASE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: phrase and label of the base detections
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, names as word runs, versions
FAMILIES = [
    ("gpl", ["gnu general public license", "gnu gpl", "general public license"], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl",
              "lesser general public license", "library general public license"], ["2.0", "2.1", "3.0"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["1.0", "3.0"]),
    ("gfdl", ["gnu free documentation license", "free documentation license", "gnu fdl"], ["1.1", "1.2", "1.3"]),
    ("apache", ["apache license", "apache software license", "apache public license"], ["1.0", "1.1", "2.0"]),
    ("mpl", ["mozilla public license"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license"], ["1.0", "2.0"]),
    ("cddl", ["common development and distribution license"], ["1.0", "1.1"]),
    ("cpl", ["common public license"], ["1.0"]),
    ("ipl", ["ibm public license"], ["1.0"]),
    ("eupl", ["european union public license", "european union public licence"], ["1.0", "1.1", "1.2"]),
    ("artistic", ["the artistic license", "perl artistic license"], ["1.0", "2.0"]),
    ("bsl", ["boost software license", "boost license"], ["1.0"]),
    ("ms-pl", ["microsoft public license"], []),
    ("ms-rl", ["microsoft reciprocal license"], []),
    ("osl", ["open software license"], ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("cecill", ["cecill license", "cecill free software license"], ["1.0", "2.0", "2.1"]),
    ("ofl", ["sil open font license", "open font license"], ["1.0", "1.1"]),
    ("psf", ["python software foundation license", "psf license"], ["2.0"]),
    ("php", ["php license"], ["3.0", "3.01"]),
    ("zpl", ["zope public license"], ["1.1", "2.0", "2.1"]),
    ("wtfpl", ["do what the fuck you want to public license"], ["2.0"]),
    ("odbl", ["open database license", "open data commons open database license"], ["1.0"]),
    ("mit", ["mit license", "mit licence", "the mit license", "expat license"], []),
    ("isc", ["isc license", "isc licence"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("unlicense", ["the unlicense", "unlicense license"], []),
    ("bsd", ["bsd license", "bsd style license", "berkeley software distribution license"], []),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license"], []),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "original bsd license"], []),
    ("cc0", ["creative commons zero", "cc0 1 0", "cc0 public domain"], ["1.0"]),
    ("public-domain", ["public domain dedication", "dedicated to the public domain", "in the public domain"], []),
]
CREATIVE = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CREATIVE_WORDS = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
CREATIVE_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
SHORT = [("gpl", ["1.0", "2.0", "3.0"]), ("lgpl", ["2.0", "2.1", "3.0"]), ("agpl", ["1.0", "3.0"]), ("apache", ["1.1", "2.0"]),
         ("mpl", ["1.1", "2.0"]), ("epl", ["1.0", "2.0"]), ("eupl", ["1.1", "1.2"]), ("cddl", ["1.0", "1.1"])]
#: wording around a license: the label says only that rights are spoken of
NOTICES = {"all rights reserved": "all-rights-reserved", "licensed under the terms": "licensed", "licensed under": "licensed",
           "released under": "licensed", "distributed under": "licensed", "subject to the terms": "licensed",
           "permission is hereby granted free of charge": "mit-text", "redistribution and use in source and binary forms": "bsd-text",
           "this program is free software": "free-software", "without warranty of any kind": "no-warranty",
           "spdx license identifier": "spdx"}


def version_words(version: str) -> str:
    """``2.0`` as it stands in words, with or without the minor zero and a ``v``."""
    major, _, minor = version.partition(".")
    return f"v?{major}(?: {minor})?" if minor == "0" else f"v?{major} {minor}"


def rules() -> Iterator[tuple[int, str, str, int, float, bool]]:
    """``(rule, label, regex, priority, weight, base)``: the families, spelled out by version and wording."""
    number = 0

    def rule(label: str, regex: str, priority: int, weight: float, base: bool = False):
        nonlocal number
        number += 1
        return number, label, regex, priority, weight, base

    for phrase, label in BASE.items():
        yield rule(label, phrase, 1, 0.9, True)
    for label, names, versions in FAMILIES:
        for name in names:
            yield rule(label, name, 2, 0.85)
            for v in versions:
                told = f"{name}(?: as published by the free software foundation)?(?: either)?(?: version| ver| v)? {version_words(v)}"
                yield rule(f"{label}-{v}", told, 4, 0.95)
                yield rule(f"{label}-{v}-or-later", f"{told}(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)", 5, 0.99)
                yield rule(f"{label}-{v}-only", f"{told} only", 5, 0.99)
    for short, versions in SHORT:
        for v in versions:
            major = v.partition(".")[0]
            for first in dict.fromkeys([f"{short} v{major}", f"{short} {major}", f"{short} version"]):
                minor = v.partition(".")[2]
                rest = f" {major}" if first.endswith("version") else ""
                tail = f"(?: {minor})?" if minor == "0" else f" {minor}"
                yield rule(f"{short}-{v}", first + rest + tail, 3, 0.9)
                yield rule(f"{short}-{v}-or-later", first + rest + tail + " or later", 5, 0.97)
                yield rule(f"{short}-{v}-only", first + rest + tail + " only", 5, 0.97)
    for kind in CREATIVE:
        label, spoken = "cc-" + kind.replace(" ", "-"), " ".join(CREATIVE_WORDS[k] for k in kind.split())
        yield rule(label, f"cc {kind}", 2, 0.85)
        yield rule(label, f"creative commons {spoken}", 2, 0.85)
        for v in CREATIVE_VERSIONS:
            yield rule(f"{label}-{v}", f"cc {kind} {version_words(v)}", 4, 0.95)
            yield rule(f"{label}-{v}", f"creative commons {spoken}(?: {v.replace('.', ' ')})?(?: international| unported)?(?: license| licence)?(?: version)? {version_words(v)}", 4, 0.95)
    for phrase, label in NOTICES.items():
        yield rule(label, phrase, 1, 0.5)


def most_words(regex: str) -> int:
    """Words of the longest run that a rule matches."""
    longest = lambda group: max(group[1].split("|"), key=lambda words: words.count(" "))
    return 1 + re.sub(r"\(\?:([^()]*)\)", longest, regex).count(" ")


#: words of the run that a rule is tried on
REACH = max(most_words(r[2]) for r in rules())


def keyed_rules() -> list[tuple]:
    """Rules with their keyword, the first two words, which must be literal."""
    out = []
    for number, label, regex, priority, weight, base in rules():
        keyword = re.match(r"[a-z0-9]+ [a-z0-9]+(?= |$|\()", regex)
        if keyword is None:
            raise ValueError(f"rule without keyword: {regex}")
        out.append((number, label, f"^(?:{regex})(?: |$)", priority, weight, base, keyword[0]))
    return out


def prefilter(keywords: list[str]) -> str:
    """A regular expression over lower-case text that every text with a keyword satisfies."""
    by: dict[str, list[str]] = {}
    for k in sorted(set(keywords)):
        by.setdefault(k.split()[0], []).append(k.split()[1])
    return "|".join(f"{a}{GAP}(?:{'|'.join(bs)})" for a, bs in by.items())


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, n_words, places``: keyword places as ``(at, keyword, run)``, null where the prefilter finds none."""
    found = sorted({r[6] for r in keyed_rules()})
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"))
    words = F.split(F.concat(F.lit(" "), F.translate("text", UPPER, LOWER), F.lit(" ")), GAP)
    seen = base.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"),
                       F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
                       F.when(F.lower("text").rlike(prefilter(found)), words).alias("words"))
    # the first and last entries are the empty ends before and after the blanks put around the text
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 4),
                        lambda i: F.struct(i.cast("long").alias("at"), F.concat_ws(" ", F.get("words", i + 1), F.get("words", i + 2)).alias("keyword")))
    hits = F.filter(pairs, lambda p: p["keyword"].isin(found))
    places = F.transform(hits, lambda p: F.struct(
        p["at"].alias("at"), p["keyword"].alias("keyword"),
        F.array_join(F.slice("words", (p["at"] + 2).cast("int"), F.lit(REACH)), " ").alias("run")))
    return seen.select("doc_id", "text_key", "n_words", F.when(F.size("words") >= 4, places).alias("places"))


def detections(places: DataFrame) -> DataFrame:
    """``text_key, rule, label, priority, weight, base, start, n, suppressed`` of every rule that matches at a place."""
    table = places.sparkSession.createDataFrame(
        keyed_rules(), "rule int, label string, regex string, priority int, weight double, base boolean, keyword string")
    found = places.where("size(places) > 0").select("text_key", F.explode("places").alias("p")).select("text_key", "p.*").distinct() \
        .join(F.broadcast(table), "keyword") \
        .withColumn("match", F.trim(F.call_function("regexp_extract", "run", "regex", F.lit(0)))).where("match != ''") \
        .select("text_key", "rule", "label", "priority", "weight", "base", F.col("at").alias("start"),
                F.size(F.split("match", " ")).alias("n"))
    order = Window.partitionBy("text_key").orderBy("start", F.desc("n"), F.desc("priority"), "rule") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reached", F.max(F.col("start") + F.col("n")).over(order)) \
        .withColumn("suppressed", F.coalesce(F.col("reached") >= F.col("start") + F.col("n"), F.lit(False))).drop("reached")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words, no places, empty labels and score 0;
    ``first_word`` and ``last_word`` are then null. Rows that repeat an id and
    its text get the same result; an empty table gives none. ``score`` is the
    greatest weight of a base place or a detection that is not suppressed.
    """
    seen = store(candidates(docs, id_col, text_col))
    listed = lambda condition: F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")
    told = detections(seen).groupBy("text_key").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), listed(F.col("base")).alias("base_labels"),
        listed(F.col("base") | ~F.col("suppressed")).alias("labels"),
        F.max(F.when(F.col("base") | ~F.col("suppressed"), F.col("weight"))).alias("score"))
    return seen.select("doc_id", "text_key", "n_words").join(told, "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _oracle() -> str:
    listed = ",\n    ".join(f"({n}, '{label}', '{regex}', {priority}, {weight}::DOUBLE, {str(base).lower()}, '{keyword}')"
                            for n, label, regex, priority, weight, base, keyword in keyed_rules())
    return f"""
WITH rules(rule, label, regex, priority, weight, base, keyword) AS (VALUES
    {listed}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
places AS (
  SELECT rid, unnest(generate_series(1, len(w) - 1)) AS i,
    unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS keyword,
    unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + {REACH - 1}], ' '))) AS run
  FROM docs WHERE len(w) > 1),
tried AS (SELECT p.rid, p.i, r.*, trim(regexp_extract(p.run, r.regex)) AS found FROM places p JOIN rules r USING (keyword)),
found AS (SELECT rid, rule, label, priority, weight, base, i - 1 AS s, len(string_split(found, ' ')) AS n FROM tried WHERE found <> ''),
resolved AS (
  SELECT *, coalesce(max(s + n) OVER (PARTITION BY rid ORDER BY s, n DESC, priority DESC, rule
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s + n, false) AS gone FROM found),
told AS (
  SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR NOT gone), '') AS labels,
    max(weight) FILTER (WHERE base OR NOT gone) AS score
  FROM resolved GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN told USING (rid)
"""


@query("op4_license_scan", _oracle())
def op4(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
