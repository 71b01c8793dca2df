"""Host rules, license scans and substring dedup against plain Python."""

import collections
import re

import pytest

from dialwise.llm import hostrules, licenses, substring
from tests.llm.helpers import AZ, SENTENCE, TEXTS, alnum_words, awkward, nothing


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), lines


def test_counts_equal_plain_python(spark):
    got = hostrules.judge(awkward(spark)).collect()
    want = []
    for i, t in TEXTS:
        c = counts(t)
        want.append(repr((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])))
    assert sorted(repr(tuple(r)[:8]) for r in got) == sorted(want)
    assert hostrules.judge(nothing(spark)).isEmpty()


def test_bad_host_is_rejected_and_small_hosts_shrink(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "few words"
    rows = [(i, good, f"h{i % 8}") for i in range(400)] + [(1000 + i, bad if i < 45 else good, "spam") for i in range(50)] \
        + [(2000, bad, "tiny"), (2001, good, "tiny"), (3000, good, None)]
    got = {r.doc_id: r for r in hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1049].host_rejected and not got[1049].base_failed and not got[1049].kept
    assert not got[2001].host_rejected and got[2001].kept and got[3000].kept and got[0].kept


def test_prior_shrinks_towards_the_mean():
    a, b = hostrules.beta_prior(0.2, 0.01)
    assert abs(a / (a + b) - 0.2) < 1e-12 and a + b > 1
    assert hostrules.beta_prior(None, None) == (0.0, 1000.0)


LICENSED = [
    (1, "Released under the GNU General Public License, version 2.0 or (at your option) any later version."),
    (2, "mit license MIT License mit-license"), (3, "summit license; admit licensee"), (4, "gnu general public"), (5, None), (6, ""),
    (7, "CC BY 4.0 and cc-by-sa 3.0"), (8, "Apache License, Version 2.0 (the License)"), (9, "license mit"),
    (10, "the mit license " * 500), (10, "the mit license " * 500), (None, "cc by"), (11, "GNU\nGENERAL\tPUBLIC...LICENSE"), (12, "mİt license"),
]


def places(text):
    w, out = alnum_words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in out]
    return len(w), len(out), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in out}))


def resolved(text):
    """Labels after suppression, by comparing every pair of detections."""
    w, found = alnum_words(text), []
    for number, label, regex, priority, _, base, keyword in licenses.keyed_rules():
        for i in range(len(w) - 1):
            if f"{w[i]} {w[i + 1]}" == keyword and (m := re.match(regex, " ".join(w[i:i + licenses.REACH]))):
                n = len(m[0].split())
                found.append((i, -n, -priority, number, i + n, label, base))
    kept = {f[5] for f in found if f[6] or not any(g[:4] < f[:4] and g[4] >= f[4] for g in found)}
    return ",".join(sorted(kept))


def test_scan_equals_plain_python(spark):
    docs = spark.createDataFrame(LICENSED, "doc_id long, text string")
    got = licenses.scan(docs).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr((i, *places(t))) for i, t in LICENSED)
    for r in got:
        text = next(t for i, t in LICENSED if i == r.doc_id)
        if text is None or len(text) < 1000:
            assert r.labels == resolved(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels for r in got}
    assert "gpl-2.0-or-later" in labels[1] and "cc-by-4.0" in labels[7] and "apache-2.0" in labels[8]


def test_scan_of_awkward_and_empty_tables(spark):
    assert sorted(repr(tuple(r)[:6]) for r in licenses.scan(awkward(spark)).collect()) == sorted(repr((i, *places(t))) for i, t in TEXTS)
    assert licenses.scan(nothing(spark)).isEmpty()


def test_every_rule_text_passes_the_prefilter():
    gate = re.compile(licenses.prefilter([r[6] for r in licenses.keyed_rules()]))
    for r in licenses.keyed_rules():
        assert gate.search(r[6].replace(" ", " - "))


def unit_list(text):
    """``(normalised words, start, end, at, is_run)`` of the units of one text, by plain Python and without any hash."""
    text = text or ""
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ)))
    words = [m[0] for m in found]
    n, least = len(words), substring.MIN_WORDS
    gaps = [text[a.end():b.start()] for a, b in zip(found, found[1:])] + ["\n"]
    parts, at, since = [], 0, 0
    for k in range(n):
        if "\n" in gaps[k] or any(c in gaps[k] for c in ".!?"):
            if "\n" in gaps[k] or k + 1 - since >= least:
                parts.append((at, k + 1))
                at = k + 1
            since = k + 1
    spans_ = {p for p in parts if p[1] - p[0] >= least}
    for k, (a, b) in enumerate(parts):
        if b - a < least:
            ahead = [e for _, e in parts[k:] if e - a >= least][:1]
            behind = [s for s, _ in reversed(parts[:k + 1]) if b - s >= least][:1]
            spans_ |= {(a, e) for e in ahead} | {(s, b) for s in behind}
    runs = [(i, i + substring.WINDOW) for i in range(n - substring.WINDOW + 1) if len(set(words[i:i + substring.WINDOW])) > 1]
    border = lambda b: found[b].start() if b < n else len(text)
    return [(tuple(words[a:b]), found[a].start(), border(b), a, is_run)
            for group, is_run in ((sorted(spans_), False), (runs, True)) for a, b in group]


def removed_units(rows):
    """Rows of ``repeats`` by plain Python, of tables in which no id repeats with its text."""
    rank = lambda i, t: (i is not None, i or 0, t)
    units = [(rank(i, t), i, t, *u) for i, t in rows for u in unit_list(t)]
    first = {}
    for r, i, t, words, start, end, at, _ in units:
        first[words] = min(first.get(words, (r, start, end, at)), (r, start, end, at))
    out, islands = [], collections.defaultdict(list)
    for r, i, t, words, start, end, at, is_run in units:
        keeper, k_start, k_end, k_at = first[words]
        if keeper == r and k_start <= start < k_end:
            continue
        kept_id = keeper[1] if keeper[0] else None
        if is_run:
            islands[(i, t, keeper, kept_id, k_at - at)].append((at, start, end, k_start))
        else:
            out.append((i, start, end, len(words), kept_id, k_start))
    for (i, t, keeper, kept_id, _), found in islands.items():
        found.sort()
        begin = 0
        for k in range(1, len(found) + 1):
            if k == len(found) or found[k][0] - found[k - 1][0] > substring.WINDOW:
                a, b = found[begin], found[k - 1]
                out.append((i, a[1], b[2], b[0] - a[0] + substring.WINDOW, kept_id, a[3]))
                begin = k
    return out


REPEATS = [(i, t) for i, t in TEXTS if t is None or len(t) < 10_000] + [
    (30, "Own words of this one stand here. " + SENTENCE + "Ünd nöch etwas mehr Text als zuvor in diesem langen Satz.\nShort line."),
    (31, "Intro\n" + SENTENCE.upper() + "\nShort line.\n" + "ünd NÖCH etwas mehr text als zuvor in diesem langen satz"),
    (32, "word " * 100), (33, "other " + "word " * 100), (40, SENTENCE), (None, SENTENCE)]


def passages():
    """Passages in lines of any width, in texts of their own words; texts differ, so their hashes only break ties of ids."""
    run = lambda name, n: [f"{name}{k}" for k in range(n)]
    wrap = lambda words, width: "\n".join(" ".join(words[k:k + width]) for k in range(0, len(words), width))
    out = []
    for k, (length, widths) in enumerate([(60, (10, 12, 15)), (20, (36, 30, 30)), (20, (30, 30, 9)), (16, (5, 7, 100)), (300, (11, 13, 500))]):
        for w, width in enumerate(widths):
            own = f"o{k}x{w}y"
            out.append((1000 + 10 * k + w, wrap(run(own + "a", 9 + w) + run(f"passage{k}q", length) + run(own + "b", 7 + 2 * w), width)))
    return out


def test_removed_units_equal_plain_python(spark):
    rows = sorted({(repr(i), i, t) for i, t in [*REPEATS, *passages()]}, key=repr)
    rows = [(i, t) for _, i, t in rows]
    # texts under one id rank by their hash, which plain Python does not have
    seen = collections.Counter(i for i, _ in rows)
    rows = [(i, t) for i, t in rows if seen[i] == 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, removed_units(rows)))
    got = substring.repeats(docs).drop("text_key").collect()
    assert sorted(repr(tuple(r)) for r in got) == want and len(want) >= 15
    gone = collections.defaultdict(list)
    for i, start, end, *_ in removed_units(rows):
        gone[i].append((start, end))

    def cut(i, t):
        hit = {k for s, e in gone[i] for k in range(s, e)}
        return t and "".join(c for k, c in enumerate(t) if k not in hit)

    cleaned = sorted(repr((r.doc_id, r.text)) for r in substring.remove_repeats(docs).collect())
    assert cleaned == sorted(repr((i, cut(i, t))) for i, t in rows)


def test_a_passage_goes_however_its_copies_are_wrapped(spark):
    rows = passages()
    got = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        left = [w for w in got[i].split() if w.startswith("passage")]
        assert len(left) == (sum(w.startswith("passage") for w in text.split()) if i % 10 == 0 else 0)
        assert [w for w in got[i].split() if w.startswith("o")] == [w for w in text.split() if w.startswith("o")]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_removed_units_of_a_whole_table_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = substring.repeats(docs).drop("text_key").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, removed_units(rows)))


def copies():
    """A passage in texts of their own words, in lines of other widths and of as many words as a run has; two near copies; repeated words."""
    run = lambda name, n: [f"{name}{k}" for k in range(n)]
    lines = lambda words, first, width: "\n".join(" ".join(x) for x in [words[:first], *[words[k:k + width] for k in range(first, len(words), width)]])
    passage, other, size = run("passage", 200), run("other", 1500), substring.WINDOW
    out = [(k, " ".join(run(f"a{k}x", 12)) + "\n" + lines(passage, first, width) + "\n" + " ".join(run(f"b{k}x", 9)))
           for k, (first, width) in enumerate([(200, 1), (size, size), (7, size), (30, 25), (64, 20)])]
    changed = [w + "new" * (k in (90, 91, 170)) for k, w in enumerate(other)]
    return [*out, (10, lines(other, 40, 60)), (11, lines(changed, 30, 24)), (12, "left right " * 60 + " ".join(passage[50:90])), (13, "right left " * 60)]


def test_stretches_of_repeated_runs_are_listed_once(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows, listed, before, store = copies(), {}, spark.conf.get(name), substring.store

    def counted(df, **options):
        assert spark.conf.get(name) == "true"  # or the shuffle files of every step stay until the last
        out = store(df, **options)
        if "at" in out.columns:
            listed[len(listed)] = out.count()
        return out

    monkeypatch.setattr(substring, "store", counted)
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key").collect()
    want = removed_units(rows)
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want)) and spark.conf.get(name) == before
    # lines of 16 words that only runs of an earlier text equal
    assert sum(i == 1 and kept == 0 and n == substring.WINDOW for i, _, _, n, kept, _ in want) >= 10
    units = collections.Counter(words for _, t in rows for words, *_, is_run in unit_list(t) if is_run)
    repeated = sum(n for n in units.values() if n > 1)
    assert repeated > 1000 and listed[0] < repeated / 2


def test_substring_on_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert substring.repeats(nothing(spark)).isEmpty() and substring.remove_repeats(nothing(spark)).isEmpty()


def test_passage_inside_lines_goes_from_all_but_one(spark):
    passage = " ".join(f"p{k}" for k in range(70))  # no sentence end at all
    rows = [(i, f"Line {i} of its own text here {i}.\nstart{i} {passage} end{i} more{i}.") for i in range(5)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 5):
        assert len(got[i].split()) < 45 and f"start{i}" in got[i] and f"more{i}" in got[i]


def test_passage_in_short_lines_goes_from_all_but_one(spark):
    verse = "\n".join(" ".join(f"v{6 * k + j}" for j in range(6)) for k in range(10))
    mixed = "\n".join(" ".join(f"m{k}x{j}" for j in range(9 if k % 2 else 4)) for k in range(10))
    rows = [(i, f"Top {i}\nown{i} words\n{verse}\nbetween{i}\n{mixed}\nlast{i} line{i}") for i in range(4)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 4):
        # "words" stands before the verse in every text, so it is the first word of the passage
        assert got[i] == f"Top {i}\nown{i} between{i}\nlast{i} line{i}"


def test_long_lines_and_passages_inside_them_go_whole(spark):
    run = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    schema, kinds = "doc_id long, text string", range(40)
    texts = [(run(f"line{k}q", 40), run(f"passage{k}q", 51)) for k in kinds]
    rows = [(100 * k + i, f"{line}\n{run(f'a{k}x{i}y', 20)} {passage} {run(f'b{k}x{i}y', 20)}.")
            for k, (line, passage) in enumerate(texts) for i in range(3)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    for k in kinds:
        assert got[100 * k] == rows[3 * k][1]
        for i in (1, 2):
            assert got[100 * k + i] == f"{run(f'a{k}x{i}y', 20)} {run(f'b{k}x{i}y', 20)}."


def test_text_that_repeats_itself_keeps_a_whole_window(spark):
    docs = spark.createDataFrame([(1, "left right " * 40)], "doc_id long, text string")
    assert substring.remove_repeats(docs).first().text == "left right " * (substring.WINDOW // 2)


def test_one_occurrence_stays_where_texts_share_an_id(spark):
    rows = [(i, f"{SENTENCE}Own words number {k} stand here.") for i in (None, 5) for k in range(3)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got if SENTENCE in r.text] == [None] and len(got) == 6


def test_full_gnu_notices_reach_the_longest_rules(spark):
    told = "This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by\n" \
        "the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    names = [("GNU General Public License", "2", "gpl-2.0"), ("GNU General Public License", "3", "gpl-3.0"),
             ("GNU Lesser General Public License", "2.1", "lgpl-2.1"), ("GNU Library General Public License", "2", "lgpl-2.0"),
             ("GNU Affero General Public License", "3", "agpl-3.0")]
    rows = [(k, told.format(name, version)) for k, (name, version, _) in enumerate(names)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (_, _, label) in enumerate(names):
        assert f"{label}-or-later" in got[k].labels.split(",") and label not in got[k].labels.split(",") and got[k].score == 0.99
        assert got[k].labels == resolved(rows[k][1])
