"""Quality rules, licence scan and line deduplication against plain programs."""

import collections
import random
import re

from pyspark.sql import functions as F

from barscope.llm import licences, linededup, quality

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if n[tuple(w[i : i + 3])] > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base)


def random_texts(n, seed=1):
    r = random.Random(seed)
    pieces = ["the", "of", "a", "b", "und", "x1", "é", "#", "<b>", "...", "\n", "\n\n", "\t", "  ", "end.", "日本"]
    return [" ".join(r.choice(pieces) for _ in range(r.randrange(0, 150))) for _ in range(n)]


def test_quality_counts(make_docs):
    texts = random_texts(60) + ["", None, "a b c " * 30, "a a a", "x\n x\nx"]
    got = {r["doc_id"]: r for r in quality.rate(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == plain_quality(t), t


def test_quality_odd(odd_docs, no_docs):
    rows = quality.rate(odd_docs).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[3].n_words == 40_000 and not by_id[3].base_failed
    assert quality.rate(no_docs).count() == 0


def test_quality_is_one_projection(odd_docs):
    plan = quality.rate(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_thresholds(make_docs):
    good = " ".join(f"the word{i}" for i in range(40))
    junk = " ".join(f"#$%word{i}" for i in range(80))
    kept = {r.doc_id: r.kept for r in quality.rate(make_docs([(1, good), (2, junk)])).collect()}
    assert kept == {1: True, 2: False}


def test_licences(make_docs):
    texts = [
        "Released under the MIT License.", "UNDER THE MIT LICENSE under, the mit-license", "under the mit licenses",
        "Licensed under CC BY-NC 4.0 and the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "mit license the under", None, "", "cc by nc cc by nc", "redistribution and use in source and binary forms",
    ]
    got = {r.doc_id: r for r in licences.scan(make_docs(list(enumerate(texts)))).collect()}
    phrases = [(t.label, t.phrase.split()) for t in licences.TEMPLATES if t.base]
    for i, t in enumerate(texts):
        w = [x for x in re.split(NOT_WORD, lower(t or "")) if x]
        places = [(p, label) for label, ph in phrases for p in range(len(w)) if w[p : p + len(ph)] == ph]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), t
        assert r.first_word == min((p for p, _ in places), default=None)
        assert r.last_word == max((p for p, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[4].labels == "gpl" and got[9].labels == "bsd" and got[0].score == 1.0 and got[5].score == 0


def test_licences_odd(odd_docs, no_docs):
    rows = licences.scan(odd_docs).collect()
    assert len(rows) == 10 and all(r.labels == "" and r.score == 0 and r.first_word is None for r in rows)
    assert licences.scan(no_docs).count() == 0


def plain_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                first[key(x)] = min(d, first.get(key(x), d))
    return [(d, "\n".join(x for x in (t or "").split("\n") if d is None or first.get(key(x), d) == d)) for d, t in rows]


def test_line_dedup(make_docs):
    r = random.Random(3)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["short", "", "  Line Number 3 of the POOL\t", "Émile et une ligne", "émile et une ligne"]
    rows = [(d, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 12)))) for d in r.sample(range(1000), 60)]
    rows += [(2000, None), (2001, ""), (None, pool[0]), (2002, pool[1] + "\n" + pool[1])]
    for batches in (1, 4, 7):
        got = linededup.dedup_lines(make_docs(rows), batches)
        assert got.columns[:2] == ["doc_id", "text"] and "label" in got.columns
        found = sorted((x.doc_id or -1, x.text or "") for x in got.collect())
        assert found == sorted((d or -1, t) for d, t in plain_lines(rows))


def test_line_dedup_of_clashing_names_and_outlying_ids(spark):
    rows = [(k, f"a line of its own {k}\na line that all have", "x") for k in (1, 2, 3, 10**12)]
    names = ["late", "first", "h1", "h2", "known", "lines"]
    docs = spark.createDataFrame([(*r, *names[1:]) for r in rows], "doc_id long, text string, late string, first string, h1 string, h2 string, known string, lines string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert [got[k]["__n_dropped"] for k in (1, 2, 3, 10**12)] == [0, 1, 1, 1] and got[2].text == "a line of its own 2" and got[2].late == "x"
    sizes = [docs.where(c).count() for c in linededup._batches(docs, 4)]
    assert sizes == [1, 1, 1, 1]


def test_line_dedup_odd(odd_docs, no_docs):
    got = linededup.dedup_lines(odd_docs)
    assert got.count() == 10 and linededup.dedup_lines(no_docs).count() == 0
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1]["__n_lines"] == 1 and by_id[4].text == "the same row twice, once more"


def test_runs_are_compacted(spark, make_docs):
    runs = linededup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(linededup.line_keys(make_docs([(k, f"a line of its own {k}\nthe line that all have")])))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.runs().count() == 6 and runs.runs().where(F.col("first") == 0).count() == 2
