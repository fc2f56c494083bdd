"""Collocations against plain counting, whatever the sample proposes and however little a task may hold."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfuse.llm import phrases

DOCS = "doc_id long, text string, lang string"


def plain(rows, least, top, covered=50):
    f, n, out = defaultdict(Counter), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + 2] for p, a in found.items() if len(p) == 3 for i in (0, 1) if 100 * a >= covered * found[p[i : i + 2]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, l, r, n[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(rows[:top])]
    return sorted(out)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "new", "york", "times", "é", "Über", "x　y", "a\x1cb", "İ", "don't", "𝛼"]
    weights = rng.dirichlet(np.ones(len(words)) * 0.7)
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!?", ":x;"]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 60))
        rows.append((i, "".join(w + g for w, g in zip(rng.choice(words, k, p=weights), rng.choice(gaps, k), strict=True)), [None, "en", "und", "fr", ""][i % 5]))
    return [*rows, (None, None, "en"), (7, "", "en"), (8, " \t ", None), rows[3], rows[3], (9, "the of new " * 4000, "en"), (9, "z" * 300_000, "fr")]


@pytest.fixture(scope="module")
def rows():
    return texts(300, 1)


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("one_in", [1, 8, 1 << 40])
def test_same_result_whatever_the_sample(spark, rows, one_in):
    df = spark.createDataFrame(rows, DOCS).withColumn("words", F.lit(1)).withColumn("n", F.lit("x")).withColumn("phrase", F.lit("x")).repartition(4)
    assert result(phrases.collocations(df, 6, 40, one_in=one_in, bits=12)) == plain(rows, 6, 40)
    passes = phrases.frequent(df, 6, one_in=one_in, bits=12)[1]
    assert passes == {1: 1, 1 << 40: 3}.get(one_in, passes)


def test_small_slices_and_tasks_that_hold_little(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    monkeypatch.setattr(phrases, "HELD", 20)
    monkeypatch.setattr(phrases, "VOCABULARY", 30)
    code = lambda name: getattr(phrases, name)
    got = defaultdict(int)
    counter = phrases.Counter("en", [(np.full(512, 255, np.uint8), np.full(512, 255, np.uint8))], 12, True)
    text = " ".join(t for _, t, _ in rows[:60]).encode()
    at = 0
    while at < len(text):
        end = text.rfind(b" ", at, at + code("SLICE")) + 1 or text.find(b" ", at + code("SLICE")) + 1 or len(text)
        counter.add(text[at:end])
        at = end
        if counter.full():
            last = [counter.words[i] for i in counter.last]
            for b in counter.given():
                for r in b.to_pylist():
                    got[r["words"], r["phrase"]] += r["n"]
            counter.last = counter._number(last)
    for b in counter.given():
        for r in b.to_pylist():
            got[r["words"], r["phrase"]] += r["n"]
    want = Counter()
    for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text.decode())):
        ws = re.findall("[^ \t]+", piece)
        want[0, ""] += len(ws)
        for k in (1, 2, 3):
            want.update((k, " ".join(ws[i : i + k])) for i in range(len(ws) - k + 1))
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_empty_tables_and_exact_scores(spark):
    none = spark.createDataFrame([], DOCS)
    assert phrases.collocations(none, bits=12).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], DOCS), bits=12).count() == 0
    big = 3_037_000_500_000
    found = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big), ("en", 1, "c", big), ("en", 2, "b c", big), ("en", 3, "a b c", big)], "lang string, words int, phrase string, n long")
    got = {r.phrase: (r.score, r.l, r.r) for r in phrases._scored(found).collect()}
    assert got["a b"] == (10**6 * big * big // ((big + 1) * (big + 3)), big + 1, big + 3)
    assert got["a b c"] == (999_999, big + 1, big)
