"""Mixing: water-filling by hand, whole and partial repetitions against a plain loop."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomfuse.llm import mixing

DOCS = "doc_id long, text string, source string"


def plain(rows, weights=(5, 2, 1), share=1.5, most=2):
    """(doc_id, size, source_size, target, taken) as a sorted list."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left = {}, share * sum(sizes.values())
    while len(target) < len(order):
        free = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        target |= {s: most * sizes[s] for s in over} if over else {s: weight[s] * level for s in free}
        left -= sum(most * sizes[s] for s in over)
    out = []
    for s in order:
        docs = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n) for i, o, n in sized if o == s)
        copies = int(target[s] // sizes[s]) if sizes[s] else 0
        more = int(target[s]) - copies * sizes[s]
        for _, known, i, n in docs:
            part = min(n, more)
            more -= part
            out.append((i if known else None, n, sizes[s], round(target[s], 6), copies * n + part))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd():
    texts = ["a b c", None, "", " \t\r\n", "x　y z\x0b", "w " * 5000, "tie", "tie"]
    rows = [(i, texts[i % len(texts)] if i % 5 else f"word{i} " * (i % 17), None if i % 7 == 0 else f"s{i % 4}") for i in range(120)]
    return [*rows, (None, "nobody knows", "s1"), (None, "nobody knows", "s1"), rows[9], rows[9], (500, None, "empty"), (501, "one", "Tiny"), (502, "é ü", "ß")]


def test_mix_against_plain_loop(spark, odd):
    df = spark.createDataFrame(odd, DOCS).withColumn("size", F.lit("x")).withColumn("row", F.lit(1)).withColumn("target", F.lit(0)).repartition(5)
    got = rows_of(mixing.mix(df))
    assert got == plain(odd) == rows_of(mixing.mix(df.coalesce(1)))
    taken, targets = Counter(), {}
    for r in mixing.mix(df).collect():
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] + r.part
    assert all(0 <= targets[s] - taken[s] < 1 for s in targets)
    assert rows_of(mixing.mix(df, (1,), 0.5, 3)) == plain(odd, (1,), 0.5, 3)


def test_all_clamped_none_and_hot_source(spark):
    rows = [(i, "a b", "s") for i in range(50)]
    assert rows_of(mixing.mix(spark.createDataFrame(rows, DOCS), share=5)) == plain(rows, share=2)
    assert {r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "s"), (2, "", None)], DOCS)).collect()} == {0}
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    hot = [(i % 3000, f"w{i} " * (i % 5), "hot" if i % 3 else f"s{i % 11}") for i in range(9000)]
    assert rows_of(mixing.mix(spark.createDataFrame(hot, DOCS).repartition(7))) == plain(hot)


def test_materialised_texts_hold_the_words_taken(spark):
    rows = [(i, f" {i} b\tc\n d", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1))
    mixed = mixing.mix(docs)
    want = {r.doc_id: (r.taken, r.copies) for r in mixed.collect() if r.taken}
    got = defaultdict(list)
    for r in mixing.materialised(docs, mixed).collect():
        got[r.doc_id].append(r.text)
        assert rows[r.doc_id][1].startswith(r.text)
    assert {i: sum(len(t.split()) for t in ts) for i, ts in got.items()} == {i: n for i, (n, _) in want.items()}
