"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from loomfuse.llm import near, simhash
from loomfuse.llm.common import written


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = {0: {r[0] for r in docs.select("doc_id").collect()}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        ids[k] = {r[0] for r in docs.select("doc_id").collect()}
        assert ids[k] <= ids[k - 1]
    toxic = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    clean = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").select("doc_id").collect()}
    assert len(toxic & ids[1]) <= 0.2 * len(toxic) and len(clean - ids[1]) <= 0.05 * len(clean)
    assert ids[2] == ids[1] and len(ids[3]) < len(ids[2]) and len(ids[4]) < len(ids[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert total.count() == len(ids[4]) and total.where("n <> t").isEmpty()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_near_dedup_finds_all_similar_texts_and_no_others(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts = ["", " \n", "short text", "SHORT  text"]
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([8, 40, 90, 300]))
        for changes in range(6):
            words = list(base)
            for _ in range(changes):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        texts.append(passage + " " + " ".join(r.choices(vocabulary, k=r.choice([5, 30]))))
    sets = [near.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a.tolist()) & set(b.tolist()))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                root = [root[j] if x == root[i] else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for k, x in enumerate(root):
        first.setdefault(x, k)
    assert len(first) < len(set(texts))
    assert {x[0] for x in simhash.stage(spark, docs, "").select("doc_id").collect()} == set(first.values())
    for block in (3, near.BLOCK):
        got = {x.doc_id: x.root for x in near.near_copies(docs, block=block).collect()}
        assert len(set(got.values())) == len(first) and all(got[k] == got[first[x]] for k, x in enumerate(root))


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = ["", "one", "two words"]
    for _ in range(20):
        base = r.choices(vocabulary, k=300)
        for at in (None, 0, 150, 299):  # one word changed
            texts.append(" ".join(base if at is None else [*base[:at], "edit", *base[at + 1 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near.shingles(t) for t in texts]
    found = [near.bands(x).view("uint64").tolist() for x in sets]
    for x, y in zip(sets, found, strict=True):  # the first two bands are the 64-bit SimHash
        ones = [2 * sum(int(h) >> k & 1 for h in x) > len(x) for k in range(64)]
        assert [v >> 30 & 0xFFFFFFFF for v in y[:2]] == [sum(1 << k for k in range(32) if ones[k + at]) for at in (0, 32)] and [v >> 62 for v in y] == [0, 1, 2, 3]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if any((a ^ b).bit_count() <= near.BUDGET for a, b in zip(found[i], found[j], strict=True))}
    rows = near.shingle_sets(docs).select("doc_id", "set", "n", "cells", "bands")
    number = {x.set: x.doc_id for x in rows.collect()}
    for pair_rows in (4, 40_000):
        root = list(range(len(texts)))
        for x in near.fingerprint_pairs(rows, pair_rows).collect():
            i, j = number[x.a], number[x.b]
            root = [root[j] if y == root[i] else y for y in root]
        assert all(root[i] == root[j] for i, j in close)  # none that fingerprints bring together is lost
    want = list(range(len(texts)))
    for i, j in close:
        if near.similar(sets[i], sets[j]):
            want = [want[j] if y == want[i] else y for y in want]
    shared = near._shared
    monkeypatch.setattr(near, "_shared", lambda sets: shared(sets).limit(0))  # fingerprints alone
    got = {x.doc_id: x.root for x in near.near_copies(docs).collect()}
    assert len(set(want)) < len(texts) - 30
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))


def test_stages_on_odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and a further column."""
    long = " ".join(f"word{i} of a long text" for i in range(6000))
    passage = "\n".join(f"this is line {i} of a passage that stands in several documents, word for word" for i in range(6))
    rows = [(None, None, None, None, None), (0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, " ", None, "s", 1), (3, long, "en", None, len(long)), (3, long, "en", None, len(long)), (4, long, "en", "s", None)]
    rows += [(5, passage, "en", "s", 1), (6, "first words here\n" + passage, "en", "s", 1), (7, "tie one two three four", "en", "s", 1), (8, "tie one two three four", "en", "s", 1), (None, "nobody's own words stand here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    sf, seen = "/root/testdata/sf0.001", []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        seen.append(sorted((r.doc_id if r.doc_id is not None else -1, len(r.text or "")) for r in docs.collect()))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert len(seen[0]) == len(seen[1]) == 12  # clean documents stay, repeated rows too
    assert [n for i, n in seen[1] if i == 6] == [len("first words here")]
    # one row for all without words, one for the long text, one for the ties
    assert [i for i, _ in seen[2]] == [-1, 0, 3, 5, 6, 7] and seen[3] == seen[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == 6
