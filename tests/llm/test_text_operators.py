"""Small cases of the text operators: each against brute force or its stated result."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomfuse.llm import decontamination, embeddings, licenses, lines, notices, packing, quality, sharding, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"Wort{i} über, naïve" for i in range(4000))
TEXTS = [None, "", " ", "a", "Hello  world\n\nnext\tline ", "x y　z \x1c w", "é" * 50, "don't <s> <|endoftext|> now", "▁▁ a ▁b", "tie one two three", "tie one two three", LONG]


def documents(spark, texts, **more):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, a repeated row and columns with names the operators use."""
    rows = [(i, t, None if i % 3 == 0 else "en", "src0", None) for i, t in enumerate(TEXTS)]
    rows += [(None, "nobody's text", None, None, None), rows[4]]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("score", F.lit(7)).withColumn("fp", F.lit("x")).withColumn("sequence_id", F.lit(1)).withColumn("vec", F.lit(0)).withColumn("n", F.lit(0)).withColumn("count", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(spark, odd, none):
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, path).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect())
    assert got == want
    assert token_counts.token_counts(none, path).count() == 0


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.MODEL)
    tokenizer = Tokenizer.from_file(path)
    want = sorted(tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd.collect())
    for ranks in (None, public_tokenizers.path(packing.RANKS)):
        rows = packing.pack(odd.repartition(3), path, ranks, size=64, open_windows=2).collect()
        windows, documents = defaultdict(list), defaultdict(list)
        for r in rows:
            assert len(r["ids"]) == 4 * r["length"]
            windows[r.sequence_id].append((r.offset, r["length"]))
            documents[r.doc_id].append((r.start, r.doc_tokens, tuple(np.frombuffer(r["ids"], "<u4"))))
        for pieces in windows.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 64
        assert sum(sum(x for _, x in p) == 64 for p in windows.values()) >= len(windows) - 1
        whole = {k: v for k, v in documents.items() if k != 4}  # id 4 stands twice
        for pieces in whole.values():
            ids = tuple(x for _, _, part in sorted(pieces) for x in part)
            assert ids in want and len(ids) == pieces[0][1]
    assert packing.pack(none, path).count() == 0


def test_line_dedup_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(3)
    line = lambda x: f"line {x}" if x % 3 else f"line {x} " + "word " * (12 + x * 12)
    texts = ["\n".join(line(x) for x in rng.integers(0, 9, rng.integers(0, 14))) for _ in range(60)] + ["\n\n\n", None, ""]
    got = {r.doc_id: r for r in lines.dedup_lines(documents(spark, texts)).collect()}
    import hashlib

    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    cut, seen = {}, set()
    for i, t in enumerate(texts):
        ls, chunks, now = (t or "").split("\n"), [], []
        for k, x in enumerate(ls):
            now.append(x)
            if len(x) >= 60 or k == len(ls) - 1 or len(ls[k + 1]) >= 60 or (number(x) + 31 * (number(ls[k - 1]) if k else 0)) % 3 == 0:
                chunks.append("\n".join(now))
                now = []
        cut[i] = chunks
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None and got[i].n_chunks == 0
            continue
        chunks, gone = cut[i], set()
        for k, c in enumerate(chunks):
            beside = (c, chunks[k + 1]) if k + 1 < len(chunks) else None
            for unit, at in (((c,), {k}), (beside, {k, k + 1})):
                if not unit or not all(u.strip() for u in unit):
                    continue
                if len(unit) == 1 and "\n" not in c and len(c) < 150:
                    continue
                gone |= at if unit in seen else set()
                seen.add(unit)
        kept = [c for k, c in enumerate(chunks) if k not in gone]
        assert (got[i].text, got[i].n_chunks, got[i].n_removed) == ("\n".join(kept), len(chunks), len(gone))
    plain = odd.drop("n", "count")
    assert lines.dedup_lines(plain).count() == odd.count()
    assert lines.dedup_lines(none).count() == 0
    for name in ("n_chunks", "_id"):
        with pytest.raises(ValueError):
            lines.dedup_lines(plain.withColumn(name, F.lit(1)))


def test_line_dedup_finds_passages_wherever_they_stand(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    sentence = lambda n: " ".join(rng.choice(words, n))
    passages = [[sentence(n) for n in ns] for ns in ((60,), (30, 30), (20, 25, 20), (12, 55), (15, 15, 15, 15))]
    texts, clean = [], []
    for p in passages:
        for _ in range(3):
            around = [[sentence(rng.integers(3, 30)) for _ in range(rng.integers(0, 4))] for _ in range(2)]
            texts.append("\n".join([*around[0], *p, *around[1]]))
            clean.append(sum(map(len, around)))
    rows = sorted(lines.dedup_lines(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    for k, r in enumerate(rows):
        whole = all(x in r.text.split("\n") for x in passages[k // 3])
        assert whole == (k % 3 == 0) and len([x for x in r.text.split("\n") if x]) == clean[k] + (len(passages[k // 3]) if whole else 0)


def test_line_dedup_keeps_repeated_rows_alike(spark):
    text = "\n".join(f"passage line {i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed > 0, len(r.text)) for r in lines.dedup_lines(df).collect())
    assert got[0] == got[1] == (1, False, len(text)) and got[2][1] and got[2][2] < len(text)


def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    near, far = item.replace("upsilon", "other"), item.replace("lambda", "other")  # 15 of 17 shingles, 11 of 21
    bench = spark.createDataFrame([(1, item), (2, "too short"), (None, None), (3, "one two three four five six")], "item_id long, text string")
    texts = [f"before it {item.upper()}, and after", f"x y {near} z", "clean words that no item has at all in any place", item, " ".join(item.split()[:8]), "one two three four five", LONG + " " + item, f"x y {far} z", " ".join(item.split()[:-1])]
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 3)) for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert got == {(0, 1): (2, 1.0), (1, 1): (1, 0.882), (3, 1): (0, 1.0), (6, 1): (12000, 1.0), (8, 1): (0, 0.938)}
    named = documents(spark, texts).withColumn("_id", F.lit(1)).withColumn("item_id", F.lit(1)).withColumn("_hits", F.lit(1))
    assert decontamination.contaminated(named, bench).count() == 5
    left = [r.doc_id for r in named.join(decontamination.contaminated(named, bench).select("doc_id").distinct(), "doc_id", "left_anti").collect()]
    assert sorted(left) == [2, 4, 5, 7]
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


def test_decontamination_against_all_windows(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    items = [list(rng.choice(words, n)) for n in (12, 20, 20, 45, 60)] + [["tie"] * 15]
    texts = []
    for k in range(60):
        part = list(items[k % len(items)])
        for _ in range(rng.integers(0, 3)):
            part[rng.choice([0, 1, len(part) - 2, len(part) - 1])] = "edit"
        texts.append(list(rng.choice(words, rng.integers(0, 40))) + part[: len(part) - int(rng.integers(0, 3))] + list(rng.choice(words, rng.integers(0, 40))))
    shingled = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            a, n = shingled(item), len(item)
            for start in range(max(1, len(t) - n + 1)):
                b = shingled(t[start : start + n])
                both = (a & b).total()
                if both and (s := both / (a.total() + b.total() - both)) >= 0.8 and s > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (start, s)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = decontamination.contaminated(documents(spark, [" ".join(t) for t in texts]), bench).collect()
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in rows}
    # fingerprints of similar windows are further apart than RADIUS in about one case of fifty at the least similarity
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 20
    assert all(got[k][1] <= want[k][1] and (got[k] == want[k] or got[k][1] < want[k][1]) for k in got)


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 12))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 12)) * 0.25, base[:5], base[:3] * 2]).astype(np.float32)
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 12, 1), (n + 2, [float("nan")] * 12, None), (n + 3, [None] * 12, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vec", F.lit(1)).withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = [(i, j) for i, j in itertools.combinations(range(n), 2) if u[i] @ u[j] >= 0.9]
    want = brute_components(range(n), linked)
    count = np.bincount(np.array(linked).ravel(), minlength=n)
    assert len(linked) > 20
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], want[i], want[i] == i)
    for i in range(n, n + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and len(got) == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    # the probes and bounds lose nothing: every list that holds a neighbour is asked
    model = embeddings.Quantiser.fit(u, 9)
    own = model.near(u)[0]
    far = np.linalg.norm(u - model.centres[own], axis=1)
    radius = np.array([max(far[own == c], default=0.0) for c in range(len(model.centres))])
    probes = model.probes(u, own, (2 - 1.8) ** 0.5, radius)[0]
    assert all(probes[i, own[j]] and probes[j, own[i]] for i, j in linked)


def test_embeddings_of_low_rank_lose_no_link(spark):
    for dims, rank in ((64, 3), (384, 16), (768, 4)):
        rng = np.random.default_rng(dims)
        base = rng.normal(size=(500, rank))
        near = base + rng.normal(size=base.shape) * 0.4
        x = (np.concatenate([base, near]) @ rng.normal(size=(rank, dims))).astype(np.float32)
        df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        want = (u @ u.T >= 0.9).sum(1) - 1
        assert want.sum() > 100
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(x))] == want.tolist()


def test_embeddings_with_repeated_ids_and_huge_or_tiny_components(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    rows = [(int(rng.integers(0, 25)), (v * 10.0 ** rng.choice([-200, 0, 200])).tolist()) for v in np.concatenate([x, x[:15] + 0.1])]
    rows += [(1, [1.0, 0.0, 0.0]), (1, [0.99, 0.1, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 0.0, 1.0]), rows[0], (90, [0.0, 1e-310, 0.0]), (91, [0.0, 1e300, 1e299])]
    u = np.array([v for _, v in rows])
    u /= np.abs(u).max(1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = brute_components({i for i, _ in rows}, [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near), strict=True)])
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, int(near[k].sum()) - 1, want[i], want[i] == i) for k, (i, _) in enumerate(rows))


def test_vectors_meet_in_columns_that_share_their_tables(monkeypatch):
    """No table is copied for a list that most queries ask, what is compared at a time is bounded, and all pairs are found once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[1500:2000] = x[:500] + 0.02 * rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embeddings.Quantiser.fit(x, 20)
    own, far = q.near(x)
    codes, off, fixed = q.encode(x, own)
    radius = np.zeros(len(q.centres))
    np.maximum.at(radius, own, np.sqrt(far))
    made, seen, tables, distances = [], [], embeddings.Quantiser.tables, embeddings.Quantiser.distances
    monkeypatch.setattr(embeddings.Quantiser, "tables", lambda self, rows: made.append(tables(self, rows)) or made[-1])
    monkeypatch.setattr(embeddings.Quantiser, "distances", lambda self, t, near, c, f: seen.append((any(t is m for m in made), len(near), len(c))) or distances(self, t, near, c, f))
    node = np.arange(len(x))
    i, j = embeddings.meet(q, math.sqrt(0.2), radius, 0.9, x, own, node, x, own, node, codes, off, fixed)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if a < b}
    assert len(i) == len(want) and {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want and len(want) >= 500
    assert all(n <= embeddings.COLUMNS and m <= embeddings.SLICE for _, n, m in seen) and len(made) == -(-len(x) // embeddings.COLUMNS)
    assert all(shared or n < embeddings.COLUMNS / 4 for shared, n, _ in seen) and any(shared for shared, *_ in seen)


def test_groups_grow_so_that_few_copies_are_sent():
    copies = [n * n / embeddings.group_size(n) for n in (50_000, 200_000, 800_000)]
    assert embeddings.group_size(1000) == 4096 and copies[1] < 5 * copies[0] and embeddings.group_size(10**9) == 16_384


def test_embedding_tables_stay_small(spark):
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_000, 32))
    model = embeddings.Quantiser(x[:4096], [x[:256, :16], x[:256, 16:]])
    tracemalloc.start()
    own, far = model.near(x)
    model.encode(x, own)
    fine, near = model.probes(x[:4096], own[:4096], 0.4, np.ones(4096), np.arange(4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fine.shape == near.shape == (4096, 4096) and peak < 200e6


def test_simhash_against_brute_force(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, 400)) for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for k in range(3):
            c = list(b)
            c[rng.integers(0, 400)] = f"edit{k}"
            texts.append(" ".join(c))
    texts += ["", None, "\t ", "one", "ONE", "one two"]
    fps = [simhash.fingerprint(t) for t in texts]
    linked = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = brute_components(range(len(texts)), linked)
    for rows, crowds in ((4, 30), (40_000, 4096)):  # both the shallow join and one that descends; some fingerprints crowded or all
        monkeypatch.setattr(simhash, "CROWDS", crowds)
        got = {r.doc_id: (r.component_id, r.fp % 2**64) for r in simhash.near_duplicates(documents(spark, texts), pair_rows=rows).collect()}
        assert got == {i: (want[i], fps[i]) for i in range(len(texts))}
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d", "c d a", "d a b", "a b c")]
    assert simhash.fingerprint("A b\nC  d a b c") == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.stage(spark, odd, "")
    assert kept.columns == odd.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert 0 in ids and 1 not in ids and 2 not in ids and 9 in ids and 10 not in ids and ids.count(4) == 1 and -1 in ids


def test_sharding(spark, odd, none, small):
    for n in (2, 3, 4):
        places, following = sharding.hilbert_states(n)

        def index(cell, bits=2, n=n, places=places, following=following):
            state = place = 0
            for k in reversed(range(bits)):
                at = state * 2**n + sum((x >> k & 1) << j for j, x in enumerate(cell))
                place, state = place * 2**n + places[at], following[at]
            return place

        order = sorted(itertools.product(range(4), repeat=n), key=index)
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in itertools.pairwise(order))
        cells = spark.createDataFrame(order, ",".join(f"c{i} int" for i in range(n)))
        got = [r[-1] for r in cells.withColumn("h", sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], 2)).collect()]
        assert got == list(range(len(order)))
    rows = sharding.op7_sharding(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    shards = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        shards[r.shard].append(r.slot)
    assert len(rows) == len(texts) and sorted(shards) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    # against a plain sort: cells by the cut points, places on the curve, fine cells and a hash of the ties
    numbers = spark.createDataFrame([(i if i % 50 else 10**17 + i, f"{'source' * 3}{i % 7}", float(i * i % 97)) for i in range(400)], "doc_id long, source string, size double")
    dims = ["doc_id", "source", "size"]
    values = {d: sharding._order(numbers, d) for d in dims}
    cuts, fine, total = sharding._cuts(numbers, values, "doc_id")
    assert total == numbers.count()
    assert all(10 <= len(cuts[d]) <= 15 for d in ("doc_id", "size")) and len(cuts["source"]) == 6  # an outlier or a shared prefix hides nothing
    places, following = sharding.hilbert_states(3)
    salt = {r.doc_id: r.s for r in numbers.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SALTS))).collect()}

    def place_of(r):
        cell = [sum((r[d].encode() if d == "source" else r[d]) >= c for c in cuts[d]) for d in dims]
        state = place = 0
        for k in reversed(range(sharding.BITS)):
            at = state * 8 + sum((x >> k & 1) << j for j, x in enumerate(cell))
            place, state = place * 8 + places[at], following[at]
        return place, sum(r.doc_id >= c for c in fine), salt[r.doc_id], r.doc_id

    order = [r.doc_id for r in sorted(numbers.collect(), key=place_of)]
    got = sharding.hilbert_shards(numbers, dims, ["doc_id"], 7).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in got] == order and [r.shard for r in got] == [i * 7 // 400 for i in range(400)]
    with pytest.raises(ValueError):
        sharding.hilbert_shards(numbers.withColumn("slot", F.lit(1)), dims, ["doc_id"])
    placed = sharding.hilbert_shards(odd.withColumn("size", F.length("text")), ["doc_id", "source", "lang", "size"], ["doc_id", "size"], 4)
    assert placed.count() == odd.count()
    assert sharding.hilbert_shards(none, ["doc_id", "lang"], ["doc_id"]).count() == 0


def test_write_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), ["doc_id", "lang"], ["doc_id"], 4)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == docs.count() and {r[0] for r in again.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_licenses(spark, odd, none):
    files = [
        ("/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("/a/b/c/x.py", "plain words of a program"),
        ("/a/b/y.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "code " * 30),
        ("/a/d/COPYING.txt", "Some words before\nReleased under the MIT License."),
        ("/a/d/e/z.py", "more words"),
        ("/q/w.py", "Licensed drivers may park under the public version of the tree"),
        (None, "Licensed under CC BY-NC 4.0."),
        ("bare.txt", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string").withColumn("license", F.lit(1))
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[i].license for i in range(8)] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", "MIT", "MIT", None, "CC-BY-NC-4.0", None]
    assert (got[1].inherited_from, got[4].inherited_from, got[2].inherited_license) == ("/a", "/a/d", "Apache-2.0")
    assert got[0].is_license_file and got[3].is_license_file and not got[2].is_license_file
    # an independent TF-IDF over all stretches of lines: the anchors lose no line and counts of all terms weigh
    import math
    import re

    bags = [Counter(re.findall("[a-z0-9]+", (t or "").lower())) for _, t in files]
    weigh = lambda c: {t: k * (math.log(9 / (1 + sum(t in b for b in bags))) + 1) for t, k in c.items()}
    cosine = lambda a, b: sum(v * b.get(t, 0) for t, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if a and b else 0.0
    templates = [(n, weigh(Counter(re.findall("[a-z0-9]+", x.lower())))) for n, x in notices.TEMPLATES]
    for i, (_, t) in enumerate(files):
        ls = (t or "").lower().split("\n")
        stretches = ["\n".join(ls[a:b]) for a in range(len(ls)) for b in range(a + 1, len(ls) + 1)]
        every = [(-round(cosine(w, weigh(Counter(re.findall("[a-z0-9]+", x)))), 12), n) for x in stretches for n, w in templates]
        best = min((p for p in every if -p[0] >= licenses.THRESHOLD), default=None)
        assert (got[i].own_license, got[i].own_similarity and round(got[i].own_similarity, 9)) == (best and best[1], best and round(-best[0], 9))
    by = {n: x for n, x in notices.TEMPLATES if len(x) > 200}  # whole licence texts, wrapped and commented
    wrapped = [("src/%d.c" % i, "/*\n" + re.sub(r"(.{60}\S*) ", r" * \1\n", f"Copyright 2020 The Authors. {x}") + "\n */\n\nint main() {}\n" + "code line\n" * 40) for i, x in enumerate(by.values())]
    wrapped += [("a/spdx.py", "# SPDX-License-Identifier: GPL-2.0\nprint()"), ("b/apache.py", "# Copyright (c) 2020 Foo Corp. Licensed under the Apache License, Version 2.0.\n" + "code " * 50)]
    many = spark.createDataFrame([(i, p, x) for i, (p, x) in enumerate(wrapped)], "doc_id long, path string, text string")
    assert [r.own_license for r in licenses.license_scan(many).orderBy("doc_id").collect()] == [*by, "GPL-2.0", "Apache-2.0"]
    assert licenses.license_scan(odd.withColumn("path", F.lit("/a/b"))).count() == odd.count()
    assert licenses.license_scan(none.withColumn("path", F.lit("x"))).count() == 0


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd, none, module, label):
    sf = "/root/testdata/sf0.01"
    query = next(iter(module.QUERIES.values()))
    rows = query(spark, sf).collect()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    parts, held = (4, 2) if label == "toxic" else (5, 0)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
    y, p = (np.array([v for r in rows if r.held_out and r.doc_id in known for v in [f(r)]]) for f in (lambda r: known[r.doc_id], lambda r: r.predicted))
    assert (y == p).mean() >= 0.85
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.fit(docs, labels)
    assert module.score(odd, model).count() == odd.count() and module.score(none, model).count() == 0
    constant = module.fit(none, labels.limit(0))
    assert len({r.score for r in module.score(odd, constant).collect()}) == 1
    # held-out labels and the order of rows change nothing
    flipped = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == held, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.score(docs.orderBy(F.desc("doc_id")), module.fit(docs, flipped)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_toxicity_against_brute_force(spark):
    import math

    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "vile", "nasty", "eta"]
    texts, y = [], []
    for i in range(80):
        y.append(int(rng.random() < 0.4))
        texts.append(" ".join(rng.choice(words, rng.integers(3, 12))) + (" vile nasty" if y[-1] and rng.random() < 0.8 else ""))
    docs = documents(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sizes=(3000,))

    def grams(t):
        s, found = " " + " ".join(t.lower().split()) + " ", set()
        for n in (3, 4, 5):
            for i in range(len(s) - n + 1):
                h = ord(s[i])
                for c in s[i + 1 : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                found.add(((h * 0x9E3779B97F4A7C15 + n) * 0x9E3779B97F4A7C15 % 2**64) >> 44)
        return found

    assert all(set(toxicity.Grams()(t).tolist()) == grams(t) for t in texts)
    train = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [Counter(), Counter()]
    for i in train:
        n[y[i]].update(grams(texts[i]))
    rows = [sum(y[i] == c for i in train) for c in (0, 1)]
    ratio = {g: math.log((n[1][g] + 1) / (rows[1] + 2)) - math.log((n[0][g] + 1) / (rows[0] + 2)) for g in {*n[0], *n[1]} if n[0][g] + n[1][g] >= 2}
    best = sorted(ratio, key=lambda g: (-abs(ratio[g]) * math.sqrt(min(n[0][g] + n[1][g], rows[1])), g))[:3000]
    features = lambda t: np.array([ratio[g] if g in own else 0.0 for own in [grams(t)] for g in best])
    x, labels_ = np.array([features(texts[i]) for i in train]), np.array([y[i] for i in train], float)
    k, a, b = x @ x.T, np.zeros(len(train)), 0.0
    for _ in range(60):  # Newton's steps to the one optimum: a = y - p, sum(a) = 0
        p = 1 / (1 + np.exp(-(k @ a + b)))
        w = (p * (1 - p))[:, None]
        full = np.block([[np.eye(len(a)) + w * k, w], [np.ones((1, len(a))), np.zeros((1, 1))]])
        step = np.linalg.solve(full, -np.append(a - labels_ + p, a.sum()))
        a, b = a + step[:-1], b + step[-1]
    want = [1 / (1 + math.exp(-(features(t) @ (x.T @ a) + b))) for t in texts]
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert max(abs(got[i] - s) for i, s in enumerate(want)) < 0.02 and np.ptp(want) > 0.5


def test_quality_trees_against_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "DEPTH", 2)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(150, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > rng.normal(size=150) * 0.3).astype(float)
    weight = rng.choice([1.0, 2.0], 150)
    model = quality.fit_trees(x, y, weight)
    w = weight * 150 / weight.sum()
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower"))) for j in range(4)]
    base = np.log((w @ y) / (w.sum() - w @ y))
    raw, forest = np.full(150, base), []

    def grow(rows, g, h, depth):
        value = -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2)
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.L2)
        best = None
        if depth < 2 and len(rows) >= 2 * quality.LEAST_ROWS:
            for j in range(4):
                for e in edges[j]:
                    left, right = [i for i in rows if x[i, j] <= e], [i for i in rows if x[i, j] > e]
                    if min(h[left].sum(), h[right].sum()) < quality.LEAST_ROWS / 4:
                        continue
                    gain = part(left) + part(right) - part(rows)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, j, e, left, right)
        return (value,) if best is None else (value, best[1], best[2], grow(best[3], g, h, depth + 1), grow(best[4], g, h, depth + 1))

    def walk(tree, row):
        while len(tree) > 1:
            tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
        return tree[0]

    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        forest.append(grow(list(range(150)), w * (p - y), w * np.maximum(p * (1 - p), 1e-6), 0))
        raw += [walk(forest[-1], r) for r in x]
    other = np.round(rng.normal(size=(200, 4)), 1)
    want = np.array([base + sum(walk(t, r) for t in forest) for r in other])
    assert np.abs(model.raw(other) - want).max() < 1e-9 and len(forest[0]) > 1


def test_quality_statistics():
    got = dict(zip(quality.STATISTICS, quality.statistics("Ab cd cd. 12\n\ncd X!"), strict=True))
    assert got["log_words"] == np.log1p(6) and got["longest_word"] == 3 and got["digits"] == 2 / 19 and got["upper"] == 2 / 19
    assert got["distinct_words"] == 5 / 6 and got["top_word"] == 2 / 6 and got["words_without_letters"] == 1 / 6 and got["lines"] == np.log1p(3)
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)


def test_packing_order_against_brute_force():
    rng = np.random.default_rng(9)
    sizes = [int(n) for n in np.concatenate([rng.integers(1, 64, 150), [64, 130, 1, 63]])]
    packer = packing.Packer(64, 4, 0)
    for i, n in enumerate(sizes):
        packer.document(i, bytes(4 * n))
    packer.end()
    got, at = defaultdict(list), defaultdict(int)
    for doc, start, length, *_, sequence, offset, _ in packer.rows:
        assert offset == at[sequence]
        at[sequence] += length
        got[sequence].append((doc, start, length))
    want, windows = [], []
    for i, n in enumerate(sizes):
        start = 0
        while n >= 64:
            want.append([(i, start, 64)])
            start, n = start + 64, n - 64
        if not n:
            continue
        used = lambda w: sum(p[2] for p in w)
        fit = [w for w in windows if used(w) + n <= 64]
        if not fit and len(windows) == 4:
            full = max(windows, key=used)
            windows.remove(full)
            room = 64 - used(full)
            if room >= packing.LEAST_CUT:
                full.append((i, start, room))
                start, n = start + room, n - room
            want.append(full)
        if not fit:
            windows.append(fit_window := [])
        else:
            fit_window = max(fit, key=used)
        fit_window.append((i, start, n))
        if used(fit_window) == 64:
            windows.remove(fit_window)
            want.append(fit_window)
    closed = [got[k] for k in sorted(got)][: len(want)]
    assert closed == want and sum(x[2] for w in got.values() for x in w) == sum(sizes)


def test_packing_bears_millions_of_blanks(spark):
    from tokenizers import Tokenizer

    n = 2_000_000
    texts = [" " * n, "\t" * n, "\n" * n, "\xa0" * n, "ab " + " " * n + "cd", "ab 漢字 " + " " * n + "漢字", "é " + "\n" * n + " über", "\r\n" * (n // 2) + "<|endoftext|>"]
    path = public_tokenizers.path(packing.MODEL)
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(documents(spark, texts).repartition(4), path, public_tokenizers.path(packing.RANKS), size=1 << 20).select("doc_id", "start", "ids").collect()
    for i, t in enumerate(texts):
        ids = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start) if p.doc_id == i)
        assert np.array_equal(np.frombuffer(ids, "<u4"), [*tokenizer.encode(t, add_special_tokens=False).ids, 0])


def test_stages_name_clashing_columns(spark, odd, small):
    for stage in (decontamination.stage, simhash.stage):
        with pytest.raises(ValueError, match="_hash"):
            stage(spark, odd.withColumn("_hash", F.lit(1)), small)


def test_decontamination_cuts_long_texts_into_sections(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SECTION", 8)
    rng = np.random.default_rng(11)
    item = [" ".join(rng.choice([f"w{i}" for i in range(60)], n)) for n in (9, 14, 30)]
    texts = [" ".join([*rng.choice(["a", "b"], at), item[at % 3], *rng.choice(["a", "b"], at % 7)]) for at in range(0, 40)]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    assert all(got[at, at % 3] == (at, 1.0) for at in range(40))


def test_toxicity_never_looks_at_held_out_labels(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(rng.choice(["vile", "foul"] if i % 3 == 0 else ["kind", "fine"], 3)) + f" w{rng.integers(50)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    fits = [toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0) ^ (flip and held(i))) for i in range(400)], "doc_id long, toxic int"), sizes=(5, 50)) for flip in (0, 1)]
    assert np.array_equal(fits[0].weights, fits[1].weights) and fits[0].bias == fits[1].bias and 0 < np.count_nonzero(fits[0].weights) <= 50
    assert fits[0].score(toxicity.Grams()("vile foul vile")) > 0.7 > 0.3 > fits[0].score(toxicity.Grams()("kind fine"))
