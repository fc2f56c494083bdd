"""Near copies by exact Jaccard similarity of word shingles: found by bands of SimHash fingerprints, and what these leave apart by prefixes of
rare shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import written
from loomfuse.llm.components import components
from loomfuse.llm.trie import PAIR_ROWS, majority, near_links

WORDS, SEED = 5, 42
#: Least similarity as a fraction, so that all bounds are exact: 4/5.
UP, DOWN = 4, 5
#: A fingerprint's bands of 32 bits, 2 to the power TOP of them; those within BUDGET bits of each other meet in their trie.
TOP, BUDGET = 2, 2
#: One text in so many is read for the shingles that go last in the common order, those in LEAST_SAMPLED of these texts;
#: at most MOST_COMMON. Any order finds the same pairs; this one keeps groups small.
SAMPLE, LEAST_SAMPLED, MOST_COMMON = 50, 4, 200_000
#: The most cells of a sketch, as a power of two.
MOST_CELLS = 16
#: Members of a shingle's group are dealt to blocks of so many, blocks are compared pair by pair.
BLOCK = 2_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 hashes, sorted, of a text's runs of WORDS words; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(parts) - WORDS + 1, 1)
    last = ends[WORDS - 1 :] if len(parts) > WORDS else ends[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n))


def sketch(found: np.ndarray) -> bytes:
    """The parity of a set's members in each of its cells, a power of two of them, about one a member."""
    cells = 1 << min(max(len(found) - 1, 1).bit_length(), MOST_CELLS)
    cells = max(cells, 256)
    odd = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def bands(found: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a set of shingle hashes as 2 ** TOP longs: a band's number in the first bits, its 32 bits after it."""
    words, mixed = [], found
    for _ in range(1 << TOP >> 1):
        words.append(majority(mixed))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)  # other bits of the same shingles
        mixed ^= mixed >> np.uint64(32)
    values = np.array(words, np.uint64).view(np.uint32).astype(np.uint64)
    return ((np.arange(1 << TOP, dtype=np.uint64) << np.uint64(64 - TOP)) | (values << np.uint64(32 - TOP))).view(np.int64)


def fold(cells: np.ndarray, size: int) -> np.ndarray:
    """A sketch brought to ``size`` bytes: a smaller power of two of cells."""
    return np.bitwise_xor.reduce(cells.reshape(-1, size), axis=0)


def may_be_similar(a: bytes, b: bytes, total: int) -> bool:
    """False only if two sets with ``total`` members can't be similar: they differ in at least as many members as cells."""
    size = min(len(a), len(b))
    apart = np.bitwise_count(fold(np.frombuffer(a, np.uint8), size) ^ fold(np.frombuffer(b, np.uint8), size)).sum()
    return int(apart) * (UP + DOWN) <= total * (DOWN - UP)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DOWN >= UP * (len(a) + len(b) - both)


def prefix(found: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles in the order (times in the sample, hash): two similar sets share one of theirs."""
    if not len(found):
        return found
    order = np.arange(len(found))
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        order = np.argsort(np.where(common[at] == found, times[at], 0), kind="stable")
    return found[order[: len(found) - -(-len(found) * UP // DOWN) + 1]]


def _common(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in many sampled texts, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["shingle"])

    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).distinct().mapInArrow(run, "shingle long")
    many = sample.groupBy("shingle").count().where(F.col("count") >= LEAST_SAMPLED).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    hashes, times = np.asarray(many["shingle"]).view(np.uint64), np.asarray(many["count"])
    order = np.argsort(hashes)
    return hashes[order], times[order]


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, set, n, cells, s0..s3, bands, prefix), one for each row of ``docs``.

    ``set`` is a hash of the shingle set, ``n`` its size, ``bands`` its fingerprint, ``cells`` its sketch, s0..s3 the same
    brought to 256 cells: two sets differ in at least as many members as cells.
    """
    common, times = _common(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            names, sizes, cells, whole, banded, firsts = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t)
                names.append(xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                whole.append(sketch(found))
                cells.append(fold(np.frombuffer(whole[-1], np.uint8), 32).view(np.int64))
                banded.append(bands(found))
                firsts.append(prefix(found, common, times).view(np.int64))
            s = np.array(cells, np.int64).reshape(-1, 4)
            listed = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in x])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (banded, firsts)]
            arrays = [b.column(0), b.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(whole, pa.binary()), *(pa.array(s[:, k]) for k in range(4)), *listed]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "set", "n", "cells", "s0", "s1", "s2", "s3", "bands", "prefix"])

    kind = docs.schema[doc_id].dataType.simpleString()
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return asked.mapInArrow(run, f"doc_id {kind}, text_hash long, set long, n int, cells binary, s0 long, s1 long, s2 long, s3 long, bands array<long>, prefix array<long>")


def _sizes(n: Column, m: Column) -> Column:
    """Whether sets of such sizes may be similar."""
    return (n * DOWN >= m * UP) & (m * DOWN >= n * UP)


def fingerprint_pairs(each: DataFrame, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Pairs (a, b) of the sets of ``each`` (set, bands) that a band holds within BUDGET bits, a < b, enough of them for reachability.

    Sets with an equal band are paired with the least of them, and bands that differ by the trie self-join, which keeps a spanning forest a node
    pair: a crowd gives a few pairs a set.
    """
    values = each.select("set", F.explode("bands").alias("fp"))
    least = written(values.groupBy("fp").agg(F.min("set").alias("centre"), F.count("*").alias("many")), "near-bands")
    equal = values.join(least.where("many > 1"), "fp").select(F.col("centre").alias("a"), F.col("set").alias("b"))
    met = written(near_links(least.select("fp"), BUDGET, pair_rows, top=TOP), "near-met")
    side = lambda c: least.select(F.col("fp").alias(c), F.col("centre").alias(f"_{c}"))
    apart = met.join(side("a"), "a").join(side("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return equal.unionByName(apart).where("a <> b").distinct()


def _shared(sets: DataFrame) -> DataFrame:
    """Rows (shingle, set, n, centre, centre_n) of the prefix shingles of several sets; ``centre`` is the least of these sets.

    Equal sets are counted once, within partitions at first, so a crowd of copies is a few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (shingle, set, n, whether it was given out, centre, its n)
        for b in batches:
            if not b.num_rows:
                continue
            h, s, n = (np.asarray(b.column(k)) for k in range(3))
            given = np.zeros(len(h) + 1, bool)
            if last is not None:
                h, s, n = np.concatenate([[last[0]], h]), np.concatenate([[last[1]], s]), np.concatenate([[last[2]], n]).astype(np.int32)
            else:
                given = given[1:]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
            if last is not None:
                given[0] = last[3]
            given, h, s, n = given[fresh], h[fresh], s[fresh], n[fresh]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            start = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            centre, centre_n = s[start][run_of], n[start][run_of]
            if last is not None:
                centre[run_of == 0], centre_n[run_of == 0] = last[4], last[5]
            several = np.bincount(run_of)[run_of] > 1
            out = (several | (centre != s)) & ~given
            last = (h[-1], s[-1], n[-1], bool(given[-1] or out[-1]), centre[-1], centre_n[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (h, s, n, centre, centre_n)], ["shingle", "set", "n", "centre", "centre_n"])

    rows = sets.groupBy("set").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select(F.explode("prefix").alias("shingle"), "set", "n")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "set").mapInArrow(run, "shingle long, set long, n int, centre long, centre_n int")


def _sketched(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets (set, n, cells) that neither sizes nor sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(2, 6)]
            fine = pa.array([may_be_similar(x, y, n + m) for n, m, x, y in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(fine) for k in range(2)], ["a", "b"])

    side = lambda c: each.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"cells{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes(F.col("na"), F.col("nb")))
    return joined.select("a", "b", "na", "nb", "cellsa", "cellsb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets whose texts (set, text) are similar indeed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = centre = None
        for batch in batches:
            a, x, y = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            right = np.zeros(len(a), bool)
            for k in range(len(a)):
                if a[k] != name:
                    name, centre = a[k], shingles(x[k])
                right[k] = similar(centre, shingles(y[k]))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(right)) for k in range(2)], ["a", "b"])

    joined = pairs.join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """Rows (set, text): one text for each set named in ``pairs``."""
    named = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    owners = sets.groupBy("set").agg(F.min("text_hash").alias("_hash")).join(named, "set", "left_semi")  # counted before the join: copies are many
    rows = docs.select(F.xxhash64(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(owners, "_hash").dropDuplicates(["set"]).select("set", "text")


def near_roots(docs: DataFrame, sets: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (set, root) for those of the ``sets`` of ``shingle_sets``, written, that are linked to others; equal roots mean reachable by links.

    Two sets are linked if their Jaccard similarity is UP/DOWN or more. Pairs that bands of their SimHash fingerprints
    bring together are verified by their texts first. Fingerprints alone would miss some, so sets that are still apart
    meet by prefixes, and no such pair is missed:
    sets that similar share one of their first shingles in any common order. Pairs with the
    least set of each shingle's group are verified before others, which joins a crowd
    of copies without all its pairs; then pairs of members that are still apart. Only pairs
    that sizes or sketches rule out are never read.
    """
    each = written(sets.groupBy("set").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("bands").alias("bands")), "near-each")
    met = written(_sketched(fingerprint_pairs(each), each), "near-fingerprints")
    links = written(_verified(met, written(_texts(docs, sets, met, text), "near-texts")), "near-links")
    roots = components(links, "near")
    root_of = lambda df, key, name: df.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    shared = written(_shared(sets), "near-shared")
    cells = ["s0", "s1", "s2", "s3"]
    marks = sets.select("set", *cells).distinct()
    apart = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in cells), F.lit(0))
    may = _sizes(F.col("na"), F.col("nb")) & (apart * (UP + DOWN) <= (F.col("na") + F.col("nb")) * (DOWN - UP))
    stars = shared.where((F.col("set") != F.col("centre")) & _sizes(F.col("n"), F.col("centre_n"))).select(F.col("centre").alias("a"), F.col("set").alias("b")).distinct()
    stars = root_of(root_of(stars.join(met, ["a", "b"], "left_anti"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    stars = written(_sketched(stars, each), "near-stars")
    links = links.union(written(_verified(stars, written(_texts(docs, sets, stars, text), "near-texts")), "near-links"))
    roots = components(links, "near")
    members = written(root_of(root_of(shared.drop("centre_n"), "set", "root"), "centre", "centre_root"), "near-members")
    mixed = written(members.where("root <> centre_root").select("shingle").distinct(), "near-mixed")
    members = written(members.join(mixed, "shingle", "left_semi").join(marks, "set"), "near-mixed-members")
    parts = written(members.groupBy("shingle").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts")).where("_parts > 1"), "near-parts")
    dealt = members.join(parts, "shingle", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("set"), F.col("_parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1))
    side = lambda df, own, other, x: df.select("shingle", F.col("_own").alias(own), every.alias(other), F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), *[F.col(c).alias(f"{c}{x}") for c in cells])
    left, right = side(dealt.where("root <> centre_root"), "_p", "_q", "a"), side(dealt, "_q", "_p", "b")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("shingle", "_p", "_q")]
    pairs = left.alias("l").join(right.alias("r").hint("merge"), same[0] & same[1] & same[2] & (F.col("ra") != F.col("rb")) & may)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars.union(met), ["a", "b"], "left_anti")
    pairs = written(_sketched(pairs, each), "near-pairs")
    if not pairs.isEmpty():
        more = _verified(pairs, written(_texts(docs, sets, pairs, text), "near-texts"))
        roots = components(links.union(written(more, "near-links")), "near")
    return roots.withColumnRenamed("node", "set")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, text_hash, root), one for each row of ``docs``; equal roots mean reachable by links.

    Two rows are linked if the Jaccard similarity of their sets of shingles (runs of WORDS
    lower-case words) is UP/DOWN or more; texts without words are linked with each other. Null
    and blank texts have the empty set; null ids, repeated rows and further columns change nothing.
    """
    sets = written(shingle_sets(docs, doc_id, text), "near-sets")
    roots = near_roots(docs, sets, text, block)
    return sets.select("doc_id", "text_hash", "set").join(roots, "set", "left").select("doc_id", "text_hash", F.coalesce("root", "set").alias("root"))


def first_copies(docs: DataFrame, first: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (root, first): for each group of linked rows, single ones too, the least ``first``, an expression of (doc_id, text_hash).

    The least of each set is found before sets are joined with their roots, so a crowd of copies is one row there.
    """
    sets = written(shingle_sets(docs, doc_id, text), "near-sets")
    each = sets.groupBy("set").agg(F.min(first).alias("first"))
    return each.join(near_roots(docs, sets, text), "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("first").alias("first"))
