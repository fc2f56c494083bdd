"""Operator 9: near-duplicates by SimHash fingerprints and a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import own_names, table, written
from loomfuse.llm.components import components
from loomfuse.llm.near import first_copies
from loomfuse.llm.trie import PAIR_ROWS, majority, near_links

WORDS, SEED, BUDGET = 3, 42, 2
#: A fingerprint of one row in so many is met by a broadcast; there are at most so many such fingerprints.
CROWDS = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles (XXH64, seed 42); 0 for a text without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(parts) - words + 1
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, fp long), one for each row of ``docs``; null texts count as empty; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, pair_rows: int = PAIR_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, fp, root, component_id), one for each row of ``docs``.

    ``root`` names the component; ``component_id`` is the smallest id among the rows reachable by links of at most
    ``budget`` differing bits, the row's own included. Rows with equal fingerprints,
    repeated rows among them, count once in the join; rows without words have
    fingerprint 0 and link like any other. Null ids are never the smallest; a component
    of null ids alone has a null id. An empty table gives no rows; other columns are not read.
    A fingerprint that one row in CROWDS has, such as that of empty texts, gets its class by a broadcast of at most CROWDS rows,
    so no task gets all its rows.
    """
    fps = written(fingerprints(docs, words, doc_id, text), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    n, rows = distinct.agg(F.count("*"), F.sum("copies")).first()
    roots = components(near_links(distinct.select("fp"), budget, pair_rows, n), "simhash")
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "simhash-roots")
    smallest = written(joined.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    classes = written(joined.join(smallest, "root").select("fp", "copies", "root", "component_id"), "simhash-classes")
    crowded = F.col("copies") * CROWDS >= (rows or 0)
    crowds = F.broadcast(classes.where(crowded).drop("copies"))
    met = [fps.join(crowds, "fp"), fps.join(crowds.select("fp"), "fp", "left_anti").join(classes.where(~crowded).drop("copies"), "fp")]
    return met[0].unionByName(met[1]).select("doc_id", "text_hash", "fp", "root", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: that with the smallest id (nulls last), then text hash; of repeated rows, one.

    Here similar means five-word shingles at Jaccard similarity 0.8, verified. Fingerprints of these shingles, in bands, meet in
    the trie; texts that similar differ in ten of 64 bits on average, so ``near`` looks for what its bands leave apart
    as well and no link is lost. Null and blank texts are copies of each
    other; an empty table gives no rows; further columns pass; ValueError if one of them begins with an underscore.
    """
    own_names(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = first_copies(docs, first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    chosen = rows.join(kept, (F.col("_text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return chosen.dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)


QUERIES = {"op9_simhash": op9_simhash}
SQL: dict[str, str] = {}
