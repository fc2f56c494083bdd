"""Bits of SimHash fingerprints, and their self-join by a binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import written
from loomfuse.llm.forest import Forest

#: Node pairs of the trie with more fingerprints are divided before a task traverses them.
PAIR_ROWS = 40_000
#: Bits of the trie that Spark descends at a time.
STEP = 4
#: Ranges of the trie with at most so many pairs of fingerprints are compared outright.
LEAF_PAIRS = 64
#: Node pairs that a task holds at a time.
FRONTIER = 400_000


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the unsigned 64-bit ``hashes``; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def traverse(left: np.ndarray, right: np.ndarray, depth: int, diff: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right) at most ``budget`` bits apart, some at a time.

    ``left`` and ``right`` are sorted unsigned fingerprints below two trie nodes of one
    depth whose prefixes differ in ``diff`` bits. Node pairs are descended together, a bit
    at a time; the differing bits of a pair add up and a pair beyond the budget goes.
    """
    todo = [(depth, *(np.array([x]) for x in (0, len(left), 0, len(right), diff)))]
    while todo:
        at, la, lb, ra, rb, d = todo.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            todo += [(at, *(x[:half] for x in (la, lb, ra, rb, d))), (at, *(x[half:] for x in (la, lb, ra, rb, d)))]
            continue
        small = (lb - la) * (rb - ra) <= LEAF_PAIRS
        if at == 64:
            small[:] = True
        if small.any():
            nl, nr = (lb - la)[small], (rb - ra)[small]
            many = nl * nr
            owner = np.repeat(np.arange(len(many)), many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i, j = la[small][owner] + k // nr[owner], ra[small][owner] + k % nr[owner]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            yield i[near], j[near]
        if not small.all():
            la, lb, ra, rb, d = (x[~small] for x in (la, lb, ra, rb, d))
            bit = np.uint64(1 << (63 - at))
            keep = ~((bit << np.uint64(1)) - np.uint64(1)) if at else np.uint64(0)
            lm = np.searchsorted(left, (left[la] & keep) | bit)
            rm = np.searchsorted(right, (right[ra] & keep) | bit)
            below = [(la, lm, ra, rm, d), (lm, lb, rm, rb, d), (la, lm, rm, rb, d + 1), (lm, lb, ra, rm, d + 1)]
            la, lb, ra, rb, d = (np.concatenate(x) for x in zip(*below, strict=True))
            live = (la < lb) & (ra < rb) & (d <= budget)
            if live.any():
                todo.append((at + 1, *(x[live] for x in (la, lb, ra, rb, d))))


def _descend(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """The rows (a, b, diff, side, fp) of node pairs at ``depth``, dealt to the pairs STEP bits below that stay within budget."""
    digit = F.shiftrightunsigned("fp", 64 - STEP - depth).bitwiseAND(F.lit((1 << STEP) - 1))
    masks = [F.array(*[F.lit(m).cast("long") for m in range(1 << STEP) if m.bit_count() <= left]) for left in range(budget + 1)]
    allowed = masks[budget]
    for spent in range(1, budget + 1):
        allowed = F.when(F.col("diff") == spent, masks[budget - spent]).otherwise(allowed)
    up = F.lit(1 << STEP)
    moved = rows.withColumn("own", digit).withColumn("mask", F.explode(allowed)).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    moved = moved.withColumn("diff", F.col("diff") + F.bit_count("mask").cast("int"))
    self = F.col("a") == F.col("b")
    first = F.when(self, F.least("own", "other")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    second = F.when(self, F.greatest("own", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(self, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side"))
    return moved.select((F.col("a") * up + first).alias("a"), (F.col("b") * up + second).alias("b"), "diff", side.alias("side"), "fp")


def near_links(distinct: DataFrame, budget: int, pair_rows: int = PAIR_ROWS, n: int | None = None, top: int = 0) -> DataFrame:
    """Links (a, b) that join fingerprints at most ``budget`` bits apart, a spanning forest for each trie node pair.

    ``distinct`` (fp) holds each fingerprint once. Spark deals them to the node pairs of
    their trie, STEP bits deeper as long as a pair holds more than ``pair_rows``; so no
    task gets more, however the fingerprints crowd. Each task traverses its pair to the
    leaves and keeps at most one link a fingerprint: enough for reachability, without all
    pairs of a crowd. Only fingerprints with equal ``top`` first bits meet.
    """
    n = distinct.count() if n is None else n
    start = F.shiftrightunsigned("fp", 64 - top) if top else F.lit(0).cast("long")
    rows, depth = distinct.select(start.alias("a"), start.alias("b"), F.lit(0).alias("diff"), F.lit(0).alias("side"), "fp"), top
    ready: list[DataFrame] = []

    def links(depth: int):
        def run(t: pa.Table) -> pa.Table:
            fps, side = np.asarray(t["fp"]).view(np.uint64), np.asarray(t["side"])
            a, b, diff = t["a"][0].as_py(), t["b"][0].as_py(), t["diff"][0].as_py()
            left = np.sort(fps[side == 0])
            right = left if a == b else np.sort(fps[side == 1])
            forest, shift = Forest(len(left) + (0 if a == b else len(right))), 0 if a == b else len(left)
            if len(left) and len(right):
                for i, j in traverse(left, right, depth, diff, budget):
                    forest.join(i, j + shift)
            both = left if a == b else np.concatenate([left, right])
            i, j = forest.links()
            return pa.table({"a": both[i].view(np.int64), "b": both[j].view(np.int64)})

        return run

    heavy = n > pair_rows
    while heavy and depth + STEP < 64:
        rows = _descend(rows, depth, budget)
        depth += STEP
        sizes = rows.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min("side").alias("_low"), F.max("side").alias("_high"))
        sizes = written(sizes.where((F.col("_n") > 1) & ((F.col("a") == F.col("b")) | (F.col("_low") < F.col("_high")))), "trie-pairs")
        heavy = not sizes.where(F.col("_n") > pair_rows).isEmpty()
        if heavy:
            rows = written(rows.join(sizes.select("a", "b", "_n"), ["a", "b"]), "trie-rows")
            ready.append(rows.where(F.col("_n") <= pair_rows).drop("_n").groupBy("a", "b").applyInArrow(links(depth), "a long, b long"))
            rows = rows.where(F.col("_n") > pair_rows).drop("_n")
    out = rows.groupBy("a", "b").applyInArrow(links(depth), "a long, b long")
    for more in ready:
        out = out.unionByName(more)
    return out
