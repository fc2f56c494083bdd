"""Operator 5: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import fold, table, written

#: n-grams are hashed to so many bits; lengths of n-grams, in characters.
BITS = 20
ORDERS = (3, 4, 5)
#: At most so many labelled rows of each class train the classifier (in expectation; chosen by a hash of the id).
MAX_PER_CLASS = 4000
#: Model sizes: n-grams that the classifier keeps, those with the most telling log-count ratios. Which one is told by log loss
#: on parts of the training rows, each scored by a model of the others; the held-out fold is never looked at.
SIZES, PARTS = (1000, 3000, 9000), 2
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Distinct hashed character n-grams of a text: lower case, every run of blanks one space."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h, found = codes, []
        for n in range(2, max(ORDERS) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * _PRIME + codes[n - 1 :]
            if n in ORDERS:
                found.append(((h * _MIX + np.uint64(n)) * _MIX >> np.uint64(64 - BITS)).astype(np.int32))
        if not found:
            return np.zeros(0, np.int32)
        ids = np.concatenate(found)
        at = np.arange(len(ids), dtype=np.int32)
        self.last[ids] = at  # the last place of each id wins
        return ids[self.last[ids] == at]


@dataclass
class Linear:
    """score = sigmoid(bias + sum of the weights of a text's distinct n-grams)."""

    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids].sum(dtype=np.float64), -30, 30))))


def log_count_ratios(n0: np.ndarray, n1: np.ndarray, rows0: float, rows1: float, smooth: float = 1.0) -> np.ndarray:
    """log of (share of class-1 rows with the n-gram / share of class-0 rows with it), smoothed."""
    return np.log((n1 + smooth) / (rows1 + 2 * smooth)) - np.log((n0 + smooth) / (rows0 + 2 * smooth))


def fit_logistic(indptr: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, l2: float = 1.0, rounds: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on the rows' scaled binary features, by L-BFGS; the bias is not penalised."""
    n, width = len(y), len(scale)
    rows, values = np.repeat(np.arange(n), np.diff(indptr)), scale[columns]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, values * v[columns], n) + v[-1]
        g = sample_weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        by_column = np.bincount(columns, values * g[rows], width) + l2 * v[:-1]
        return float(sample_weight @ (np.logaddexp(0, z) - y * z) + l2 / 2 * v[:-1] @ v[:-1]), np.append(by_column, g.sum())

    v = np.zeros(width + 1)
    f, g = loss(v)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = -g, []
        for s, t in reversed(pairs):
            used.append(a := s @ d / (s @ t))
            d = d - a * t
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(g))))
        for (s, t), a in zip(pairs, reversed(used), strict=True):
            d = d + (a - t @ d / (s @ t)) * s
        step, slope = 1.0, float(g @ d)
        while (new := loss(v + step * d))[0] > f + 1e-4 * step * slope and step > 1e-8:
            step /= 2
        if new[0] >= f:
            break
        s, t = step * d, new[1] - g
        if s @ t > 1e-12:
            pairs = [*pairs[1 - memory :], (s, t)]
        done = f - new[0] < 1e-6 * f
        v, f, g = v + s, *new
        if done:
            break
    return v[:-1], float(v[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled rows (text, y, weight, part) outside the held-out fold, about ``most`` of each class at most; ``part`` tells the PARTS that check each other.

    Rows are chosen by a hash of the id, so the same on every run; ``weight`` undoes
    the choice. Null labels and ids are left out; of an id's several labels the
    largest counts. The chosen ids are few by construction, so they are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & (fold(doc_id, folds) != held_out)).groupBy(doc_id).agg((F.max(label) > 0).cast("int").alias("_y"))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rate = F.when(F.col("_y") == 1, min(1.0, most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / max(1, sizes.get(0, 0))))
    chosen = known.withColumn("_rate", rate).where(F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(1 << 30)) < F.col("_rate") * (1 << 30))
    return docs.select(F.col(doc_id), F.col(text).alias("_text")).join(F.broadcast(chosen), doc_id).select(F.col("_text").alias("text"), F.col("_y").alias("y"), (1 / F.col("_rate")).alias("weight"), F.pmod(F.xxhash64(F.col(doc_id), F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))


def telling(n: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` n-grams with the most telling log-count ratios, in order of their number, and those ratios; ``n`` (class, gram), ``rows`` (class)."""
    ratio = log_count_ratios(n[0], n[1], rows[0], rows[1])
    often = np.flatnonzero(n.sum(0) >= 2)
    weight = np.abs(ratio[often]) * np.sqrt(np.minimum(n.sum(0)[often], rows[1]))
    ids = np.sort(often[np.lexsort([often, -weight])[:most]])
    return ids, ratio[ids]


def _columns(indptr: np.ndarray, grams: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ``rows`` over the n-grams ``ids`` alone, as indptr and columns."""
    column = np.full(1 << BITS, -1, np.int64)
    column[ids] = np.arange(len(ids))
    owner = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    place = np.full(len(indptr) - 1, -1)
    place[rows] = np.arange(len(rows))
    fine = (column[grams] >= 0) & (place[owner] >= 0)
    return np.concatenate([[0], np.cumsum(np.bincount(place[owner[fine]], minlength=len(rows)))]), column[grams[fine]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = MAX_PER_CLASS, sizes: tuple[int, ...] = SIZES, doc_id: str = "doc_id", text: str = "text") -> Linear:
    """The classifier, learnt from a bounded sample of the labelled rows (``labelled_sample``).

    Spark counts n-grams by class and part, at most as many as there are hashes; the sample's
    rows over the most telling of them come to the driver, where the weights are fitted. Of several ``sizes`` of the model that is
    taken which does best, by log loss, on each part of the sample when fitted on the others, ratios included. With no
    labelled row of one class the score is the same for all texts: the share of the other.
    """
    sample = written(labelled_sample(docs, labels, label, folds, held_out, most, doc_id, text), "toxic-sample")
    rows = np.zeros((PARTS, 2))
    for r in sample.groupBy("part", "y").agg(F.sum("weight").alias("n")).collect():
        rows[r["part"], r["y"]] = r["n"]
    if not rows.sum(0).all():
        return Linear(np.zeros(1 << BITS, np.float32), 4.0 if rows.sum(0)[1] else -4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = Grams(), np.zeros((2 * PARTS, 1 << BITS), np.float32)
        for b in batches:
            for t, y, w, part in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n[2 * part + y][grams(t)] += w
        found = np.flatnonzero(n.sum(0))
        for at in range(0, len(found), 50_000):
            some = found[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"gram": some.astype(np.int32)} | {f"n{k}": n[k][some].astype(float) for k in range(2 * PARTS)})

    names = [f"n{k}" for k in range(2 * PARTS)]
    counts = sample.mapInArrow(count, "gram int, " + ", ".join(f"{c} double" for c in names)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])
    counts = counts.where(sum(map(F.col, names)) >= 2).toArrow()
    n = np.zeros((PARTS, 2, 1 << BITS))
    for k, c in enumerate(names):
        n[k // 2, k % 2, counts["gram"].to_numpy()] = counts[c].to_numpy()
    others = {part: (n.sum(0) - n[part], rows.sum(0) - rows[part]) for part in range(PARTS)}
    others = {part: x for part, x in others.items() if len(sizes) > 1 and x[1].all() and rows[part].sum()}
    every = telling(n.sum(0), rows.sum(0), max(sizes))[0]
    wanted = np.unique(np.concatenate([every, *(telling(*x, max(sizes))[0] for x in others.values())]))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = Grams(), np.zeros(1 << BITS, bool)
        known[wanted] = True
        for b in batches:
            found = [g[known[g]] for g in map(grams, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (1, 2, 3)), pa.array([np.sort(x) for x in found], pa.list_(pa.int32()))], ["y", "weight", "part", "grams"])

    fitted = sample.mapInArrow(narrow, "y int, weight double, part int, grams array<int>").toArrow().combine_chunks()
    lists = [np.asarray(x.values) for x in fitted["grams"]]
    order = sorted(range(len(lists)), key=lambda i: (len(lists[i]), lists[i].tobytes(), fitted["y"][i].as_py()))  # the fit must not depend on the order of rows
    lists = [lists[i] for i in order]
    y, weight, part = (fitted[c].to_numpy()[order] for c in ("y", "weight", "part"))
    indptr, grams = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists).astype(np.int64)

    def model(own: np.ndarray, counted: tuple[np.ndarray, np.ndarray], size: int, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
        ids, ratio = telling(*counted, size)
        w, bias = fit_logistic(*_columns(indptr, grams, own, ids), ratio, y[own].astype(float), weight[own], rounds=rounds)
        return ids, w * ratio, bias

    loss = dict.fromkeys(sizes, 0.0)
    for size in sizes if others else ():
        for p, counted in others.items():
            own, other = np.flatnonzero(part != p), np.flatnonzero(part == p)
            ids, w, bias = model(own, counted, size, 30)
            at, columns = _columns(indptr, grams, other, ids)
            z = np.bincount(np.repeat(np.arange(len(other)), np.diff(at)), w[columns], len(other)) + bias
            loss[size] += float(weight[other] @ (np.logaddexp(0, z) - y[other] * z))
    ids, w, bias = model(np.arange(len(y)), (n.sum(0), rows.sum(0)), min(sizes, key=lambda k: (loss[k], k)), 60)
    weights = np.zeros(1 << BITS, np.float32)
    weights[ids] = w
    return Linear(weights, bias)


def score(docs: DataFrame, model: Linear, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``, nothing shuffled.

    Whole texts are scored; null and empty texts get the score of no n-gram at all.
    Null ids and repeated rows are scored each for itself; other columns are not read;
    an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.score(grams(t)) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below THRESHOLD, with their columns; ids are taken from the rows themselves.

    Rows are scored where they stand: the score is a column beside the others, so
    null ids and repeated rows need no join.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            yield b.filter(pa.array([model.value.score(grams(t)) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
