"""Operator 10: quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import fold, table
from loomfuse.llm.toxicity import labelled_sample

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: At most so many labelled rows of each class train the trees (in expectation; chosen by a hash of the id).
MAX_PER_CLASS = 6000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, L2 = 80, 5, 0.15, 64, 10.0, 1.0

STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "longest_word", "upper", "digits", "blanks", "letters", "other",
    "pipes", "stars", "bangs", "brackets", "full_stops", "commas", "lines", "mean_line", "short_lines", "repeated_lines",
    "distinct_words", "top_word", "repeated_pairs", "longest_run", "words_without_letters", "title_words", "upper_words",
    "word_entropy", "line_ends", "non_ascii", "vowels", "one_letter_words",
)
_LETTERS = re.compile(r"[^\W\d_]").search


def statistics(text: str | None) -> list[float]:
    """The numbers named in STATISTICS for a whole text; all zero for a null or blank one."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    chars, n = len(text), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.bincount(codes[codes < 128], minlength=128)
    share = lambda s: float(sum(low[ord(c)] for c in s)) / chars
    upper, lower = int(low[65:91].sum()), int(low[97:123].sum())
    beyond = int((codes >= 128).sum())
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    count, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    same, longest = np.flatnonzero(np.fromiter((a != b for a, b in zip(words, words[1:], strict=False)), bool, n - 1)), n
    if len(same):
        edges = np.concatenate([[-1], same, [n - 1]])
        longest = int(np.diff(edges).max())
    freq = np.fromiter(count.values(), float, len(count)) / n
    blanks = n - 1 + len(lines)
    return [
        math.log1p(chars), math.log1p(n), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        upper / chars, share("0123456789"), min(1.0, blanks / chars), (upper + lower + beyond) / chars, share("#$%&@^~_=+<>\\/"),
        share("|"), share("*"), share("!?"), share("()[]{}"), float(low[46]) / n, float(low[44] + low[58] + low[59]) / n,
        math.log1p(len(lines)), n / len(lines), sum(len(x) < 20 for x in full) / len(full), 1 - len(set(full)) / len(full),
        len(count) / n, float(freq.max()), sum(v for v in pairs.values() if v > 1) / n, math.log1p(longest),
        sum(k for w, k in count.items() if not _LETTERS(w)) / n, sum(k for w, k in count.items() if w[:1].isupper() and w[1:].islower()) / n, sum(k for w, k in count.items() if w.isupper() and len(w) > 1) / n,
        float(-(freq * np.log(freq)).sum()) / math.log(n + 1), sum(x.rstrip()[-1] in ".!?:;\"')" for x in full) / len(full), beyond / chars, share("aeiouy"), sum(k for w, k in count.items() if len(w) == 1) / n,
    ]


@dataclass
class Trees:
    """Boosted trees as flat arrays, a row for each tree: split feature, threshold, children, leaf value.

    A leaf is its own child on both sides, so that DEPTH steps end at a leaf from anywhere.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[t][node]] <= self.threshold[t][node], self.left[t][node], self.right[t][node])
            total += self.value[t][node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _split(hist_g: np.ndarray, hist_h: np.ndarray) -> tuple[float, int, int]:
    """The best (gain, feature, bin) of a node's histograms; rows up to that bin go left."""
    gl, hl = hist_g.cumsum(1)[:, :-1], hist_h.cumsum(1)[:, :-1]
    g, h = hist_g[0].sum(), hist_h[0].sum()
    gr, hr = g - gl, h - hl
    gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - g**2 / (h + L2)
    gain[(hl < LEAST_ROWS / 4) | (hr < LEAST_ROWS / 4)] = -1
    at = int(gain.argmax())
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss on histograms of at most BINS bins a feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(width) * BINS
    weight = weight * n / weight.sum()
    p = np.clip((weight @ y) / weight.sum(), 1e-4, 1 - 1e-4)
    raw = np.full(n, base := float(np.log(p / (1 - p))))
    nodes = 2 ** (DEPTH + 1) - 1
    out = [np.zeros((TREES, nodes), k) for k in (np.int64, float, np.int64, np.int64, float)]
    for t in range(TREES):
        prob = 1 / (1 + np.exp(-raw))
        g, h = weight * (prob - y), weight * np.maximum(prob * (1 - prob), 1e-6)
        feature, threshold, left, right, value = (a[t] for a in out)
        left[:] = right[:] = np.arange(nodes)
        level = [(0, np.arange(n))]
        for depth in range(DEPTH + 1):
            below = []
            for node, rows in level:
                value[node] = -RATE * g[rows].sum() / (h[rows].sum() + L2)
                if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
                    raw[rows] += value[node]
                    continue
                at = flat[rows].ravel()
                hist = [np.bincount(at, np.repeat(v[rows], width), width * BINS).reshape(width, BINS) for v in (g, h)]
                gain, j, b = _split(*hist)
                if gain <= 1e-6 or b >= len(edges[j]):
                    raw[rows] += value[node]
                    continue
                feature[node], threshold[node], left[node], right[node] = j, edges[j][b], 2 * node + 1, 2 * node + 2
                goes = binned[rows, j] <= b
                below += [(2 * node + 1, rows[goes]), (2 * node + 2, rows[~goes])]
            level = below
    return Trees(*out, base)


def _numbers(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, most: int = MAX_PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """The trees, learnt from a bounded sample of the labelled rows.

    Executors compute the statistics of whole texts; only the sample's numbers (at most
    2 x ``most`` rows in expectation) come to the driver. Without labelled rows of both
    classes the score is one constant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _numbers(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "weight", "x"])

    sample = labelled_sample(docs, labels, label, folds, held_out, most, doc_id, text).mapInArrow(run, "y int, weight double, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y, weight = (np.asarray(sample.column(c), float) for c in ("y", "weight"))
    if len(set(y.tolist())) < 2:
        nodes = np.zeros((0, 1), np.int64)
        return Trees(nodes, nodes, nodes, nodes, nodes, 0.0 if not len(y) else 4.0 if y[0] else -4.0)
    order = np.lexsort([*x.T, y])  # the fit must not depend on the order of rows
    return fit_trees(x[order], y[order], weight[order])


def score(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``, nothing shuffled.

    Null and blank texts have all statistics zero. Null ids and repeated rows are
    scored each for itself; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_numbers(b.column(1).to_pylist())))], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
