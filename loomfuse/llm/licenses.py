"""Operator 8: licences by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory."""

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

from loomfuse.llm.common import table, written
from loomfuse.llm.notices import TEMPLATES

THRESHOLD = 0.7
#: Lines with telling terms that are no further apart belong to one notice.
NEAR_LINES = 3
#: A file is a licence file if its name says so, or if one notice holds this share of its words.
LICENCE_SHARE = 0.5
LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"

_terms = re.compile("[a-z0-9]+").findall


def terms(text: str) -> Counter:
    """How often each run of ASCII letters and digits occurs, in lower case."""
    return Counter(_terms(text.lower()))


def idf(documents: int, having: int) -> float:
    return math.log((1 + documents) / (1 + having)) + 1


@dataclass
class Matcher:
    """Templates as rows of a term matrix, scaled to length 1 by TF-IDF, and the terms that tell of one."""

    names: list[str]
    place: dict[str, int]
    weights: np.ndarray
    threshold: float
    anchors: list[frozenset[str]]

    @staticmethod
    def of(templates, documents: int, having: dict[str, int], threshold: float) -> Matcher:
        counted = [(name, terms(text)) for name, text in templates]
        place = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
        weights = np.zeros((len(counted), len(place)))
        for row, (_, c) in zip(weights, counted, strict=True):
            for t, k in c.items():
                row[place[t]] = k * idf(documents, having.get(t, 0))
        weights /= np.sqrt((weights**2).sum(1))[:, None]
        words, anchors = list(place), []
        for row in weights:
            own = set()
            # what has none of a template's heaviest terms can't reach the threshold by the others
            rest = 1.0
            for i in sorted(range(len(words)), key=lambda i: (-row[i], words[i])):
                if rest < threshold**2:
                    break
                own.add(words[i])
                rest -= row[i] ** 2
            anchors.append(frozenset(own))
        return Matcher([n for n, _ in counted], place, weights, threshold, anchors)

    def stretches(self, text: str | None) -> list[str]:
        """What of a text may be a notice: lines with a telling term, the runs of lines around those that lie near
        each other, the lines up to the first blank one, and the whole text; each once.

        A cosine is at most the length of the template's part whose terms occur, so only templates of which the
        whole text holds enough are looked for.
        """
        low = (text or "").lower()
        known = [self.place[t] for t in self.place.keys() & set(_terms(low))]
        held = np.flatnonzero((self.weights[:, known] ** 2).sum(1) >= self.threshold**2 - 1e-9)
        anchors = frozenset().union(*(self.anchors[k] for k in held))
        lines = [x.strip() for x in low.split("\n")] if anchors else []
        told = [i for i, x in enumerate(lines) if not anchors.isdisjoint(_terms(x))]
        if not told:
            return []
        runs, start = [], told[0]
        for i, j in zip(told, [*told[1:], len(lines) + NEAR_LINES + 1], strict=True):
            if j - i > NEAR_LINES:
                runs.append("\n".join(lines[start : i + 1]))
                start = j
        head = next((i for i, x in enumerate(lines) if not x), len(lines))
        return list(dict.fromkeys([*(lines[i] for i in told), *runs, *(["\n".join(lines[:head])] if told[0] < head else []), "\n".join(lines)]))

    def best(self, units: list[tuple[list[str], np.ndarray]]) -> list[tuple[float, str] | None]:
        """For each unit, its terms and their weights, the best (cosine, licence) at or above the threshold; of equal ones the first by name."""
        x = np.zeros((len(units), len(self.place)))
        for row, (words, w) in zip(x, units, strict=True):
            at = [(self.place[t], v) for t, v in zip(words, w, strict=True) if t in self.place]
            for i, v in at:
                row[i] = v
        norm = np.sqrt([(w**2).sum() for _, w in units])
        cosines = np.round((x @ self.weights.T) / np.maximum(norm, 1e-300)[:, None], 12)
        found = [min(((-c, n) for c, n in zip(row, self.names, strict=True) if c >= self.threshold), default=None) for row in cosines]
        return [(-f[0], f[1]) if f else None for f in found]


def license_scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, path: str = "path", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, path, own_license, own_similarity, is_license_file, inherited_license, inherited_from, license), one for each row of ``files``.

    Spark counts in how many documents each term occurs. Of each text the lines that hold a
    telling term, the runs of lines around them, the head and the whole are compared with each
    template by TF-IDF cosine, once for each distinct stretch of text; the best speaks for the file. A licence file
    speaks for its directory (of several, the one of highest cosine, then lowest licence name).
    Each directory takes the licence of the nearest directory on its path that has one, by a
    join of distinct directories' ancestors; ``license`` is a file's own, else its directory's.

    Null and empty texts have no licence of their own; a null path has no directory and
    inherits nothing. Repeated rows are judged each for itself; other columns are not read, so their names don't matter;
    an empty table gives no rows. Templates are few and fixed, so what is sent to tasks is too.
    """
    vocabulary = sorted({t for _, x in templates for t in terms(x)})
    split = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda t: t != "")
    having = files.select(F.explode(split(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("having"))
    having = written(having, "license-terms")
    documents = files.count()
    known = {r["term"]: r["having"] for r in having.where(F.col("term").isin(vocabulary)).collect()}  # the templates' terms
    matcher = files.sparkSession.sparkContext.broadcast(Matcher.of(templates, documents, known, threshold))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [matcher.value.stretches(t) for t in b.column(2).to_pylist()]
            words = [len((t or "").split()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(units, pa.list_(pa.string()))], ["doc_id", "path", "words", "units"])

    kind = files.schema[doc_id].dataType.simpleString()
    rows = files.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id {kind}, path string, words long, units array<string>")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "license-units")
    key = F.sha2("unit", 256)  # stands for a stretch wherever its terms go one by one
    units = written(rows.select(F.explode("units").alias("unit")).distinct().select(key.alias("key"), "unit"), "license-distinct")
    said = units.select("key", F.explode(F.filter(F.split("unit", "[^a-z0-9]+"), lambda t: t != "")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("times"))
    weighed = said.join(having, "term").groupBy("key").agg(F.collect_list(F.struct("term", "times", "having")).alias("terms"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(sorted((t["term"], t["times"], t["having"]) for t in u)) for u in b.column(1).to_pylist()]
            best = matcher.value.best([([t for t, _, _ in u], np.array([k * idf(documents, h) for _, k, h in u])) for u in found]) if found else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x and x[1] for x in best], pa.string()), pa.array([x and x[0] for x in best], pa.float64())], ["key", "name", "cosine"])

    hits = written(weighed.mapInArrow(judge, "key string, name string, cosine double").where("name is not null"), "license-hits")
    long = F.size(F.split(F.trim("unit"), r"\s+"))
    each = rows.select("_row", "words", F.explode("units").alias("unit")).select("_row", "words", key.alias("key"), long.alias("long")).join(hits, "key")
    own = each.groupBy("_row").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "name")).alias("b"), F.max(F.col("long") / F.greatest("words", F.lit(1))).alias("share"))
    rows = rows.drop("units").join(own.select("_row", F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("own_similarity"), "share"), "_row", "left")
    says = F.coalesce(F.col("own_license").isNotNull() & (F.col("path").rlike(LICENCE_NAME) | (F.col("share") >= LICENCE_SHARE)), F.lit(False))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    rows = written(rows.select("doc_id", "path", "own_license", "own_similarity", says.alias("is_license_file"), folder.alias("_folder")), "license-files")
    spoken = rows.where(F.col("is_license_file") & F.col("_folder").isNotNull()).groupBy("_folder").agg(F.min(F.struct((-F.col("own_similarity")).alias("_s"), "own_license")).alias("_b"))
    spoken = spoken.select(F.col("_folder").alias("_above"), F.col("_b.own_license").alias("inherited_license"))
    folders = rows.select("_folder").where("_folder is not null").distinct()
    parts = F.split("_folder", "/")
    above = folders.select("_folder", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_depth")).withColumn("_above", F.array_join(F.slice(parts, F.lit(1), F.col("_depth")), "/"))
    nearest = above.join(spoken, "_above").groupBy("_folder").agg(F.max(F.struct("_depth", "_above", "inherited_license")).alias("_n"))
    nearest = written(nearest.select("_folder", F.col("_n.inherited_license").alias("inherited_license"), F.col("_n._above").alias("inherited_from")), "license-folders")
    joined = rows.join(nearest, "_folder", "left").withColumn("license", F.coalesce("own_license", "inherited_license"))
    return joined.select("doc_id", "path", "own_license", "own_similarity", "is_license_file", "inherited_license", "inherited_from", "license")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` have no path of their own: source, language and thousand of the id stand for directories."""
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    place = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), thousand, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", place.alias("path"), "text"))


QUERIES = {"op8_licenses": op8_licenses}
SQL: dict[str, str] = {}
