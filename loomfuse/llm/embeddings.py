"""Operator 4: near-duplicate embeddings by product quantisation with exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import table, written
from loomfuse.llm.components import components
from loomfuse.llm.forest import Forest

THRESHOLD = 0.9
#: Vectors on which the quantiser is fitted, about so many at most; every vector is indexed.
FIT_VECTORS = 16_384
MOST_LISTS, SUBSPACES, CODES = 4096, 8, 256
#: Members of a group of lists, and as many queries, that meet in one task: at least, and at most where there are vectors for many tasks.
GROUP, MOST_GROUP, TASKS = 4096, 16_384, 12
#: Members, and queries, that are compared at a time, so that their distances and tables stay in a core's cache.
SLICE, COLUMNS = 256, 512
#: Spare room in the distance bounds for rounding of single-precision tables.
SLACK = 1e-3


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``; the start is spread over the sorted rows, so the result is fixed."""
    order = np.lexsort(x.T)
    centres = x[order[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]]
    for _ in range(rounds):
        near = np.concatenate([np.argmin((centres**2).sum(1) - 2 * x[i : i + 1024] @ centres.T, 1) for i in range(0, len(x), 1024)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


@dataclass
class Quantiser:
    """Coarse centres, and code books for the subspaces of what remains of a vector after its centre."""

    centres: np.ndarray
    books: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Quantiser:
        centres = _kmeans(x, lists)
        rest = x - centres[Quantiser(centres, []).near(x)[0]]
        return Quantiser(centres, [_kmeans(part, CODES) for part in np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1)])

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its nearest centre and the squared distance to it."""
        own, far, parts = np.zeros(len(x), np.int64), np.zeros(len(x)), (self.centres**2).sum(1)
        for k in range(0, len(x), SLICE):
            d = parts - 2 * x[k : k + SLICE] @ self.centres.T
            own[k : k + SLICE] = np.argmin(d, 1)
            far[k : k + SLICE] = d.min(1) + (x[k : k + SLICE] ** 2).sum(1)
        return own, np.maximum(far, 0)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the residuals; how far each vector is from what its codes stand for; and the part of a distance to
        that point z which no query changes, |z|^2 - |centre|^2."""
        rest, codes = x - self.centres[own], np.zeros((len(x), len(self.books)), np.int64)
        for k in range(0, len(x), 4 * SLICE):
            for j, (part, b) in enumerate(zip(self._parts(rest[k : k + 4 * SLICE]), self.books, strict=True)):
                codes[k : k + 4 * SLICE, j] = np.argmin((b**2).sum(1) - 2 * part @ b.T, 1)
        stood = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - stood) ** 2).sum(1)), (stood * (stood + 2 * self.centres[own])).sum(1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each subspace a table, code by query, of -2 (query . code): one row serves all members with that code."""
        return [np.ascontiguousarray((-2 * b @ p.T).astype(np.float32)) for p, b in zip(self._parts(queries), self.books, strict=True)]

    def distances(self, tables: list[np.ndarray], near: np.ndarray, codes: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances, member by query, within one list: sums of table rows. ``near``: the queries'
        squared distances to the list's centre; ``fixed``: the members' own parts."""
        total = near[None] + fixed.astype(np.float32)[:, None]
        row = np.empty_like(total)
        for j, t in enumerate(tables):
            total += np.take(t, codes[:, j], 0, out=row, mode="clip")
        return total

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float, radius: np.ndarray, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Vector by list: whether the list can hold a vector within ``reach`` of this one; and the squared distances to the lists' centres.

        If y is in the list of c, then y is at least as near to c as to x's own centre o, so
        |x - c|^2 - |x - o|^2 <= 2 (x - y)(c - o) <= 2 |x - y| |c - o|; and |x - c| <= |x - y| +
        the list's ``radius``. Lists beyond either bound with |x - y| = ``reach`` hold none. Worked out for some vectors at a time.
        """
        lists = np.arange(len(self.centres)) if lists is None else lists
        centres, fine, near = self.centres[lists], np.zeros((len(x), len(lists)), bool), np.zeros((len(x), len(lists)), np.float32)
        lengths = (centres**2).sum(1)
        for k in range(0, len(x), SLICE):
            some, o = x[k : k + SLICE], self.centres[own[k : k + SLICE]]
            d = np.maximum((some**2).sum(1)[:, None] + lengths - 2 * some @ centres.T, 0)
            home = ((some - o) ** 2).sum(1)[:, None]
            gap = np.sqrt(np.maximum((o**2).sum(1)[:, None] + lengths - 2 * o @ centres.T, 0))
            fine[k : k + SLICE] = (d - home <= 2 * reach * gap + SLACK) & (np.sqrt(d) <= reach + radius[lists] + SLACK)
            near[k : k + SLICE] = d
        return fine, near


def group_size(total: int) -> int:
    """Members of a group among ``total`` vectors. Where all lists are asked, each vector is sent to total / size groups: larger groups, fewer copies."""
    return max(GROUP, min(MOST_GROUP, total // TASKS))


def meet(q: Quantiser, reach: float, radius: np.ndarray, threshold: float, x: np.ndarray, own: np.ndarray, by: np.ndarray, y: np.ndarray, owner: np.ndarray, to: np.ndarray, codes: np.ndarray, off: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of queries ``x`` and members ``y`` with a cosine of ``threshold``, and so a distance of ``reach`` at most, each pair once.

    Queries have lists ``own`` and nodes ``by``; members lists ``owner``, nodes ``to``, ``codes``, and ``off`` and ``fixed`` of ``encode``.
    Queries go in columns of COLUMNS: their tables are made once, looked up where they are for all lists, and copied only for a list that few of them ask.
    """
    order, lists = np.argsort(own, kind="stable"), np.unique(owner)
    probed, near = q.probes(x, own, reach, radius, lists)
    most = ((reach + off + SLACK) ** 2).astype(np.float32)
    held = [np.array_split(every, -(-len(every) // SLICE)) for every in (np.flatnonzero(owner == c) for c in lists)]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for some in (order[k : k + COLUMNS] for k in range(0, len(order), COLUMNS)):
        tables, asks = q.tables(x[some]), probed[some] & (own[some, None] <= lists)
        for at_list, c in enumerate(lists):
            n = np.count_nonzero(asks[:, at_list])
            if not n:
                continue
            few = 4 * n < len(some)
            who = np.flatnonzero(asks[:, at_list]) if few else np.arange(len(some))
            part, home = [t[:, who] for t in tables] if few else tables, near[some[who], at_list]
            for slot in held[at_list]:
                hit = np.flatnonzero(q.distances(part, home, codes[slot], fixed[slot]) <= most[slot][:, None])
                if not len(hit):
                    continue
                i, j = some[who[hit % len(who)]], slot[hit // len(who)]
                once = (own[i] < c) | (own[i] == c) & (by[i] < to[j])  # pairs of one list are met from both ends
                i, j = i[once], j[once]
                for k in range(0, len(i), 100_000):
                    fine = np.einsum("ij,ij->i", x[i[k : k + 100_000]], y[j[k : k + 100_000]]) >= threshold
                    found.append((i[k : k + 100_000][fine], j[k : k + 100_000][fine]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def group_lists(centres: np.ndarray, sizes: np.ndarray, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first group and in how many groups its members are dealt: large lists get several of their own,
    small ones share one with lists whose centres lie near along the centres' main direction."""
    middle = centres - centres.mean(0)
    main = np.linalg.svd(middle, full_matrices=False)[2][0] if len(centres) > 1 else np.zeros(centres.shape[1])
    first, parts, at, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most)), 0, 0
    for i in np.argsort(middle @ main, kind="stable"):
        if held and held + sizes[i] > most:
            at, held = at + 1, 0
        first[i] = at
        held += sizes[i]
        if parts[i] > 1:
            at, held = at + parts[i], 0
    return first, parts


def _unit(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, initial=0)[:, None]  # so that no square runs over or under
    return x / np.sqrt((x**2).sum(1))[:, None]


def _comparable(vec) -> F.Column:
    """True for a vector that has a direction: not null or empty, all components finite numbers, not all zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def _links(vectors: DataFrame, threshold: float, label: str) -> DataFrame:
    """Rows (a, b, n) over distinct vectors (node, copies, vec), each with a node of its own, of one length: links of a spanning forest of
    each task's pairs (n null), and for node a the rows it links to among them (b null)."""
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * threshold)
    total = vectors.count()
    part = min(1.0, FIT_VECTORS / max(1, total))
    fit = vectors.where(F.pmod(F.xxhash64("node", F.lit("fit")), F.lit(1 << 30)) < part * (1 << 30)).select("vec").toArrow()
    sample = _unit(fit["vec"]) if len(fit) else _unit(vectors.limit(1).toArrow()["vec"])
    quantiser = Quantiser.fit(sample, max(1, min(MOST_LISTS, len(sample), math.isqrt(total))))
    model = spark.sparkContext.broadcast(quantiser)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for b in batches:
            if not len(b):
                continue
            x = _unit(b.column(2))
            own, far = q.near(x)
            codes, off, fixed = q.encode(x, own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(np.sqrt(far)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(fixed)], ["node", "copies", "vec", "own", "far", "codes", "off", "fixed"])

    kind = vectors.schema["vec"].dataType.simpleString()
    spread = vectors.select("node", "copies", "vec").repartition(max(1, min(total // 500, 4096)), "node")
    indexed = written(spread.mapInArrow(index, f"node long, copies long, vec {kind}, own int, far double, codes binary, off double, fixed double"), f"{label}-index")
    lists = len(quantiser.centres)
    sizes, radius = np.zeros(lists, np.int64), np.zeros(lists)
    for r in indexed.groupBy("own").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most MOST_LISTS rows
        sizes[r["own"]], radius[r["own"]] = r["n"], r["far"]
    most = group_size(total)
    first, parts = group_lists(quantiser.centres, sizes, most)
    layout = spark.sparkContext.broadcast((radius, first, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (radius, first, parts) = model.value, layout.value
        for b in batches:
            own, groups = np.asarray(b.column(3)), []
            x = _unit(b.column(2)) if len(b) else np.zeros((0, q.centres.shape[1]))
            for k in range(0, len(x), SLICE):
                asked = q.probes(x[k : k + SLICE], own[k : k + SLICE], reach, radius)[0]
                for i, row in enumerate(asked):
                    to = np.flatnonzero(row[own[k + i] :]) + own[k + i]
                    groups.append(np.unique(np.concatenate([first[to], *(first[j] + np.arange(1, parts[j]) for j in to[parts[to] > 1])])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(groups, pa.list_(pa.int32()))], ["node", "groups"])

    asked = written(indexed.select("node", "copies", "vec", "own").mapInArrow(ask, "node long, groups array<int>"), f"{label}-asked")
    # how many queries ask each group: a number for each group
    blocks = asked.select(F.explode("groups").alias("group")).groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    blocks = written(blocks, f"{label}-blocks")
    layout_rows = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, parts, strict=True))], "own int, first int, parts int")
    place = (F.col("first") + F.pmod(F.xxhash64("node", F.lit(0)), F.col("parts"))).cast("int")
    members = indexed.join(F.broadcast(layout_rows), "own").withColumn("group", place).join(F.broadcast(blocks), "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = asked.select("node", F.explode("groups").alias("group")).join(F.broadcast(blocks), "group").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    queries = queries.select("node", "group", "block").join(indexed.select("node", "copies", "vec", "own"), "node")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("off", "double"), ("fixed", "double"))]
    rows = members.select("group", "block", F.lit(0).alias("side"), "node", "copies", "vec", "own", "codes", "off", "fixed").unionByName(queries.select("group", "block", F.lit(1).alias("side"), "node", "copies", "vec", "own", *nothing))

    def compare(t: pa.Table) -> pa.Table:
        q, side = model.value, np.asarray(t["side"])
        ours, theirs = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        out = {"a": [], "b": [], "n": []}
        if len(ours) and len(theirs):
            y, x = _unit(ours["vec"]), _unit(theirs["vec"])
            codes = np.frombuffer(b"".join(ours["codes"].to_pylist()), np.uint8).reshape(len(ours), -1)
            off, fixed, to, by = (np.asarray(c) for c in (ours["off"], ours["fixed"], ours["node"], theirs["node"]))
            i, j = meet(q, reach, layout.value[0], threshold, x, np.asarray(theirs["own"]), by, y, np.asarray(ours["own"]), to, codes, off, fixed)
            ids, at = np.unique(np.concatenate([to, by]), return_inverse=True)
            j, i, copies = at[j], at[len(to) + i], np.zeros(len(ids), np.int64)
            copies[at] = np.concatenate([np.asarray(ours["copies"]), np.asarray(theirs["copies"])])
            n = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
            some = np.flatnonzero(n)
            forest = Forest(len(ids))
            forest.join(i, j)
            a, b = forest.links()
            out = {"a": [*ids[a], *ids[some]], "b": [*ids[b], *[None] * len(some)], "n": [*[None] * len(a), *n[some]]}
        return pa.table(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    return rows.groupBy("group", "block").applyInArrow(compare, "a long, b long, n long")


def _shared_ids(usable: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of different vectors with one id; told by hashes of 128 bits which ids have any."""
    print_of = F.struct(F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g"))
    ids = usable.groupBy("vec_id").agg(F.min(print_of).alias("low"), F.max(print_of).alias("high")).where("low <> high").select("vec_id")
    pairs = written(usable.join(ids, "vec_id").join(distinct, "vec").select("vec_id", "node").distinct(), "vectors-of-ids")
    return pairs.join(pairs.groupBy("vec_id").agg(F.min("node").alias("a")), "vec_id").where("a <> node").select("a", F.col("node").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, is ``threshold``
    or more. Equal vectors are indexed once. Each vector is put in the list of its
    nearest coarse centre with codes of its residual; each asks every list that can hold
    a neighbour, bounds the distance to each member by table lookup and the member's own
    quantisation error, and computes the exact cosine of those that the bound leaves. All
    bounds are strict, so no link is missed whatever directions the vectors take, at the price
    of probing most lists of unclustered vectors. Small lists share a group, large ones are
    divided, and a group's queries are dealt to blocks, so no task gets more than about ``group_size``
    members and as many queries; it yields counts and at most one link a node.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Repeated rows link with each other; rows
    of one id with different vectors are vectors of their own with links of their own, but share one component. Rows with null ids
    are returned with no links and a null component, and kept. Other columns are not read.
    """
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    usable = base.where(_comparable(F.col("vec")) & F.col("vec_id").isNotNull())
    distinct = usable.groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r[0] for r in distinct.select(F.size("vec")).distinct().collect())
    found = None
    for length in lengths:  # vectors of one length make one index
        part = _links(distinct.where(F.size("vec") == length), threshold, f"vectors-{length}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "vector-links")
    roots = components(found.where("b is not null").select("a", "b").unionByName(_shared_ids(usable, distinct)), "vectors")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = distinct.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "vectors-named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(named.join(smallest, "root").select("vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-classes")
    linked = base.join(named, F.when(_comparable(base["vec"]) & base["vec_id"].isNotNull(), base["vec"]) == named["vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embeddings": op4_embeddings}
SQL = {
    "op4_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id"""
}
