"""Operator 7: shards as runs of a Hilbert curve through quantised metadata. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfuse.llm.common import table, written

SHARDS = 16
#: Bits of each quantised dimension.
BITS = 4
#: Rows of one curve cell are told apart by so many cells of the first dimension, then by a hash.
FINE, SALTS = 128, 64


def hilbert_states(n: int) -> tuple[list[int], list[int]]:
    """The curve in ``n`` dimensions as a machine: for state * 2^n + corner the corner's place, and the next state.

    A state is the corner where the curve enters a cube and the axis along which it
    leaves; state 0 is the whole cube. (After Hamilton's "Compact Hilbert indices", 2006.)
    """
    size = 1 << n
    turn = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & (size - 1)  # noqa: E731  to the right
    gray = lambda x: x ^ (x >> 1)
    place_of = {gray(w): w for w in range(size)}
    ones = lambda x: (x ^ (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    axis = lambda w: 0 if not w else ones(w - 1 if w % 2 == 0 else w) % n
    states, places, following = [(0, 0)], [], []
    for e, d in states:  # grows as it is read
        for corner in range(size):
            w = place_of[turn(corner ^ e, d + 1)]
            state = (e ^ turn(entry(w), n - (d + 1) % n), (d + axis(w) + 1) % n)
            if state not in states:
                states.append(state)
            places.append(w)
            following.append(states.index(state))
    return places, following


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a cell given by one coordinate of ``bits`` bits a dimension."""
    n = len(cells)
    places, following = (F.array(*map(F.lit, x)) for x in hilbert_states(n))
    coordinates = F.array(*[c.cast("int") for c in cells])

    def step(state: Column, level: Column) -> Column:
        corner = sum((F.call_function("shiftright", F.get(coordinates, F.lit(j)), level) % 2 * (1 << j) for j in range(n)), F.lit(0))
        at = state["state"] * (1 << n) + corner
        return F.struct(F.get(following, at).alias("state"), (state["place"] * (1 << n) + F.get(places, at)).alias("place"))

    levels = F.array(*[F.lit(k) for k in reversed(range(bits))])
    return F.aggregate(levels, F.struct(F.lit(0).alias("state"), F.lit(0).alias("place")), step, lambda s: s["place"])


def _order(df: DataFrame, name: str) -> Column:
    """A dimension as values in order: text and bytes by their bytes, anything else as it compares."""
    return F.encode(F.col(name), "utf-8") if dict(df.dtypes)[name] == "string" else F.col(name)


def _cuts(rows: DataFrame, values: dict[str, Column], first: str) -> tuple[dict[str, list], list, int]:
    """Each dimension's cut points, the finer ones of the ``first`` dimension, and the number of rows.

    Numbers are cut by sketches of bounded size, all in the pass that counts rows; others by counts of values, in one pass a type.
    """
    asked = {(d, 1 << BITS) for d in values} | {(first, FINE)}
    kind = {d: rows.schema[d].dataType for d in values}
    at = {(d, n): F.percentile_approx(values[d], [k / n for k in range(1, n)], 100 * n).alias(f"{n}:{d}") for d, n in asked if isinstance(kind[d], T.NumericType)}
    told = rows.agg(F.count(F.lit(1)).alias("rows"), *at.values()).first()
    found = {(d, n): sorted(set(told[f"{n}:{d}"] or [])) for d, n in at}
    others: dict[str, dict[str, Column]] = {}
    for d in values:
        if not isinstance(kind[d], T.NumericType):
            others.setdefault(kind[d].simpleString(), {})[d] = values[d]
    for alike in others.values():
        found |= _counted_cuts(rows, alike, {(d, n) for d, n in asked if d in alike})
    return {d: found[d, 1 << BITS] for d in values}, found[first, FINE], told["rows"]


def _counted_cuts(rows: DataFrame, values: dict[str, Column], asked: set[tuple[str, int]]) -> dict[tuple[str, int], list]:
    """For each (dimension, parts) at most parts - 1 values that divide its non-null rows about evenly, a value that is frequent once.

    The values of all dimensions, of one type, are counted once each, then laid out in ranges by Spark's sort, and each range tells
    how many rows it holds: the cuts are the values at whose rows the shares of the whole begin.
    """
    each = F.array(*[F.struct(F.lit(d).alias("d"), v.alias("v")) for d, v in values.items()])
    counts = rows.select(F.explode(each).alias("e")).select("e.*").where("v is not null").groupBy("d", "v").count()
    counts = written(counts.orderBy("d", "v").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "hilbert-values")
    ranges = counts.groupBy("d", "range").agg(F.sum("count").alias("n"))  # a row for each range, one more where a dimension begins
    own = Window.partitionBy("d")
    before = ranges.select("d", "range", (F.sum("n").over(own.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("total"))
    inside = counts.join(F.broadcast(before), ["d", "range"])
    upto = F.col("before") + F.sum("count").over(Window.partitionBy("d", "range").orderBy("at"))
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("_d"), F.lit(n).alias("parts")) for d, n in sorted(asked)])).alias("_p")
    placed = inside.withColumn("upto", upto).select("*", parts).where(F.col("_p._d") == F.col("d"))
    share = lambda n: F.floor((n - 1) * F.col("_p.parts") / F.col("total"))
    placed = placed.withColumn("share", share(F.col("upto"))).withColumn("prior", share(F.col("upto") - F.col("count")))
    cuts: dict[tuple[str, int], list] = {x: [] for x in asked}
    for r in placed.where("prior >= 0 and share > prior").orderBy("at").select("d", "_p.parts", "v").collect():  # parts - 1 a dimension at most
        cuts[r["d"], r["parts"]].append(r["v"])
    return cuts


def _cell(value: Column, cuts: list) -> Column:
    """How many of the cut points a value reaches; null counts as lowest."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value >= c)) if cuts else F.lit(0)


def hilbert_shards(rows: DataFrame, dimensions: list[str], ties: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with columns (shard int, slot long): runs of a Hilbert curve, their counts at most one apart.

    Each dimension is cut into 2^BITS cells of about as many rows each, so outliers don't matter; rows are
    ordered by the curve through the cells, inside a cell by finer cells of the first dimension and then by a
    hash, and ``ties`` settle the rest. A row's rank is the sum of offsets taken from counts
    on three levels (256 top parts of the curve, the cells of each, the fine parts of each
    cell) and its place in its fine part, so no task sorts more than a fine part. Nulls lie
    in the lowest cell. Rows alike in all of these are ordered arbitrarily, which changes no
    row's content. An empty table gives no rows. ValueError if a column is named shard or slot, or
    begins with an underscore and names one of the operator's own.
    """
    own = {"shard", "slot", "_h", "_fine", "_salt", "_top", "_place", "_start", "_rank"}
    if taken := own.intersection(rows.columns):
        raise ValueError(f"the names of these columns are the operator's own: {', '.join(sorted(taken))}")
    values = {d: _order(rows, d) for d in dimensions}
    first = dimensions[0]
    cuts, fine_cuts, total = _cuts(rows, values, first)
    bits = BITS * len(dimensions)
    placed = rows.select(
        *rows.columns,
        hilbert_index([_cell(values[d], cuts[d]) for d in dimensions]).alias("_h"),
        _cell(values[first], fine_cuts).alias("_fine"),
        F.pmod(F.xxhash64(*ties), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    placed = placed.withColumn("_top", F.shiftright("_h", max(0, bits - 8)))
    fine = written(placed.groupBy("_top", "_h", "_fine", "_salt").count(), "hilbert-counts")

    def before(counts: DataFrame, part: list[str], order: list[str], to: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(to, F.coalesce(F.sum("count").over(w), F.lit(0)))

    cell = fine.groupBy("_top", "_h").agg(F.sum("count").alias("count"))
    top = cell.groupBy("_top").agg(F.sum("count").alias("count"))  # 256 rows at most
    offsets = before(top, [], ["_top"], "_a").select("_top", "_a")
    cells = before(cell, ["_top"], ["_h"], "_b").select("_top", "_h", "_b").join(F.broadcast(offsets), "_top")
    fines = before(fine, ["_h"], ["_fine", "_salt"], "_c").select("_h", "_fine", "_salt", "_c")
    starts = written(fines.join(cells, "_h").select("_h", "_fine", "_salt", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_start")), "hilbert-starts")
    place = F.row_number().over(Window.partitionBy("_h", "_fine", "_salt").orderBy(*ties)) - 1
    ranked = placed.withColumn("_place", place).join(starts, ["_h", "_fine", "_salt"]).withColumn("_rank", F.col("_start") + F.col("_place"))
    shard = F.expr(f"_rank * {shards} div {max(1, total)}")
    begins = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rank") - begins).select(*rows.columns, "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, dimensions: list[str], ties: list[str], shards: int = SHARDS) -> None:
    """The rows of ``docs`` in Parquet folders shard=0, 1, ...; each shard's rows are near on the curve, so that readers
    skip files by the ranges of any of the dimensions."""
    placed = hilbert_shards(docs, dimensions, ties, shards)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(rows.withColumn("_log_size", F.log2("size")), "shard-metadata")
    placed = hilbert_shards(rows, ["doc_id", "source", "lang", "_log_size"], ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
