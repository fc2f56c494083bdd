"""Finding header rows in grids of cells, and naming columns from them.

A grid is a table ``cells`` (sheet, r, c, v, in_merge) with a row for each cell, r and c
from 1, and ``merges`` (sheet, r1, r2, c1, c2). Every sheet of the table is judged in the
same jobs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfuse.functions import fixed, text
from loomfuse.operators.scratch import kept

TITLE_SHARE, TITLE_ROWS, PROBE_ROWS, SCORED_ROWS, NAMED_ROWS, PREVIEW_ROWS, PREVIEW_CHARS = 0.5, 10, 200, 100, 31, 6, 40
#: Rows and columns of a tile in which cells meet merged regions.
TILE = 256, 16
DATA_SHARE, STABLE_SHARE, STABLE_RATIO, WIDE, SPARSE, FULL_SPAN = 0.6, 0.5, 0.3, 3, 0.6, 0.8


def filled(v: Column) -> Column:
    """True for a cell that says something: not null, not blank, no generated name."""
    return text.valid(v) & ~v.contains("Unnamed")


def covering(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Each cell with each region that covers it: ``cells`` (sheet, r, c, ...) beside ``regions`` (sheet, r1, r2, c1, c2, ...).

    Sheets are cut into tiles of TILE rows and columns; a cell lies in one tile, a region in those that it touches, and
    only cells and regions of one tile meet. So a sheet with many of both is neither one group nor compared in full.
    """
    tile = lambda at, size: F.floor((F.col(at) - 1) / size)
    placed = cells.withColumns({"_tr": tile("r", TILE[0]), "_tc": tile("c", TILE[1])})
    spread = regions.withColumn("_tr", F.explode(F.sequence(tile("r1", TILE[0]), tile("r2", TILE[0])))).withColumn("_tc", F.explode(F.sequence(tile("c1", TILE[1]), tile("c2", TILE[1]))))
    met = placed.join(spread, ["sheet", "_tr", "_tc"])
    return met.where(F.col("r").between(F.col("r1"), F.col("r2")) & F.col("c").between(F.col("c1"), F.col("c2"))).drop("_tr", "_tc")


def resolve_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges`` with the value of each region: that of its corner, else of its first cell that is not blank, row by row."""
    met = covering(cells.where(text.valid(F.col("v"))).select("sheet", "r", "c", "v"), merges.select("sheet", "r1", "r2", "c1", "c2").distinct())
    values = met.groupBy("sheet", "r1", "r2", "c1", "c2").agg(F.min_by("v", F.struct("r", "c")).alias("value"))
    return merges.join(values, ["sheet", "r1", "r2", "c1", "c2"], "left")


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``cells`` in which every cell that a region covers has the region's value.

    Only cells between the first and the last row and column of all regions can be covered; the others stay where they are, and are not shuffled.
    """
    box = merges.agg(*[f(c).alias(c) for f, c in ((F.min, "r1"), (F.max, "r2"), (F.min, "c1"), (F.max, "c2"))]).first()
    shown = cells.select("sheet", "r", "c", "v")
    if box["r1"] is None:
        return shown.withColumn("in_merge", F.lit(False))
    inside = F.coalesce(F.col("r").between(box["r1"], box["r2"]) & F.col("c").between(box["c1"], box["c2"]), F.lit(False))
    regions = resolve_merges(cells.where(inside), merges)
    covered = regions.select("sheet", F.explode(F.sequence("r1", "r2")).alias("r"), "c1", "c2", "value").select("sheet", "r", F.explode(F.sequence("c1", "c2")).alias("c"), "value", F.lit(True).alias("_m"))
    joined = shown.where(inside).join(covered, ["sheet", "r", "c"], "full")
    joined = joined.select("sheet", "r", "c", F.when(F.col("_m"), F.col("value")).otherwise(F.col("v")).alias("v"), F.coalesce("_m", F.lit(False)).alias("in_merge"))
    return shown.where(~inside).withColumn("in_merge", F.lit(False)).unionByName(joined)


#: What is counted of a run of cells of one row: those filled, outside merges, numbers; characters and key words, if asked for.
COUNTS = ["eff", "real", "numbers", "chars", "words"]


def _counted(run: np.ndarray, n: int, h: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of ``n`` runs the distinct values and the most common one's count; and the values by run, where each run's begin, and their counts. ``run``: each value's."""
    order = np.lexsort((h, run))
    run, h = run[order], h[order]
    start = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (h[1:] != h[:-1])]))
    times, run, h = np.add.reduceat(times[order], start), run[start], h[start]
    begin = np.searchsorted(run, np.arange(n + 1))
    return np.diff(begin), np.maximum.reduceat(times, begin[:-1]), h, begin, times


def _by_run(batches: Iterator[pa.RecordBatch], fold) -> Iterator[pa.RecordBatch]:
    """``fold(table, run)`` over all rows, whose first columns are sheet and r; ``run`` numbers the runs of equal ones, and no run is cut between two calls."""
    held: list[pa.RecordBatch] = []

    def runs(t: pa.Table) -> np.ndarray:
        name = t.column(0).combine_chunks()
        name = np.asarray((name.combine_chunks() if isinstance(name, pa.ChunkedArray) else name).dictionary_encode().indices.fill_null(-1))
        r = np.asarray(t.column(1))
        return np.concatenate([[0], np.cumsum((name[1:] != name[:-1]) | (r[1:] != r[:-1]))])

    for b in batches:
        if not len(b):
            continue
        run = runs(pa.Table.from_batches([b]))
        last = int(np.searchsorted(run, run[-1]))
        if last == 0 and held and b.slice(0, 1).select([0, 1]).to_pylist() == held[-1].slice(0, 1).select([0, 1]).to_pylist():
            held.append(b)
            continue
        if held or last:
            t = pa.Table.from_batches([*held, b.slice(0, last)])
            yield fold(t, runs(t))
        held = [b.slice(last)]
    if held:
        t = pa.Table.from_batches(held)
        yield fold(t, runs(t))


def _runs(cells: DataFrame, scored: bool, values: bool = False) -> DataFrame:
    """Rows (sheet, r, first, last, total, *COUNTS, uniq, most) for each run of filled cells of one row that stand together in ``cells``: the first
    and last column, whether the first cell names a total, and what is counted; with ``values`` the hashes of the distinct values and their counts.

    Values are told apart by 64 bits of hash.
    """
    v, none = text.strip(F.col("v")), F.lit(0)
    total, words = (functools.reduce(lambda x, y: x | y, [v.contains(w) for w in fixed.TOTAL_WORDS]), sum((v.contains(w).cast("int") for w in fixed.HEADER_WORDS), none))
    number = F.regexp_replace(v, "[, ]", "").rlike(fixed.NUMBER)
    each = cells.where(filled(F.col("v"))).select("sheet", "r", "c", F.xxhash64(v).alias("h"), total.alias("total"), (~F.col("in_merge")).cast("int").alias("real"), number.cast("int").alias("numbers"), *([F.length(v).alias("chars"), words.alias("words")] if scored else []))
    kind = dict(cells.dtypes)

    def fold(t: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        col = lambda name: np.asarray(t[name].combine_chunks().fill_null(0) if name != "total" else t[name].combine_chunks().fill_null(False).cast(pa.int8()))
        start = np.flatnonzero(np.diff(run, prepend=-1))
        c, n = col("c"), len(start)
        first = np.minimum.reduceat(c, start)
        uniq, most, h, begin, times = _counted(run, n, col("h"), np.ones(len(run), np.int64))
        sums = {"eff": np.diff(start, append=len(run)), **{x: np.add.reduceat(col(x).astype(np.int64), start) if x in t.column_names else np.zeros(n, np.int64) for x in COUNTS[1:]}}
        out = [t[x].combine_chunks().take(pa.array(start)) for x in ("sheet", "r")] + [pa.array(first), pa.array(np.maximum.reduceat(c, start)), pa.array(np.add.reduceat(col("total") * (c == first[run]), start) > 0), *[pa.array(sums[x].astype(np.int64)) for x in COUNTS], pa.array(uniq.astype(np.int64)), pa.array(most.astype(np.int64))]
        if values:
            packed = lambda x: pa.array([x[a:z].tobytes() for a, z in itertools.pairwise(begin)], pa.binary())
            out += [packed(h.astype(np.int64)), packed(times.astype(np.int32))]
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], [f.name for f in schema.fields])

    schema = StructType.fromDDL(f"sheet {kind['sheet']}, r {kind['r']}, first {kind['c']}, last {kind['c']}, total boolean, " + ", ".join(f"{c} long" for c in [*COUNTS, "uniq", "most"]) + ", h binary, times binary" * values)
    return each.mapInArrow(lambda batches: _by_run(batches, fold), schema)


def _joined(runs: DataFrame) -> DataFrame:
    """``runs`` with values, those of one row made one, wherever they stand; a task goes through its rows as a stream."""
    schema = runs.drop("h", "times").schema

    def fold(t: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.diff(run, prepend=-1))
        first, h = np.asarray(t["first"]), t["h"].to_pylist()
        uniq, most = _counted(np.repeat(run, [len(x) // 8 for x in h]), len(start), np.frombuffer(b"".join(h), np.int64), np.frombuffer(b"".join(t["times"].to_pylist()), np.int32).astype(np.int64))[:2]
        least = np.minimum.reduceat(first, start)
        made = {"first": least, "last": np.maximum.reduceat(np.asarray(t["last"]), start), "total": np.add.reduceat((np.asarray(t["total"]) & (first == least[run])).astype(int), start) > 0, "uniq": uniq.astype(np.int64), "most": most.astype(np.int64)} | {c: np.add.reduceat(np.asarray(t[c]), start) for c in COUNTS}
        keys = {x: t[x].combine_chunks().take(pa.array(start)) for x in ("sheet", "r")}
        out = [pa.array(made[f.name]) if f.name in made else keys[f.name] for f in schema.fields]
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], [f.name for f in schema.fields])

    return runs.repartition("sheet", "r").sortWithinPartitions("sheet", "r").mapInArrow(lambda batches: _by_run(batches, fold), schema)


def row_stats(cells: DataFrame, scored: bool = False) -> DataFrame:
    """For each row: cells filled (eff), those outside merges (real), distinct values, numbers, the most common value's count, the last column, and whether
    it is a title or data; if ``scored``, characters and key words too.

    The cells of a row mostly stand together, as a grid is read line by line: such a run is counted where it is, and only the counts are written.
    Rows between the first and the last that is found in several runs are counted again, with the hashes of their values, which alone are shuffled.
    """
    rows = kept(_runs(cells, scored), "row-runs", compression="zstd")
    apart = rows.groupBy("sheet", "r").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("r").alias("a"), F.max("r").alias("z")).first()
    if apart["a"] is not None:
        several = F.col("r").between(apart["a"], apart["z"])
        rows = rows.where(~several).unionByName(_joined(_runs(cells.where(several), scored, values=True)))
    rows = rows if scored else rows.drop("chars", "words")
    return rows.withColumn("is_title", (F.col("eff") >= 2) & (F.col("most") >= 2) & (F.col("most") / F.col("eff") >= TITLE_SHARE)).withColumn("is_data", (F.col("numbers") / F.col("eff") >= DATA_SHARE) | F.col("total"))


class Sheet:
    """The first rows of one sheet, counted: what its header row is, by the rules of ``header_zone``."""

    def __init__(self, n_columns: int, rows: dict[int, tuple[int, int, int, int, int, bool]], regions: list[tuple[int, int, int]]):
        """``rows``: row -> (eff, real, uniq, most, numbers, total), only rows that say something; ``regions``: (first row, last row, columns)."""
        self.n, self.at = n_columns, sorted(rows)
        self.eff, self.real, self.uniq, most, numbers, total = (list(x) for x in zip(*(rows[r] for r in self.at), strict=True))
        span = dict.fromkeys([*self.at, *(r - 1 for r in self.at)], 0)
        for r1, r2, columns in regions:
            for r in range(max(r1, self.at[0] - 1), min(r2, self.at[-1]) + 1):
                if r in span:
                    span[r] = max(span[r], columns)
        self.span, self.above = [span[r] for r in self.at], [span[r - 1] for r in self.at]
        every = range(len(self.at))
        self.title = [i < every[-1] and self.at[i] <= TITLE_ROWS and self.eff[i] >= 2 and most[i] >= 2 and most[i] / self.eff[i] >= TITLE_SHARE for i in every]
        self.data = [numbers[i] / self.eff[i] >= DATA_SHARE or total[i] for i in every]
        self.least = max(1, min(self.n // 6, 3))

    def _after(self, i: int, counts: list[int], untitled: bool) -> list[int]:
        """The counts of the next two rows below that have any, titles left out if asked."""
        found: list[int] = []
        for k in range(i + 1, len(self.at)):
            if len(found) < 2 and counts[k] > 0 and not (untitled and self.title[k]):
                found.append(counts[k])
        return found

    def _steady(self, i: int, counts: list[int], untitled: bool = True) -> bool:
        """Whether a row fills half the columns, or is filled much as the next two of its kind."""
        own = counts[i]
        return own >= STABLE_SHARE * self.n or all(min(own, x) / max(own, x) >= STABLE_RATIO for x in self._after(i, counts, untitled))

    def _next(self, i: int) -> int | None:
        return i + 1 if i + 1 < len(self.at) and self.at[i + 1] == self.at[i] + 1 else None

    def _field(self, i: int, way: int) -> bool:
        counts = self.eff if way == 1 else self.real
        if counts[i] < self.least or self.data[i] or way < 3 and (self.title[i] or self.span[i] >= WIDE):
            return False
        if way == 1 and self.eff[i] < SPARSE * self.n and self.above[i] < WIDE and any(self.eff[i] < x for x in self._after(i, self.eff, True)):
            return False
        return self._steady(i, counts, way < 3)

    def _richer(self, i: int, way: int) -> bool:
        """Whether the next row could be the field row too and tells more apart."""
        k = self._next(i)
        if k is None or self.data[k] or way < 3 and (self.title[k] or self.span[k] >= WIDE):
            return False
        counts, more = (self.eff, self.uniq) if way == 1 else (self.real, self.real)
        return counts[k] >= self.least and more[k] > more[i]

    def zone(self) -> tuple[int, list[int]] | None:
        """The field row and the category rows above it."""
        first = next(((i, way) for way in (1, 2, 3) for i in range(len(self.at)) if self._field(i, way)), None)
        if first is None:
            return None
        detail = self.at[first[0]] + self._richer(*first)
        above = [i for i in range(len(self.at)) if self.at[i] < detail and not self.title[i]]
        full = [self.span[i] >= FULL_SPAN * self.n for i in above] + [True]
        return detail, [self.at[i] for k, i in enumerate(above) if not (k == 0 and full[0] and not full[1])]


def header_zone(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows (sheet, detail, categories, n_columns): the row of field names and the category rows above it.

    A field row has enough cells, is no title, no data and no wide category, and either fills
    half the columns or is filled much as the next two rows. A sparse row above a fuller one is
    passed over, unless a wide category stands above it; where the next row could be one too and
    tells more values apart, that one is taken. If no row qualifies by all cells, cells outside
    merges decide, and then those without regard to titles and categories. All rows above are
    categories, but for titles and a first region as wide as the sheet above narrower ones.
    Sheets without such a row are left out.

    One shuffle brings together what is counted of the first PROBE_ROWS rows of a sheet, a few numbers a row and no texts; whole sheets
    pass through tasks one after the other, each judged by itself.
    """
    counts, numbers = row_stats(cells), ["a", "b", "c", "d", "e"]
    part = lambda df, kind, r, values, total=None: df.select("sheet", F.lit(kind).alias("kind"), r.cast("long").alias("r"), *[(values[i] if i < len(values) else F.lit(None)).cast("long").alias(x) for i, x in enumerate(numbers)], (F.lit(None) if total is None else total).cast("boolean").alias("total"))
    shown = part(counts.where(F.col("r") <= PROBE_ROWS), 0, F.col("r"), [F.col(c) for c in ("eff", "real", "uniq", "most", "numbers")], F.col("total"))
    width = part(counts.groupBy("sheet").agg(F.max("last").alias("last")), 1, F.lit(0), [F.col("last")])
    over = part(merges.where(F.col("r1") <= PROBE_ROWS), 2, F.col("r1"), [F.col("r2"), F.col("c2") - F.col("c1") + 1])
    parts = shown.unionByName(width).unionByName(over).repartition("sheet").sortWithinPartitions("sheet", "kind", "r")

    def judge(name: str, kind: np.ndarray, r: np.ndarray, values: np.ndarray, total: np.ndarray) -> tuple | None:
        rows = {int(r[i]): (*map(int, values[i]), bool(total[i])) for i in np.flatnonzero(kind == 0)}
        if not rows:
            return None
        sheet = Sheet(int(values[kind == 1, 0].max()), rows, [(int(r[i]), int(values[i, 0]), int(values[i, 1])) for i in np.flatnonzero(kind == 2)])
        zone = sheet.zone()
        return zone and (name, *zone, sheet.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(found: list) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32()), strict=True)], ["sheet", "detail", "categories", "n_columns"])

        name, held = None, []
        for b in batches:
            names = b.column(0).dictionary_encode()
            codes, out = np.asarray(names.indices), []
            kind, r, *values, total = [b.column(i).fill_null(0 if i < 8 else False).to_numpy(zero_copy_only=False) for i in range(1, 9)]
            values = np.stack(values, 1)
            for some in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(codes)) + 1) if len(codes) else ():
                own = names.dictionary[int(codes[some[0]])].as_py()
                if held and own != name:
                    out.append(judge(name, *(np.concatenate(x) for x in zip(*held, strict=True))))
                    held = []
                name = own
                held.append([x[some] for x in (kind, r, values, total)])
            yield done([x for x in out if x])
        if held:
            yield done([x for x in [judge(name, *(np.concatenate(x) for x in zip(*held, strict=True)))] if x])

    return parts.mapInArrow(run, "sheet string, detail int, categories array<int>, n_columns int")


def compound_names(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows (sheet, c, name): a column's category values, each once where it repeats downwards, then its field name, joined by ``>``.

    A column without a field name is Col<c>. Field names that repeat a category stay behind it.
    """
    said = cells.where(filled(F.col("v"))).join(zones.select("sheet", "detail", "categories"), "sheet")
    above = said.where(F.array_contains("categories", F.col("r"))).withColumn("_before", F.lag("v").over(Window.partitionBy("sheet", "c").orderBy("r")))
    above = above.where(F.col("_before").isNull() | (F.col("_before") != F.col("v"))).groupBy("sheet", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.strip(F.col("v")).alias("v")))), lambda x: x["v"]), ">").alias("prefix"))
    own = said.where("r = detail").select("sheet", "c", text.strip(F.col("v")).alias("leaf"))
    columns = zones.select("sheet", F.explode(F.sequence(F.lit(1), F.col("n_columns").cast("int"))).alias("c"))
    named = columns.join(above, ["sheet", "c"], "left").join(own, ["sheet", "c"], "left")
    return named.select("sheet", "c", F.concat_ws(">", "prefix", F.coalesce("leaf", F.concat(F.lit("Col"), F.col("c")))).alias("name"))


def zone_names(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows (sheet, c, name) for zones that a user gives, (sheet, start, end, n_columns): a column's values from row
    ``start`` to ``end``, each once where it repeats downwards, joined by ``>``; Col<c> for a column without any."""
    said = cells.where(filled(F.col("v"))).join(zones.select("sheet", "start", "end"), "sheet").where(F.col("r").between(F.col("start"), F.col("end")))
    said = said.select("sheet", "c", "r", text.strip(F.col("v")).alias("v")).withColumn("_before", F.lag("v").over(Window.partitionBy("sheet", "c").orderBy("r")))
    parts = said.where(F.col("_before").isNull() | (F.col("_before") != F.col("v"))).groupBy("sheet", "c").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("_v"))
    columns = zones.select("sheet", F.explode(F.sequence(F.lit(1), F.col("n_columns").cast("int"))).alias("c"))
    name = F.array_join(F.transform("_v", lambda x: x["v"]), ">")
    return columns.join(parts, ["sheet", "c"], "left").select("sheet", "c", F.coalesce(name, F.concat(F.lit("Col"), F.col("c"))).alias("name"))


def legacy_header(cells: DataFrame) -> DataFrame:
    """Rows (sheet, r, score): the best row by the older rule: points for cells, their length and each key word in each cell, less for numbers alone."""
    rows = row_stats(cells.where(F.col("r") <= SCORED_ROWS), scored=True)
    mean = F.col("chars") / F.col("eff")
    score = F.col("eff") * 10 + F.when(F.col("eff") >= 5, 20).when(F.col("eff") >= 3, 10).otherwise(0) + F.when(mean.between(2, 25), 15).when(mean <= 40, 8).otherwise(0) + F.col("words") * 10 - F.when(F.col("numbers") == F.col("eff"), 50).otherwise(0)
    return rows.withColumn("score", score).groupBy("sheet").agg(F.max_by("r", F.struct("score", -F.col("r"))).alias("r"), F.max("score").alias("score"))


def named_header(cells: DataFrame) -> DataFrame:
    """Rows (sheet, r, score): the row among the first that reads most like names: points for cells, for a name's length, for a letter in front."""
    name = text.strip(F.col("v"))
    point = F.lit(10) + F.when(F.length(name) <= 30, 5).otherwise(0) + F.when(name.rlike(r"^\p{L}"), 3).otherwise(0)
    rows = cells.where(filled(F.col("v")) & (F.col("r") <= NAMED_ROWS)).groupBy("sheet", "r").agg(F.sum(point).alias("score"))
    return rows.groupBy("sheet").agg(F.max_by("r", F.struct("score", -F.col("r"))).alias("r"), F.max("score").alias("score"))


def header_candidates(cells: DataFrame) -> DataFrame:
    """Rows (sheet, start, end, preview): the first rows alone, and runs of two and three of them."""
    lines = cells.where(filled(F.col("v")) & (F.col("r") <= PREVIEW_ROWS)).groupBy("sheet", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", text.strip(F.col("v")).alias("v")))), lambda x: x["v"]), " | ").alias("line"))
    runs = lines.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    other = lines.select(F.col("sheet").alias("_s"), F.col("r").alias("_r"))
    joined = runs.join(other, (F.col("sheet") == F.col("_s")) & (F.col("_r") == F.col("r") + F.col("more")))
    return joined.select("sheet", F.col("r").alias("start"), F.col("_r").alias("end"), F.substring("line", 1, PREVIEW_CHARS).alias("preview"))


def clean_names(names: list[str | None], prefix: str = "_col_") -> list[str]:
    """Unique column names: stripped, blank ones numbered from 1 among themselves, repeated ones with _2, _3 and so on behind
    them, the first that no other column has or was given."""
    plain, blank = [], 0
    for n in names:
        n = (n or "").strip()
        if not n or "Unnamed" in n:
            blank += 1
            n = f"{prefix}{blank}"
        plain.append(n)
    out, used, seen = [], set(plain), {}
    for n in plain:
        k = seen.get(n, 0) + 1
        name = n
        if k > 1:
            while (name := f"{n}_{k}") in used:
                k += 1
            used.add(name)
        seen[n] = k
        out.append(name)
    return out


def to_table(cells: DataFrame, sheet: str, zone: dict, names: list[str]) -> DataFrame:
    """One sheet's rows below its header as a table with ``row_idx``, the place below the header; rows without cells are left out."""
    body = cells.where((F.col("sheet") == sheet) & (F.col("r") > zone["detail"]))
    columns = list(range(1, len(names) + 1))
    wide = body.groupBy("r").pivot("c", columns).agg(F.first("v", ignorenulls=True))
    return wide.select((F.col("r") - zone["detail"] - 1).cast("long").alias("row_idx"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, clean_names(names), strict=True)])


def refilled(df: DataFrame, column: str, cells: DataFrame, sheet: str, detail: int) -> DataFrame:
    """``df`` (row_idx, ...) in which blanks of ``column`` take what the grid shows there, as where a merged cell covers several rows of a key.

    ``cells`` are those of ``expand_merges``. The column is looked up in the header row ``detail``: the first whose name, or its last part, is
    the same after normalisation; without one nothing changes.
    """
    wanted = text.norm_name(F.lit(column))
    shown = F.col("v")
    own = cells.where((F.col("sheet") == sheet) & text.valid(shown))
    at = own.where((F.col("r") == detail) & ((text.norm_name(text.strip(shown)) == wanted) | (text.norm_name(text.leaf(text.strip(shown))) == wanted))).agg(F.min("c").alias("_at"))
    found = own.where(F.col("r") > detail).join(F.broadcast(at), F.col("c") == F.col("_at")).select((F.col("r") - detail - 1).cast("long").alias("_row"), text.strip(shown).alias("_shown"))
    name = F.col(f"`{column}`")
    joined = df.join(found, F.col("row_idx") == F.col("_row"), "left")
    return joined.select(*[F.when(text.valid(name), name).otherwise(F.coalesce("_shown", name)).alias(column) if c == column else F.col(f"`{c}`") for c in df.columns])
