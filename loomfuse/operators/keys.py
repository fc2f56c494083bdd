"""Row keys: finding the key column, reading keys, filling gaps, indexing and extending templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfuse.functions import fixed, text
from loomfuse.operators.scratch import kept

GENERATED = "_col_"


def valid_counts(df: DataFrame) -> dict[str, int]:
    """How many valid cells each column has, in one pass."""
    if not df.columns:
        return {}
    row = df.agg(*[F.count_if(text.valid(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[i] for i, c in enumerate(df.columns)}


def detect_key(df: DataFrame, counts: dict[str, int] | None = None) -> str | None:
    """The column with most valid cells, of equal ones the first; generated columns only if no other has any."""
    counts = valid_counts(df) if counts is None else counts
    named = {c: n for c, n in counts.items() if not c.startswith(GENERATED)}
    for group in (named, counts):
        if group and max(group.values()) > 0:
            return max(group, key=group.get)
    return df.columns[0] if df.columns else None


def resolve_key(columns: list[str], key: str | int | None) -> str | None:
    """A key column given by place, by name or by a name that normalises to the same; else the first column."""
    if isinstance(key, int) and 0 <= key < len(columns):
        return columns[key]
    squeeze = lambda s: "".join(s.translate(str.maketrans(text.WIDE, text.NARROW)).lower().split()).replace("_", "").replace("-", "")
    if isinstance(key, str):
        if key in columns:
            return key
        for c in columns:
            if squeeze(c) == squeeze(key):
                return c
    return columns[0] if columns else None


def key_text(c: Column) -> Column:
    """A cell as a key: stripped text; empty if the cell is not valid. Whole doubles lose their fraction of zero."""
    return F.when(text.valid(c), text.strip(c.cast("string"))).otherwise(F.lit(""))


def key_number(c: Column) -> Column:
    """A floating-point id as a key: digits alone if it is whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def _named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{column}`")


def forward_fill(df: DataFrame, key: str, order: str, by: list[str] = [], block: int = 1 << 20, to: str | None = None) -> DataFrame:  # noqa: B006
    """``df`` with nulls of ``key`` replaced by the last value above them, in the order of the long ``order``, for each ``by``.

    Only nulls are filled, blanks stay. Rows are dealt to blocks of ``order``; each block
    takes over the last value of the blocks before it, so that no task sorts more than a
    block and the blocks' own table has a row for each block. Rows with null ``by`` are a group
    like others; rows with null ``order`` come first in theirs.
    """
    own, at = _named(key), _named(order)
    rows = df.withColumn("_block", F.floor(at / block))
    groups = [_named(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    names = [f"_by_{i}" for i in range(len(by))]
    blocks = rows.groupBy(*groups, "_block").agg(F.max_by(own, F.when(own.isNotNull(), at)).alias("_last"))
    carried = Window.partitionBy(*names).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*names, F.col("_block").alias("_own_block"), F.last("_last", ignorenulls=True).over(carried).alias("_carried"))
    same = F.col("_block").eqNullSafe(F.col("_own_block"))
    for c, name in zip(by, names, strict=True):
        same = same & _named(c).eqNullSafe(F.col(name))
    inside = Window.partitionBy(*map(_named, by), "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.join(blocks, same).withColumn("_filled", F.coalesce(F.last(own, ignorenulls=True).over(inside), F.col("_carried")))
    if to:
        return filled.select(*map(_named, df.columns), F.col("_filled").alias(to))
    return filled.select(*[F.col("_filled").alias(c) if c == key else _named(c) for c in df.columns])


def key_index(df: DataFrame, key: str, order: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (*by, key, n_rows, first_row, duplicate), one for each valid key."""
    keyed = df.select(*by, key_text(F.col(key)).alias("key"), F.col(order).alias("_order")).where("key <> ''")
    return keyed.groupBy(*by, "key").agg(F.count("*").alias("n_rows"), F.min("_order").alias("first_row")).withColumn("duplicate", F.col("n_rows") > 1)


def row_key_candidates(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """Matches ranked as row keys: those whose target names a key word, by valid cells, word, order; without any, all matches.

    ``matches`` (ord, tgt_field, src_field, matched), ``counts`` (tgt_field, n_valid). Rank 1 is the row key.
    """
    word = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(fixed.ROW_KEY_WORDS))):
        word = F.when(F.col("tgt_field").contains(w), F.lit(i)).otherwise(word)
    usable = matches.where(F.col("matched") & F.col("src_field").isNotNull()).join(counts, "tgt_field", "left").withColumn("word", word)
    hits = usable.where("word is not null")
    pool = usable.where(F.col("word").isNotNull() | F.lit(hits.isEmpty()))
    w = Window.orderBy(F.coalesce("n_valid", F.lit(0)).desc(), F.col("word").asc_nulls_last(), "ord")
    return pool.withColumn("rank", F.row_number().over(w))  # a row for each matched field


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first row."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def _in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by ranges and written, with ``_range`` and ``_rank`` from 0 over all of it; a range counts from the rows before it."""
    placed = kept(df.orderBy(*map(_named, order)).withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_range"), 33)
    return placed.join(F.broadcast(before), "_range").withColumn("_rank", rank).drop("_at", "_before")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_rank`` from 0 in the order of ``order``: rows are sorted by ranges, a range counts from the rows before it."""
    return _in_ranges(df, order).drop("_range")


def numbered_within(df: DataFrame, by: list[str], order: list[str], to: str) -> DataFrame:
    """``df`` with the long ``to`` from 0 in the order of ``order`` for each ``by``, nulls a group like others.

    All rows are sorted by ranges together, so a group of any size is spread over many tasks; a row's rank is
    its place less that of its group's first row, which is known for each group and range.
    """
    placed = _in_ranges(df, *by, *order)
    names = [f"_by_{i}" for i in range(len(by))]
    spans = placed.groupBy(*[_named(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_range").alias("_of")).agg(F.min("_rank").alias("_first"))
    spans = spans.withColumn("_first", F.min("_first").over(Window.partitionBy(*names)))  # a row for each group and range
    same = F.col("_range") == F.col("_of")
    for c, n in zip(by, names, strict=True):
        same = same & _named(c).eqNullSafe(F.col(n))
    return placed.join(spans, same).select(*map(_named, df.columns), (F.col("_rank") - F.col("_first")).alias(to))


def expand_target(target: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with a row for each of ``keys`` (key, ord) that it lacks, behind its own rows; a missing key column is added."""
    if key not in target.columns:
        target = target.withColumn(key, F.lit(None).cast("string"))
    start = target.agg(F.coalesce(F.max(order) + 1, F.lit(0))).first()[0]
    new = keys.join(target.select(_named(key).alias("key")), "key", "left_anti")
    rows = numbered(new, "ord").select(F.col("key").alias(key), (F.col("_rank") + start).cast(target.schema[order].dataType).alias(order))
    return target.unionByName(rows, allowMissingColumns=True)
