"""Filling a target's cells from matched sources: a join on ranks instead of a loop over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.functions import text
from loomfuse.operators.keys import key_text, numbered_within


def unpivot(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Rows (*ids, field, value string), one for each cell of ``fields``."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in fields])
    return df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.field", "_c.value")


def source_cells(source: DataFrame, source_id: str, source_order: int, key: str, order: str, fields: list[str]) -> DataFrame:
    """A source's valid cells: (source_id, source_order, src_row, key, n_valid, field, value)."""
    rest = [c for c in source.columns if c != order]
    keyed = source.select(F.lit(source_id).alias("source_id"), F.lit(source_order).alias("source_order"), F.col(f"`{order}`").alias("src_row"), key_text(F.col(f"`{key}`")).alias("key"), text.nonempty_count([F.col(f"`{c}`") for c in rest]).alias("n_valid"), *[F.col(f"`{c}`") for c in fields if c not in ("source_id", "source_order", "src_row", "key", "n_valid")])
    return unpivot(keyed.where("key <> ''"), ["source_id", "source_order", "src_row", "key", "n_valid"], fields).where(text.valid(F.col("value")))


def effective_keys(target_keys: DataFrame, alignment: DataFrame, overrides: DataFrame | None = None, unbind: str = "hard") -> DataFrame:
    """For each (source_id, tgt_key) the source key that fills it: override, else alignment, else the key itself.

    ``target_keys`` (source_id, tgt_key), ``alignment`` (source_id, tgt_key, src_key), ``overrides``
    (tgt_key, src_key). An override without a source key unbinds; with ``unbind="soft"`` the key
    itself still counts then.
    """
    joined = target_keys.join(alignment, ["source_id", "tgt_key"], "left")
    if overrides is None:
        return joined.select("source_id", "tgt_key", F.coalesce("src_key", "tgt_key").alias("src_key"))
    given = overrides.select("tgt_key", F.col("src_key").alias("_given"), F.lit(True).alias("_present"))
    own = F.col("tgt_key") if unbind == "soft" else F.lit(None).cast("string")
    chosen = F.when(F.col("_present"), F.coalesce("_given", own)).otherwise(F.coalesce("src_key", "tgt_key"))
    return joined.join(given, "tgt_key", "left").select("source_id", "tgt_key", chosen.alias("src_key"))


def fill_cells(target_cells: DataFrame, sources: DataFrame, keys: DataFrame, matches: DataFrame, policy: str = "locked") -> DataFrame:
    """Rows (tgt_row, field, old, value, source_id): the cells of matched fields with what fills them, null if nothing does.

    ``target_cells`` (tgt_row, key, field, value), ``sources`` from ``source_cells``, ``keys`` from
    ``effective_keys``, ``matches`` (tgt_field, src_field, source_id). The k-th target row of a key
    takes the k-th of the key's valid source cells, most complete rows first, so each source
    row serves a field once. ``locked`` leaves a match to its one source; with ``coalesce_latest``
    a field may match in several and the last of them that has a value wins.
    """
    asked = target_cells.where("key <> ''").join(F.broadcast(matches), F.col("field") == F.col("tgt_field"))
    asked = asked.select("tgt_row", F.col("key").alias("tgt_key"), "field", "src_field", "source_id").join(keys, ["source_id", "tgt_key"]).where("src_key is not null")
    asked = numbered_within(asked, ["source_id", "field", "src_key"], ["tgt_row"], "_k")  # a key may hold any number of rows
    given = sources.join(F.broadcast(matches.select("source_id", F.col("src_field").alias("field"), F.col("tgt_field").alias("_to"))), ["source_id", "field"])
    given = given.select("source_id", "source_order", F.col("_to").alias("field"), F.col("key").alias("src_key"), "value", (-F.col("n_valid")).alias("_lacks"), "src_row")
    given = numbered_within(given, ["source_id", "field", "src_key"], ["_lacks", "src_row"], "_k").drop("_lacks", "src_row")
    found = asked.join(given, ["source_id", "field", "src_key", "_k"])
    pick = F.max_by if policy == "coalesce_latest" else F.min_by
    won = found.groupBy("tgt_row", "field").agg(pick(F.struct("value", "source_id"), "source_order").alias("_w"))
    wanted = target_cells.join(F.broadcast(matches.select(F.col("tgt_field").alias("field")).distinct()), "field", "left_semi")
    return wanted.join(won, ["tgt_row", "field"], "left").select("tgt_row", "field", F.col("value").alias("old"), F.col("_w.value").alias("value"), F.col("_w.source_id").alias("source_id"))


def fill(target: DataFrame, key: str, order: str, sources: DataFrame, keys: DataFrame, matches: DataFrame, policy: str = "locked") -> tuple[DataFrame, DataFrame]:
    """The filled target, its columns as text, and its statistics (tgt_field, status, cells, reason).

    A value replaces a cell; a blank source never clears one. Matches of the key column
    are left out, those of unknown fields are skipped and told.
    """
    known = [c for c in target.columns if c not in (key, order)]
    active = matches.where(F.col("tgt_field") != key)
    usable = active.where(F.col("tgt_field").isin(known))
    fields = [r[0] for r in usable.select("tgt_field").distinct().collect()]  # columns of the template
    stats = active.where(~F.col("tgt_field").isin(known)).select("tgt_field", F.lit("skip").alias("status"), F.lit(0).cast("long").alias("cells"), F.lit("unknown target field").alias("reason")).distinct()
    if not fields:
        return target, stats
    base = target.select(F.col(f"`{order}`").alias("tgt_row"), key_text(F.col(f"`{key}`")).alias("key"), *[F.col(f"`{c}`") for c in fields])
    cells = fill_cells(unpivot(base, ["tgt_row", "key"], fields), sources, keys, usable, policy)
    wide = cells.groupBy("tgt_row").pivot("field", fields).agg(F.first(F.coalesce("value", "old")))
    out = target.drop(*fields).join(wide, F.col(f"`{order}`") == F.col("tgt_row"), "left").select(*[F.col(f"`{c}`") for c in target.columns])
    done = cells.groupBy("field").agg(F.count("value").alias("cells")).select(F.col("field").alias("tgt_field"), F.lit("ok").alias("status"), "cells", F.lit(None).cast("string").alias("reason"))
    return out, done.unionByName(stats)
