"""Sources that arrive over time: the latest row of a key, and templates filled while rows come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomfuse.functions import text
from loomfuse.operators.fill import unpivot
from loomfuse.operators.keys import key_text, numbered_within


def latest_rows(rows: DataFrame, key: str, at: str, lateness: str = "1 hour") -> DataFrame:
    """A stream's rows by normalised key: (norm, n_rows, last_at, last); keys unseen for ``lateness`` leave the state."""
    marked = rows.withColumn("norm", text.norm_rowkey(F.col(key))).where("norm <> ''")
    day = F.window(at, "1 day")
    return marked.withWatermark(at, lateness).groupBy("norm", day).agg(F.count("*").alias("n_rows"), F.max(at).alias("last_at"), F.max_by(F.struct(*rows.columns), at).alias("last"))


def fill_as_they_come(rows: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Call ``apply(batch, batch_id)`` for each batch of a stream; a batch that is repeated after a failure keeps its id."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ranked_cells(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """A stream's valid cells (key, field, value, arrived, rank): the k-th valid value of a key and field, in order of arrival, has rank k from 0.

    The state is one number for each key and field: how many have come. Inside a batch ``order`` decides, so any split of the
    rows into batches that keeps their order gives the same ranks, and a late row takes the next free place instead of moving others.
    Keys are compared as ``fill`` does, as stripped text; rows without a key and blank values take no place.
    """
    keyed = rows.select(key_text(F.col(f"`{key}`")).alias("key"), F.col(f"`{order}`").alias("arrived"), *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(fields)])
    names = F.create_map(*[F.lit(x) for i, c in enumerate(fields) for x in (f"_{i}", c)])
    cells = unpivot(keyed.where("key <> ''"), ["key", "arrived"], [f"_{i}" for i in range(len(fields))]).where(text.valid(F.col("value")))
    cells = cells.select("key", F.element_at(names, F.col("field")).alias("field"), "value", "arrived")
    kind = dict(cells.dtypes)["arrived"]

    def place(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        come = pd.concat(list(parts)).sort_values("arrived", kind="stable")
        seen = state.get[0] if state.exists else 0
        come["rank"] = range(seen, seen + len(come))
        state.update((seen + len(come),))
        yield come[["key", "field", "value", "arrived", "rank"]]

    out = f"key string, field string, value string, arrived {kind}, rank long"
    return cells.groupBy("key", "field").applyInPandasWithState(place, out, "seen long", "append", GroupStateTimeout.NoTimeout)


def fill_stream(rows: DataFrame, key: str, order: str, target: DataFrame, target_key: str, target_order: str, matches: dict[str, str]) -> DataFrame:
    """A stream of (tgt_row, field, value): what arriving rows fill in ``target``, a table.

    ``matches`` names the stream's column for each field of the target. The k-th target row of a key takes the key's k-th valid value
    of a field, so each cell is filled once, as soon as its row has come; what comes beyond the target's rows fills nothing.
    """
    places = target.select(F.col(f"`{target_order}`").alias("tgt_row"), key_text(F.col(f"`{target_key}`")).alias("key")).where("key <> ''")
    places = numbered_within(places, ["key"], ["tgt_row"], "rank")
    back: dict[str, list[str]] = {}
    for to, by in matches.items():
        back.setdefault(by, []).append(to)
    to = F.create_map(*[x for by, fields in back.items() for x in (F.lit(by), F.array(*map(F.lit, fields)))])
    ranked = ranked_cells(rows, key, order, list(back))
    return ranked.join(places, ["key", "rank"]).select("tgt_row", F.explode(F.element_at(to, F.col("field"))).alias("field"), "value")
