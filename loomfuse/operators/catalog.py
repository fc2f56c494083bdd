"""What fields sources have, with samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfuse.functions import text
from loomfuse.operators.fill import unpivot
from loomfuse.operators.keys import GENERATED

SAMPLES, CHARS = 3, 40


def target_fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(GENERATED)]


def field_catalog(source: DataFrame, source_id: str, source_order: int, order: str) -> DataFrame:
    """Rows (source_id, source_order, ord, field, samples): the first valid values of each field, cut to CHARS.

    Each task keeps the first few of its own rows, so no field gathers in one place.
    """
    fields = [c for c in target_fields(source) if c != order]
    cells = unpivot(source.select(F.col(order).alias("_o"), *[F.col(f"`{c}`") for c in fields]), ["_o"], fields)
    part = cells.where("value is not null").withColumn("_p", F.floor(F.col("_o") / 4096))
    few = part.withColumn("_r", F.row_number().over(Window.partitionBy("field", "_p").orderBy("_o"))).where(F.col("_r") <= SAMPLES)
    best = few.withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy("_o"))).where(F.col("_r") <= SAMPLES)
    samples = best.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.substring("value", 1, CHARS).alias("v")))), lambda x: x["v"]).alias("samples"))
    names = source.sparkSession.createDataFrame([(source_id, source_order, i, c) for i, c in enumerate(fields)], "source_id string, source_order int, ord int, field string")
    return names.join(samples, "field", "left").select("source_id", "source_order", "ord", "field", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def all_samples(catalog: DataFrame) -> DataFrame:
    """Rows (field, sample): samples of each name, the first source's, joined by slashes."""
    return catalog.groupBy("field").agg(F.array_join(F.min_by("samples", F.struct("source_order", "ord")), " / ").alias("sample"))
