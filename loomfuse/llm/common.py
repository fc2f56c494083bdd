"""What the text operators share: reading tables and cutting lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.operators.scratch import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder, compressed well, and read again (``scratch.kept``)."""
    return kept(df, label, compression="zstd")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def let(value, use):
    """``use(value)`` with ``value`` computed once, for expressions that name it often or inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def own_names(docs: DataFrame) -> None:
    """ValueError if ``docs`` has a column that begins with an underscore: such names are the operator's own."""
    if taken := [c for c in docs.columns if c.startswith("_")]:
        raise ValueError(f"the names of these columns are the operator's own: {', '.join(taken)}")
