"""Operator 1: token counts by a map-side two-tier lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import table
from loomfuse.llm.units import Encoder, frequent_units

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def token_counts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each row of ``docs``, nothing shuffled.

    Tokens are those of the sentencepiece model at ``model_path``, without added ones.
    A compact table of frequent units' lengths is broadcast (bounded, see
    ``frequent_units``); other units are encoded through each worker's bounded cache.
    A null text counts as empty: 0 bytes, 0 tokens. Null ids, repeated rows and rows
    with equal ids are counted each for itself; other columns are not read. An empty
    table gives no rows.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, text, "piece", (model_path,)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of("piece", model_path)
        for b in batches:
            n = [sum(v) for v in encoder.values(b.column(2).to_pylist(), frequent.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
