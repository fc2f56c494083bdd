"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all documents that its predecessor kept, read again from Parquet;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfuse.llm import decontamination, lines, packing, simhash, toxicity
from loomfuse.llm.common import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: Fitted weights and token ids have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed token sequences of ``documents``, stage after stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
