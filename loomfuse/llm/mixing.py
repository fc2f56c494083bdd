"""Operator 13: mixing sources to target weights, by capped water-filling and seeded repetitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfuse.llm.common import table, written
from loomfuse.operators.keys import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words, and how often a source may be repeated at most.
SHARE, MOST = 1.5, 2
SEED = "mix"


def _draw(seed: str, doc_id: str) -> Column:
    """The seeded place of a document in its source's order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _cap(size: Column, most: int) -> Column:
    return (size * most).cast("double")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target`` (double): words to take from each source.

    All targets together are ``share`` of all sizes. A source gets its weight's part of the
    words, but at most ``most`` times its size: the water level is the words a unit of weight gets,
    sources that it would lift above their cap are clamped there, and what they leave raises the level
    for the others, round by round, until no other source is above. Only sums come to the driver.
    If all sources are clamped, their caps are the targets.
    """
    part = Fraction(share).limit_denominator(10**6)
    total, weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    if not weights:
        return sources.withColumn("target", F.lit(0.0))
    level, before = part.numerator * total / (part.denominator * weights), None
    while level != before:
        above = F.col("weight") * F.lit(level) > _cap(F.col("size"), most)
        clamped, rest = sources.agg(F.sum(F.when(above, F.col("size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if not rest:
            return sources.withColumn("target", _cap(F.col("size"), most))
        level, before = (part.numerator * total - part.denominator * most * clamped) / (part.denominator * rest), level
    return sources.withColumn("target", F.least(_cap(F.col("size"), most), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, part, taken), one for each row of ``docs``.

    ``size`` is a text's words, 0 for a null text. Sources in the order of code points, null
    last, take ``weights`` in turn; ``targets`` tells how many words each gives. Every
    document of a source goes in ``copies`` times as a whole; what the target asks beyond that is taken
    once more from documents in a seeded order, until it is met: ``part`` is the words of that further
    repetition, all of a document, none, or, for the one document where the target is reached, its first
    words. ``taken`` is copies * size + part, so a source's words are its target's whole part.

    The order is the md5 sum of seed and id, then id and size; rows equal in all of them are
    interchangeable, so reruns give the same rows. Nothing but counts of words is shuffled:
    rows are sorted by ranges of (source, order), so a source of any size is spread over many
    tasks, and what lies before a range comes from sums of ranges. Empty texts and sources
    without words take nothing; null ids are documents like others; repeated rows count each; an empty
    table gives no rows; columns other than the three named are not read, so their names don't matter.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = numbered(per_source.withColumn("_place", F.struct(F.col("source").isNull(), F.col("source"))), "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    filled = targets(written(ranked.select("source", "size", weight.alias("weight")), "mix-sources"), share, most)

    placed = sized.withColumn("draw", _draw(seed, "doc_id")).withColumn("row", F.monotonically_increasing_id())
    order = ["draw", "doc_id", "size", "row"]
    ranges = written(placed.repartitionByRange("source", *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    spans = ranges.groupBy("source", "range").agg(F.sum("size").alias("words"))  # a row for each source and range
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    told = filled.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    spans = spans.join(told, F.col("source").eqNullSafe(F.col("of"))).select("source", "range", "before", "source_size", "target", whole.alias("copies"))
    spans = spans.withColumn("more", F.floor("target") - F.col("copies") * F.col("source_size"))
    inside = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
    rows = rows.join(spans.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.range") == F.col("s.range")))
    part = F.greatest(F.lit(0), F.least(F.col("r.size"), F.col("more") - F.col("before") - F.col("inside")))
    rows = rows.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "copies", part.alias("part"))
    return rows.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def materialised(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: ``docs``' rows as often as ``mixed`` takes them, with ``repetition`` from 0; a last, partial one holds
    the first ``part`` words of the text. Ids must be unique; rows with null ids are left out. ValueError if ``docs`` has a
    column ``repetition`` or one that begins with an underscore."""
    if taken := [c for c in docs.columns if c == "repetition" or c.startswith("_")]:
        raise ValueError(f"the names of these columns are the operator's own: {', '.join(taken)}")
    plan = mixed.where("copies > 0 or part > 0").select(F.col("doc_id").alias("_of"), F.col("copies").alias("_copies"), F.col("part").alias("_part"), F.col("size").alias("_words"))
    rows = docs.join(plan, F.col(doc_id) == F.col("_of"))
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - F.when(F.col("_part") > 0, 0).otherwise(1))))
    pieces = F.regexp_extract_all(text, F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")
    cut = (F.col("repetition") == F.col("_copies")) & (F.col("_part") < F.col("_words"))
    return rows.withColumn(text, F.when(cut, first).otherwise(F.col(text))).select(*docs.columns, "repetition")


QUERIES = {"op13_mixing": op13_mixing}
SQL = {
    "op13_mixing": f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS size, ({list(WEIGHTS)})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM sized GROUP BY source
), level AS (
  SELECT 0 AS k, ({Fraction(SHARE).numerator} * sum(size)::BIGINT)::DOUBLE / ({Fraction(SHARE).denominator} * sum(w)::BIGINT) AS v FROM src
  UNION ALL
  SELECT k + 1, next FROM (
    SELECT k, v, ({Fraction(SHARE).numerator} * sum(size)::BIGINT - {Fraction(SHARE).denominator * MOST} * sum(CASE WHEN w * v > ({MOST} * size)::DOUBLE THEN size ELSE 0 END)::BIGINT)::DOUBLE
      / ({Fraction(SHARE).denominator} * nullif(sum(CASE WHEN w * v > ({MOST} * size)::DOUBLE THEN 0 ELSE w END)::BIGINT, 0)) AS next
    FROM level, src GROUP BY k, v) WHERE next <> v
), told AS (
  SELECT source, size AS source_size, least(({MOST} * size)::DOUBLE, w * (SELECT arg_max(v, k) FROM level)) AS target FROM src
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS copies,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN told t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, floor(target)::BIGINT - copies * source_size - before)))::BIGINT AS taken FROM placed"""
}
