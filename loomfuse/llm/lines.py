"""Operator 2: removal of repeated multi-line chunks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import let, table, written

#: A chunk ends after a line if the rolling hash of so many lines up to it leaves no remainder by DIVISOR.
WINDOW, DIVISOR, BASE = 2, 3, 31
#: A line of so many characters is a chunk of its own, so that it is found wherever it stands.
LONG_LINE = 60
#: A chunk alone is looked for if it has so many lines, or so many characters; chunks side by side always are.
LEAST_LINES, LEAST_CHARS = 2, 150
#: Words of 64 bits, as a power of two, of the set that tells which documents may lose lines.
SLOT_BITS = 18


def _chunks(text: Column) -> Column:
    """A text's content-defined chunks: an array of (lines, text), null for a null text.

    ``let`` binds each array once: a column named inside a lambda could be computed
    again for every element.
    """

    def rolling(hashes: Column, i: Column) -> Column:
        total = F.get(hashes, i)
        for back in range(1, WINDOW):
            total = total + F.coalesce(F.get(hashes, i - back), F.lit(0)) * BASE**back
        return total

    def cut(lines: Column) -> Column:
        last = F.size(lines) - 1
        long = lambda i: F.coalesce(F.length(F.get(lines, i)) >= LONG_LINE, F.lit(False))
        ends = lambda hashes: F.filter(F.sequence(F.lit(0), last), lambda i: long(i) | long(i + 1) | (rolling(hashes, i) % DIVISOR == 0) | (i == last))
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
        return let(let(hashes, ends), lambda e: F.transform(e, lambda end, i: chunk(lines, F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1) + 1), end)))

    def chunk(lines: Column, start: Column, end: Column) -> Column:
        n = end - start + 1
        return F.struct(n.alias("lines"), F.array_join(F.slice(lines, start + 1, n), "\n").alias("text"))

    return let(F.split(text, "\n", -1), cut)


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _key (a hash of the text) and _chunks; _chunks is null for a null text."""
    return docs.withColumn("_key", F.xxhash64(text)).withColumn("_chunks", F.when(F.col(text).isNotNull(), _chunks(F.col(text))))


def _units(chunks: Column) -> Column:
    """What is looked for in other places: (at, pair, a, b), hashes of chunks alone (pair 0, b 0) and of two side by side (pair 1)."""

    def told(c: Column) -> Column:
        fine = c["text"].rlike("[^ \\t\\r\\n]")
        alone = fine & ((c["lines"] >= LEAST_LINES) | (F.length(c["text"]) >= LEAST_CHARS))
        return F.struct(F.xxhash64(c["text"]).alias("h"), fine.alias("fine"), alone.alias("alone"))

    def both(t: Column, i: Column, every: Column) -> Column:
        next_ = F.get(every, i + 1)
        unit = lambda ok, pair, b: F.struct(ok.alias("ok"), i.alias("at"), F.lit(pair).alias("pair"), t["h"].alias("a"), b.alias("b"))
        beside = F.coalesce(t["fine"] & next_["fine"], F.lit(False))
        return F.array(unit(t["alone"], 0, F.lit(0).cast("long")), unit(beside, 1, F.coalesce(next_["h"], F.lit(0).cast("long"))))

    every = let(F.transform(chunks, told), lambda ts: F.flatten(F.transform(ts, lambda t, i: both(t, i, ts))))
    return F.filter(every, lambda u: u["ok"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and (n_chunks, n_removed) beside its columns.

    Texts are cut into lines and lines into chunks: where the rolling hash of the last WINDOW
    line hashes says so, and around each line of LONG_LINE characters, so that equal passages are cut
    alike wherever they stand. Repeated passages are chunks of several lines, or of LEAST_CHARS characters,
    and any two chunks side by side, that stand elsewhere too with equal bytes, blank chunks aside.
    Of equal passages the first stays (by id, nulls first, then text hash, then place), all
    others go; so of a chunk that goes an equal one always stands before it. Only hashes are
    compared across documents at first; the texts of repeated chunks are then compared byte by
    byte, and chunks whose hash stands for several texts stay. Only texts that hold repeated chunks are shuffled, and a few more.

    A null text stays null with no chunks; an empty text is one blank chunk. Rows that
    repeat both id and text are one document: they keep or lose the same chunks. Texts
    that lose all lines become empty. Other columns pass; ValueError if one of them is named
    n_chunks or n_removed, or begins with an underscore.
    """
    if taken := [c for c in docs.columns if c in ("n_chunks", "n_removed") or c.startswith("_")]:
        raise ValueError(f"the names of these columns are the operator's own: {', '.join(taken)}")
    chunked = with_chunks(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text")
    each = chunked.select("_id", "_key", F.explode(_units(F.col("_chunks"))).alias("_u")).select("_id", "_key", F.col("_u.at").alias("_at"), F.col("_u.pair").alias("_pair"), F.col("_u.a").alias("_a"), F.col("_u.b").alias("_b"))
    hashed = written(each, "line-chunks")
    place = F.struct("_id", "_key", "_at")
    repeated = written(hashed.groupBy("_pair", "_a", "_b").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").drop("_n"), "line-repeated")
    later = ~place.eqNullSafe(F.col("_first"))
    entry = lambda at, h: F.struct(at.cast("int").alias("_at"), h.alias("_hash"), later.alias("_later"))
    entries = F.when(F.col("_pair") == 1, F.array(entry(F.col("_at"), F.col("_a")), entry(F.col("_at") + 1, F.col("_b")))).otherwise(F.array(entry(F.col("_at"), F.col("_a"))))
    found = hashed.join(repeated, ["_pair", "_a", "_b"]).select("_id", "_key", F.explode(entries).alias("_e"))
    found = written(found.groupBy("_id", "_key").agg(F.collect_set("_e").alias("_found")), "line-found")
    found = found.select(F.col("_id").alias("_found_id"), F.col("_key").alias("_found_key"), "_found")
    rows = docs.withColumn("_id", F.col(doc_id)).withColumn("_key", F.xxhash64(text))
    # a set of bits of bounded size tells documents that can't lose lines: their texts are never shuffled. The others meet what was
    # found by the same join at every size: found is a fraction of the documents, so it is never broadcast
    slot = lambda i, k: F.pmod(F.shiftright(F.xxhash64(i, k), 6), F.lit(1 << SLOT_BITS))
    bit = lambda i, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(i, k), F.lit(64)).cast("int"))
    slots = written(found.groupBy(slot("_found_id", "_found_key").alias("_slot")).agg(F.bit_or(bit("_found_id", "_found_key")).alias("_set")), "line-slots")
    told = rows.join(F.broadcast(slots), slot("_id", "_key") == F.col("_slot"), "left")
    maybe = F.coalesce(F.col("_set").bitwiseAND(bit("_id", "_key")) != 0, F.lit(False))
    columns = [*docs.columns, "_id", "_key"]
    marked = told.where(maybe).select(columns).join(found.hint("merge"), (F.col("_key") == F.col("_found_key")) & F.col("_id").eqNullSafe(F.col("_found_id")), "left")
    marked = written(marked.select(*columns, "_found"), "line-marked")
    whole = told.where(~maybe).select(*columns, F.lit(None).cast(marked.schema["_found"].dataType).alias("_found"))
    chunked = with_chunks(marked, text)
    texts = chunked.where("_found is not null").select("_chunks", F.explode("_found").alias("_f")).select(F.col("_f._hash").alias("_hash"), F.get("_chunks", F.col("_f._at"))["text"].alias("_text")).distinct()
    clashing = [r[0] for r in texts.groupBy("_hash").count().where("count > 1").collect()]  # none, unless 64-bit hashes collide
    later = F.filter("_found", lambda f: f["_later"] & ~f["_hash"].isin(clashing) if clashing else f["_later"])
    gone = F.coalesce(F.array_distinct(F.transform(later, lambda f: f["_at"])), F.array().cast("array<int>"))
    n = F.coalesce(F.size("_chunks"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    shorter = let(F.col("_chunks"), lambda c: F.array_join(F.transform(kept, lambda i: F.get(c, i)["text"]), "\n"))
    return chunked.unionByName(with_chunks(whole, text)).withColumn("_gone", gone).select(
        *[F.when(F.col(text).isNull() | (F.size("_gone") == 0), F.col(text)).otherwise(shorter).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_chunks"),
        F.size("_gone").cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks; where lines went, ``n_chars`` is counted anew.

    Null and empty texts, null ids, repeated rows and empty tables are as in ``dedup_lines``.
    """
    shorter = dedup_lines(docs)
    return shorter.select(*[F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": f"""
WITH line AS (
  SELECT doc_id, i, ls[i] AS l, len(ls) AS n, ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), cut AS (
  SELECT *, CASE WHEN length(l) >= {LONG_LINE} OR coalesce(length(lead(l) OVER w), 0) >= {LONG_LINE} OR (h + {BASE} * coalesce(lag(h) OVER w, 0)) % {DIVISOR} = 0 THEN 1 ELSE 0 END AS ends FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM cut
), chunk AS (
  SELECT doc_id, c, count(*) AS lines, string_agg(l, chr(10) ORDER BY i) AS t FROM numbered GROUP BY doc_id, c
), told AS (
  SELECT *, regexp_matches(t, '[^ \t\r\n]') AS fine, lead(t) OVER (PARTITION BY doc_id ORDER BY c) AS t2 FROM chunk
), gone AS (
  SELECT doc_id, c FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY t ORDER BY doc_id, c) AS k FROM told WHERE fine AND (lines >= {LEAST_LINES} OR length(t) >= {LEAST_CHARS})) WHERE k > 1
  UNION
  SELECT doc_id, unnest([c, c + 1]) FROM (SELECT doc_id, c, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, c) AS k FROM told WHERE fine AND regexp_matches(t2, '[^ \t\r\n]')) WHERE k > 1
)
SELECT told.doc_id, coalesce(string_agg(t, chr(10) ORDER BY told.c) FILTER (WHERE gone.c IS NULL), '') AS text, count(*) AS n_chunks, count(gone.c) AS n_removed
FROM told LEFT JOIN gone ON gone.doc_id = told.doc_id AND gone.c = told.c GROUP BY told.doc_id"""
}
