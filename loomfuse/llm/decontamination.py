"""Operator 3: documents that hold benchmark items, by SimHash of item-sized windows. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import let, own_names, table, written

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints are cut into so many blocks; items are filed under each block's value and all values up to FLIPS bits away.
#: A window within RADIUS bits of an item then agrees with it, up to FLIPS bits, in some block, so none is missed; of other
#: windows of its length one in 24 meets it.
BLOCKS, FLIPS = 4, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Starts of windows that one row holds: a longer text is cut into overlapping sections.
SECTION = 2048
#: Tables of a benchmark with at most so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """The hash of each run of SHINGLE words, in order; none for fewer words."""
    n = F.size(words) - SHINGLE + 1
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Counters:
    """How often each of 64 bits is set in a window, several counters in a long: ``width`` bits each, ``lanes`` of them."""

    width: int
    lanes: int

    @staticmethod
    def up_to(most: int) -> Counters:
        """Counters that hold ``most`` without running over."""
        width = max(1, most).bit_length()
        return Counters(width, min(8, 63 // width))

    def spread(self, shingles: Column) -> Column:
        """A struct of arrays: for each long its counters of each shingle alone."""
        table = F.array(*[F.lit(sum((b >> i & 1) << i * self.width for i in range(self.lanes))).cast("long") for b in range(1 << self.lanes)])
        part = lambda k: lambda x: F.get(table, F.call_function("shiftrightunsigned", x, F.lit(k)).bitwiseAND(F.lit((1 << self.lanes) - 1)).cast("int"))
        return F.struct(*[F.transform(shingles, part(k)).alias(f"p{k}") for k in range(0, 64, self.lanes)])

    def simhash(self, spread: Column, start: Column, n: Column) -> Column:
        """The SimHash of ``n`` shingles from place ``start`` on, repeats included."""
        add = lambda total, x: total + x
        sums = F.struct(*[F.aggregate(F.slice(spread[f"p{k}"], start + 1, n), F.lit(0).cast("long"), add).alias(f"p{k}") for k in range(0, 64, self.lanes)])

        def bits(held: Column) -> Column:
            total = F.lit(0).cast("long")
            for b in range(64):
                count = F.call_function("shiftrightunsigned", held[f"p{b // self.lanes * self.lanes}"], F.lit(b % self.lanes * self.width)).bitwiseAND(F.lit((1 << self.width) - 1))
                total = total.bitwiseOR(F.when(2 * count > n, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
            return total

        return let(sums, bits)


def _windows(hits: Column, n_words: Column, offset: Column, sizes: list[int], similarity: float) -> Column:
    """All windows (size, start, n) of the given sizes in words, ``n`` shingles each, that can be similar to an item and start in the
    section of the document that begins at the word ``offset``; places count from there.

    ``hits`` are the places, in order, of the document's shingles that occur in some item. Two windows
    of m and n shingles reach the similarity only if they share s/(1+s) (m+n) of them, so a window
    must hold as many places of ``hits``. Its first one, hits[j], gives its starts as a range: after
    hits[j-1], and late enough to reach hits[j + least - 1]. A document shorter than an item is one window.
    """
    rows = []
    for size in sizes:
        m = size - SHINGLE + 1
        short = n_words < size
        n = F.when(short, n_words - SHINGLE + 1).otherwise(F.lit(m))
        least = F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).cast("int")
        rows.append(F.struct(F.lit(size).alias("size"), n.cast("int").alias("n"), F.greatest(least, F.lit(1)).alias("least"), F.least(F.when(short, 0).otherwise(n_words - size) - offset, F.lit(SECTION - 1)).cast("int").alias("last")))

    def starts(w: Column) -> Column:
        def of(j: Column) -> Column:
            low = F.greatest(F.coalesce(F.get(hits, j - 1) + 1, F.lit(0)), F.get(hits, j + w["least"] - 1) - w["n"] + 1, F.lit(0))
            high = F.least(F.get(hits, j), w["last"])
            some = F.transform(F.sequence(low, F.greatest(low, high)), lambda at: F.struct(w["size"].alias("size"), at.alias("start"), w["n"].alias("n")))
            return F.when(low <= high, some).otherwise(F.array().cast("array<struct<size:int,start:int,n:int>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - w["least"]), of))

    usable = F.filter(F.array(*rows), lambda w: (w["n"] > 0) & (w["least"] <= w["n"]) & (w["least"] <= F.size(hits)))
    return F.flatten(F.transform(usable, starts))


def _block(fp: Column, k: Column | int) -> Column:
    width = 64 // BLOCKS
    shift = F.lit(k * width) if isinstance(k, int) else k * width
    return F.call_function("shiftrightunsigned", fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles, a shingle's weight being how often it occurs."""
    times = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    add = lambda n, v: n + v
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: add(n, F.least(times(a, s), times(b, s))))
    return let(both, lambda m: m / F.greatest(F.size(a) + F.size(b) - m, F.lit(1)))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, item_id, start, n_words, similarity): each document with each item that it holds.

    Words are lower-case runs of letters and digits, shingles runs of five words. Windows as long
    as an item, of every length that items have, are laid at every place where enough of their
    shingles occur anywhere in the benchmark; others can't be similar to any item. Windows and
    items are fingerprinted by SimHash; fingerprints of one length within RADIUS bits meet through the
    multi-index blocks, as ids alone; of those pairs the weighted Jaccard similarity of the
    shingles themselves decides. The best window of a pair is given, of equal ones the
    first: ``start`` counts words from 0.

    Null and short texts hold nothing; items of fewer than five words are not looked for;
    null item ids are items like others. A document shorter than an item is compared as a whole.
    Rows that repeat id and text give one result; other columns are not read, so their names
    don't matter; an empty table on either side gives no rows.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("_item")).where(F.size("_item") >= SHINGLE).distinct()
    items = written(items.withColumn("_size", F.size("_item")).withColumn("_name", F.xxhash64("item_id", F.array_join("_item", " "))), "bench-items")
    sizes = sorted(r[0] for r in items.select("_size").distinct().collect())  # lengths of items, few
    counters = Counters.up_to(max(sizes, default=1))
    known = written(items.select(F.explode(_shingles(F.col("_item"))).alias("_hash")).distinct(), "bench-shingles")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), _words(F.col(text)).alias("_words"))
    shared = rows.select("_id", "_key", F.posexplode(_shingles(F.col("_words"))).alias("_at", "_hash")).join(small(known), "_hash")
    hits = written(shared.groupBy("_id", "_key").agg(F.array_sort(F.collect_set("_at")).alias("_hits")), "bench-hits")
    texts = docs.select(F.col(doc_id).alias("_own"), F.xxhash64(text).alias("_own_key"), F.col(text).alias("_text"))
    held = texts.join(hits, (F.col("_own_key") == F.col("_key")) & F.col("_own").eqNullSafe(F.col("_id"))).select("_id", "_key", "_hits", _words(F.col("_text")).alias("_words"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(held.dropDuplicates(["_id", "_key"]).repartition(parts, "_key", "_id"), "bench-held")
    print_of = lambda w: lambda p: F.struct(w["size"].alias("_size"), w["start"].alias("_start"), counters.simhash(p, w["start"], w["n"]).alias("_fp"))
    # a row for each section: it holds the words that windows beginning in it can reach, and their places of hits
    reach = SECTION + max(sizes, default=0)
    section = lambda k: F.struct((k * SECTION).alias("_offset"), F.size("_words").alias("_n"), F.slice("_words", k * SECTION + 1, reach).alias("_part"), F.transform(F.filter("_hits", lambda h: (h >= k * SECTION) & (h < k * SECTION + reach)), lambda h: h - k * SECTION).alias("_near"))
    touched = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(F.floor(F.greatest(h - reach + SECTION, F.lit(0)) / SECTION), F.floor(h / SECTION)))))
    sections = held.select("_id", "_key", F.explode(F.transform(touched, lambda k: section(k.cast("int")))).alias("_s")).select("_id", "_key", "_s.*")
    windows = _windows(F.col("_near"), F.col("_n"), F.col("_offset"), sizes, similarity) if sizes else F.array().cast("array<struct<size:int,start:int,n:int>>")
    printed = let(counters.spread(_shingles(F.col("_part"))), lambda p: F.transform(windows, lambda w: print_of(w)(p)))
    prints = sections.select("_id", "_key", "_offset", F.explode(printed).alias("_w")).select("_id", "_key", "_w._size", (F.col("_w._start") + F.col("_offset")).alias("_start"), "_w._fp")
    prints = written(prints, "bench-prints")
    block = F.array(*[F.lit(k) for k in range(BLOCKS)])
    flips = F.array(*[F.lit(sum(1 << k for k in bits)) for n in range(FLIPS + 1) for bits in combinations(range(64 // BLOCKS), n)])
    whole = let(counters.spread(_shingles(F.col("_item"))), lambda p: counters.simhash(p, F.lit(0), F.col("_size") - SHINGLE + 1))
    filed = items.select("_name", "_size", whole.alias("_item_fp")).withColumn("_block", F.explode(block)).withColumn("_flip", F.explode(flips))
    filed = written(filed.withColumn("_value", _block(F.col("_item_fp"), F.col("_block")).bitwiseXOR(F.col("_flip").cast("long"))).drop("_flip"), "bench-filed")
    asked = prints.withColumn("_block", F.explode(block)).withColumn("_value", _block(F.col("_fp"), F.col("_block")))
    near = asked.join(small(filed), ["_size", "_block", "_value"]).where(F.bit_count(F.col("_fp").bitwiseXOR(F.col("_item_fp"))) <= RADIUS)
    near = near.select("_id", "_key", "_start", "_name").distinct()
    runs = lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    own = held.select(F.col("_id").alias("_own"), F.col("_key").alias("_own_key"), "_words")
    met = near.join(items, "_name").join(own, (F.col("_own_key") == F.col("_key")) & F.col("_own").eqNullSafe(F.col("_id")))
    scored = met.withColumn("_part", F.slice("_words", F.col("_start") + 1, F.col("_size"))).withColumn("_similarity", let(F.struct(runs(F.col("_part")).alias("a"), runs(F.col("_item")).alias("b")), lambda s: _similarity(s["a"], s["b"])))
    best = F.max(F.struct("_similarity", (-F.col("_start")).alias("_back"), "_size")).alias("_best")
    found = scored.where(F.col("_similarity") >= similarity).groupBy("_id", "_key", "item_id").agg(best)
    return found.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_hash"), "item_id", (-F.col("_best._back")).alias("start"), F.col("_best._size").alias("n_words"), F.col("_best._similarity").alias("similarity"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Documents with null or short texts stay, as do those with null ids; rows that repeat id and
    text stay or go together; an empty table or benchmark takes nothing away. Further columns pass; ValueError if
    one of them begins with an underscore.
    """
    own_names(docs)
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = written(found, "bench-found")
    return docs.join(found, (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


QUERIES = {"op3_decontamination": op3_decontamination}
SQL = {
    "op3_decontamination": r"""
WITH dw AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), ds AS (
  SELECT id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p, w FROM dw WHERE len(w) >= 5
), d AS (
  SELECT id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM ds
), isr AS (
  SELECT item_id, len(w) AS size, unnest(range(0, len(w) - 4)) AS o, w FROM iw WHERE len(w) >= 5
), i AS (
  SELECT item_id, size, o, array_to_string(w[o + 1:o + 5], ' ') AS s FROM isr
), win AS (
  SELECT DISTINCT id, item_id, size, start FROM (SELECT d.id, i.item_id, i.size, d.n, unnest(range(greatest(0, d.p - i.size + 5), d.p + 1)) AS start FROM d JOIN i ON d.s = i.s) WHERE start <= greatest(0, n - size)
), wc AS (
  SELECT win.id, win.item_id, win.start, win.size, d.s, count(*) AS c FROM win JOIN d ON d.id = win.id AND d.p >= win.start AND d.p <= win.start + win.size - 5 GROUP BY ALL
), ic AS (
  SELECT item_id, size, s, count(*) AS c FROM i GROUP BY ALL
), both_ AS (
  SELECT wc.id, ic.item_id, wc.start, wc.size, sum(least(wc.c, ic.c)) AS m FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.s = ic.s GROUP BY ALL
), sim AS (
  SELECT b.id AS doc_id, b.item_id, b.start, b.size, b.m::DOUBLE / ((SELECT sum(c) FROM ic WHERE ic.item_id = b.item_id) + t.n - b.m) AS similarity
  FROM both_ b JOIN (SELECT id, item_id, start, sum(c) AS n FROM wc GROUP BY ALL) t ON t.id = b.id AND t.item_id = b.item_id AND t.start = b.start
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS n_words, similarity
FROM sim WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
}
