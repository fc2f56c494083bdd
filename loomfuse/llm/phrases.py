"""Operator 11: phrase collocation mining after Toivonen: a sample proposes, full passes count exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfuse.llm.common import table, written

#: Phrases of two and three words that occur so often are candidates.
LEAST = 10
#: One document in so many is the sample, chosen by a hash; words and pairs that occur so often in it are proposed.
ONE_IN, PROPOSED = 8, 2
#: A phrase goes if a longer one that holds it has so many hundredths of its occurrences.
COVERED = 50
TOP = 2000
UNKNOWN = "und"
#: Bits of a filter, as a power of two: at most 8 MB each, whatever the input.
FILTER_BITS = 26
#: Bytes of text cut at a time, and different pairs, triples or words that a task holds before it gives its counts on.
SLICE, HELD, VOCABULARY = 1_500_000, 400_000, 150_000
#: Bits of a word's number within a task; three fit a 64-bit key.
ID_BITS = 21
#: Parts that a language is ranked in before they meet.
PARTS = 64
COUNTS = "lang string, words int, phrase string, n long"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


# A phrase's place in a filter comes from the CRC sums of "language, zero byte, word"; Spark and numpy compute the same.
PAIR = (7919, 104_729)


def _word_place(word: Column) -> Column:
    return F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), word.cast("binary")))


def _place(bits: int) -> Column:
    """The place of a row's phrase, a word or a pair."""
    words = F.split("phrase", " ")
    pair = _word_place(F.get(words, F.lit(0))) * PAIR[0] + _word_place(F.get(words, F.lit(1))) * PAIR[1]
    at = F.when(F.col("words") == 1, _word_place(F.col("phrase"))).otherwise(pair)
    return F.pmod(at.bitwiseXOR(F.shiftright(at, bits)), F.lit(1 << bits))


def _passes(packed: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    at = (at ^ (at >> np.int64(bits))) & np.int64((1 << bits) - 1)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter(phrases: DataFrame, words: int, bits: int) -> np.ndarray:
    """A set of phrases as bits, of fixed size: one that was put in always passes, others rarely. What comes to the driver is at most the bits."""
    at = phrases.where(F.col("words") == words).select(_place(bits).alias("at"))
    slots = at.groupBy(F.shiftright("at", 5).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set")).toArrow()
    packed = np.zeros(1 << (bits - 5), "<u4")
    packed[slots["slot"].to_numpy()] = slots["set"].to_numpy().astype("<u4")
    return packed.view(np.uint8)


class Counter:
    """Counts of one language's phrases in one task.

    Text is cut into words, words are numbered, and numbers of neighbours make keys that are
    sorted and counted as arrays. A pair counts if both its words pass the filter of words, a triple if both its
    pairs pass that of pairs, and neither if it did with the filters of earlier passes.
    """

    def __init__(self, lang: str, filters: list[tuple[np.ndarray, np.ndarray]], bits: int, count_words: bool):
        self.lang, self.filters, self.bits, self.count_words = lang, filters, bits, count_words
        self.prefix = lang.encode() + b"\0"
        self.fresh()

    def fresh(self) -> None:
        self.ids: dict[bytes, int] = {b"\n": 0, b"": 1}
        self.words: list[bytes] = [b"\n", b""]
        self.place = np.zeros(2, np.int64)
        self.ok = [np.zeros(2, bool) for _ in self.filters]
        self.seen = np.zeros(2, np.int64)
        self.held = {2: (np.empty(0, np.int64), np.empty(0, np.int64)), 3: (np.empty(0, np.int64), np.empty(0, np.int64))}
        self.last = np.zeros(2, np.int64)

    def _number(self, tokens: list[bytes]) -> np.ndarray:
        ids = self.ids
        new = [t for t in dict.fromkeys(tokens) if t not in ids]
        if new:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            self.words += new
            place = np.fromiter((zlib.crc32(self.prefix + t) for t in new), np.int64, len(new))
            self.place = np.concatenate([self.place, place])
            self.ok = [np.concatenate([ok, _passes(f[0], place, self.bits)]) for ok, f in zip(self.ok, self.filters, strict=True)]
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        found = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        return found[found != 1]

    def add(self, text: bytes) -> None:
        """Counts a text or more, pieces parted by line ends; what stands before may run on into it."""
        found = self._number(text.translate(_FOLD).replace(b"\n", b" \n ").split(b" "))
        self.seen += np.bincount(found, minlength=len(self.seen))
        row = np.concatenate([self.last, found])
        if len(row) < 3:
            self.last = row[-2:]
            return
        inside = row != 0
        beside = inside[1:] & inside[:-1]
        place = self.place[row]
        pair_place = place[:-1] * PAIR[0] + place[1:] * PAIR[1]
        two, three = np.zeros(len(row) - 1, bool), np.zeros(len(row) - 2, bool)
        for turn, (f, ok) in enumerate(zip(self.filters, self.ok, strict=True)):
            known = ok[row]
            pair = beside & known[1:] & known[:-1]
            passed = beside & _passes(f[1], pair_place, self.bits)
            triple = passed[1:] & passed[:-1]
            two, three = (pair, triple) if turn == 0 else (two & ~pair, three & ~triple)
        two[0] = False  # ends in what was counted before
        i, j = np.flatnonzero(two), np.flatnonzero(three)
        self._hold(2, row[i] << ID_BITS | row[i + 1])
        self._hold(3, row[j] << 2 * ID_BITS | row[j + 1] << ID_BITS | row[j + 2])
        self.last = row[-2:]

    def _hold(self, words: int, keys: np.ndarray) -> None:
        new, n = np.unique(keys, return_counts=True)
        old, m = self.held[words]
        every, at = np.unique(np.concatenate([old, new]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at[: len(old)], m)
        np.add.at(total, at[len(old) :], n)
        self.held[words] = every, total

    def full(self) -> bool:
        return len(self.words) > VOCABULARY or len(self.held[2][0]) + len(self.held[3][0]) > HELD

    def given(self) -> Iterator[pa.RecordBatch]:
        """All counts so far; forgets them."""
        words = pa.array(self.words, pa.binary())
        batch = lambda k, phrase, n: pa.RecordBatch.from_arrays([pa.array([self.lang] * len(n)), pa.array(np.full(len(n), k, np.int32)), phrase.cast(pa.string()), pa.array(n)], ["lang", "words", "phrase", "n"])
        if self.count_words:
            self.seen[:2] = 0
            yield batch(0, pa.array([b""]), self.seen.sum(keepdims=True))
            found = np.flatnonzero(self.seen)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield batch(1, words.take(pa.array(part)), self.seen[part])
        mask = (1 << ID_BITS) - 1
        for k, (keys, n) in self.held.items():
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                each = [words.take(pa.array((part >> ID_BITS * x) & mask)) for x in reversed(range(k))]
                yield batch(k, pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.binary())), n[i : i + 50_000])
        self.fresh()


def _counted(rows: DataFrame, filters: list[tuple], bits: int, count_words: bool, least: int) -> DataFrame:
    """COUNTS of ``rows`` (lang, text), written: of words, and of all words of a language as its phrase of none, if asked for, and of
    the pairs and triples that pass; those of less than ``least`` are left out.

    ``filters`` are those of this pass and of the one before, if any. Each task adds up what it reads, in bounded memory.
    """
    shared = rows.sparkSession.sparkContext.broadcast([[zlib.compress(f.tobytes(), 1) for f in pair] for pair in filters])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        opened = [tuple(np.frombuffer(zlib.decompress(f), np.uint8) for f in pair) for pair in shared.value]
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            waiting: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                if text:
                    waiting.setdefault(lang, []).append(text)
            for lang, some in waiting.items():
                counter = counters.get(lang)
                if counter is None:
                    counter = counters[lang] = Counter(lang, opened, bits, count_words)
                joined, at = b"\n".join([b"", *some, b""]), 0
                while at < len(joined):
                    end = at + SLICE
                    if end < len(joined):  # at a blank, so that no word is cut
                        end = joined.rfind(b" ", at, end) + 1 or joined.find(b" ", end) + 1 or len(joined)
                    counter.add(joined[at:end])
                    at = end
                    if counter.full():
                        last = [counter.words[i] for i in counter.last]
                        yield from counter.given()
                        counter.last = counter._number(last)
                if sum(len(c.words) for c in counters.values()) > 2 * VOCABULARY or sum(len(c.held[2][0]) + len(c.held[3][0]) for c in counters.values()) > 2 * HELD:
                    for c in counters.values():  # each stands at the end of a text
                        yield from c.given()
                    counters = {}
        for c in counters.values():
            yield from c.given()

    counts = rows.mapInArrow(count, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    done = written(counts.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")
    shared.destroy()
    return done


def frequent(docs: DataFrame, least: int = LEAST, one_in: int = ONE_IN, proposed: int = PROPOSED, bits: int = FILTER_BITS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """Rows (lang, words, phrase, n): all words, pairs and triples that occur ``least`` times, and each language's number of words (as its phrase of 0 words); and the passes made.

    The sample proposes words and pairs. A full pass counts every word, every pair of proposed words
    and every triple of proposed pairs: so all that was proposed, and its negative border, the phrases just beyond whose parts
    were all proposed. Words and pairs that turn out frequent without having been proposed are failures
    of the border; with them proposed too, a further pass counts only what now passes and did not before. It
    ends when no new one fails, after a few passes at most, as each counts longer phrases. So the
    sample affects the work, never the result. Proposals are sent as filters of fixed size; what passes by accident is counted
    like the rest, and drops out if it isn't frequent.
    """
    rows = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), text)
    every = np.full(1 << (bits - 3), 255, np.uint8)
    none = np.zeros(1 << (bits - 3), np.uint8)
    sample = docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(one_in)) == 0).select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), text)
    sampled = _counted(sample, [(every, none)], bits, True, proposed)
    have = _filter(sampled, 1, bits), _filter(sampled, 2, bits)
    filters, parts = [have], []
    while True:
        parts.append(_counted(rows, filters, bits, not parts, least))
        grown = have[0] | _filter(parts[-1], 1, bits), have[1] | _filter(parts[-1], 2, bits)
        if all(map(np.array_equal, have, grown)):
            break
        filters, have = [grown, have], grown
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found, len(parts)


def _scored(found: DataFrame) -> DataFrame:
    """Candidates (lang, words, phrase, a, l, r, score) by their lowest-scoring cut; decimals hold all products exactly."""
    each = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(each, 1, k), " ").alias("first"), F.array_join(F.slice(each, k + 1, 3), " ").alias("rest"))
    cuts = F.when(F.col("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    rows = found.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "words", "phrase", "a", "cut.*")
    part = lambda name, n: found.where("words in (1, 2)").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    rows = rows.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = rows.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("least"))
    return lowest.select("lang", "words", "phrase", "a", "least.l", "least.r", "least.score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``: each part of a language is ranked for itself before the parts' first rows meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", rank("part")).where(F.col("rank") <= top)
    return parts.withColumn("rank", rank().cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, **options) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    A-Z become small letters; pieces end at .,;:!? and line breaks (\\n to \\r), words at blanks and tabs; a phrase lies
    inside a piece. Phrases that occur ``least`` times (a) are scored by floor(1000000 a a / (l r)), l and r being the
    occurrences of its two parts, at the cut where that is lowest; those inside a longer one with ``covered`` hundredths of
    their occurrences go. Order: score and a falling, phrase by its UTF-8 bytes. ``options`` are those of
    ``frequent``.

    A null language counts as "und", like that name itself; null, empty and blank texts hold no words;
    repeated rows count each; words may be of any length and hold any character but those above; an empty table gives no
    rows; other columns are not read, so their names don't matter. Counts up to 10 to the 15th are exact.
    """
    found, _ = frequent(docs, least, **options)
    scored = _scored(found)
    each = F.split("phrase", " ")
    inside = F.explode(F.array(*[F.array_join(F.slice(each, i, 2), " ") for i in (1, 2)]))
    longer = found.where("words = 3").select("lang", inside.alias("phrase"), F.col("n")).groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    stays = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("a") * covered, F.lit(True)))
    total = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))  # a row for each language
    return _first(stays, top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_phrases": op11_phrases}
SQL = {
    "op11_phrases": rf"""
WITH piece AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece
), gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) + 2 - k), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) AS v(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM gram GROUP BY ALL
), cut AS (
  SELECT c.lang, c.k, c.phrase, c.n AS a, v.c1, array_to_string(string_split(c.phrase, ' ')[:v.c1], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[v.c1 + 1:], ' ') AS rest
  FROM f c JOIN (VALUES (1), (2)) AS v(c1) ON v.c1 < c.k WHERE c.n >= {LEAST}
), scored AS (
  SELECT c.lang, c.k, c.phrase, a, min({{'score': ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT, 'c1': c.c1, 'l': l.n, 'r': r.n}}) AS s
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest GROUP BY c.lang, c.k, c.phrase, a
), longer AS (
  SELECT lang, phrase, max(n) AS n FROM (SELECT lang, n, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3 AND n >= {LEAST}) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.s.score DESC, a DESC, s.phrase) AS rank FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.n IS NULL OR 100 * g.n < {COVERED} * a
)
SELECT x.lang, rank, phrase, a, x.s.l AS l, x.s.r AS r, t.n::BIGINT AS n, x.s.score AS score
FROM ranked x JOIN (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = x.lang WHERE rank <= {TOP}"""
}
