"""Cutting text where a public tokenizer never joins across, and caching what the parts encode to.

A *unit* is a stretch of text whose tokens do not depend on its neighbours, so the
tokens of a text are those of its units in turn. Most units are frequent words:
their encodings come from a small table that the driver broadcasts, the others from
a cache that each Python worker keeps.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each of a worker's two caches: when the newer is full it becomes the older, and the older goes.
CACHE_ENTRIES = 250_000
#: Longer units are encoded each time: they seldom recur.
UNIT_CHARS = 40
#: Text that is cut and looked up at a time.
SLICE_CHARS = 1_000_000
#: The faster library can't bear runs of some hundred thousand blanks; texts with twice as many as this in a row go to the other.
BLANK_RUN = 5_000


class PieceUnits:
    """Units of a sentencepiece model; values are token counts.

    Cuts are made around newlines and before a run of word marks. Both are checked
    against the vocabulary when the model is loaded: no piece may hold a newline next
    to anything else, nor a mark after another character. For a model that fails the
    check, or that changes texts before encoding, the whole text is the unit.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        probe = " a  B ﬁ①\n x　 "
        kept = "".join(self.sp.encode("b" + "".join(c for c in probe if c in " aBx"), out_type=str)) == "▁b▁a▁▁B▁▁x▁"
        self.whole = not kept or any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        self.find = re.compile("\n|▁*[^▁\n]+|▁+").findall
        self.head = len(self.sp.encode("\n"))
        if not self.whole:  # a last check on mixed text
            self.whole = sum(map(self._one, self.cut(probe))) != len(self.sp.encode(probe))

    def _one(self, unit: str) -> int:
        return len(self.sp.encode("\n" + unit)) - self.head

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return [text] if self.whole else self.find("▁" + text.replace(" ", "▁"))

    def encode(self, units: list[str]) -> Iterable[int]:
        if self.whole:
            return [len(x) for x in self.sp.encode(units, num_threads=1)]
        return [len(x) - self.head for x in self.sp.encode(["\n" + u for u in units], num_threads=1)]


class ByteUnits:
    """Units of a byte-level BPE of the tokenizers library; values are ids as little-endian uint32 bytes.

    The pre-tokenizer takes a space with the word that follows it and never joins a
    word to a blank after it, so each unit is a run of blanks with the run of other
    characters that follows. Special strings inside a text get their special id, the
    library's default. Texts with blanks other than space, tab, newline and return
    are encoded whole. Given ``ranks_path``, the same vocabulary in tiktoken's form,
    texts and units of Latin letters and without special strings are encoded by that library.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f\x85]").search
        self.find = re.compile(r"\n(?=[^ \n\t\r])|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
        self.ranked = self._ranked(ranks_path) if ranks_path else None
        self.beyond = re.compile("[^\x00-\u024f]").search
        if self.ranked:  # use it only if it agrees
            probe = self.cut("The thanedble's 12,345 --- ÉÇañ über\n\nx\t y!! Ünß *** don't 'sT a.b")
            if [self.ranked(u) for u in probe] != [x.ids for x in self.tokenizer.encode_batch(probe, add_special_tokens=False)]:
                self.ranked = None

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary in tiktoken's form, several times as fast on short texts."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return [text] if self.odd(text) else self.find(text)

    def _fast(self, text: str) -> bool:
        """Whether the faster library encodes a text alike: no special strings, letters up to Latin ones, no long run of blanks."""
        if "<|" in text or not text.isascii() and self.beyond(text):
            return False
        return not any(text[i : i + BLANK_RUN].isspace() for i in range(0, len(text) - BLANK_RUN, BLANK_RUN))

    def plain(self, text: str) -> bytes | None:
        """The ids of a text that the faster library encodes alike as a whole; None for any other text."""
        if self.ranked and self._fast(text):
            return array("I", self.ranked(text)).tobytes()
        return None

    def encode(self, units: list[str]) -> Iterable[bytes]:
        if self.ranked:
            own = [u for u in units if not self._fast(u)]
            slow = dict(zip(own, self._library(own), strict=True))
            return [slow[u] if u in slow else array("I", self.ranked(u)).tobytes() for u in units]
        return self._library(units)

    def _library(self, units: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


KINDS = {"piece": PieceUnits, "byte": ByteUnits}
_loaded: dict[tuple[str, ...], Encoder] = {}


class Encoder:
    """Values of texts' units: the broadcast table first, then this worker's caches, then the library.

    ``newer`` starts as a copy of the broadcast table and learns other units; when it is full
    it becomes ``older``, from which units that recur move over to its successor.
    """

    def __init__(self, kind: str, *paths: str):
        self.units = KINDS[kind](*paths)
        self.newer: dict = {}
        self.older: dict = {}

    @staticmethod
    def of(kind: str, *paths: str) -> Encoder:
        if (kind, *paths) not in _loaded:
            _loaded[kind, *paths] = Encoder(kind, *paths)
        return _loaded[kind, *paths]

    def _learn(self, missing: set[str]) -> None:
        found = {u: self.older[u] for u in missing if u in self.older}
        fresh = [u for u in missing if u not in found]
        self.newer |= found
        self.newer |= zip(fresh, self.units.encode(fresh), strict=True)

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a batch: of plain texts as a whole, of others unit by unit; null counts as empty."""
        for value in column:
            text = value.as_py() or ""
            ids = self.units.plain(text)
            yield b"".join(next(self.values([text], {}))) if ids is None else ids

    def values(self, texts: list[str | None], frequent: dict) -> Iterator[list]:
        """For each text the values of its units; null counts as empty."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < SLICE_CHARS):
                chars += len(texts[end] or "")
                end += 1
            cut = [self.units.cut(t or "") for t in texts[at:end]]
            if len(self.newer) > CACHE_ENTRIES or not self.newer:
                self.newer, self.older = dict(frequent), self.newer
            missing = set().union(*cut).difference(self.newer)
            self._learn(missing)
            look = self.newer.__getitem__
            for units in cut:
                yield list(map(look, units))
            for u in missing:  # long units seldom recur
                if len(u) > UNIT_CHARS:
                    self.newer.pop(u, None)
            at = end


def frequent_units(docs: DataFrame, text: str, kind: str, paths: tuple[str, ...], entries: int = 65_536, one_in: int = 64) -> dict:
    """The values of frequent units, for broadcasting: at most ``entries`` units of at most UNIT_CHARS characters.

    One Spark job counts the units of one text in ``one_in``, chosen by a hash of the text,
    so from every partition alike, and returns the most frequent. This only warms the
    table: a unit that is not in it is encoded where it occurs, so no result depends on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, found = Encoder.of(kind, *paths).units, Counter()
        give = lambda: pa.RecordBatch.from_pydict({"unit": list(found), "n": list(found.values())})
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(u for u in units.cut(t or "") if len(u) <= UNIT_CHARS)
                if len(found) > CACHE_ENTRIES:
                    yield give()
                    found.clear()
        if found:
            yield give()

    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0)
    total = sample.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    names = [r["unit"] for r in total.where("n > 1").orderBy(F.desc("n"), "unit").limit(entries).collect()]
    return dict(zip(names, KINDS[kind](*paths).encode(names), strict=True))
