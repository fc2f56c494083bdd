"""Operator 6: packing token sequences with a bounded number of open windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.llm.common import table, written
from loomfuse.llm.units import Encoder

MODEL, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SIZE = 1024
OPEN_WINDOWS = 32
#: A gap of fewer tokens is left as padding rather than filled with a cut.
LEAST_CUT = 16
#: Leftover windows that one task merges.
MERGE_WINDOWS = 512
COLUMNS = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "leftover"]


class Window:
    """An open sequence: its pieces (doc_id, start, ids, doc_tokens) and its length in tokens."""

    __slots__ = ("length", "pieces")

    def __init__(self):
        self.length, self.pieces = 0, []

    def add(self, doc_id, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc_id, start, ids, total))
        self.length += len(ids) // 4


class Packer:
    """Bounded-space online packing of one task's pieces.

    At most ``open_windows`` windows are open. A piece goes to the window that it fills
    best; where none has room, the fullest takes as much of the piece as it has room
    for, unless that is under LEAST_CUT tokens, and is emitted. ``end`` merges what is
    still open into full windows and at most one leftover.
    """

    def __init__(self, size: int, open_windows: int, first_id: int, with_ids: bool = True):
        self.size, self.most, self.next_id, self.with_ids = size, open_windows, first_id, with_ids
        self.open: list[Window] = []
        self.rows: list[tuple] = []

    def emit(self, window: Window, leftover: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in window.pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids if self.with_ids or leftover else None, zlib.crc32(ids), total, self.next_id, at, leftover))
            at += len(ids) // 4
        self.next_id += 1

    def document(self, doc_id, ids: bytes) -> None:
        """All of a document: full windows of its own, then what remains."""
        total, step = len(ids) // 4, 4 * self.size
        full = len(ids) // step * step
        for at in range(0, full, step):
            alone = Window()
            alone.add(doc_id, at // 4, ids[at : at + step], total)
            self.emit(alone)
        if full < len(ids):
            self.piece(doc_id, full // 4, ids[full:], total)

    def piece(self, doc_id, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        best = max((w for w in self.open if w.length + n <= self.size), key=lambda w: w.length, default=None)
        if best is None and len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w.length)
            self.open.remove(fullest)
            if (room := self.size - fullest.length) >= LEAST_CUT:
                fullest.add(doc_id, start, ids[: 4 * room], total)
                start, ids = start + room, ids[4 * room :]
            self.emit(fullest)
        if best is None:
            self.open.append(best := Window())
        best.add(doc_id, start, ids, total)
        if best.length == self.size:
            self.open.remove(best)
            self.emit(best)

    def end(self) -> None:
        rest = sorted(self.open, key=lambda w: -w.length)
        self.open = []
        merged = Window()
        for window in rest:
            for doc_id, start, ids, total in window.pieces:
                while ids:
                    room = 4 * (self.size - merged.length)
                    merged.add(doc_id, start, ids[:room], total)
                    start, ids = start + len(ids[:room]) // 4, ids[room:]
                    if merged.length == self.size:
                        self.emit(merged)
                        merged = Window()
        if merged.pieces:
            self.emit(merged, leftover=True)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], COLUMNS)


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = SIZE, open_windows: int = OPEN_WINDOWS, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most ``size`` tokens.

    ``ids`` are little-endian unsigned 32-bit token ids, ``ids_crc32`` their CRC sum; without
    ``with_ids`` the ids are left out and only the sums kept. A document is its ids by the
    byte-level BPE at ``tokenizer_path``, then ``end_id``; a null text is empty, so its
    document is that one id. ``ranks_path`` may name the same vocabulary in tiktoken's
    form, which only makes it faster. Each partition packs its own rows; the one window that it
    leaves unfilled joins those of other partitions in a second, small pass. The first
    pass is written to the shared folder, so a lost executor can't change what the
    second one sees. Repeated rows are documents of their own, null ids are ids like others;
    an empty table gives no pieces; columns other than the two named are not read, so their
    names don't matter.
    """
    paths = (tokenizer_path, ranks_path) if ranks_path else (tokenizer_path,)
    field = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {field}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean"
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of("byte", *paths), Packer(size, open_windows, TaskContext.get().partitionId() << 32, with_ids)
        kind = pa.int64()
        for b in batches:
            names, kind = b.column(0).to_pylist(), b.column(0).type
            for name, ids in zip(names, encoder.texts(b.column(1)), strict=True):
                packer.document(name, ids + end)
                if len(packer.rows) >= 2000:
                    yield _batch(packer.rows, kind)
                    packer.rows = []
        packer.end()
        if packer.rows:
            yield _batch(packer.rows, kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, open_windows, 1 << 60 | TaskContext.get().partitionId() << 32, with_ids)
        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            for name, start, ids, total in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                packer.piece(name, start, ids, total)
        packer.end()
        if packer.rows:
            yield _batch(packer.rows, kind)

    packed = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, schema), "packed")
    left = packed.where("leftover")
    tasks = -(-left.select("sequence_id").distinct().count() // MERGE_WINDOWS)
    done = packed.where(~F.col("leftover"))
    if tasks:
        again = left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "ids", "doc_tokens")
        done = done.unionByName(again.mapInArrow(merge, schema))
    return done.drop("leftover") if with_ids else done.drop("leftover", "ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path(MODEL), public_tokenizers.path(RANKS), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences, with the ids themselves; null texts are empty documents, and so on as in ``pack``."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(MODEL), public_tokenizers.path(RANKS))


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
