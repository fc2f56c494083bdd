"""Workbooks and delimited files as grids of cells.

Files are read by Spark (``binaryFile``, ``text``), so any path that Spark can read will do;
each workbook is taken apart inside one task, its cells as they come.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomfuse.functions import text
from loomfuse.operators import headers
from loomfuse.operators.keys import numbered
from loomfuse.operators.scratch import kept

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates and times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SCHEMA = "file string, sheet string, kind string, r int, c int, r2 int, c2 int, v string, vtype string"
BATCH = 20_000


def column_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def place(reference: str) -> tuple[int, int]:
    """Row and column of a reference such as B12."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference.replace("$", "")).groups()
    return int(digits), column_number(letters)


def _number(v: str) -> str:
    """A number's canonical text: whole ones without fraction."""
    x = float(v)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def numbered_rows(data: ET.Element) -> Iterator[tuple[int, ET.Element]]:
    """Rows with their numbers; one without a number stands below the row before it."""
    at = 0
    for row in data.iter(f"{MAIN}row"):
        at = int(row.get("r") or at + 1)
        yield at, row


def placed_cells(row: ET.Element) -> Iterator[tuple[int, ET.Element]]:
    """Cells of a row with their columns; one without a reference stands right of the cell before it."""
    at = 0
    for cell in row.iter(f"{MAIN}c"):
        at = place(cell.get("r"))[1] if cell.get("r") else at + 1
        yield at, cell


def sheet_paths(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """The sheets' names and their parts, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        to = targets[s.get(RELATION)]
        found.append((s.get("name"), to.lstrip("/") if to.startswith("/") else f"xl/{to}"))
    return found


#: What a file that is no sound workbook may raise.
BROKEN = (zipfile.BadZipFile, KeyError, ValueError, IndexError, AttributeError, ET.ParseError)


class Book:
    """An open workbook: what all sheets share is read once, a sheet only when it is asked for."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        self.sheets = sheet_paths(self.zip)
        names = set(self.zip.namelist())
        self.strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as xml:
                for _, e in ET.iterparse(xml):
                    if e.tag == f"{MAIN}si":
                        self.strings.append("".join(t.text or "" for t in e.iter(f"{MAIN}t")))
                        e.clear()
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
            if (formats := styles.find(f"{MAIN}cellXfs")) is not None:
                self.dates = [int(x.get("numFmtId", 0)) in DATE_FORMATS | own for x in formats]
        settings = ET.fromstring(self.zip.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        self.start = datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else datetime(1899, 12, 30)

    def _cell(self, cell: ET.Element) -> tuple[str, str] | None:
        """A cell's text and type; None for one without a value."""
        kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if value is None:
            return None
        if kind == "s":
            return self.strings[int(value)], "str"
        if kind == "b":
            return str(value == "1"), "bool"
        if kind == "n" and (k := int(cell.get("s", 0))) < len(self.dates) and self.dates[k]:
            moment = self.start + timedelta(days=float(value))
            moment = (moment + timedelta(milliseconds=500)).replace(microsecond=0)
            return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S"), "date"
        return (_number(value), kind) if kind == "n" else (value, "str" if kind == "inlineStr" else kind)

    def rows(self, sheet: str, part: str) -> Iterator[tuple]:
        """Rows (sheet, kind, r, c, r2, c2, v, vtype) of one sheet: its cells with a value and its merged regions."""
        r = 0
        with self.zip.open(part) as xml:
            for _, e in ET.iterparse(xml):
                if e.tag == f"{MAIN}mergeCell":
                    a, b = (e.get("ref").split(":") * 2)[:2]
                    yield sheet, "merge", *place(a), *place(b), None, None
                elif e.tag == f"{MAIN}row":
                    r = int(e.get("r") or r + 1)
                    for c, cell in placed_cells(e):
                        if (said := self._cell(cell)) is not None:
                            yield sheet, "cell", r, c, r, c, *said
                    e.clear()


def workbook(content: bytes) -> Iterator[tuple]:
    """Rows (sheet, kind, r, c, r2, c2, v, vtype) of a workbook: its cells with a value and its merged regions."""
    book = Book(io.BytesIO(content))
    for sheet, part in book.sheets:
        yield from book.rows(sheet, part)


def batches_of(path: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a workbook as batches of SCHEMA; what is wrong with the file as a last row of kind error."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    types = [pa.int32() if n in ("r", "c", "r2", "c2") else pa.string() for n in names]
    pack = lambda some: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), types, strict=True)], names)
    held: list[tuple] = []
    try:
        for row in rows:
            held.append((path, *row))
            if len(held) == BATCH:
                yield pack(held)
                held = []
    except BROKEN as e:
        held.append((path, None, "error", None, None, None, None, str(e), None))
    if held:
        yield pack(held)


def read_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells and merged regions of all sheets of .xlsx files; a file that is no workbook gives one row of kind error."""
    if bad := [p for p in paths if p.lower().endswith(".xls")]:
        raise ValueError(f"the old .xls format can't be read; save as .xlsx: {', '.join(bad)}")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from batches_of(path, workbook(content))

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(take, SCHEMA)


def ends_inside(line: str, inside: bool, divider: str = ",") -> bool:
    """Whether a quoted field is open at the end of a line, given whether one was at its start. A quote opens only at a field's
    start; a doubled one doesn't close."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(divider, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:  # to the quote that closes
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        inside, at = False, line.find(divider, at + 1) + 1
        if not at or at > n:
            return False


def _records(spark: SparkSession, path: str, divider: str) -> DataFrame:
    """A file's records, which quoted fields may carry over many lines, as (_at, value), ``_at`` rising in the order of the file.

    Each task goes through its stretch of the file twice at once, as if a quoted field were open at its start and as if not; how a stretch
    ends for either start is all that the next ones need, so stretches are read side by side. Lines of one record then meet
    by its first line; records of one line, nearly all, don't move.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [False, True]
        for b in batches:
            begins: tuple[list, list] = ([], [])
            ends: tuple[list, list] = ([], [])
            for line in b.column(1).to_pylist():
                for way in (0, 1):
                    begins[way].append(state[way])
                    if '"' in line:
                        state[way] = ends_inside(line, state[way], divider)
                    ends[way].append(state[way])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.bool_()) for x in (*begins, *ends))], ["_at", "value", "in0", "in1", "out0", "out1"])

    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), "value")
    lines = kept(lines.mapInArrow(mark, "_at long, value string, in0 boolean, in1 boolean, out0 boolean, out1 boolean"), "csv-lines").withColumn("_part", F.shiftright("_at", 33))
    parts = lines.groupBy("_part").agg(F.max_by("out0", "_at").alias("out0"), F.max_by("out1", "_at").alias("out1"), F.max(F.when(~F.col("in0"), F.col("_at"))).alias("l0"), F.max(F.when(~F.col("in1"), F.col("_at"))).alias("l1"))
    inside, last, entering = False, None, []
    for r in parts.orderBy("_part").collect():  # a row for each stretch of the file
        entering.append((r["_part"], inside, last))
        last = (r["l1"] if inside else r["l0"]) if (r["l1"] if inside else r["l0"]) is not None else last
        inside = r["out1"] if inside else r["out0"]
    told = spark.createDataFrame(entering, "_part long, _inside boolean, _last long")
    within = Window.partitionBy("_part").orderBy("_at")  # a stretch is a task's share of the file
    lines = lines.join(F.broadcast(told), "_part").withColumn("_open", F.when(F.col("_inside"), F.col("in1")).otherwise(F.col("in0")))
    lines = lines.withColumn("_record", F.coalesce(F.max(F.when(~F.col("_open"), F.col("_at"))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_last")))
    alone = ~F.col("_open") & ~F.coalesce(F.lead("_open").over(within), F.lit(True))
    lines = lines.select("_at", "value", "_record", alone.alias("_alone"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n")
    several = lines.where(~F.col("_alone")).groupBy(F.col("_record").alias("_at")).agg(joined.alias("value"))
    return lines.where("_alone").select("_at", "value").unionByName(several)


def read_delimited(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file with one header row as a table of text columns with row_idx in the order of the file.

    Files in which some line has an odd number of quotes, so that records may go on in the next line, are cut into records first
    (``_records``); blank lines are no records.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    if not spark.read.text(path).where(quotes % 2 == 1).isEmpty():
        divider = options.get("sep", ",")
        records = kept(_records(spark, path, divider).where(F.trim("value") != ""), "csv-records")
        head = records.orderBy("_at").first()
        columns = next(csv.reader(io.StringIO(head["value"]), delimiter=divider))
        shape = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns))])
        parsed = F.from_csv("value", shape.simpleString()[7:-1].replace(":", " "), {"escape": '"', "sep": divider})
        rows = numbered(records.where(F.col("_at") != head["_at"]).select("_at", parsed.alias("_c")), "_at")
        return rows.select(F.col("_rank").alias("row_idx"), *[F.col(f"_c.c{i}").alias(n) for i, n in enumerate(headers.clean_names(columns))])
    df = spark.read.options(**{"header": True, "inferSchema": False, "escape": '"'} | options).csv(path)
    placed = df.select(F.monotonically_increasing_id().alias("_at"), "*")  # the order of the scan; made dense below, from counts
    part = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = part.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = part.join(F.broadcast(before), "_part").withColumn("row_idx", F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33))
    names = headers.clean_names(df.columns)
    return rows.select("row_idx", *[F.col(f"`{a}`").alias(b) for a, b in zip(df.columns, names, strict=True)])


def lines_as_cells(texts: DataFrame, sheet: str, value: str, divider: str) -> DataFrame:
    """Texts as grids: a sheet for each, a row for each line, a cell for each part between ``divider``."""
    rows = texts.select(F.col(sheet).cast("string").alias("sheet"), F.posexplode(F.split(value, "\n", -1)).alias("r", "line"))
    cells = rows.select("sheet", (F.col("r") + 1).alias("r"), F.posexplode(F.split("line", divider, -1)).alias("c", "v"))
    return cells.select("sheet", "r", (F.col("c") + 1).alias("c"), F.when(text.valid(F.col("v")), F.col("v")).alias("v"), F.lit(False).alias("in_merge"))
