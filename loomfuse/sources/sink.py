"""Writing results: workbooks patched from a template, and logs of what was matched."""

from __future__ import annotations

import io
import os
import re
import zipfile
from datetime import datetime
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.sources.grid import MAIN, column_letters, numbered_rows, place, placed_cells, sheet_paths, workbook


def default_name(template: str, suffix: str = "filled", now: datetime | None = None) -> str:
    """template_suffix_time.xlsx"""
    stem = os.path.splitext(os.path.basename(template))[0]
    return f"{stem}_{suffix}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.xlsx"


def _with_namespaces(xml: bytes, root: ET.Element) -> bytes:
    """``root`` as XML with the prefixes of its source ``xml``, those too that only attribute values name."""
    prefixes = dict(e for _, e in ET.iterparse(io.BytesIO(xml), events=["start-ns"]))
    for prefix, uri in prefixes.items():
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    text = ET.tostring(root, encoding="unicode")
    end = text.index(">")
    missing = "".join(f' xmlns:{p}="{escape(u)}"' for p, u in prefixes.items() if p and f'xmlns:{p}="' not in text[:end])
    start = text.index(" ") if " " in text[:end] else end
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text[:start] + missing + text[start:]).encode("utf-8")


def patch_workbook(template: bytes, sheet: str, values: dict[tuple[int, int], str], first_row: int, last_row: int = 1 << 20) -> bytes:
    """The template with ``values`` by (row, column) in one sheet.

    Styles and namespaces stay; regions that reach into the rows from ``first_row`` to ``last_row`` are
    taken apart; blanks change nothing.
    """
    book, out = zipfile.ZipFile(io.BytesIO(template)), io.BytesIO()
    part = dict(sheet_paths(book))[sheet]
    xml = book.read(part)
    root = ET.fromstring(xml)
    data = root.find(f"{MAIN}sheetData")
    rows = dict(numbered_rows(data))
    cells = {n: dict(placed_cells(r)) for n, r in rows.items()}
    for n, r in rows.items():
        r.set("r", str(n))
        for c, x in cells[n].items():
            x.set("r", f"{column_letters(c)}{n}")
    for (r, c), value in sorted(values.items()):
        if value is None or not str(value).strip():
            continue
        if r not in rows:
            rows[r], cells[r] = ET.Element(f"{MAIN}row", r=str(r)), {}
        cell = cells[r].setdefault(c, ET.Element(f"{MAIN}c", r=f"{column_letters(c)}{r}"))
        for old in list(cell):
            cell.remove(old)
        cell.set("t", "inlineStr")
        shown = ET.SubElement(ET.SubElement(cell, f"{MAIN}is"), f"{MAIN}t")
        shown.text = str(value)
        shown.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    for r, row in rows.items():
        row.attrib.pop("spans", None)
        row[:] = [cells[r][c] for c in sorted(cells[r])] + [x for x in row if x.tag != f"{MAIN}c"]
    data[:] = [rows[k] for k in sorted(rows)]
    if (size := root.find(f"{MAIN}dimension")) is not None:
        root.remove(size)  # it may not hold any more, and may be left out
    if (merged := root.find(f"{MAIN}mergeCells")) is not None:
        bounds = lambda m: [place(x)[0] for x in (m.get("ref").split(":") * 2)[:2]]
        merged[:] = [m for m in merged if bounds(m)[1] < first_row or bounds(m)[0] > last_row]
        merged.set("count", str(len(merged)))
        if not len(merged):
            root.remove(merged)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in book.namelist():
            new.writestr(name, _with_namespaces(xml, root) if name == part else book.read(name))
    return out.getvalue()


def filled_workbook(template: bytes, sheet: str, names: list[str], rows: list[tuple], candidate: int | None = None) -> tuple[bytes, list[str]]:
    """The template with ``rows`` (place below the header, *values of ``names``), and the names that its header doesn't have."""
    from loomfuse.operators.schema_match import header_places, header_row

    shown: dict[int, dict[int, str]] = {}
    for s, kind, r, c, _, _, v, _ in workbook(template):
        if s == sheet and kind == "cell":
            shown.setdefault(r, {})[c] = v
    detail = header_row(shown, names, candidate)
    places = header_places(shown, detail, names)
    values = {(detail + 1 + at, places[n]): v for at, *cells in rows for n, v in zip(names, cells, strict=True) if n in places and v is not None}
    last = detail + max((at for at, *_ in rows), default=0) + 1
    return patch_workbook(template, sheet, values, detail + 1, last), [n for n in names if n not in places]


XML_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
SHEET_PART = "xl/worksheets/sheet1.xml"
SHEET_HEAD, SHEET_TAIL = f'{XML_HEAD}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>', "</sheetData></worksheet>"


def row_xml(r: int, cells: list) -> str:
    """A row of inline texts; cells without a value are left out."""
    cell = lambda c, v: f'<c r="{column_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", str(v)))}</t></is></c>'
    return f'<row r="{r}">{"".join(cell(c, v) for c, v in enumerate(cells, 1) if v is not None)}</row>'


#: Characters that no XML file may hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def package_parts(sheet: str) -> dict[str, str]:
    """The parts of a plain workbook with one sheet, but for the sheet itself."""
    ns, rel = MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    return {name: XML_HEAD + xml for name, xml in parts.items()}


def new_workbook(names: list[str], rows: list[list[str | None]], sheet: str = "Sheet1") -> bytes:
    """A plain workbook with one sheet."""
    body = "".join(row_xml(i, row) for i, row in enumerate([names, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name, xml in (package_parts(sheet) | {SHEET_PART: SHEET_HEAD + body + SHEET_TAIL}).items():
            new.writestr(name, xml)
    return out.getvalue()


def publish(content: bytes, path: str) -> str:
    """Write so that readers see the old file or the whole new one."""
    new = f"{path}.new"
    with open(new, "wb") as f:
        f.write(content)
    os.replace(new, path)
    return path


def log_start(spark: SparkSession, path: str, matches: DataFrame, output: str) -> None:
    """Append one row that a run begins: where it writes, and how many fields are matched."""
    n = matches.where("matched").count()
    spark.range(1).select(F.lit("exec_start").alias("event"), F.current_timestamp().alias("at"), F.lit(output).alias("output"), F.lit(n).alias("fields")).write.mode("append").json(path)


def log_matches(matches: DataFrame, path: str, event: str = "match") -> None:
    """Append a row for each match decision as JSON lines."""
    decision = F.when(F.col("matched"), "matched").when(F.col("suggested"), "suggested").otherwise("unmatched")
    rows = matches.select(F.lit(event).alias("event"), F.current_timestamp().alias("at"), "tgt_field", "src_field", "confidence", decision.alias("decision"), "conflict")
    rows.write.mode("append").json(path)


def log_summary(matches: DataFrame, path: str, seconds: float) -> None:
    """Append one row with the counts of a finished run."""
    from loomfuse.operators.schema_match import status_summary

    status_summary(matches).select(F.lit("exec_done").alias("event"), F.current_timestamp().alias("at"), F.lit(seconds).alias("seconds"), "*").write.mode("append").json(path)
