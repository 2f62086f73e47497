"""Inventory sheets (.xlsx, .csv, Parquet) and result sheets, with the standard library alone.

An .xlsx file is a zip of XML. It is read on the driver row by row: a sheet has about a million rows at most.
"""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import parse_number
from ..functions.text import py_normalize
from .config import ExcelError, ExportError

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEADER_ROWS, BIGGER = 20, 2
_FIELDS = {py_normalize(alias): name for name, aliases in V.HEADERS.items() for alias in aliases}


def map_header(label: object) -> str | None:
    """The field of a column label: equal to an alias, or beginning or ending with one as whole words."""
    key = py_normalize("" if label is None else str(label))
    if not key or key in _FIELDS:
        return _FIELDS.get(key)
    return next((f for alias, f in _FIELDS.items() if len(alias) >= 3 and (key.startswith(alias + " ") or key.endswith(" " + alias))), None)


def find_header(rows: list[list]) -> tuple[int, dict[int, str]]:
    """(row, {column: field}) of the first row with most distinct fields; (-1, {}) if none has two."""
    best: tuple[int, dict[int, str]] = (-1, {})
    for n, row in enumerate(rows[:HEADER_ROWS]):
        found: dict[int, str] = {}
        for column, label in enumerate(row):
            name = map_header(label)
            if name and name not in found.values():
                found[column] = name
        if len(found) >= max(2, len(best[1]) + 1):
            best = (n, found)
    return best


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook:
    def __init__(self, path: str):
        try:
            self.zip = zipfile.ZipFile(path)
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (OSError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
            raise ExcelError("the inventory sheet can't be read", str(error)) from error
        names = self.zip.namelist()
        self.strings = []
        if "xl/sharedStrings.xml" in names:
            self.strings = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))]
        self.sheets = ["xl/" + rels[s.get(REL)].removeprefix("/xl/") for s in book.iter(f"{NS}sheet")]
        view = book.find(f".//{NS}workbookView")
        self.active = int(view.get("activeTab", 0)) if view is not None else 0

    def area(self, sheet: str) -> int:
        with self.zip.open(sheet) as file:
            for _, e in ElementTree.iterparse(file, events=("start",)):
                if e.tag == f"{NS}dimension":
                    last = e.get("ref").split(":")[-1]
                    return (_column(last) + 1) * int(re.search(r"\d+", last).group())
                if e.tag == f"{NS}row":
                    break
        rows = list(self.rows(sheet))
        return len(rows) * max((len(r) for r in rows), default=0)

    def pick(self) -> str:
        """The active sheet, unless another one has more than twice its area."""
        best = self.sheets[self.active]
        size = self.area(best)
        for sheet in self.sheets:
            if (own := self.area(sheet)) > BIGGER * size:
                best, size = sheet, own
        return best

    def rows(self, sheet: str) -> Iterator[list]:
        at = 0
        with self.zip.open(sheet) as file:
            for _, e in ElementTree.iterparse(file):
                if e.tag != f"{NS}row":
                    continue
                number, row = int(e.get("r", at + 1)), []
                for cell in e.iter(f"{NS}c"):
                    column = _column(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (column - len(row)))
                    row.append(self.value(cell))
                for _ in range(number - at - 1):
                    yield []
                at = number
                e.clear()
                yield row

    def value(self, cell: ElementTree.Element) -> object:
        kind, v = cell.get("t"), cell.find(f"{NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{NS}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind in ("str", "e", "d"):
            return v.text
        if kind == "b":
            return v.text == "1"
        return int(v.text) if re.fullmatch(r"-?\d+", v.text) else float(v.text)


def sheet_rows(path: str) -> Iterator[list]:
    if path.lower().endswith(".csv"):
        with open(path, newline="", encoding="utf-8-sig") as file:
            yield from csv.reader(file)
        return
    book = Workbook(path)
    yield from book.rows(book.pick())


ITEMS = "item_id long, row int, code string, name string, stock_text string, unit string"


def read_inventory(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Inventory rows (item_id, row, code, name, stock, unit) of a sheet whose columns are found by their labels."""
    head, mapping, out = [], None, []
    rows = sheet_rows(path)
    try:
        for row in rows:
            head.append(row)
            if len(head) == HEADER_ROWS:
                break
    except (OSError, UnicodeDecodeError) as error:
        raise ExcelError("the inventory sheet can't be read", str(error)) from error
    at, mapping = find_header(head)
    if at < 0 or not {"code", "name"} & set(mapping.values()):
        raise ExcelError("no column of codes or names was found", str(head[:3]))

    def add(number: int, row: list) -> None:
        values = {f: row[c] for c, f in mapping.items() if c < len(row) and row[c] is not None and str(row[c]).strip()}
        item = {f: str(values[f]).strip() if f in values else "" for f in ("code", "name", "unit")}
        if item["code"] or item["name"]:
            stock = values.get("stock")
            out.append((len(out), number, item["code"], item["name"], None if stock is None or isinstance(stock, bool) else repr(float(stock)) if isinstance(stock, (int, float)) else str(stock), item["unit"]))

    for n, row in enumerate(head[at + 1 :], at + 2):
        add(n, row)
    for n, row in enumerate(rows, len(head) + 1):
        if max_rows and len(out) >= max_rows:
            break
        add(n, row)
    out = out[:max_rows] if max_rows else out
    if not out:
        raise ExcelError("the inventory sheet has no rows")
    df = spark.createDataFrame(out, ITEMS)
    plain = F.col("stock_text").rlike(r"^-?[0-9.]+(e[+-]?[0-9]+)?$")
    return df.select("item_id", "row", "code", "name", F.when(plain, F.col("stock_text").try_cast("double")).otherwise(parse_number(F.col("stock_text"))).alias("stock"), "unit")


def write_sheet(rows: Iterator[dict], columns: list[tuple[str, str]], path: str) -> str:
    """An .xlsx file, right to left, header frozen and filtered; ``columns`` are (key, label)."""

    def cell(column: int, row: int, value: object, style: int) -> str:
        ref = f"{chr(65 + column)}{row}"
        if value is None or value == "":
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'
        return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    try:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            out.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
            out.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            out.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Prices" sheetId="1" r:id="r1"/></sheets></workbook>')
            out.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/></Relationships>')
            out.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{main}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="3" applyNumberFormat="1"/></cellXfs></styleSheet>')
            with out.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetViews><sheetView rightToLeft="1" workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData><row r="1">'.encode())
                sheet.write("".join(cell(i, 1, label, 1) for i, (_, label) in enumerate(columns)).encode() + b"</row>")
                n = 1
                for n, row in enumerate(rows, 2):
                    sheet.write(f'<row r="{n}">{"".join(cell(i, n, row.get(key), 2 if key == "price" else 0) for i, (key, _) in enumerate(columns))}</row>'.encode())
                sheet.write(f'</sheetData><autoFilter ref="A1:{chr(64 + len(columns))}{n}"/></worksheet>'.encode())
    except OSError as error:
        raise ExportError("the result can't be written", str(error)) from error
    return path
