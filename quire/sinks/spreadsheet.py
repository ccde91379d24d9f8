"""Spreadsheets: one sheet for each document, written as OOXML by hand.

The title stands over the widest table, a page mark over each table, a blank row between two. Cells keep the merges and
borders of ruled tables, numbers stay numbers with their decimals, columns are as wide as their longest cell, within
limits. Tables go on over pages by their column starts, whatever text follows them; a failed page leaves a note.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import astuple, dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from quire.sinks.books import Open, cell_value, is_header_row, lone, mark
from quire.sinks.books import books as of_documents

# Fixed values.
LEAST_WIDTH, MOST_WIDTH, CENTERED = 8, 42, 12
TITLE_ROW, FIRST_ROW = 0, 2

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_TYPES = f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KINDS}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KINDS}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KINDS}.styles+xml"/></Types>'
_RELS = f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK_RELS = f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>'


@dataclass(frozen=True)
class Style:
    bold: bool = False
    size: float = 11
    color: str = ""
    fill: str = ""
    across: str = ""
    down: str = ""
    wrap: bool = False
    number: str = ""
    edges: tuple[bool, ...] = ()  # top, right, bottom, left


@dataclass
class Cell:
    text: str
    value: float | None = None
    style: Style = Style()
    span: tuple[int, int] = (1, 1)  # rows, columns


def column_name(k: int) -> str:
    name = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def _width(t: str) -> int:
    """Columns on display: two for each code point above U+2E80."""
    return sum(2 if ord(c) > 0x2E80 else 1 for c in t)


class Sheet:
    """Cells by place, and the state that tables over pages need."""

    def __init__(self, name: str, lang: str):
        self.name, self.lang = name, lang
        self.cells: dict[tuple[int, int], Cell] = {}
        self.row, self.n_tables, self.most_columns = FIRST_ROW, 0, 1
        self.widths: dict[int, int] = {}
        self.mark: tuple[int, int, int] | None = None  # row, columns and first page of the last page mark
        self.open: dict[str, Open] = {}

    def put(self, row: int, column: int, text: str, style: Style, span: tuple[int, int] = (1, 1)) -> None:
        value, number, text = cell_value(text)
        self.cells[row, column] = Cell(text, value, Style(*astuple(style)[:7], number or "", style.edges), span)
        if span == (1, 1):
            self.widths[column] = max(self.widths.get(column, 0), _width(text))

    def marked(self, page: int, columns: int, goes_on: bool) -> None:
        """A page mark over a new table, or the last one extended to this page."""
        if not goes_on:
            self.row += self.row > FIRST_ROW
            self.mark = (self.row, columns, page)
            self.most_columns = max(self.most_columns, columns)
            self.row += 1
            self.n_tables += 1
        if self.mark:
            row, columns, first = self.mark
            text = mark("page", self.lang, page) if page == first else mark("pages", self.lang, first, page)
            self.cells[row, 0] = Cell(text, None, Style(size=9, color="999999", across="center", down="center"), (1, columns))

    def grid(self, block: dict, page: int, goes_on: bool) -> None:
        columns = len(block["starts"]) - 1
        self.marked(page, columns, goes_on)
        head = not goes_on and is_header_row(block["rows"])
        for c in block["cells"]:
            if not c["text"] and not any(c["edges"]):
                continue
            wide = c["h"] > 1 or c["w"] > 1
            across = ("center" if len(c["text"]) <= CENTERED else "left") if wide else ""
            look = Style(head and c["r"] == 0, fill="EFEFEF" if head and c["r"] == 0 else "", across=across, down="center" if wide else "top", wrap=True, edges=tuple(c["edges"]))
            self.put(self.row + c["r"], c["c"], c["text"], look, (c["h"], c["w"]))
        self.row += len(block["rows"])
        self.open = {"grid": Open("grid", block["starts"], page, head, None)}

    def table(self, block: dict, page: int, before: Open | None) -> None:
        self.marked(page, len(block["starts"]), before is not None)
        head = before.header if before else is_header_row(block["rows"])
        for n, row in enumerate(block["rows"]):
            top = head and n == 0 and before is None
            for c, t in enumerate(row):
                if t:
                    label = c == 0 and not head and len(block["starts"]) == 2  # labels and values
                    self.put(self.row, c, t, Style(top or label, fill="EFEFEF" if top else "", down="top", wrap=True))
            self.row += 1
        self.open["table"] = Open("table", block["starts"], page, head, None)

    def page(self, page: dict) -> None:
        no = page["page_no"]
        if page["error"] is not None:
            self.cells[self.row, 0] = Cell(mark("failed", self.lang, no, page["error"]), None, Style(bold=True, color="C03030"))
            self.row += 2
            self.open = {}
            return
        for k, b in enumerate(page["blocks"]):
            before = self.open.get(b["kind"])
            before = before if k == 0 and before and before.goes_on(b, no) else None
            if b["kind"] == "grid":
                self.grid(b, no, before is not None)
            elif b["kind"] == "table" and not lone(b["rows"]):
                self.table(b, no, before)

    def written(self) -> bytes:
        self.cells[TITLE_ROW, 0] = Cell(self.name, None, Style(bold=True, size=14, across="center" if self.most_columns > 1 else ""), (1, self.most_columns))
        if not self.n_tables:
            self.cells[FIRST_ROW, 0] = Cell(mark("no_table", self.lang))
        return archived(self.cells, {c: min(max(w + 2, LEAST_WIDTH), MOST_WIDTH) for c, w in self.widths.items()}, mark("sheet", self.lang))


class Styles:
    """The style sheet: every different look, and its parts, by number."""

    def __init__(self):
        self.parts: dict[str, dict[str, int]] = {k: {} for k in ("fonts", "fills", "borders", "numFmts", "cellXfs")}
        self._number("fills", "<fill><patternFill/></fill>")
        self._number("fills", '<fill><patternFill patternType="gray125"/></fill>')
        self.of(Style())

    def _number(self, kind: str, xml: str) -> int:
        return self.parts[kind].setdefault(xml, len(self.parts[kind]))

    def of(self, s: Style) -> int:
        font = self._number("fonts", f"<font>{'<b/>' if s.bold else ''}<sz val=\"{s.size:g}\"/>{f'<color rgb=\"FF{s.color}\"/>' if s.color else ''}<name val=\"Calibri\"/></font>")
        fill = self._number("fills", f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s.fill}"/></patternFill></fill>') if s.fill else 0
        top, right, bottom, left = s.edges or (False,) * 4
        side = lambda name, on: f'<{name} style="thin"/>' if on else f"<{name}/>"
        border = self._number("borders", f"<border>{side('left', left)}{side('right', right)}{side('top', top)}{side('bottom', bottom)}</border>")
        number = 164 + self._number("numFmts", escape(s.number)) if s.number else 0
        places = "".join([f' horizontal="{s.across}"' if s.across else "", f' vertical="{s.down}"' if s.down else "", ' wrapText="1"' if s.wrap else ""])
        return self._number("cellXfs", f'<xf numFmtId="{number}" fontId="{font}" fillId="{fill}" borderId="{border}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1"{f" applyAlignment=\"1\"><alignment{places}/></xf>" if places else "/>"}')

    def xml(self) -> str:
        formats = "".join(f'<numFmt numFmtId="{164 + k}" formatCode="{x}"/>' for x, k in self.parts["numFmts"].items())
        lists = {k: f'<{k} count="{len(v)}">{"".join(v)}</{k}>' for k, v in self.parts.items()} | {"numFmts": f'<numFmts count="{len(self.parts["numFmts"])}">{formats}</numFmts>' if formats else ""}
        return f'{_HEAD}<styleSheet xmlns="{_MAIN}">{lists["numFmts"]}{lists["fonts"]}{lists["fills"]}{lists["borders"]}<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>{lists["cellXfs"]}</styleSheet>'


def archived(cells: dict[tuple[int, int], Cell], widths: dict[int, int], sheet: str) -> bytes:
    """A workbook of one sheet. Cells under a merge carry its style, so that its borders are whole."""
    styles, merges = Styles(), []
    rows: dict[int, dict[int, str]] = {}
    for (r, c), cell in cells.items():
        look = styles.of(cell.style)
        high, wide = cell.span
        if cell.span != (1, 1):
            merges.append(f'<mergeCell ref="{column_name(c)}{r + 1}:{column_name(c + wide - 1)}{r + high}"/>')
        for i in range(r, r + high):
            for j in range(c, c + wide):
                at = f'<c r="{column_name(j)}{i + 1}" s="{look}"'
                if (i, j) != (r, c) or not cell.text and cell.value is None:
                    xml = f"{at}/>"
                elif cell.value is not None:
                    xml = f"{at}><v>{cell.value:.15g}</v></c>"
                else:
                    xml = f'{at} t="inlineStr"><is><t xml:space="preserve">{escape(cell.text)}</t></is></c>'
                rows.setdefault(i, {})[j] = xml
    columns = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in sorted(widths.items()))
    data = "".join(f'<row r="{r + 1}">{"".join(x for _, x in sorted(row.items()))}</row>' for r, row in sorted(rows.items()))
    joined = f'<mergeCells count="{len(merges)}">{"".join(merges)}</mergeCells>' if merges else ""
    body = f'{_HEAD}<worksheet xmlns="{_MAIN}">{f"<cols>{columns}</cols>" if columns else ""}<sheetData>{data}</sheetData>{joined}</worksheet>'
    book = f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>'
    return archive({"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS, "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _BOOK_RELS, "xl/styles.xml": styles.xml(), "xl/worksheets/sheet1.xml": body})


def workbook(rows: list[list[str]]) -> bytes:
    """A sheet of plain rows."""
    cells = {(r, c): Cell(t, value, Style(number=number or "")) for r, row in enumerate(rows) for c, x in enumerate(row) if x for value, number, t in [cell_value(x)]}
    return archived(cells, {}, "tables")


def archive(parts: dict[str, str | bytes]) -> bytes:
    """A zip of the parts, the same for the same parts. Bytes (pictures) are stored as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            if isinstance(body, str):
                z.writestr(zipfile.ZipInfo(name), body.encode(), zipfile.ZIP_DEFLATED)
            else:
                z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED)
    return out.getvalue()


def read_back(blob: bytes) -> list[list[str]]:
    """The texts of each row's cells; numbers as their number format shows them, blank cells at the end of a row left out."""
    space = f"{{{_MAIN}}}"
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        root, look = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")), ElementTree.fromstring(z.read("xl/styles.xml"))
    formats = {f.get("numFmtId"): f.get("formatCode") for f in look.iter(f"{space}numFmt")}
    decimals = [len((formats.get(x.get("numFmtId")) or "").partition(".")[2]) for x in look.find(f"{space}cellXfs")]
    out = []
    for row in root.iter(f"{space}row"):
        cells: list[str] = []
        for c in row.iter(f"{space}c"):
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(re.match("[A-Z]+", c.get("r"))[0][::-1])) - 1
            t = "".join(c.itertext())
            cells += [""] * (at - len(cells))
            cells.append(f"{float(t):.{decimals[int(c.get('s', 0))]}f}" if c.get("t") is None and t else t)
        while cells and not cells[-1]:
            cells.pop()
        out.append(cells)
    return out


def merges_of(blob: bytes) -> list[str]:
    """The merged ranges of a sheet."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        return [m.get("ref") for m in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{{{_MAIN}}}mergeCell")]


def widths_of(blob: bytes) -> dict[int, float]:
    """Widths by column, counted from 0."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        return {int(c.get("min")) - 1: float(c.get("width")) for c in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{{{_MAIN}}}col")}


def books(pages: DataFrame, lang: str = "en") -> DataFrame:
    """doc_id, content, n_tables and most_columns of whole documents. pages: see sinks.books.books."""

    def make(name: str, some: list[dict]) -> tuple:
        sheet = Sheet(name, lang)
        for page in some:
            sheet.page(page)
        return sheet.written(), sheet.n_tables, sheet.most_columns

    return of_documents(pages, make, "content binary, n_tables int, most_columns int")
