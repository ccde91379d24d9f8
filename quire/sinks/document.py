"""Word-processor documents, written as OOXML by hand: paragraphs with indents, lists, headings, tables and pictures.

Tables go on over pages as operators.crosspage.anchored_pieces has it; the page mark of such a page is a row of the
table, any other a paragraph of its own. Ruled tables keep spans and the borders of each side.
"""

from __future__ import annotations

import io
import struct
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from quire.config import Config
from quire.functions import patterns as P
from quire.operators.styles import CM, LEAST_CELL, LEAST_GRID_CELL
from quire.plans.folding import folded
from quire.sinks.books import Look, Open, indent_zero, is_header_row, lone, look, mark
from quire.sinks.books import books as of_documents
from quire.sinks.spreadsheet import archive

# Fixed values, lengths in twentieths of a point.
STEP, MARGINS, LONG, SHORT = round(0.74 * CM), 5 * CM, 16838, 11906
TABLE_SIZE, MARK_SIZE, MARK_COLOR, ERROR_COLOR, LEVELS = 10, 8, "999999", "C03030", 6
GLYPHS = (("•", "Symbol"), ("o", "Courier New"), ("▪", "Wingdings"))
EMU = 635  # of a twentieth of a point

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE, _PACKAGE, _DRAW = "http://schemas.openxmlformats.org/officeDocument/2006", "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/drawingml/2006"
_W, _M, _R = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", f"{_OFFICE}/math", f"{_OFFICE}/relationships"
_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"


def el(name: str, *children: str, **attributes: object) -> str:
    """An element of the w namespace unless the name has another; attributes of the element's namespace, `plain_` ones of none."""
    name = name if ":" in name else f"w:{name}"
    space = name.split(":")[0]
    some = "".join(f" {k.removeprefix('plain_') if k.startswith('plain_') else f'{space}:{k}'}={quoteattr(str(v))}" for k, v in attributes.items())
    return f"<{name}{some}>{''.join(children)}</{name}>" if children else f"<{name}{some}/>"


def fonts(ascii_font: str, asian: str | None = None) -> str:
    return el("rFonts", ascii=ascii_font, hAnsi=ascii_font, **({"eastAsia": asian} if asian else {}))


def sized(points: float) -> str:
    return el("sz", val=round(2 * points)) + el("szCs", val=round(2 * points))


def runs(text: str, cfg: Config, size: float, bold: bool = False, color: str = "") -> str:
    """Runs of one paragraph; marked fractions become math."""
    shape = el("rPr", fonts(cfg.en_font, cfg.zh_font), (el("b") + el("bCs")) if bold else "", el("color", val=color) if color else "", sized(size))
    term = lambda t: el("m:r", el("rPr", fonts("Cambria Math"), sized(size)), f'<m:t xml:space="preserve">{escape(t)}</m:t>')
    plain = lambda t: el("r", shape, f'<w:t xml:space="preserve">{escape(t)}</w:t>') if t else ""
    first, *rest = text.split(P.FRACTION)
    out = [plain(first)]
    for k in range(0, len(rest) - 1, 3):
        out += [el("m:oMath", el("m:f", el("m:num", term(rest[k])), el("m:den", term(rest[k + 1])))), *map(plain, rest[k + 2 : k + 3])]
    return "".join(out)


def paragraph(own: Look, cfg: Config, color: str = "") -> str:
    """List items hang by a step at their indent; their glyph is that of the deepest level that is defined."""
    listed = own.style in ("glyph", "bullet")
    style = el("pStyle", val="ListBullet") + el("numPr", el("ilvl", val=min(own.indent, LEVELS - 1)), el("numId", val=1)) if listed else ""
    indent = el("ind", left=STEP * (own.indent + 1), hanging=STEP) if listed else el("ind", left=STEP * own.indent) if own.indent else ""
    side = el("jc", val=own.align) if own.align != "left" else ""
    return el("p", el("pPr", style, el("spacing", before=0, after=60, line=276, lineRule="auto"), indent, side), runs(own.text, cfg, own.size, own.bold, color))


def cell(text: str, width: int, cfg: Config, size: float, bold: bool = False, span: int = 1, below: bool | None = None, edges: tuple | None = None, center: bool = False, color: str = "") -> str:
    """A table cell; each line of its text is a paragraph. below: whether it goes on a cell above, None without a vertical merge."""
    sides = dict(zip(("top", "right", "bottom", "left"), edges or (), strict=False))
    borders = el("tcBorders", *[el(k, val="single" if sides[k] else "none", sz=4 if sides[k] else 0, space=0, color="auto") for k in ("top", "left", "bottom", "right")]) if edges else ""
    merge = "" if below is None else el("vMerge") if below else el("vMerge", val="restart")
    shape = el("tcPr", el("tcW", w=width, type="dxa"), el("gridSpan", val=span) if span > 1 else "", merge, borders, el("vAlign", val="center") if center else "")
    inner = [el("p", el("pPr", el("spacing", before=0, after=0, line=252, lineRule="auto"), el("jc", val="center") if center else ""), runs(t, cfg, size, bold, color)) for t in text.split("\n")]
    return el("tc", shape, *inner)


def row(cells: list[str], header: bool = False) -> str:
    return el("tr", el("trPr", el("tblHeader", val="true")) if header else "", *cells)


class Table:
    def __init__(self, widths: list[int], ruled: bool):
        self.widths, self.ruled, self.rows = widths, ruled, []

    def xml(self) -> str:
        line = {"val": "single", "sz": 4} if self.ruled else {"val": "none", "sz": 0}
        borders = el("tblBorders", *[el(k, **line, space=0, color="auto") for k in ("top", "left", "bottom", "right", "insideH", "insideV")])
        shape = el("tblPr", el("tblStyle", val="TableGrid") if self.ruled else "", el("tblW", w=0, type="auto"), borders, el("tblLayout", type="fixed"))
        return el("tbl", shape, el("tblGrid", *[el("gridCol", w=w) for w in self.widths]), *self.rows)


class Writer:
    """One document's body; a table stays open for rows of later pages."""

    def __init__(self, pages: list[dict], lang: str, cfg: Config):
        self.lang, self.cfg, self.zero = lang, cfg, indent_zero(pages, cfg)
        self.landscape = 2 * sum(p["w"] > p["h"] for p in pages) > len(pages)
        self.usable = (29.7 if self.landscape else 21.0) * CM - MARGINS
        self.body: list[str | Table] = []
        self.pictures: list[bytes] = []
        self.open: Open | None = None
        self.pending: int | None = None  # the page whose mark goes into the open table

    def note(self, text: str, size: float, color: str, bold: bool = False, align: str = "left") -> None:
        self.body.append(paragraph(Look("plain", text, 0, size, bold, align), self.cfg, color))

    def widths(self, block: dict) -> list[int]:
        ruled = block["kind"] == "grid"
        edges = block["starts"] if ruled else [*block["starts"], 1.0]
        total, least = max(edges[-1] - edges[0], 1e-6), LEAST_GRID_CELL if ruled else LEAST_CELL
        return [int(max(self.usable * (b - a) / total, least) + 0.5) for a, b in zip(edges, edges[1:], strict=False)]

    def rows_of(self, block: dict, table: Table, header: bool) -> list[str]:
        if block["kind"] == "grid":
            return self.ruled_rows(block, table.widths, header)
        labels = not header and len(block["starts"]) == 2
        first = header and not table.rows
        return [row([cell(t, w, self.cfg, TABLE_SIZE, first and n == 0 or labels and k == 0) for k, (t, w) in enumerate(zip(cells, table.widths, strict=False))], first and n == 0) for n, cells in enumerate(block["rows"])]

    def ruled_rows(self, block: dict, widths: list[int], header: bool) -> list[str]:
        """A merged cell stands in each of its rows: its text and top in the first, its bottom in the last."""
        n = len(widths)
        size = 10 if n <= 6 else 9 if n <= 10 else 8
        lines: list[dict[int, str]] = [{} for _ in block["rows"]]
        for c in block["cells"]:
            for k in range(c["h"]):
                top, right, bottom, left = c["edges"]
                edges = (top and k == 0, right, bottom and k == c["h"] - 1, left)
                bold = header and c["r"] + k == 0
                lines[c["r"] + k][c["c"]] = cell("" if k else c["text"], sum(widths[c["c"] : c["c"] + c["w"]]), self.cfg, size, bold, c["w"], None if c["h"] == 1 else k > 0, edges, c["w"] > 1 or c["h"] > 1)
        return [row([x for _, x in sorted(line.items())], header and r == 0) for r, line in enumerate(lines)]

    def table(self, block: dict, page: int, at: int) -> None:
        held = self.open if at == 0 and self.open and self.open.goes_on(block, page) else None
        if held:
            table: Table = held.table
            if self.pending is not None:
                table.rows.append(row([cell(mark("page", self.lang, self.pending), sum(table.widths), self.cfg, MARK_SIZE, span=len(table.widths), center=True, color=MARK_COLOR)]))
                self.pending = None
            table.rows += self.rows_of(block, table, held.header and block["kind"] == "table")
            held.page = page
            return
        table, header = Table(self.widths(block), block["kind"] == "grid"), is_header_row(block["rows"])
        table.rows = self.rows_of(block, table, header)
        self.body += [table, el("p")]
        self.open = Open(block["kind"], block["starts"], page, header, table)

    def figure(self, f: dict, page: dict) -> None:
        """As large as on paper, if that fits; on the side where its middle is."""
        wide = max(page["w"], 1)
        k = (self.usable + MARGINS) / wide
        w, h = (f["x1"] - f["x0"]) * k, (f["y1"] - f["y0"]) * k
        if w > self.usable:
            w, h = self.usable, h * self.usable / w
        middle = (f["x0"] + f["x1"]) / 2 / wide
        align = "right" if middle > 0.62 else "left" if middle < 0.38 else "center"
        self.pictures.append(f["png"])
        n, size = len(self.pictures), {"plain_cx": int(w) * EMU, "plain_cy": int(h) * EMU}
        picture = (
            f'<pic:pic xmlns:pic="{_DRAW}/picture"><pic:nvPicPr><pic:cNvPr id="{n}" name="Figure {n}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rId{n + 2}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
            f'<pic:spPr><a:xfrm><a:off x="0" y="0"/>{el("a:ext", **size)}</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
        )
        inline = f'<wp:inline xmlns:wp="{_DRAW}/wordprocessingDrawing" distT="0" distB="0" distL="0" distR="0">{el("wp:extent", **size)}<wp:docPr id="{n}" name="Figure {n}"/><a:graphic xmlns:a="{_DRAW}/main"><a:graphicData uri="{_DRAW}/picture">{picture}</a:graphicData></a:graphic></wp:inline>'
        self.body.append(el("p", el("pPr", el("spacing", before=60, after=60), el("jc", val=align) if align != "left" else ""), el("r", el("drawing", inline))))

    def page(self, page: dict) -> None:
        no, blocks = page["page_no"], page["blocks"]
        if page["error"] is not None:
            self.note(mark("failed", self.lang, no, page["error"]), 10.5, ERROR_COLOR, bold=True)
            self.open = self.pending = None
            return
        if self.cfg.page_marker:
            inside = bool(blocks) and self.open is not None and blocks[0]["kind"] in ("table", "grid") and self.open.goes_on(blocks[0], no)
            self.pending = no if inside else None
            if not inside:
                self.note(mark("page", self.lang, no), MARK_SIZE, MARK_COLOR, align="center")
        for k, b in enumerate(blocks):
            if b["kind"] == "text":
                if self.open and self.open.kind == "grid":
                    self.open = None  # text closes a ruled table; a borderless one may go on
                self.body += [paragraph(look(p, after, self.zero, self.cfg), self.cfg) for p, after in zip(b["paras"], [*b["paras"][1:], None], strict=True)]
            elif b["kind"] == "figure":
                self.figure(b["figure"], page)
                self.open = None
            elif b["kind"] == "table" and lone(b["rows"]):
                self.body += [paragraph(Look("plain", " ".join(filter(None, r)), 0, self.cfg.font_size, False, "left"), self.cfg) for r in b["rows"]]
            else:
                self.table(b, no, k)

    def written(self) -> bytes:
        body = "".join(x if isinstance(x, str) else x.xml() for x in self.body)
        size = el("pgSz", w=LONG, h=SHORT, orient="landscape") if self.landscape else el("pgSz", w=SHORT, h=LONG)
        section = el("sectPr", size, el("pgMar", top=1418, right=1418, bottom=1418, left=1418, header=851, footer=992, gutter=0))
        return packed(body + section, self.pictures, self.cfg)


def numbering() -> str:
    """A list glyph for each level."""
    levels = [
        el("lvl", el("start", val=1), el("numFmt", val="bullet"), el("lvlText", val=glyph), el("lvlJc", val="left"), el("pPr", el("ind", left=STEP * (k + 1), hanging=STEP)), el("rPr", el("rFonts", ascii=font, hAnsi=font, hint="default")), ilvl=k)
        for k in range(LEVELS)
        for glyph, font in [GLYPHS[k % len(GLYPHS)]]
    ]
    inner = el("abstractNum", el("multiLevelType", val="hybridMultilevel"), *levels, abstractNumId=0) + el("num", el("abstractNumId", val=0), numId=1)
    return f'{_HEAD}<w:numbering xmlns:w="{_W}">{inner}</w:numbering>'


def style_sheet(cfg: Config) -> str:
    lines = el("tblBorders", *[el(k, val="single", sz=4, space=0, color="auto") for k in ("top", "left", "bottom", "right", "insideH", "insideV")])
    inner = [
        el("docDefaults", el("rPrDefault", el("rPr", fonts(cfg.en_font, cfg.zh_font), sized(cfg.font_size)))),
        el("style", el("name", val="Normal"), type="paragraph", default=1, styleId="Normal"),
        el("style", el("name", val="List Bullet"), el("basedOn", val="Normal"), el("pPr", el("numPr", el("ilvl", val=0), el("numId", val=1)), el("ind", left=420, hanging=420)), type="paragraph", styleId="ListBullet"),
        el("style", el("name", val="Table Grid"), el("tblPr", lines), type="table", styleId="TableGrid"),
    ]
    return f'{_HEAD}<w:styles xmlns:w="{_W}">{"".join(inner)}</w:styles>'


def packed(body: str, pictures: list[bytes], cfg: Config) -> bytes:
    """The file around a body; pictures are numbered from 1."""
    kinds = {"document": "document.main", "styles": "styles", "numbering": "numbering"}
    types = [f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), *([("png", "image/png")] if pictures else []))]
    types += [f'<Override PartName="/word/{part}.xml" ContentType="{_KIND}.{kind}+xml"/>' for part, kind in kinds.items()]
    targets = [("styles", "styles.xml"), ("numbering", "numbering.xml"), *[("image", f"media/image{k}.png") for k in range(1, len(pictures) + 1)]]
    related = lambda some: f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f"<Relationship Id=\"rId{k}\" Type=\"{_R}/{kind}\" Target=\"{to}\"/>" for k, (kind, to) in enumerate(some, 1))}</Relationships>'
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{"".join(types)}</Types>',
        "_rels/.rels": related([("officeDocument", "word/document.xml")]),
        "word/_rels/document.xml.rels": related(targets),
        "word/styles.xml": style_sheet(cfg),
        "word/numbering.xml": numbering(),
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_W}" xmlns:m="{_M}" xmlns:r="{_R}"><w:body>{body}</w:body></w:document>',
    }
    return archive(parts | {f"word/media/image{k}.png": png for k, png in enumerate(pictures, 1)})


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag in (f"{{{_W}}}t", f"{{{_M}}}t"))


def read_back(blob: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraph texts outside tables, and table cells, whose paragraphs are lines."""
    w = f"{{{_W}}}"
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    tables = [[["\n".join(_text(p) for p in c.iter(f"{w}p")) for c in r.iter(f"{w}tc")] for r in t.iter(f"{w}tr")] for t in body.findall(f"{w}tbl")]
    return [_text(p) for p in body.findall(f"{w}p")], tables


def outline(blob: bytes) -> list[tuple[str, str, int, str, bool, int]]:
    """What stands in the body, in order: kind (p, list, row or picture), text (cells by tabs), indent, align, bold, spans."""
    w = f"{{{_W}}}"
    out = []
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    for e in body:
        if e.tag == f"{w}tbl":
            for r in e.iter(f"{w}tr"):
                spans = sum(int(s.get(f"{w}val")) - 1 for s in r.iter(f"{w}gridSpan")) + len(list(r.iter(f"{w}vMerge")))
                out.append(("row", "\t".join("\n".join(_text(p) for p in c.iter(f"{w}p")) for c in r.iter(f"{w}tc")), 0, "left", r.find(f".//{w}b") is not None, spans))
        elif e.tag == f"{w}p" and len(e):
            shape = e.find(f"{w}pPr")
            kind = "picture" if e.find(f".//{w}drawing") is not None else "list" if shape.find(f"{w}numPr") is not None else "p"
            left, side = shape.find(f"{w}ind"), shape.find(f"{w}jc")
            out.append((kind, _text(e), int(left.get(f"{w}left")) if left is not None else 0, side.get(f"{w}val") if side is not None else "left", e.find(f".//{w}b") is not None, 0))
    return out


def picture_sizes(blob: bytes) -> list[tuple[int, int]]:
    """Width and height in pixels of the pictures in a file."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        return [struct.unpack(">II", z.read(n)[16:24]) for n in sorted(z.namelist()) if n.startswith("word/media/")]


def books(pages: DataFrame, lang: str = "en", cfg: Config = Config()) -> DataFrame:
    """doc_id and content of whole documents. pages: see sinks.books.books."""

    def make(_: str, some: list[dict]) -> tuple:
        writer = Writer(some, lang, cfg)
        for page in some:
            writer.page(page)
        return (writer.written(),)

    return of_documents(pages, make, "content binary")


def documents(blocks: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, content of plain blocks, without page marks and looks: tables of one number are one table of equal columns.

    blocks: doc_id, page_no, block, kind, table_no, rows, paras, as page.blocks_of() and crosspage.continued() have them.
    """

    def one(key: tuple, some: list[tuple]) -> list[tuple]:
        body: list[str | Table] = []
        tables: dict[int, Table] = {}
        for _, _, kind, number, rows, paras in some:
            if kind != "table":
                body += [paragraph(Look("plain", t, 0, cfg.font_size, False, "left"), cfg) for t in paras or []]
                continue
            if number not in tables:
                n = max(map(len, rows))
                tables[number] = Table([round((21.0 * CM - MARGINS) / n)] * n, False)
                body.append(tables[number])
            table = tables[number]
            table.rows += [row([cell(t or "", w, cfg, TABLE_SIZE) for t, w in zip(r, table.widths, strict=False)]) for r in rows]
        return [(*key, packed("".join(x if isinstance(x, str) else x.xml() for x in body), [], cfg))]

    return folded(blocks.select("doc_id", "page_no", "block", "kind", "table_no", "rows", "paras"), ["doc_id"], ["page_no", "block"], one, "doc_id long, content binary")
