"""Markdown output: whole documents with titles, page marks, lists and figures, or plain blocks in DataFrame functions.

Tables of following pages with equally many columns are one table; text, figures and failed pages close it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import text as X
from quire.sinks.books import books as of_documents
from quire.sinks.books import heading_level, indent_zero, is_header_row, lone, look, mark


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, X.md_cell), " | "), F.lit(" |"))


def rule(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(cells)))


def paragraph(text: Column) -> Column:
    level = X.heading_level(text)
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), text)).otherwise(X.md_escape(text))


def header_row(rows: Column) -> Column:
    """Whether the first of at least three rows is a header: two short cells or more, none of which ends a sentence."""
    first = F.filter(F.get(rows, F.lit(0)), lambda c: c != "")
    short = F.forall(first, lambda c: (F.length(c) <= 12) & ~c.contains("\n"))
    return (F.size(rows) >= 3) & (F.size(first) >= 2) & short & ~F.exists(first, X.end_punct)


def rendered(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown. blocks: doc_id, page_no, block, kind, rows, paras, as page.blocks_of() has them."""
    by = Window.partitionBy("doc_id").orderBy("page_no", "block")
    table, first = F.col("kind") == "table", F.get("rows", F.lit(0))
    some = blocks.filter(~table | (F.size("rows") > 1) | (F.get(first, F.lit(0)) != ""))
    rows = some.withColumn("_n", F.when(table, F.size(first)))
    goes_on = table & (F.col("block") == 0) & (F.lag("_n").over(by) == F.col("_n")) & (F.lag("page_no").over(by) == F.col("page_no") - 1)
    lines = lambda some: F.array_join(F.transform(some, table_line), "\n")
    headed = F.when(header_row(F.col("rows")), F.col("rows")).otherwise(F.concat(F.array(F.array_repeat(F.lit(""), F.col("_n"))), F.col("rows")))
    opened = F.concat(table_line(F.get(headed, F.lit(0))), F.lit("\n"), rule(first), F.lit("\n"), lines(F.slice(headed, 2, F.size("rows"))))
    whole = F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.lit("\n"), lines(F.col("rows")))).otherwise(F.concat(F.lit("\n\n"), opened))
    part = F.when(table, whole).otherwise(F.concat(F.lit("\n\n"), F.array_join(F.transform("paras", paragraph), "\n\n")))
    return _joined(rows.withColumn("part", part))


def _joined(parts: DataFrame) -> DataFrame:
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "block", "part"))), lambda s: s["part"]), "")
    return parts.groupBy("doc_id").agg(X.squeeze(F.regexp_replace(ordered, r"\A\n+", "")).alias("markdown"))


def escaped(t: str) -> str:
    t = t.rstrip()
    return f"\\{t}" if t[:1] in ("#", ">", "|") and t else t


def _row(cells: list[str], n: int) -> str:
    padded = [*cells, *[""] * (n - len(cells))]
    return "".join(["|", *(f" {c.strip().replace('|', chr(92) + '|').replace(chr(10), '<br>')} |" for c in padded), "\n"])


class Writer:
    """The parts of one document's text. A table that goes on takes back the blank line after its last row."""

    def __init__(self, name: str, lang: str, cfg: Config):
        self.folder, self.lang, self.cfg = f"{name}.assets".replace(" ", "%20"), lang, cfg
        self.parts = [f"# {escaped(name)}\n\n"]
        self.figures: list[bytes] = []
        self.open: tuple[int, int] | None = None  # columns and page of the table that may go on

    def continues(self, blocks: list[dict], page: int) -> bool:
        return bool(blocks) and blocks[0]["kind"] in ("table", "grid") and self.open == (len(columns_of(blocks[0])), page - 1)

    def table(self, rows: list[list[str]], goes_on: bool) -> None:
        n = max(map(len, rows))
        if goes_on:
            while self.parts and not (last := self.parts.pop().rstrip()):
                pass
            self.parts.append(last + "\n")
        else:
            head, rows = (rows[0], rows[1:]) if is_header_row(rows) else ([], rows)
            self.parts += [_row(head, n), f"|{' --- |' * n}\n"]
        self.parts += [*(_row(r, n) for r in rows), "\n"]

    def text(self, paras: list[dict], zero: float) -> None:
        for p in paras:
            if not p["text"].strip():
                continue
            own = look(p | {"text": p["text"].strip()}, None, zero, self.cfg)
            t, level = escaped(own.text.strip() if own.style == "glyph" else own.text), heading_level(own.text)
            if own.style in ("glyph", "bullet"):
                self.parts.append(f"{'  ' * own.indent}- {t}\n")
            elif level:
                self.parts.append(f"\n{'#' * (level + 1)} {t}\n\n")
            else:
                self.parts.append(f"\n## {t}\n\n" if p["center"] else f"{t}\n\n")
        if not "".join(self.parts[-2:]).endswith("\n\n"):
            self.parts.append("\n")

    def page(self, page: dict, zero: float) -> None:
        no, blocks = page["page_no"], page["blocks"]
        if page["error"] is not None:
            self.parts.append(f"> **{escaped(mark('failed', self.lang, no, page['error']))}**\n\n")
            self.open = None
            return
        if self.cfg.page_marker and not self.continues(blocks, no):
            self.parts.append(f"<!-- {mark('page', self.lang, no)} -->\n\n")
        for k, b in enumerate(blocks):
            if b["kind"] in ("table", "grid"):
                if lone(b["rows"]) and b["kind"] == "table" or not b["rows"]:
                    continue
                n = len(columns_of(b))
                self.table(b["rows"], k == 0 and self.open == (n, no - 1))
                self.open = (n, no)
                continue
            self.open = None
            if b["kind"] == "text":
                self.text(b["paras"], zero)
            else:
                self.figures.append(b["figure"]["png"])
                self.parts.append(f"![]({self.folder}/fig-{len(self.figures)}.png)\n\n")

    def done(self) -> str:
        return re.sub(r"\n{3,}", "\n\n", "".join(self.parts))


def columns_of(block: dict) -> list[float]:
    """Column starts; a grid has an edge more than columns."""
    return block["starts"][:-1] if block["kind"] == "grid" else block["starts"]


def books(pages: DataFrame, lang: str = "en", cfg: Config = Config()) -> DataFrame:
    """doc_id, markdown and the figures that it shows, of whole documents. pages: see sinks.books.books."""

    def make(name: str, some: list[dict]) -> tuple:
        writer, zero = Writer(name, lang, cfg), indent_zero(some, cfg)
        for page in some:
            writer.page(page, zero)
        return writer.done(), writer.figures

    return of_documents(pages, make, "markdown string, figures array<binary>")
