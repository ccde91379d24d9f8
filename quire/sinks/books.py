"""What the outputs of a whole document share: its pages in order, its indents, its tables over pages, and paragraph looks.

A document's file is one, so its pages (operators.compose.pages_of) are one group of a streamed fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import SAME_GRID, SAME_TABLE, Config
from quire.functions import interface
from quire.functions import patterns as P
from quire.operators.crosspage import close, merged_tiers, zero_of
from quire.operators.page import is_header_row
from quire.operators.styles import CENTER_SIZE, HEAD_SIZE, SUBHEAD_END, SUBHEAD_LENGTH
from quire.plans.folding import folded

_BULLET, _END, _START, _SENTENCE = P.python(P.BULLET), P.python(P.END_PUNCT), P.python(P.NUM_START), P.python(P.SENTENCE)
#: Pattern, length below which it holds, and level of a heading, in order.
_HEADINGS = [(P.python(P.HEADING_LETTER), 70, 1), (P.python(P.HEADING_NUMBER), 90, 2), (P.python(P.HEADING_HAN), 60, 2), (P.python(P.HEADING_DOTTED), 90, 3), (P.python(P.HEADING_PLAIN), 70, 3)]
_DOTTED = P.python(P.HEADING_NOT)
_NUMBER, _ZERO, _TERM = P.python(P.NUMBER), P.python(P.LEADING_ZERO), P.python(P.SIMPLE_TERM)


def mark(key: str, lang: str, *args: object) -> str:
    """The output text of a key in a language; see functions.interface.mark."""
    template = interface.MARKS[key].get(lang, interface.MARKS[key]["zh"])
    return re.sub(r"\{([0-9]+)\}", lambda m: str(args[int(m[1])]) if int(m[1]) < len(args) else "", template)


def heading_level(text: str) -> int | None:
    t = text.strip()
    if _SENTENCE.search(t):
        return None
    return next((level for pattern, most, level in _HEADINGS if len(t) < most and pattern.search(t) and not (pattern is _HEADINGS[1][0] and _DOTTED.search(t))), None)


def flat_text(t: str) -> str:
    """Fractions as a/b, with brackets around compound terms; see functions.text.flat_text."""
    plain, *rest = t.split(P.FRACTION)
    out = [plain]
    for k in range(0, len(rest) - 1, 3):
        up, low = (x if _TERM.search(x) else f"({x})" for x in rest[k : k + 2])
        out += [f"{up}/{low}", *rest[k + 2 : k + 3]]
    return "".join(out)


def cell_value(t: str) -> tuple[float | None, str | None, str]:
    """A cell's number and number format, if it is a number, and its text."""
    t = flat_text(t)
    s = t.strip()
    if not _NUMBER.search(s) or _ZERO.search(s):
        return None, None, t
    decimals = len(s.partition(".")[2])
    return float(s), "0." + "0" * decimals if decimals else None, t


def lone(rows: list[list[str]]) -> bool:
    """A table of no row, or of one row without a first cell: text that drifted here from the page before."""
    return not rows or len(rows) == 1 and not rows[0][0]


@dataclass(frozen=True)
class Look:
    """How a paragraph is set: its style, text without a bullet's glyph, indent, size, weight and side."""

    style: str
    text: str
    indent: int
    size: float
    bold: bool
    align: str


def look(p: dict, after: dict | None, zero: float, cfg: Config) -> Look:
    """The look of a paragraph. after: the next one of its block."""
    t = p["text"]
    steps = round_half_up((p["cx0"] - zero) / cfg.ind_step)
    indent = min(max(steps, 0), cfg.ind_max)
    plain = lambda style, text, at=indent, size=cfg.font_size, bold=False, align="left": Look(style, text, at, size, bold, align)
    level = heading_level(t)
    if glyph := _BULLET.search(t):
        return plain("glyph", t[glyph.end() :])
    if p["bullet"]:
        return plain("bullet", t)
    if steps > cfg.ind_max and p["rx1"] - p["cx0"] < 0.25:
        return plain("right", t, 0, align="right")
    if level:
        return plain("heading", t, size=HEAD_SIZE - level, bold=True)
    if p["rx1"] < SUBHEAD_END and len(t) < SUBHEAD_LENGTH and after and after["rx1"] > cfg.full_line and not _END.search(t) and not _START.search(t):
        return plain("subheading", t, 0, bold=True)
    return plain("center", t, 0, CENTER_SIZE, True, "center") if p["center"] else plain("plain", t)


def round_half_up(x: float) -> int:
    """Halves away from zero."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def indent_zero(pages: list[dict], cfg: Config) -> float:
    """The zero of indents, from the text lines of all pages."""
    return zero_of(merged_tiers([[x for b in page["blocks"] if b["kind"] == "text" for x in b["indents"]] for page in pages], cfg.ind_step))


@dataclass
class Open:
    """The table that the next page may go on with."""

    kind: str
    starts: list[float]
    page: int
    header: bool
    table: object

    def goes_on(self, block: dict, page: int) -> bool:
        """By kind, page, and close column starts."""
        return block["kind"] == self.kind and page == self.page + 1 and close(self.starts, block["starts"], SAME_GRID if self.kind == "grid" else SAME_TABLE)


def books(pages: DataFrame, make: Callable[[str, list[dict]], tuple], schema: str) -> DataFrame:
    """doc_id and what `make` gives for a document's name and pages. pages: see compose.PAGES, and name if documents have names."""
    name = F.col("name") if "name" in pages.columns else F.col("doc_id").cast("string")
    rows = pages.select("doc_id", "page_no", "w", "h", "error", "blocks", name.alias("name"))

    def one(key: tuple, some: list[tuple]) -> list[tuple]:
        found = [dict(zip(("page_no", "w", "h", "error", "blocks"), r[:5], strict=True)) | {"blocks": r[4] or []} for r in some]
        return [(*key, *make(some[0][5] or str(key[0]), found))]

    return folded(rows, ["doc_id"], ["page_no"], one, f"doc_id long, {schema}")


__all__ = ["Look", "Open", "books", "cell_value", "flat_text", "heading_level", "indent_zero", "is_header_row", "lone", "look", "mark"]
