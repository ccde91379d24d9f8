"""State across pages: table continuation after each output's policy, and document-wide indent tiers.

A document's page starts are the group (bounded by its pages); the folds carry one open table.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import IND_MIN_HITS, SAME_GRID, SAME_TABLE
from quire.plans.folding import folded


def close(a: list[float], b: list[float], tol: float) -> bool:
    return len(a) == len(b) and all(abs(x - y) < tol for x, y in zip(a, b, strict=True))


Blocks = list[tuple[str, list[float]]] | None


@dataclass
class Anchors:
    """The word-processor policy, a page at a time; also the state of a stream.

    Only a page's first block can go on. It is compared with the table's first piece. Text closes a grid but leaves a
    borderless table open, a figure or a failed page closes both, and a grid closes a borderless table and the other way
    round. held: by kind, the table's number, the starts of its first piece, and the last page.
    """

    number: int = 0
    held: dict[str, tuple[int, list[float], int]] = field(default_factory=dict)

    def page(self, page: int, blocks: Blocks) -> list[tuple[int, int, str, int]]:
        """(page, block, kind, table number) of the page's tables. blocks: kind and starts, or None for a failed page."""
        out = []
        for k, (kind, starts) in enumerate([("figure", [])] if blocks is None else blocks):
            if kind in ("table", "grid"):
                number, first, last = self.held.get(kind, (0, [], 0))
                if k or not number or last != page - 1 or not close(first, starts, SAME_GRID if kind == "grid" else SAME_TABLE):
                    self.number += 1
                    number, first = self.number, starts
                self.held = {kind: (number, first, page)}
                out.append((page, k, kind, number))
            elif kind == "text":
                self.held.pop("grid", None)
            else:
                self.held = {}
        return out


def anchored_pieces(pages: list[tuple[int, Blocks]]) -> list[tuple[int, int, str, int]]:
    """The tables of pages, by number, after the policy of Anchors."""
    state = Anchors()
    return [piece for page, blocks in pages for piece in state.page(page, blocks)]


def counted_pieces(pages: list[tuple[int, Blocks]]) -> list[tuple[int, int, str, int]]:
    """The same by the Markdown policy: only the column count matters, grids and tables are alike, text and figures close."""
    held: tuple[int, int, int] | None = None  # number, columns, page
    out, number = [], 0
    for page, blocks in pages:
        if blocks is None:
            held = None
            continue
        for k, (kind, starts) in enumerate(blocks):
            if kind not in ("table", "grid"):
                held = None
                continue
            if not (k == 0 and held and held[1:] == (len(starts), page - 1)):
                number += 1
                held = (number, len(starts), page)
            held = (held[0], len(starts), page)
            out.append((page, k, kind, held[0]))
    return out


def continued(blocks: DataFrame, policy=anchored_pieces) -> DataFrame:
    """doc_id, page_no, block, kind, table_no. blocks: doc_id, page_no, block, kind, starts; kind `failed` marks a failed page."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        pages = []
        for number, some in groupby(rows, key=lambda r: r[0]):
            own = [(kind, starts or []) for _, _, kind, starts in some if kind != "empty"]
            pages.append((number, None if any(kind == "failed" for kind, _ in own) else own))
        return [(*key, *r) for r in policy(pages)]

    return folded(blocks.select("doc_id", "page_no", "block", "kind", "starts"), ["doc_id"], ["page_no", "block"], one, "doc_id long, page_no int, block int, kind string, table_no int")


def merged_tiers(pages: list[list[float]], step: float) -> list[tuple[float, int]]:
    """Indent tiers by place, with their hits: pages in order, starts of a page ascending.

    A start within half a step of a tier belongs to it (the leftmost such tier); a tier stays where its first start is.
    """
    place: list[float] = []
    hits: list[int] = []
    for starts in pages:
        for x in sorted(starts):
            k = bisect_left(place, x - step / 2)
            if k < len(place) and place[k] <= x + step / 2:
                hits[k] += 1
            else:
                place.insert(k, x)
                hits.insert(k, 1)
    return list(zip(place, hits, strict=True))


def tiers(starts: list[float], step: float) -> list[tuple[float, int]]:
    """The tiers of one page."""
    return merged_tiers([starts], step)


def zero_of(found: list[tuple[float, int]]) -> float:
    """The leftmost tier with enough hits, else the leftmost, else 0."""
    return next((x for x, n in found if n >= IND_MIN_HITS), found[0][0] if found else 0.0)


def indent_zero(lines: DataFrame, step: float = 0.035) -> DataFrame:
    """Each document's zero of indents, from the text lines of all its pages (doc_id, page_no, cx0): the first of two passes."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, zero_of(merged_tiers([[x for _, x in some] for _, some in groupby(rows, key=lambda r: r[0])], step)))]

    return folded(lines.select("doc_id", "page_no", "cx0"), ["doc_id"], ["page_no", "cx0"], one, "doc_id long, zero double")


def indented(paras: DataFrame, lines: DataFrame, step: float = 0.035, most: int = 15) -> DataFrame:
    """Paragraphs with their indent level and whether they are right-aligned: the second pass. lines: of text blocks, see indent_zero()."""
    joined = paras.join(indent_zero(lines, step), "doc_id", "left")
    raw = F.round((F.col("cx0") - F.coalesce("zero", F.lit(0.0))) / step)
    return joined.withColumn("level", F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(most))).cast("int")).withColumn("right", (raw > most) & (F.col("rx1") - F.col("cx0") < 0.25))
