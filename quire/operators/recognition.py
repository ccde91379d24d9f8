"""Reading pages by a recogniser that is plugged in, and what follows one: greedy decoding, score filter, marker re-reads.

No model ships with this library. A recogniser is a class with the three methods of Recogniser; it is made once in each
Python worker, when the first page comes (or, with `lazy`, anew for each page, which saves memory between pages).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import adopted_marker
from quire.operators import detection, imaging

# Fixed values.
LEAST_SCORE, TURNED, WIDER = 0.5, 0.9, 1.5
_MARKER = re.compile(P.MARKER_RUN)


@dataclass(frozen=True)
class Options:
    """How recognisers are run. Options that a recogniser doesn't know are its own to ignore."""

    threads: int | None = None
    lazy: bool = False
    deterministic: bool = False
    most_side: int | None = None
    model: str | None = None


class Recogniser(Protocol):
    """The parts of a reader that need models."""

    alphabet: list[str]

    def detect(self, gray: np.ndarray) -> np.ndarray:
        """A map of text probabilities, of any size, over the page."""

    def upside_down(self, crops: list[np.ndarray]) -> np.ndarray:
        """The probability that each crop is turned by half."""

    def read(self, crops: list[np.ndarray], stretch: float) -> list[np.ndarray]:
        """For each crop its frames' class scores; class 0 is blank. stretch: how much wider than their shape crops are read."""


def greedy(frames: np.ndarray, alphabet: list[str]) -> tuple[str, float]:
    """Text and mean score of a greedy reading; the same as decoded()."""
    if not len(frames):
        return "", 0.0
    best = frames.argmax(1)
    kept = np.flatnonzero((best != 0) & (best != np.concatenate([[-1], best[:-1]])))
    return "".join(alphabet[k - 1] for k in best[kept]), float(frames[kept, best[kept]].mean()) if len(kept) else 0.0


def longer_marker(first: str, again: str) -> str:
    """The second reading, if it only lengthens the marker; the same as functions.text.adopted_marker()."""
    a, b = _MARKER.search(first), _MARKER.search(again)
    longer = a and b and len(b[1]) > len(a[1]) and a[1][0] == b[1][0] and first[len(a[1]) :] == again[len(b[1]) :]
    return again if longer else first


def in_batches(engine: Recogniser, crops: list[np.ndarray], stretch: float = 1.0) -> list[tuple[str, float]]:
    """Readings of crops, those of like shape together."""
    order = np.argsort([c.shape[1] / c.shape[0] for c in crops], kind="stable")
    out: list[tuple[str, float]] = [("", 0.0)] * len(crops)
    for a in range(0, len(order), detection.BATCH):
        some = order[a : a + detection.BATCH].tolist()
        for k, frames in zip(some, engine.read([crops[k] for k in some], stretch), strict=True):
            out[k] = greedy(np.asarray(frames), engine.alphabet)
    return out


def items_of(engine: Recogniser, gray: np.ndarray) -> list[tuple[str, float, float, float, float, float]]:
    """t, x0, y0, x1, y1 and score of a page's readings, in reading order."""
    page, kx, ky = detection.fitted(gray)
    quads = detection.quadrilaterals(np.asarray(engine.detect(page), np.float64), page.shape[1], page.shape[0])
    if not len(quads):
        return []
    crops = [detection.upright(detection.cropped(page, q)) for q in quads]
    turned = np.asarray(engine.upside_down(crops)) > TURNED
    crops = [np.rot90(c, 2) if t else c for c, t in zip(crops, turned.tolist(), strict=True)]
    read = in_batches(engine, crops)
    marked = [k for k, (t, _) in enumerate(read) if _MARKER.search(t)]
    for k, (again, _) in zip(marked, in_batches(engine, [crops[k] for k in marked], WIDER) if marked else [], strict=True):
        read[k] = (longer_marker(read[k][0], again), read[k][1])
    boxes = np.concatenate([quads.min(1), quads.max(1)], 1) * (kx, ky, kx, ky)
    return [(t, *box, s) for (t, s), box in zip(read, boxes.tolist(), strict=True) if t and s >= LEAST_SCORE]


ITEMS = "doc_id long, page_no int, seq int, t string, x0 double, y0 double, x1 double, y1 double, s double, error string"


def read_pages(pages: DataFrame, make: Callable[[Options], Recogniser], options: Options = Options()) -> DataFrame:
    """Items of page rasters (doc_id, page_no, w, h, px); a page that fails is one row with its error."""
    names = [c.split()[0] for c in ITEMS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                key = (r["doc_id"], r["page_no"])
                try:
                    engine = make(options) if engine is None or options.lazy else engine
                    rows = [(*key, n, *item, None) for n, item in enumerate(items_of(engine, imaging.raster(r["w"], r["h"], r["px"])))]
                except Exception as e:  # noqa: BLE001: the other pages go on
                    rows = [(*key, *[None] * 7, f"{type(e).__name__}: {e}")]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return pages.select("doc_id", "page_no", "w", "h", "px").mapInArrow(run, ITEMS)


def decoded(frames: Column, alphabet: Column) -> tuple[Column, Column]:
    """Text and mean score of a greedy reading. frames: for each step, the classes' scores; class 0 is blank.

    Equal neighbours count once, blanks are dropped; of equally scored classes the first is read.
    """
    best = F.transform(frames, lambda f: F.struct((F.array_position(f, F.array_max(f)) - 1).cast("int").alias("k"), F.array_max(f).alias("s")))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("s"))), best)  # one longer: the last pairs with nothing
    steps = F.filter(F.zip_with(best, before, lambda b, p: F.struct(b["k"].alias("k"), b["s"].alias("s"), p["k"].alias("before"))), lambda b: b["k"].isNotNull())
    kept = F.filter(steps, lambda b: (b["k"] != 0) & (b["k"] != b["before"]))
    text = F.array_join(F.transform(kept, lambda b: F.element_at(alphabet, b["k"])), "")
    score = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["s"]) / F.size(kept)).otherwise(0.0)
    return text, score


def accepted(items: DataFrame, scale: float, least: float = LEAST_SCORE) -> DataFrame:
    """Readings that aren't empty or weak, with coordinates back on the page."""
    return items.filter((F.col("t") != "") & (F.col("s") >= least)).withColumns({c: F.col(c) / scale for c in ("x0", "y0", "x1", "y1")})


def reread(items: DataFrame) -> DataFrame:
    """Items with their second reading (again) where that only lengthens the marker."""
    return items.withColumn("t", F.when(F.col("again").isNull(), F.col("t")).otherwise(adopted_marker(F.col("t"), F.col("again")))).drop("again")
