"""Pages of files, by a renderer that is plugged in: page sizes, rasters, the text layer and vector paths.

No renderer ships with this library but one for the PDF files that it writes itself (sinks.searchable_pdf), whose page
pictures it reads back. A file that can't be opened becomes one row with the problem, a page one with its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEAST_DPI, MOST_DPI, LONG_EDGE = 150, 300, 2560
PAGES = "path string, page_no int, w int, h int, px binary, rgb binary, chars array<struct<c string, generated boolean, ax double, ay double, bx double, by double, size double>>, paths array<struct<ax double, ay double, bx double, by double>>, problem string"


class Renderer(Protocol):
    """An open file."""

    def __len__(self) -> int: ...

    def page(self, k: int, long_edge: int) -> dict:
        """Page k (from 0) as columns of PAGES: w, h and px; rgb, chars and paths if there are any."""


def resolution(long_side: Column, long_edge: int = LONG_EDGE) -> Column:
    """Dots an inch for pages of this many points on the long side."""
    return F.least(F.greatest(F.round(F.lit(long_edge) / long_side * 72), F.lit(LEAST_DPI)), F.lit(MOST_DPI)).cast("int")


def pages(files: DataFrame, opened: Callable[[bytes], Renderer], long_edge: int = LONG_EDGE) -> DataFrame:
    """One row per page of the files (path, content), see PAGES; one file is open at a time and one page leaves at a time."""
    kinds = {"path": pa.string(), "page_no": pa.int32(), "w": pa.int32(), "h": pa.int32(), "px": pa.binary(), "rgb": pa.binary(), "problem": pa.string()}
    point = [(k, pa.float64()) for k in ("ax", "ay", "bx", "by")]
    kinds |= {"chars": pa.list_(pa.struct([("c", pa.string()), ("generated", pa.bool_()), *point, ("size", pa.float64())])), "paths": pa.list_(pa.struct(point))}
    schema = pa.schema([(name, kinds[name]) for name in re.findall(r"(?:^|, )(\w+) (?=string|int|binary|array)", PAGES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    file = opened(content)
                    n = len(file)
                except Exception as e:  # noqa: BLE001: the other files go on
                    yield pa.RecordBatch.from_pylist([{"path": path, "page_no": 0, "problem": f"{type(e).__name__}: {e}"}], schema)
                    continue
                for k in range(n):
                    row = {"path": path, "page_no": k + 1}
                    try:
                        row |= file.page(k, long_edge)
                    except Exception as e:  # noqa: BLE001: the other pages go on
                        row["problem"] = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(run, PAGES)


class OwnPdf:
    """Page pictures of PDF files that sinks.searchable_pdf writes."""

    _PICTURE = re.compile(rb"/Subtype /Image /Width (\d+) /Height (\d+) /ColorSpace /Device(Gray|RGB) /BitsPerComponent 8 /Filter /FlateDecode /Length (\d+) >>\nstream\n")

    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF file")
        self.content, self.found = content, list(self._PICTURE.finditer(content))

    def __len__(self) -> int:
        return len(self.found)

    def page(self, k: int, long_edge: int) -> dict:
        m = self.found[k]
        w, h, size = int(m[1]), int(m[2]), int(m[4])
        px = zlib.decompress(self.content[m.end() : m.end() + size])
        return {"w": w, "h": h, "px" if m[3] == b"Gray" else "rgb": px}
