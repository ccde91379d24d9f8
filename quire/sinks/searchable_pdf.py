"""Searchable PDF: each page is its picture with invisible text over it. Bytes are built by hand.

Pictures are made page by page (JPEG, or without loss), so that a document's file is put together from small parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.folding import folded
from quire.sinks.jpeg import jpeg

# Fixed values.
BASELINE, LEAST_STRETCH, MOST_STRETCH, QUALITY = 0.15, 10.0, 400.0, 90


def placed(x0: float, y0: float, x1: float, y1: float, n: int, kx: float, ky: float, height: float) -> tuple[float, float, float, float]:
    """Size, horizontal stretch, x and baseline of a text of n characters. kx, ky: points for each pixel; height in points."""
    size = max((y1 - y0) * ky, 1.0)
    return size, min(max(100 * (x1 - x0) * kx / (max(n, 1) * size), LEAST_STRETCH), MOST_STRETCH), x0 * kx, height - y1 * ky + BASELINE * size


def placement(kx: Column, ky: Column, height: Column) -> dict[str, Column]:
    """The same as columns, of items with t, x0, y0, x1, y1."""
    size = F.greatest((F.col("y1") - F.col("y0")) * ky, F.lit(1.0))
    stretch = F.least(F.greatest(100 * (F.col("x1") - F.col("x0")) * kx / (F.greatest(F.length("t"), F.lit(1)) * size), F.lit(LEAST_STRETCH)), F.lit(MOST_STRETCH))
    return {"size": size, "stretch": stretch, "x": F.col("x0") * kx, "baseline": height - F.col("y1") * ky + BASELINE * size}


def hexed(t: str) -> str:
    return "".join(c for c in t if c.isprintable() or c == " ").encode("utf-16-be", "replace").hex().upper()


@dataclass(frozen=True)
class Picture:
    """Bytes of a page picture, its channels, and the filter that reads them."""

    data: bytes
    channels: int
    filter: str

    @property
    def head(self) -> bytes:
        return f"/ColorSpace /Device{'Gray' if self.channels == 1 else 'RGB'} /BitsPerComponent 8 /Filter /{self.filter}".encode()


def picture(w: int, h: int, px: bytes, quality: int | None = QUALITY) -> Picture:
    """Of gray (w * h bytes) or colour pixels. quality: of JPEG, None without loss."""
    n = len(px) // (w * h)
    if quality is None:
        return Picture(zlib.compress(px), n, "FlateDecode")
    return Picture(jpeg(np.frombuffer(px, np.uint8).reshape((h, w) if n == 1 else (h, w, 3)), quality), n, "DCTDecode")


def pdf(pages: list[tuple[int, int, bytes | Picture | None, list[tuple]]], dpi: float = 150.0, quality: int | None = QUALITY) -> bytes:
    """pages: width, height, pixels or a picture or None, and items (t, x0, y0, x1, y1) in pixels."""
    k = 72.0 / dpi
    objects: list[bytes] = [b"", b""]
    add = lambda body: (objects.append(body), len(objects))[1]
    stream = lambda head, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)
    cmap = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end"
    unicode = add(stream(b"", cmap))
    inner = add(b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 4 >> /DW 1000 >>")
    font = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, unicode))
    kids = []
    for w, h, px, items in pages:
        out = [f"q {w * k:.3f} 0 0 {h * k:.3f} 0 0 cm /Im Do Q"] if px is not None else []
        out.append("BT 3 Tr")
        for t, *box in items:
            if code := hexed(t):
                size, stretch, x, y = placed(*box, len(t), k, k, h * k)
                out.append(f"/F {size:.3f} Tf {stretch:.2f} Tz 1 0 0 1 {x:.3f} {y:.3f} Tm <{code}> Tj")
        out.append("ET")
        made = picture(w, h, px, quality) if isinstance(px, bytes) else px
        image = b"/XObject << /Im %d 0 R >>" % add(stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d " % (w, h) + made.head, made.data)) if made else b""
        content = add(stream(b"/Filter /FlateDecode", zlib.compress("\n".join(out).encode())))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Resources << /Font << /F %d 0 R >> %s >> /Contents %d 0 R >>" % (w * k, h * k, font, image, content)))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % n for n in kids))
    data, offsets = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        offsets.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(data)
    data += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(data + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def texts(blob: bytes) -> list[list[str]]:
    """The texts of each page, read back from the content streams."""
    out = []
    for m in re.finditer(rb"<< /Filter /FlateDecode /Length (\d+) >>\nstream\n", blob):
        body = zlib.decompress(blob[m.end() : m.end() + int(m[1])])
        out.append([bytes.fromhex(x.decode()).decode("utf-16-be") for x in re.findall(rb"<([0-9A-F]*)> Tj", body)])
    return out


def page_numbers(blob: bytes) -> range:
    """Pages of a file, from 1."""
    return range(1, len(re.findall(rb"/Type /Page /Parent", blob)) + 1)


def documents(items: DataFrame, width: int, height: int) -> DataFrame:
    """doc_id, content: text-only pages of one size. A document is one group, as its file is one."""

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        pages: dict[int, list[tuple]] = {}
        for page, _, *item in rows:
            pages.setdefault(page, []).append(tuple(item))
        return [(*key, pdf([(width, height, None, pages[p]) for p in sorted(pages)]))]

    return folded(items.select("doc_id", "page_no", "seq", "t", "x0", "y0", "x1", "y1"), ["doc_id"], ["page_no", "seq"], one, "doc_id long, content binary")


def books(pages: DataFrame, items: DataFrame, dpi: float = 150.0, quality: int | None = QUALITY) -> DataFrame:
    """doc_id, content of whole documents; a page that couldn't be read keeps its picture, without text.

    pages: doc_id, page_no, w, h, px (gray) and, where there is colour, rgb. items: doc_id, page_no, seq, t, x0, y0, x1, y1.
    """
    rgb = F.col("rgb") if "rgb" in pages.columns else F.lit(None).cast("binary").alias("rgb")
    names, kinds = ["doc_id", "page_no", "w", "h", "data", "channels", "filter"], [pa.int64(), *[pa.int32()] * 3, pa.binary(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a raster at a time
                (r,) = batch.slice(k, 1).to_pylist()
                px = r["rgb"] if r["rgb"] is not None else r["px"]
                whole = px is not None and len(px) in (r["w"] * r["h"], 3 * r["w"] * r["h"])
                made = picture(r["w"], r["h"], px, quality) if whole and px else None
                row = [r["doc_id"], r["page_no"], r["w"], r["h"], *((made.data, made.channels, made.filter) if made else (None, 0, None))]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    made = pages.select("doc_id", "page_no", "w", "h", "px", rgb).mapInArrow(run, "doc_id long, page_no int, w int, h int, data binary, channels int, filter string")
    texts = items.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "t", "x0", "y0", "x1", "y1"))).alias("items"))

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        parts = [(w, h, Picture(data, n, kind) if data is not None else None, [tuple(i[c] for c in ("t", "x0", "y0", "x1", "y1")) for i in some or []]) for _, w, h, data, n, kind, some in rows]
        return [(*key, pdf(parts, dpi))]

    return folded(made.join(texts, ["doc_id", "page_no"], "left"), ["doc_id"], ["page_no"], one, "doc_id long, content binary")
