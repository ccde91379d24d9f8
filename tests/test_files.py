"""Outputs are read back; rasters are measured again."""

import numpy as np
import pytest
from quire.config import Config
from quire.operators import grids, imaging, recognition
from quire.operators.page import Box
from quire.plans import catalogue
from quire.sinks import document, searchable_pdf
from quire.sinks.books import Look


def test_word_reads_back():
    mark, cfg = "\ue000", Config()
    plain = lambda t: document.paragraph(Look("plain", t, 0, 10.5, False, "left"), cfg)
    table = document.Table([1000, 1000], False)
    table.rows = [document.row([document.cell(t, 1000, cfg, 10) for t in r], header=k == 0) for k, r in enumerate([["h", "i"], ["1\n2", "3"]])]
    paras, tables = document.read_back(document.packed(plain("a <b> & c") + plain(f"x {mark}1{mark}2{mark} y") + table.xml(), [], cfg))
    assert paras == ["a <b> & c", "x 12 y"] and tables == [[["h", "i"], ["1\n2", "3"]]]
    assert table.xml().count("<w:tblHeader") == 1


def test_spans_in_word():
    cells = [(0, 0, 2, 1, "tall", [True] * 4), (0, 1, 1, 2, "wide", [True, False, True, True]), (1, 1, 1, 1, "x", [True] * 4), (1, 2, 1, 1, "y", [True] * 4)]
    block = {"kind": "grid", "rows": [["tall", "wide", ""], ["", "x", "y"]], "cells": [dict(zip(("r", "c", "h", "w", "text", "edges"), c, strict=True)) for c in cells]}
    table = document.Table([500, 500, 500], True)
    table.rows = document.Writer([], "en", Config()).ruled_rows(block, table.widths, False)
    xml = table.xml()
    assert xml.count("<w:vMerge") == 2 and '<w:gridSpan w:val="2"/>' in xml
    assert document.read_back(document.packed(xml, [], Config()))[1] == [[["tall", "wide"], ["", "x", "y"]]]


def test_pdf_reads_back():
    blob = searchable_pdf.pdf([(100, 200, bytes(20000), [("Grüße 中文", 10, 20, 60, 30)]), (100, 200, None, [("b", 1, 2, 3, 4), ("\x07", 1, 2, 3, 4)])])
    assert searchable_pdf.texts(blob) == [["Grüße 中文"], ["b"]]
    at = int(blob.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert blob[at : at + 4] == b"xref"
    for n, line in enumerate(blob[at:].split(b"\n")[3:], 1):
        if not line.endswith(b"n "):
            break
        assert blob[int(line[:10]) :].startswith(b"%d 0 obj" % n)


def bars() -> np.ndarray:
    page = np.full((800, 600), 255, np.uint8)
    for k in range(20):
        page[100 + 30 * k : 108 + 30 * k, 60:540] = 0
    return page


@pytest.mark.parametrize("degrees", [-2.0, -0.7, 0.0, 1.1, 2.6])
def test_skew_is_found_and_undone(degrees):
    turned = imaging.rotated(bars(), degrees)
    assert abs(imaging.skew(turned) - degrees) <= 0.2
    straight, _ = imaging.straightened(turned)
    assert abs(imaging.skew(straight)) <= 0.2


def test_shading_is_divided_out():
    light = np.linspace(250, 140, 600, dtype=np.float32)[None, :].repeat(400, 0)
    flat, spread = imaging.flattened(light.astype(np.uint8))
    assert spread >= imaging.FLAT and min(flat[:, :60].mean(), flat[:, -60:].mean()) > 235 and abs(flat[:, :60].mean() - flat[:, -60:].mean()) < 10
    assert imaging.flattened(np.full((400, 600), 200, np.uint8))[1] == 0
    assert imaging.flattened(np.zeros((50, 600), np.uint8))[1] == 0


def test_opening_and_components():
    bits = np.zeros((6, 12), bool)
    bits[1, 1:9] = bits[3, 2:4] = bits[4, 4] = True
    assert imaging.opened(bits, True, 3).sum() == 8 and (imaging.opened(bits, True, 0) == bits).all()
    assert imaging.blobs(bits) == [(1, 1, 8, 1, 8), (2, 3, 3, 2, 3)]  # a corner links
    rng = np.random.default_rng(0)
    noise = rng.random((30, 40)) < 0.4
    seen, found = np.zeros_like(noise), []
    for y, x in zip(*np.nonzero(noise), strict=True):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            own.append((a, b))
            for i in range(max(0, a - 1), min(30, a + 2)):
                for j in range(max(0, b - 1), min(40, b + 2)):
                    if noise[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
        ys, xs = zip(*own, strict=True)
        found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    assert sorted(imaging.blobs(noise)) == sorted(found)


def test_merged_cells():
    hs = [(100.0, 900.0, y) for y in (100.0, 200.0, 300.0)]
    vs = [(100.0, 300.0, 100.0), (200.0, 300.0, 500.0), (100.0, 300.0, 900.0)]
    (grid,) = grids.grids_of(hs, vs, [], 1000.0, 5.0)
    assert [(c.r, c.c, c.h, c.w) for c in grid.cells] == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)] and grid.merged == 1
    grids.filled(grid, [Box("head", 400, 140, 480, 160), Box("left", 120, 240, 200, 260), Box("a", 520, 230, 880, 250), Box("b", 520, 255, 600, 275)])
    assert [c.text for c in grid.cells] == ["head", "left", "a b"]


def test_open_sides():
    hs = [(0.0, 900.0, y) for y in (100.0, 200.0, 300.0)]
    vs = [(100.0, 300.0, x) for x in (300.0, 600.0)]
    assert len(grids.grids_of(hs, vs, [], 1200.0, 5.0)[0].xs) == 2
    text = [Box("l", 100, 140, 200, 160), Box("r", 700, 140, 800, 160)]
    assert grids.grids_of(hs, vs, text, 1200.0, 5.0)[0].xs == [0.0, 300.0, 600.0, 900.0]


def test_broken_bars_and_covered_rules():
    assert grids.stitched([(0, 50, 10), (52, 100, 12), (300, 400, 10)], 5) == [(0, 100, 11.0), (300, 400, 10)]
    assert grids.off_text([(380, 438, 1018)], [(184, 664, 1002, 1049)]) == []
    assert grids.off_text([(161, 1615, 986)], [(161, 1615, 925, 986)]) == [(161, 1615, 986)]


def test_decoding(spark):
    from pyspark.sql import functions as F

    rows = [([[0.1, 0.8, 0.1], [0.1, 0.7, 0.2], [0.9, 0.0, 0.1], [0.1, 0.6, 0.3], [0.2, 0.4, 0.4], [0.0, 0.1, 0.9]],), ([],)]
    text, score = recognition.decoded(F.col("f"), F.array(F.lit("a"), F.lit("b")))
    found = spark.createDataFrame(rows, "f array<array<double>>").select(text.alias("t"), score.alias("s")).collect()
    assert found[0].t == "aab" and found[0].s == pytest.approx((0.8 + 0.6 + 0.9) / 3) and found[1].t == "" and found[1].s == 0


def test_markers(spark):
    from quire.functions import text as X

    rows = [("ii. x", "iii. x"), ("ii. x", "iii. y"), ("ii. x", "ll. x"), ("a. x", "iii. x")]
    found = spark.createDataFrame(rows, "a string, b string")
    assert [r.t for r in found.select(X.adopted_marker(found.a, found.b).alias("t")).collect()] == ["iii. x", "ii. x", "ii. x", "a. x"]


def test_fractions(spark):
    from quire.functions import text as X

    m = ""
    found = spark.createDataFrame([("plain",), (f"x{m}1{m}2{m}y",), (f"{m}a + b{m}c{m}",)], "t string")
    assert [r.t for r in found.select(X.flat_text(found.t).alias("t")).collect()] == ["plain", "x1/2y", "(a + b)/c"]


def test_word_of_pages(spark):
    from quire.operators import crosspage, page

    blocks = page.blocks_of(catalogue.order_lines(spark, "/root/testdata/sf0.001"), 1024, 2048)
    numbered = blocks.join(crosspage.continued(blocks).select("doc_id", "page_no", "block", "table_no"), ["doc_id", "page_no", "block"], "left")
    rows = sum(len(t) for r in document.documents(numbered).collect() for t in document.read_back(r.content)[1])
    assert rows == catalogue.table_roundtrip_lineitem(spark, "/root/testdata/sf0.001").count()
