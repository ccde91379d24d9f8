"""Figures, fractions, looks, texts and the queue on small fixtures."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from quire.functions import interface
from quire.functions.patterns import FRACTION
from quire.operators import figures, styles
from quire.operators.page import Box, Line
from quire.sources import jobs


def paper(h: int = 1600, w: int = 1200) -> np.ndarray:
    return np.full((h, w), 255, np.uint8)


def ring(page: np.ndarray, cx: int, cy: int, r: int = 110) -> np.ndarray:
    y, x = np.mgrid[0 : page.shape[0], 0 : page.shape[1]]
    d = np.hypot(x - cx, y - cy)
    page[(d <= r) & (d >= r - 6)] = 0
    return page


def test_ring_is_found_and_cropped(spark):
    page = ring(paper(), 800, 900)
    (box,) = figures.found(page, [], [])
    assert abs(box[0] - 690) <= 6 and abs(box[1] - 790) <= 6 and abs(box[2] - 911) <= 6 and abs(box[3] - 1011) <= 6
    rows = spark.createDataFrame([(1, 1, 1200, 1600, bytearray(page.tobytes()), None)], "doc_id long, page_no int, w int, h int, px binary, boxes array<struct<t string, x0 double, y0 double, x1 double, y1 double>>")
    (row,) = figures.figures_of(rows).collect()
    assert (figures.unpng(row.png) == page[row.y0 : row.y1, row.x0 : row.x1]).all()
    assert figures.figures_of(rows.limit(0)).collect() == []


def test_ring_over_text_and_near_parts():
    page = ring(paper(), 800, 900)
    page[890:910, 700:900] = 0
    assert len(figures.found(page, [Box("字", 700, 890, 900, 910)], [])) == 1
    assert len(figures.found(ring(ring(paper(), 400, 900, 60), 540, 900, 60), [], [])) == 1
    assert len(figures.found(ring(ring(paper(), 300, 900, 60), 800, 900, 60), [], [])) == 2


def test_what_is_no_figure():
    ruled = paper()
    ruled[800:803, 100:1100] = 0
    ruled[300:1300, 600:603] = 0
    assert figures.found(ruled, [], []) == []
    specks = paper()
    specks[::200, ::200] = 0
    assert figures.found(specks, [], []) == []
    assert figures.found(np.zeros((1600, 1200), np.uint8), [], []) == []
    assert figures.found(ring(paper(), 800, 100, 60), [], []) == []  # header
    assert figures.found(ring(paper(), 800, 900), [], [(600.0, 700.0, 1000.0, 1100.0)]) == []  # inside a table
    assert figures.found(np.zeros((0, 0), np.uint8), [], []) == []


def test_clumps_do_not_depend_on_order():
    rng = np.random.default_rng(5)
    rects = [(int(x), int(y), int(x) + int(w), int(y) + int(h)) for x, y, w, h in zip(rng.integers(0, 900, 60), rng.integers(0, 900, 60), rng.integers(1, 60, 60), rng.integers(1, 60, 60), strict=True)]
    once = sorted(figures.clumped(rects, 10))
    assert once == sorted(figures.clumped(rects[::-1], 10)) and 1 < len(once) < 60
    apart = lambda a, b: not (a[0] < b[2] + 10 and b[0] < a[2] + 10 and a[1] < b[3] + 10 and b[1] < a[3] + 10)
    assert all(apart(a, b) for k, a in enumerate(once) for b in once[:k])


def fraction(bar: bool) -> list[Box]:
    page = paper(400, 400)
    if bar:
        page[100:102, 98:142] = 0
    boxes = [Box("y =", 0.1, 0.23, 0.2, 0.28), Box("1", 0.25, 0.19, 0.35, 0.24), Box("2", 0.25, 0.265, 0.35, 0.31)]
    return figures.with_fractions(Line(0.19, 0.31, boxes), page).boxes


def test_fractions_need_a_bar():
    assert [b.t for b in fraction(True)] == ["y =", f"{FRACTION}1{FRACTION}2{FRACTION}"]
    assert [b.t for b in fraction(False)] == ["y =", "1", "2"]


def test_figures_between_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, 0, 10.0), (1, 1, 1, 50.0), (1, 1, 2, 30.0), (1, 1, 3, 70.0)], "doc_id long, page_no int, block int, y0 double")
    figs = spark.createDataFrame([(1, 1, 0, 40.0), (1, 1, 1, 50.0), (1, 1, 2, 90.0)], "doc_id long, page_no int, figure int, y0 double")
    found = [(r.kind, r.number) for r in figures.interleaved(blocks, figs).orderBy("at").collect()]
    assert found == [("block", 0), ("figure", 0), ("block", 1), ("block", 2), ("figure", 1), ("block", 3), ("figure", 2)]


def test_paragraph_looks(spark):
    rows = [
        (1, 1, 0, "• item", 0.5, False, False, 1, False, ("glyph", "item", 10.5, False, "left", 1)),
        (1, 1, 1, "listed", 0.5, False, True, 2, False, ("bullet", "listed", 10.5, False, "left", 2)),
        (1, 1, 2, "p. 3", 0.95, False, False, 15, True, ("right", "p. 3", 10.5, False, "right", 0)),
        (1, 1, 3, "A. Scope", 0.3, False, False, 0, False, ("heading", "A. Scope", 11.0, True, "left", 0)),
        (1, 1, 4, "Background", 0.3, False, False, 3, False, ("subheading", "Background", 10.5, True, "left", 0)),
        (1, 1, 5, "A long line that reaches", 0.9, True, False, 0, False, ("center", "A long line that reaches", 13.0, True, "center", 0)),
        (1, 1, 6, "last", 0.3, False, False, 1, False, ("plain", "last", 10.5, False, "left", 1)),
    ]
    df = spark.createDataFrame([r[:9] for r in rows], "doc_id long, page_no int, para int, text string, rx1 double, center boolean, bullet boolean, level int, right boolean")
    found = styles.styled(df).orderBy("para").select("style", "body", "size", "bold", "align", "left").collect()
    assert [tuple(r) for r in found] == [r[9] for r in rows]


def test_widths(spark):
    one = spark.range(1)
    assert one.select(styles.table_widths(F.array(F.lit(0.1), F.lit(0.4)), 9000.0)).first()[0] == [3000, 6000]
    assert one.select(styles.table_widths(F.array(F.lit(0.1), F.lit(0.11)), 9000.0)).first()[0][0] == round(1.2 * 567)
    assert one.select(styles.grid_widths(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.8)), 9000.0)).first()[0] == [3000, 6000]
    assert [r[0] for r in spark.createDataFrame([(700,), (100,), (450,)], "x int").select(figures.alignment(F.col("x"), F.col("x") + 100, F.lit(1000))).collect()] == ["right", "left", "center"]


def test_languages_and_templates(spark):
    tags = {"zh": "zh", "zh_TW.UTF-8": "zh-Hant", "zh-Hans-SG": "zh", "zh-HK": "zh-Hant", "EN_us": "en", "fr": None, "": None, "de": "de"}
    df = spark.createDataFrame([(k,) for k in tags], "t string")
    assert {r[0]: r[1] for r in df.select("t", interface.language(F.col("t"))).collect()} == tags
    cases = [(None, "de_DE.UTF-8:en", "de"), ("C", "", "zh"), ("fr_FR", "de", "en"), (None, None, "zh")]
    found = spark.createDataFrame(cases, "a string, b string, want string").select(interface.detected(F.col("a"), F.col("b")), "want").collect()
    assert all(r[0] == r[1] for r in found)
    fills = [("{1} of {0}", "b of a{1}"), ("{x} {} {9} {", "{x} {}  {"), ("", ""), ("{0}{0}", "a{1}a{1}"), ("{99999999999}z", "z")]
    made = spark.createDataFrame(fills, "t string, want string").select(interface.fill(F.col("t"), F.lit("a{1}"), F.lit("b")), "want").collect()
    assert all(r[0] == r[1] for r in made)
    assert spark.range(1).select(interface.mark("pages", F.lit("en"), F.lit(3), F.lit(5))).first()[0] == "—— pages 3–5 of the original ——"
    assert all(set(m) == set(interface.LANGUAGES) for m in interface.MARKS.values())
    assert spark.range(1).select(interface.one_line(F.lit(" a\n b  c "), 3), interface.kilobytes(F.lit(2047)), interface.megabytes(F.lit(13_540_000))).first() == ("a b…", 1, "13.5 MB")


def test_queue(spark):
    paths = spark.createDataFrame([("/a.pdf",), ("/b.PDF",), ("/b.PDF",), ("/c.txt",), ("/d.pdf",)], "path string")
    queued = spark.createDataFrame([("/d.pdf",)], "path string")
    assert tuple(jobs.addition(paths, queued).first()) == (2, 2, 1)
    assert tuple(jobs.addition(paths.limit(0), queued).first()) == (0, 0, 0)
    work = spark.createDataFrame([(1, "failed", None), (2, "failed", "md"), (3, "done", None)], "job int, status string, formats string")
    assert [tuple(r) for r in jobs.batch(work, "docx", failed_only=True).orderBy("job").collect()] == [(1, "failed", "docx"), (2, "failed", "md")]
    one = spark.range(1)
    assert one.select(jobs.toggled(F.array(F.lit("md")), F.lit("md")), jobs.toggled(F.array(F.lit("md")), F.lit("pdf"))).first() == (["md"], ["md", "pdf"])
    assert one.select(*jobs.progress(F.lit(1), F.lit(4), F.lit(5), F.lit(10), F.lit(60))).first() == (0.375, 100)
    assert one.select(*jobs.progress(F.lit(0), F.lit(40), F.lit(5), F.lit(10), F.lit(60))).first() == (0.0125, None)
    files = spark.createDataFrame([("x", bytearray(b"abc")), ("y", bytearray(b"abd"))], "name string, content binary")
    packs = spark.createDataFrame([(n, 3, hashlib.sha256(b"abc").hexdigest()) for n in "xyz"], "name string, bytes long, sha256 string")
    assert {tuple(r) for r in jobs.verified(files, packs).collect()} == {("x", True), ("y", False), ("z", False)}
