"""Whole documents in all outputs, on hand-built pages: marks, continuation, lone rows, failed pages, looks, merges, widths."""

import itertools

import numpy as np
import pytest
from quire.config import Config
from quire.functions import text as X
from quire.operators import compose, crosspage, figures, page
from quire.plans import hooks
from quire.sinks import books, document, markdown, searchable_pdf, spreadsheet
from quire.sources import files, jobs, render

W, H = 1000, 2000


def block(kind, **more):
    empty = {"kind": kind, "y0": 0.0, "starts": [], "rows": [], "paras": [], "cells": [], "figure": None, "indents": [], "n_lines": 1}
    return empty | more


def table(rows, starts=None):
    return block("table", rows=rows, starts=starts or [0.1 + 0.2 * k for k in range(len(rows[0]))])


def para(text, cx0=0.1, rx1=0.9, center=False, bullet=False):
    return {"text": text, "rx0": cx0, "cx0": cx0, "rx1": rx1, "ry0": 0.1, "center": center, "bullet": bullet}


def text(*paras):
    return block("text", paras=list(paras), indents=[p["cx0"] for p in paras])


def grid(rows, cells, edges):
    return block("grid", rows=rows, cells=cells, starts=edges)


def cell(r, c, t, h=1, w=1, edges=(True,) * 4):
    return {"r": r, "c": c, "h": h, "w": w, "text": t, "edges": list(edges)}


def pages(spark, *some):
    """A document of pages, each a list of blocks or an error."""
    rows = [(1, k, W, H, 0, 0, x if isinstance(x, str) else None, [] if isinstance(x, str) else x, "A book") for k, x in enumerate(some, 1)]
    return spark.createDataFrame(rows, f"{compose.PAGES}, name string").repartition(3)


def word(spark, *some, cfg=Config()):
    (row,) = document.books(pages(spark, *some), cfg=cfg).collect()
    return document.outline(bytes(row.content))


def mark(n):
    return f"—— page {n} of the original ——"


ROWS = [["name", "size"], ["one", "1.50"], ["two", "2"]]


def test_table_goes_on_in_all_outputs(spark):
    some = [[table(ROWS), text(para("a note."))], [table([["three", "3"], ["four", "4"]])]]
    found = word(spark, *some)
    assert [(k, t) for k, t, *_ in found] == [("p", mark(1)), ("row", "name\tsize"), ("row", "one\t1.50"), ("row", "two\t2"), ("row", mark(2)), ("row", "three\t3"), ("row", "four\t4"), ("p", "a note.")]
    assert [bold for kind, _, _, _, bold, _ in found if kind == "row"] == [True, False, False, False, False, False]
    (sheet,) = spreadsheet.books(pages(spark, *some)).collect()
    assert (sheet.n_tables, sheet.most_columns) == (1, 2)
    assert spreadsheet.read_back(bytes(sheet.content)) == [["A book"], ["—— pages 1–2 of the original ——"], ["name", "size"], ["one", "1.50"], ["two", "2"], ["three", "3"], ["four", "4"]]
    assert spreadsheet.merges_of(bytes(sheet.content)) == ["A3:B3", "A1:B1"]
    (md,) = markdown.books(pages(spark, *some)).collect()
    assert md.markdown == f"# A book\n\n<!-- {mark(1)} -->\n\n| name | size |\n| --- | --- |\n| one | 1.50 |\n| two | 2 |\n\na note.\n\n<!-- {mark(2)} -->\n\n|  |  |\n| --- | --- |\n| three | 3 |\n| four | 4 |\n\n"


def test_markdown_table_goes_on_without_text(spark):
    (md,) = markdown.books(pages(spark, [table(ROWS)], [table([["three", "a|b"], ["four", "x\ny"]])])).collect()
    assert md.markdown.endswith("| two | 2 |\n| three | a\\|b |\n| four | x<br>y |\n\n") and mark(2) not in md.markdown


def test_failed_page_closes_tables(spark):
    some = [[table(ROWS)], "it broke", [table([["three", "3"], ["four", "4"]])]]
    assert [t for k, t, *_ in word(spark, *some) if k == "p"] == [mark(1), "[page 2 failed and was skipped: it broke]", mark(3)]
    (sheet,) = spreadsheet.books(pages(spark, *some)).collect()
    rows = spreadsheet.read_back(bytes(sheet.content))
    assert sheet.n_tables == 2 and ["[page 2 failed and was skipped: it broke]"] in rows and rows[-3:] == [[mark(3)], ["three", "3"], ["four", "4"]]
    (md,) = markdown.books(pages(spark, *some)).collect()
    assert "> **[page 2 failed and was skipped: it broke]**\n\n" in md.markdown and md.markdown.count("| --- |") == 2


def test_lone_row_is_text(spark):
    some = [[table([["", "drifted", "here"]])]]
    assert [(k, t) for k, t, *_ in word(spark, *some)] == [("p", mark(1)), ("p", "drifted here")]
    (sheet,) = spreadsheet.books(pages(spark, *some)).collect()
    assert sheet.n_tables == 0 and spreadsheet.read_back(bytes(sheet.content))[1][0].startswith("(No tables")
    (md,) = markdown.books(pages(spark, *some)).collect()
    assert "drifted" not in md.markdown
    blocks = spark.createDataFrame([(1, 1, 0, "table", [["", "x"]], None), (1, 1, 1, "text", None, ["end"])], "doc_id long, page_no int, block int, kind string, rows array<array<string>>, paras array<string>")
    assert markdown.rendered(blocks).first().markdown == "end"


def test_grid_merges_and_edges(spark):
    none = (False,) * 4
    cells = [cell(0, 0, "head", w=2), cell(1, 0, "left", h=2), cell(1, 1, "12.50"), cell(2, 1, "", edges=none)]
    some = [[grid([["head", ""], ["left", "12.50"], ["", ""]], cells, [0.1, 0.5, 0.9])]]
    found = word(spark, *some)
    assert [(t, spans) for k, t, *_, spans in found if k == "row"] == [("head", 1), ("left\t12.50", 1), ("\t", 1)]
    (sheet,) = spreadsheet.books(pages(spark, *some)).collect()
    assert sorted(spreadsheet.merges_of(bytes(sheet.content))) == ["A1:B1", "A3:B3", "A4:B4", "A5:A6"]
    assert spreadsheet.widths_of(bytes(sheet.content)) == {1: 8.0}  # merged cells don't count; 5 + 2 is below the least
    blob = spreadsheet.books(pages(spark, [[table([["x" * 60, "y" * 20], ["a", "b"]])]][0])).first()
    assert spreadsheet.widths_of(bytes(blob.content)) == {0: 42.0, 1: 22.0}


def test_text_closes_grids_but_not_tables(spark):
    g = grid([["a", "b"]], [cell(0, 0, "a"), cell(0, 1, "b")], [0.1, 0.5, 0.9])
    assert [t for k, t, *_ in word(spark, [g, text(para("x."))], [g]) if k == "p"] == [mark(1), "x.", mark(2)]
    assert [t for k, t, *_ in word(spark, [g], [g]) if k == "p"] == [mark(1)]
    assert [t for k, t, *_ in word(spark, [g], [table([["a", "b"], ["c", "d"]])]) if k == "p"] == [mark(1), mark(2)]


def test_looks(spark):
    body = [para(f"line {k}", 0.1) for k in range(4)]
    some = [*body, para("• glyph", 0.135), para("listed", 0.17, bullet=True), para("far right", 0.7, 0.9), para("1. Numbered", 0.135), para("A lonely head", 0.1, 0.4), para("middle", 0.4, 0.6, center=True), para("x" * 70, 0.135)]
    some[8:9] = [para("A lonely head", 0.1, 0.4), para("which goes on over the line", 0.1, 0.9)]
    found = word(spark, [text(*some)], cfg=Config(page_marker=False))
    step = document.STEP
    assert [f[:5] for f in found[4:]] == [
        ("list", "glyph", 2 * step, "left", False), ("list", "listed", 3 * step, "left", False), ("p", "far right", 0, "right", False), ("p", "1. Numbered", step, "left", True),
        ("p", "A lonely head", 0, "left", True), ("p", "which goes on over the line", 0, "left", False), ("p", "middle", 0, "center", True), ("p", "x" * 70, step, "left", False),
    ]
    (md,) = markdown.books(pages(spark, [text(*some)]), cfg=Config(page_marker=False)).collect()
    assert "  - glyph\n    - listed\nfar right\n\n### 1. Numbered\n\nA lonely head\n\nwhich goes on over the line\n\n## middle\n\n" in md.markdown


def test_looks_match_columns(spark):
    """The Python and the Column form of heading levels, fractions and cell values agree."""
    heads, tails = ("", "1. ", "1.2 ", "A. Ab", "二、", "3 Ab", "12、", "B. x"), ("x", "word here", "end。", "x" * 70, "x" * 95)
    some = ["".join(p) for p in itertools.product(heads, tails)] + ["1.50", "-3", "007", "-0.5", "12345678901", "12", "a12b", "a bc"]
    rows = spark.createDataFrame([(t,) for t in some], "t string")
    found = rows.select("t", X.heading_level(rows.t).alias("level"), X.flat_text(rows.t).alias("flat"), X.cell_number(rows.t).alias("value"), X.cell_format(rows.t).alias("format")).collect()
    for r in found:
        value, number, flat = books.cell_value(r.t)
        assert (books.heading_level(r.t), flat, value, number) == (r.level, r.flat, r.value, r.format), r.t


def test_figures_are_placed(spark):
    px = np.full((100, 100), 7, np.uint8)
    f = block("figure", figure={"x0": 700, "y0": 100, "x1": 800, "y1": 200, "png": figures.png(px)})
    wide = block("figure", figure={"x0": 0, "y0": 300, "x1": 1000, "y1": 400, "png": figures.png(px[:50])})
    (row,) = document.books(pages(spark, [f, wide])).collect()
    assert [(k, a) for k, _, _, a, *_ in document.outline(bytes(row.content))] == [("p", "center"), ("picture", "right"), ("picture", "center")]
    assert document.picture_sizes(bytes(row.content)) == [(100, 100), (100, 50)]
    (md,) = markdown.books(pages(spark, [f, wide])).collect()
    assert "![](A%20book.assets/fig-1.png)\n\n![](A%20book.assets/fig-2.png)\n\n" in md.markdown and (figures.unpng(bytes(md.figures[0])) == px).all()


def test_landscape_by_majority(spark):
    import io
    import zipfile

    rows = [(1, k, *((H, W) if k < 3 else (W, H)), 0, 0, None, [text(para("x"))]) for k in range(3 + 1)]
    (row,) = document.books(spark.createDataFrame(rows, compose.PAGES)).collect()
    assert 'w:orient="landscape"' in zipfile.ZipFile(io.BytesIO(bytes(row.content))).read("word/document.xml").decode()


def test_weave_and_figures():
    line = lambda y: page.Line(y, y + 0.01, [page.Box(f"{y:.2f}", 0.1, y, 0.9, y + 0.01)])
    g = lambda a, b: compose.grids.Grid([100.0, 500.0, 900.0], [a * H, b * H], [compose.grids.Cell(0, 0, 1, 1, (True,) * 4, "x"), compose.grids.Cell(0, 1, 1, 1, (True,) * 4, "y")])
    kinds = lambda parts: [p.kind if p.kind != "text" else p.paras[0]["text"] for p in parts]
    assert kinds(compose.woven([line(0.1), line(0.5), line(0.9)], [g(0.2, 0.4), g(0.6, 0.8)], W, H, Config())) == ["0.10", "grid", "0.50", "grid", "0.90"]
    # a grid that reaches further down holds back those after it
    assert kinds(compose.woven([line(0.5), line(0.9)], [g(0.1, 0.7), g(0.2, 0.3)], W, H, Config())) == ["0.50", "grid", "grid", "0.90"]
    assert kinds(compose.woven([], [g(0.1, 0.2)], W, H, Config())) == ["grid"] and compose.woven([], [], W, H, Config()) == []
    parts = compose.woven([line(0.1), line(0.5)], [g(0.2, 0.4)], W, H, Config())
    found = [compose.Part("figure", y) for y in (50.0, 500.0, 1999.0)]
    assert [p.kind for p in compose.with_figures(parts, found)] == ["figure", "text", "grid", "figure", "text", "figure"]


def test_pages_with_their_boxes(spark):
    """Items gathered beforehand give the same pages; noise and zones are those of the rows' rules."""
    from pyspark.sql import functions as F
    from quire.operators import noise
    from quire.plans import outputs
    from quire.sources import typeset

    sf = "/root/testdata/sf0.001"
    sheets, items = outputs.scanned_pages(spark, sf)
    boxes = items.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("seq", "t", "x0", "y0", "x1", "y1", "s")).alias("boxes"))
    key = lambda df: sorted((r.doc_id, r.n_items, r.n_aside, r.error, str(r.blocks)) for r in df.collect())
    assert key(compose.pages_with(sheets.join(boxes, ["doc_id", "page_no"], "left"))) == key(compose.pages_of(items, sheets))
    strewn = typeset.strewn(spark.read.parquet(f"{sf}/documents.parquet"))
    sizes = strewn.select("doc_id", "page_no").distinct().withColumns({"w": F.lit(1024), "h": F.lit(2048)})
    rows = noise.zones(strewn, 1024, 2048).groupBy("doc_id", "page_no").agg(F.count_if(F.col("zone") != "body").alias("n"))
    found = compose.pages_of(strewn, sizes)
    assert {(r.doc_id, r.page_no): r.n_aside for r in found.collect() if r.n_aside} == {(r.doc_id, r.page_no): r.n for r in rows.collect() if r.n}


def test_indents_of_all_pages():
    assert crosspage.merged_tiers([[0.2, 0.1], [0.11, 0.2, 0.05]], 0.035) == [(0.05, 1), (0.1, 2), (0.2, 2)]
    assert crosspage.zero_of(crosspage.merged_tiers([[0.2] * 3], [0.1][0])) == 0.2


def test_stream_waits_for_pages(spark, tmp_path):
    from quire.streaming.pages import continued_stream

    schema = "doc_id long, page_no int, block int, kind string, starts array<double>"
    cycle = ["table", "grid", "text", "grid", "table", "failed", "table", "empty", "table", "table"]
    rows = [(d, p, b, cycle[(p * 3 + d + b) % 10], [0.125, 0.25 + 0.0078125 * (p % 2)]) for d in range(4) for p in range(1, 13) for b in range(2)]
    rows = [r for r in rows if not (r[2] == 1 and cycle[(r[1] * 3 + r[0]) % 10] in ("failed", "empty"))]
    rows = [(d, p, b, k if b == 0 or k not in ("failed", "empty") else "text", s) for d, p, b, k, s in rows]
    frame = spark.createDataFrame(rows, schema)
    for k, some in enumerate(((5, 6, 11), (1, 2, 12), (3, 4, 9), (7, 8, 10))):
        frame.filter(frame.page_no.isin(*some)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = continued_stream(stream, wait=True).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "page_no", "block", "kind", "table_no").collect()))
    assert key(spark.table("late")) == key(crosspage.continued(frame)) and spark.table("late").count() > 20


def test_renderer_seam(spark):
    px = np.arange(60 * 40, dtype=np.uint32).astype(np.uint8).reshape(40, 60)
    good = searchable_pdf.pdf([(60, 40, px.tobytes(), [("word", 1, 1, 9, 9)]), (60, 40, px[::-1].tobytes(), [])], quality=None)
    rows = spark.createDataFrame([("a.pdf", bytearray(good)), ("b.pdf", bytearray(b"no pdf")), ("c.pdf", bytearray(good[:400] + good[420:]))], "path string, content binary")
    found = sorted(render.pages(rows, render.OwnPdf).collect(), key=lambda r: (r.path, r.page_no))
    assert [(r.path, r.page_no, r.w, r.h) for r in found if r.path == "a.pdf"] == [("a.pdf", 1, 60, 40), ("a.pdf", 2, 60, 40)] and bytes(found[0].px) == px.tobytes()
    assert [(r.page_no, r.problem) for r in found if r.path == "b.pdf"] == [(0, "ValueError: not a PDF file")]


def test_pdf_of_whole_documents(spark):
    from quire.sinks import jpeg

    px = np.tile(np.arange(64, dtype=np.uint8), (48, 1))
    rows = [(1, 2, 64, 48, bytearray(px.tobytes()), None), (1, 1, 64, 48, bytearray(px.tobytes()), bytearray(np.repeat(px, 3).tobytes())), (1, 3, 64, 48, bytearray(b"cut off"), None)]
    some = spark.createDataFrame(rows, "doc_id long, page_no int, w int, h int, px binary, rgb binary")
    items = spark.createDataFrame([(1, 1, 1, "second", 5.0, 20.0, 40.0, 30.0), (1, 1, 0, "first", 5.0, 5.0, 40.0, 15.0), (1, 2, 0, "字", 1.0, 1.0, 9.0, 9.0)], "doc_id long, page_no int, seq int, t string, x0 double, y0 double, x1 double, y1 double")
    blob = bytes(searchable_pdf.books(some, items).first().content)
    assert searchable_pdf.texts(blob) == [["first", "second"], ["字"], []] and len(searchable_pdf.page_numbers(blob)) == 3
    found = [jpeg.size_of(b"\xff\xd8" + part.split(b"\nendstream")[0]) for part in blob.split(b"stream\n\xff\xd8")[1:]]
    assert found == [(64, 48, 3), (64, 48, 1)]
    plain = bytes(searchable_pdf.books(some.drop("rgb"), items, quality=None).first().content)
    assert bytes(render.OwnPdf(plain).page(0, 0)["px"]) == px.tobytes()


def test_saved_files(spark, tmp_path):
    from pyspark.sql import functions as F
    from quire.sinks import saved

    rows = spark.createDataFrame([(1, bytearray(b"one"), "a/b"), (2, bytearray(b"two"), "c"), (3, bytearray(b"three"), "c")], "doc_id long, content binary, name string").coalesce(1)
    write = lambda some, **how: sorted((r.doc_id, r.path) for r in saved.saved(some, str(tmp_path), ".docx", "20260102030405", **how).collect())
    assert write(rows, name=F.col("name")) == [(1, f"{tmp_path}/a_b.docx"), (2, f"{tmp_path}/c.docx"), (3, f"{tmp_path}/c-20260102030405.docx")]
    assert write(rows, name=F.col("name")) == [(1, f"{tmp_path}/a_b.docx"), (2, f"{tmp_path}/c.docx"), (3, f"{tmp_path}/c-20260102030405.docx")]  # again: the same
    other = rows.withColumn("content", F.lit(b"other"))
    assert write(other.limit(1), name=F.lit("c")) == [(1, f"{tmp_path}/c-20260102030405-2.docx")]
    assert (tmp_path / "c.docx").read_bytes() == b"two" and sorted(p.name for p in tmp_path.iterdir()) == ["a_b.docx", "c-20260102030405-2.docx", "c-20260102030405.docx", "c.docx"]
    f = block("figure", figure={"x0": 700, "y0": 100, "x1": 800, "y1": 200, "png": figures.png(np.zeros((9, 9), np.uint8))})
    (tmp_path / "1.md").write_text("mine")
    (row,) = saved.saved_markdown(markdown.books(pages(spark, [f, f])), str(tmp_path), "20260102030405").collect()
    assert row.path.endswith("/1-20260102030405.md") and "![](1-20260102030405.assets/fig-2.png)" in open(row.path).read() and (tmp_path / "1.md").read_text() == "mine"
    assert (figures.unpng((tmp_path / "1-20260102030405.assets/fig-1.png").read_bytes()) == 0).all()


def test_files_and_queue(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "in/c.pdf", ".hidden/d.pdf", "e.txt", "1/2/3/4/5/6/deep.pdf", "1/2/3/4/5/6/7/too.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-" + name.encode())
    stems = lambda **how: sorted(r.stem for r in files.pdf_files(spark, str(tmp_path), **how).collect())
    assert stems() == ["a", "b", "c", "deep"] == stems(most=None) and stems(most=2) == ["a", "deep"]
    damaged = spark.createDataFrame([("k", 1, '[{"t":"x","x0":1.0,"y0":1.0,"x1":2.0,"y1":2.0,"s":1.0}]'), ("k", 2, "[{"), ("k", 3, None)], "key string, page_no int, json string")
    assert [(r.page_no, r.t) for r in files.from_json(damaged).collect()] == [(1, "x")]
    registry = spark.createDataFrame([("ja", "ja.onnx", 3, __import__("hashlib").sha256(b"abc").hexdigest()), ("ko", "ko.onnx", 3, "0"), ("de", "de.onnx", 3, "0")], "code string, name string, bytes long, sha256 string")
    there = spark.createDataFrame([("ja.onnx", bytearray(b"abc")), ("ko.onnx", bytearray(b"abc"))], "name string, content binary")
    assert jobs.chosen_pack(registry, there, "ja") == "ja.onnx"
    for code, error in (("ko", ValueError), ("de", FileNotFoundError), ("xx", ValueError)):
        with pytest.raises(error):
            jobs.chosen_pack(registry, there, code)
    k = X.cache_key
    one = spark.createDataFrame([(b"a", 1)], "c binary, e int")
    keys = one.select(k(one.c, one.e).alias("a"), k(one.c, one.e + 1).alias("b"), k(one.c, one.e).alias("c")).first()
    assert keys.a == keys.c != keys.b


def test_hooks(spark):
    seen, said = [], []
    rows = lambda n, pause: spark.range(n).repartition(n).mapInArrow(lambda it: (__import__("time").sleep(pause) or b for b in it), "id long")
    watch = hooks.Hooks(lambda done, known: seen.append((done, known)), said.append)
    assert hooks.watched(spark, "count", lambda: rows(8, 0.3).count(), watch, 0.05) == 8
    assert seen and all(a <= b for a, b in seen) and said == ["count: begun", "count: done"]
    with pytest.raises(hooks.Stopped):
        hooks.watched(spark, "long", lambda: rows(64, 2.0).count(), hooks.Hooks(stop=lambda: True), 0.5)
    with pytest.raises(ZeroDivisionError):
        hooks.watched(spark, "bad", lambda: 1 / 0, hooks.Hooks())
    assert spark.range(5).count() == 5
