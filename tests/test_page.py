"""Folds of one page, on the numbers of hand-built pages."""

import numpy as np
import pytest
from quire.operators import crosspage
from quire.operators.page import Box, Growth, Line, Spans, blocks, bulleted, column_starts, is_header_row, paragraphs, spans, table_rows, visual_lines
from quire.sinks import spreadsheet


def line(t, rx0, rx1, ry0, cx0=None):
    boxes = [Box(t, rx0, ry0, rx1, ry0 + 0.012)] if cx0 is None else [Box(t.split(" ", 1)[0], rx0, ry0, rx0 + 0.01, ry0 + 0.012), Box(t.split(" ", 1)[1], cx0, ry0, rx1, ry0 + 0.012)]
    return Line(ry0, ry0 + 0.012, boxes)


def texts(*lines):
    return [p.text for p in paragraphs(list(lines))]


def test_wrapped_line_joins():
    assert texts(line("a long line that goes on", 0.14, 0.93, 0.30), line("and ends here", 0.14, 0.88, 0.32)) == ["a long line that goes on and ends here"]


@pytest.mark.parametrize(("a", "b"), [("a. Unified", "b.Because"), ("i. One", "ii. Two"), ("1. x", "2. y"), ("• x", "• y")])
def test_markers_part(a, b):
    assert len(texts(line(a, 0.14, 0.93, 0.30), line(b, 0.18, 0.90, 0.32))) == 2


def test_initials_are_no_marker():
    assert len(texts(line("the address in the", 0.14, 0.93, 0.30), line("P.R. China", 0.14, 0.40, 0.32))) == 1


def test_short_line_ends_a_paragraph():
    assert len(texts(line("short", 0.14, 0.50, 0.30), line("next", 0.14, 0.88, 0.32))) == 2


def test_chinese_joins_without_space():
    assert texts(line("中文的第一行没有结束", 0.126, 0.998, 0.30), line("继续到这里", 0.083, 0.998, 0.32), line("期。", 0.076, 0.125, 0.34)) == ["中文的第一行没有结束继续到这里期。"]


def test_hanging_indent_joins_and_nested_parts():
    assert len(texts(line("1. numbered text that fills", 0.079, 0.93, 0.30), line("goes on here", 0.107, 0.90, 0.32))) == 1
    assert len(texts(line("no number but it fills", 0.046, 0.93, 0.30), line("shifted", 0.079, 0.90, 0.32))) == 2


def test_bullets():
    paras = paragraphs([line(f"text {k}", x, 0.5, 0.1 + 0.02 * k) for k, x in enumerate((0.161, 0.125, 0.125, 0.125, 0.824, 0.523))])
    assert [p.bullet for p in bulleted(paras)] == [True, False, False, False, False, False]


def test_touching_spans_stay_apart():
    assert spans(Line(0, 1, [Box("a", 0.1, 0, 0.2, 1), Box("b", 0.2, 0, 0.3, 1)])) == [(0.1, 0.2), (0.2, 0.3)]
    assert spans(Line(0, 1, [Box("a", 0.1, 0, 0.3, 1), Box("b", 0.15, 0, 0.35, 1)])) == [(0.1, 0.35)]


def test_lines_grow():
    lines = visual_lines([Box("a", 0, 0, 1, 10), Box("b", 2, 4, 3, 14), Box("c", 4, 9, 5, 18), Box("d", 0, 30, 1, 40)])
    assert [ln.text() for ln in lines] == ["a b c", "d"]


def row(y, *cells):
    return Line(y, y + 0.012, [Box(t, x, y, x + 0.1, y + 0.012) for t, x in cells])


def test_table_block_and_rows():
    lines = [row(0.10, ("Name", 0.1), ("Size", 0.5)), row(0.12, ("one", 0.1), ("1", 0.5)), row(0.14, ("two", 0.1), ("2", 0.5)), row(0.16, ("more", 0.5))]
    (block,) = [b for b in blocks(lines) if b.kind == "table"]
    assert column_starts(lines[:3]) == pytest.approx([0.1, 0.5])
    rows = table_rows(lines, block.starts)
    assert rows == [["Name", "Size"], ["one", "1"], ["two", "2\nmore"]]
    assert is_header_row(rows)


@pytest.mark.parametrize("wide", [0.015, 0.08, 0.4])
def test_growing_tables_have_the_starts_of_all_spans(wide):
    """Line by line, with spans of equal starts taken together, as from all spans at once."""
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(150):
        at = np.sort(rng.choice(np.arange(1, 40) / 40, 6, replace=False))
        lines = []
        for k in range(int(rng.integers(1, 9))):
            some = at[rng.random(6) < 0.8] + rng.choice([0, 0, 0, 0.01, 0.03]) * rng.random()
            lines.append(Line(k, k + 1, [Box("x", float(a), k, float(a + rng.random() * wide), k + 1) for a in some]))
        growth, every = Growth(lines), Spans.of(lines)
        for n in range(1, len(lines) + 1):
            starts, want = growth.starts(), every.starts(n)
            assert starts == pytest.approx(want.tolist(), abs=1e-12)
            assert growth.straddled(starts) == every.straddled(0, n, want)
        seen += growth.all is None
    assert seen > 100 if wide < 0.02 else seen < 140


def test_lines_of_orders_move_once(spark):
    """Lines are dealt by document; their cells, six times as many rows, stay where they are."""
    from quire.plans import catalogue

    plan = catalogue.table_roundtrip_lineitem(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 2  # one for both windows, one for the cells


def test_groups_of_odd_keys(spark):
    """Groups of null, text and long keys, also over batches, with null values."""
    from quire.plans.folding import folded

    rows = [(None if k % 5 == 0 else 2**53 + k % 5, None if k % 3 == 0 else "ab"[k % 2], k, None if k % 4 == 0 else k, None if k % 7 == 0 else f"t{k}", k / 2) for k in range(1000)]
    want: dict = {}
    for r in rows:
        want.setdefault(r[:2], []).append(r[3:])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        frame = spark.createDataFrame(rows, "a long, b string, k int, v long, t string, x double")
        found = folded(frame, ["a", "b"], ["k"], lambda key, some: [(*key, repr([r[1:] for r in some]))], "a long, b string, r string").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.a, r.b): r.r for r in found} == {key: repr(some) for key, some in want.items()} and len(found) == len(want)


def test_wide_gap_ends_a_table():
    kinds = [b.kind for b in blocks([row(0.10, ("a", 0.1), ("b", 0.5)), row(0.12, ("c", 0.1), ("d", 0.5)), row(0.20, ("e", 0.1), ("f", 0.5)), row(0.22, ("g", 0.1), ("h", 0.5))])]
    assert kinds == ["table", "table"]


def test_continuation_policies():
    t, s = ("table", [0.1, 0.5]), ("table", [0.14, 0.5])
    drift = [(1, [t]), (2, [s]), (3, [("table", [0.18, 0.5])])]
    assert [n for *_, n in crosspage.anchored_pieces(drift)] == [1, 1, 2]  # compared with the first piece
    assert [n for *_, n in crosspage.counted_pieces(drift)] == [1, 1, 1]
    assert [n for *_, n in crosspage.anchored_pieces([(1, [t]), (2, None), (3, [t])])] == [1, 2]
    assert [n for *_, n in crosspage.anchored_pieces([(1, [t, ("text", [])]), (2, [t])])] == [1, 1]
    assert [n for *_, n in crosspage.counted_pieces([(1, [t, ("text", [])]), (2, [t])])] == [1, 2]
    grid = ("grid", [0.1, 0.5])
    assert [n for *_, n in crosspage.anchored_pieces([(1, [grid, ("text", [])]), (2, [grid])])] == [1, 2]
    assert [n for *_, n in crosspage.anchored_pieces([(1, [t]), (2, [t, ("figure", [])]), (3, [t])])] == [1, 1, 2]


def test_indent_zero():
    found = crosspage.tiers([0.010, *[0.046] * 3, 0.079, 0.107, 0.142], 0.035)
    assert crosspage.zero_of(found) == pytest.approx(0.046)
    assert crosspage.zero_of([]) == 0.0


def test_workbook_reads_back():
    rows = [["a", "1.50", "007"], ["<&>", "12345678901", "-3"]]
    assert spreadsheet.read_back(spreadsheet.workbook(rows)) == rows
    assert spreadsheet.column_name(0) == "A" and spreadsheet.column_name(27) == "AB"


def test_stream_equals_batch(spark, tmp_path):
    from quire.streaming.pages import continued_stream

    schema = "doc_id long, page_no int, block int, kind string, starts array<double>"
    rows = [(d, p, 0, "figure" if p == 4 and d == 2 else "table", [0.125, 0.25 + 0.03125 * ((p * d) % 3)]) for d in range(5) for p in range(1, 9) if (p + d) % 6]
    frame = spark.createDataFrame(rows, schema)
    for k, pages in enumerate(((1, 3), (4, 8))):
        frame.filter(f"page_no between {pages[0]} and {pages[1]}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = continued_stream(stream).writeStream.outputMode("append").format("memory").queryName("pieces").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "page_no", "table_no").collect()))
    assert key(spark.table("pieces")) == key(crosspage.continued(frame))
