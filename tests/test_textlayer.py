"""The text-layer fold against a plain walk over characters."""

import numpy as np
import pyarrow as pa
from quire.operators import textlayer

CHARS = "doc_id long, page_no int, seq long, c string, x0 double, y0 double, x1 double, y1 double, size double"
RULES = "doc_id long, page_no int, x double, y0 double, y1 double"


def walked(chars, rules):
    """Items of one page: characters in order of centre, then of start, rows by their whole extent."""
    rows = []
    for ch in sorted(chars, key=lambda c: ((c[3] + c[5]) / 2, c[2], c[0])):
        if rows:
            top, foot = min(c[3] for c in rows[-1]), max(c[5] for c in rows[-1])
            if abs((top + foot) / 2 - (ch[3] + ch[5]) / 2) < 0.5 * max(min(foot - top, ch[5] - ch[3]), 1.0):
                rows[-1].append(ch)
                continue
        rows.append([ch])
    out = []
    for row in rows:
        row.sort(key=lambda c: (c[2], c[0]))
        middle = (min(c[3] for c in row) + max(c[5] for c in row)) / 2
        segments = [[row[0]]]
        for a, b in zip(row, row[1:], strict=False):
            xa, xb = (a[2] + a[4]) / 2, (b[2] + b[4]) / 2
            if b[2] - a[4] > 1.2 * max(a[6], b[6], 1.0) or any(xa < x < xb and y0 <= middle <= y1 for x, y0, y1 in rules):
                segments.append([])
            segments[-1].append(b)
        out += [("".join(c[1] for c in s), min(c[2] for c in s), min(c[3] for c in s), max(c[4] for c in s), max(c[5] for c in s)) for s in segments if "".join(c[1] for c in s).strip()]
    return out


def test_against_a_walk(spark):
    rng = np.random.default_rng(8)
    chars, rules, want = [], [], []
    for doc in range(30):
        for page in (1, 2):
            n = int(rng.integers(1, 120))
            own, own_rules = [], [(float(x), float(a), float(a + b)) for x, a, b in zip(rng.integers(0, 400, 5), rng.integers(0, 200, 5), rng.integers(10, 200, 5), strict=True)]
            for k in range(n):
                x, y = float(rng.integers(0, 400)), float(rng.choice([20, 24, 60, 66, 100, 103, 107, 160]) + rng.integers(0, 3))
                tall = float(rng.choice([4, 8, 12, 20]))
                own.append((k, str(rng.choice(list("ab é字 \t"))), x, y, x + float(rng.integers(2, 12)), y + tall, float(rng.choice([4, 8, 12]))))
            chars += [(doc, page, *c) for c in own]
            rules += [(doc, page, *r) for r in own_rules]
            want += [(doc, page, *item) for item in walked(own, own_rules)]
    rng.shuffle(chars)
    found = textlayer.segments(spark.createDataFrame([tuple(c) for c in chars], CHARS).repartition(5), spark.createDataFrame(rules, RULES)).collect()
    assert sorted((r.doc_id, r.page_no, r.t, r.x0, r.y0, r.x1, r.y1) for r in found) == sorted(want)
    plain = textlayer.segments(spark.createDataFrame([tuple(c) for c in chars], CHARS))
    assert plain.count() == sum(len(walked([c[2:] for c in chars if c[0] == d and c[1] == p], [])) for d in range(30) for p in (1, 2))


ARRAYS = "doc_id long, page_no int, chars array<struct<c string, x0 double, y0 double, x1 double, y1 double, size double>>, rules array<struct<x double, y0 double, y1 double>>"


def test_arrays_give_the_same(spark):
    rng = np.random.default_rng(9)
    pages, rows, ruled = [], [], []
    for page in range(1, 40):
        chars = [(str(rng.choice(list("ab é字"))), float(x), float(y), float(x) + 9, float(y) + 12, 8.0) for x, y in zip(rng.integers(0, 300, 50), rng.choice([10, 13, 40, 80], 50), strict=True)]
        rules = [(float(x), 0.0, 60.0) for x in rng.integers(0, 300, 4)]
        pages.append((page % 3, page, chars if page % 10 else [], rules if page % 4 else None))
        rows += [(page % 3, page, k, *c) for k, c in enumerate(chars if page % 10 else [])]
        ruled += [(page % 3, page, *r) for r in (rules if page % 4 else [])]
    key = lambda df: sorted(map(tuple, df.collect()))
    arrays = spark.createDataFrame(pages, ARRAYS)
    assert key(textlayer.segments_of(arrays)) == key(textlayer.segments(spark.createDataFrame(rows, CHARS), spark.createDataFrame(ruled, RULES)))
    from quire.sources import typeset

    items = typeset.prose(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    forms = [textlayer.segments(typeset.characters(items)), textlayer.segments_of(typeset.character_pages(items)), textlayer.segments_packed(typeset.packed_characters(items))]
    assert key(forms[0]) == key(forms[1]) == key(forms[2])
    assert key(textlayer.segments_of(arrays.drop("rules"))) == key(textlayer.segments(spark.createDataFrame(rows, CHARS)))


def test_pages_across_batches(spark, monkeypatch):
    """A page that goes on in the next batch stays whole."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(d, 1, k, "x", 12.0 * k, 0.0, 12.0 * k + 10, 10.0, 10.0) for d in range(4) for k in range(60_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7000")
    try:
        found = textlayer.segments(spark.createDataFrame(rows, CHARS).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.doc_id, len(r.t)) for r in found) == [(d, 60_000) for d in range(4)]
    assert textlayer.segments(spark.createDataFrame([], CHARS)).count() == 0


def test_packed_pages_are_small_and_lossless():
    """A page on the move takes about as many bytes as its text, and comes back bit by bit."""
    rng = np.random.default_rng(10)
    text = "".join(rng.choice(list("etaoin shrdlu"), 40 * 80))
    k = np.arange(len(text)) % 80
    line = np.arange(len(text)) // 80
    prose = {"doc_id": np.full(len(text), 7), "page_no": np.full(len(text), 1, np.int32), "seq": line * 1000 + k, "c": list(text), "x0": 64.0 + 10 * k, "y0": 320.0 + 32 * line, "x1": 74.0 + 10 * k, "y1": 344.0 + 32 * line, "size": np.full(len(text), 10.0)}
    (blob,) = textlayer.packed(pa.table(prose)).column("chars").to_pylist()
    assert len(blob) < 1.5 * len(text)
    tables = [pa.table(prose)]
    for n, scale in ((0, 1.0), (1, 1.0), (500, 1.0), (500, 1 / 64), (500, 0.1)):
        x = rng.integers(-900, 900, n) * scale
        if scale == 0.1:
            x[::7], x[::11], x[::13] = np.nan, -0.0, np.inf
        c = pa.array([(None, "a", "é字", "", "long" * 100)[j] for j in rng.integers(0, 5, n)], pa.string())
        tables.append(pa.table({"doc_id": np.sort(rng.integers(0, 4, n)), "page_no": np.full(n, 2, np.int32), "seq": rng.integers(-5, 1 << 40, n), "c": c, "x0": x, "y0": x * 2, "x1": x - 1, "y1": np.full(n, 7.5), "size": rng.integers(0, 30, n).astype(float)}))
    rows = [row for t in tables for row in zip(*(column.to_pylist() for column in textlayer.packed(t).columns), strict=True)]
    found, want = textlayer._unpacked(rows), pa.concat_tables(tables)
    assert found.column("c").to_pylist() == want.column("c").to_pylist()
    for name in set(want.column_names) - {"c"}:
        assert found.column(name).cast(want.column(name).type).to_numpy(zero_copy_only=False).tobytes() == want.column(name).to_numpy().tobytes()


def test_items_make_pages(spark):
    """From characters to documents, as the README has it."""
    from pyspark.sql import functions as F
    from quire.operators import compose
    from quire.sinks import markdown
    from quire.sources import typeset

    docs = spark.createDataFrame([(1, "Some words of a first line\nand a second one."), (2, "1. A numbered line")], "doc_id long, text string")
    items = textlayer.segments(typeset.characters(typeset.prose(docs)))
    sizes = items.select("doc_id", "page_no").distinct().withColumns({"w": F.lit(typeset.WIDTH), "h": F.lit(typeset.HEIGHT)})
    pages = compose.pages_of(items, sizes)
    texts = {r.doc_id: r.markdown for r in markdown.books(pages).collect()}
    assert "Some words of a first line" in texts[1] and texts[2].endswith("### 1. A numbered line\n\n")
    assert sorted((r.doc_id, r.n_items, r.n_blocks) for r in compose.statistics(pages).collect()) == [(1, 2, 1), (2, 1, 1)]
