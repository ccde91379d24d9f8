"""Named queries over whole pages and documents: text layers, composed pages, paragraphs, files, recognition geometry, the queue.

Their SQL is written from the rules, with its own patterns, and never reads the implementation's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import compose, crosspage, detection, figures, imaging, page, styles, textlayer
from quire.plans.catalogue import _GLYPH, _NUM, _PIECES, _STOP, _clean, query
from quire.plans.folding import spread
from quire.sinks import document, markdown, searchable_pdf, spreadsheet
from quire.sources import files, jobs, render
from quire.sources import typeset as T

W, H = T.WIDTH, T.HEIGHT

# ---- the text layer

_SUPPLIER_CELLS = "SELECT s_suppkey, 0 AS c, lpad(s_suppkey::VARCHAR, 20, '0') AS t FROM supplier UNION ALL SELECT s_suppkey, 1, rpad(s_name, 20, '.') FROM supplier UNION ALL SELECT s_suppkey, 2, rpad(s_nationkey::VARCHAR, 20, '.') FROM supplier"


def drawn_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Characters and paths of tables whose cells touch, so that only standing rules part them.

    Every fifth character stands high and small; the reader also reports line ends and made-up spaces. Corners come in
    any order. Besides the rules there are fills, short ticks and lying lines.
    """
    key = F.col("s_suppkey")
    cells = F.array(F.lpad(key.cast("string"), 20, "0"), F.rpad("s_name", 20, "."), F.rpad(F.col("s_nationkey").cast("string"), 20, "."))
    rows = T.table(spark, sf_dir, "supplier").select(F.floor(key / 40).alias("doc_id"), F.lit(1).alias("page_no"), F.pmod(key, F.lit(40)).alias("n"), F.posexplode(cells).alias("c0", "t"))
    each = rows.select("doc_id", "page_no", "n", "c0", F.posexplode(F.split("t", "")).alias("k", "c")).filter("c != ''")
    x, y, high = 64 + 200 * F.col("c0") + 10 * F.col("k"), T.TOP + T.PITCH * F.col("n"), F.pmod("k", F.lit(5)) == 3
    box = each.select("doc_id", "page_no", (F.col("n") * 60 + F.col("c0") * 20 + F.col("k")).alias("seq"), "c", F.lit(False).alias("generated"), x.alias("ax"), F.when(high, y + 2).otherwise(y).alias("by"), (x + 10).alias("bx"), F.when(high, y + 14).otherwise(y + 24).alias("ay"), F.lit(10.0).alias("size"))
    made_up = box.filter("seq % 7 = 0").withColumns({"c": F.lit(" "), "generated": F.lit(True), "bx": F.col("bx") + 300})
    ends = box.filter("seq % 20 = 19").withColumn("c", F.lit("\n"))
    chars = box.unionByName(made_up).unionByName(ends)
    pages = rows.select("doc_id", "page_no").distinct()
    lines = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), p, strict=True)]) for p in ((263, 2000, 265, 300), (465, 300, 463, 2000), (64, 300, 664, 1700), (150, 300, 165, 340), (120, 330, 121, 338), (64, 500, 664, 502))])
    return chars, pages.select("doc_id", "page_no", F.explode(lines).alias("p")).select("doc_id", "page_no", "p.*")


@query(f"SELECT s_suppkey // 40 AS doc_id, 1 AS page_no, t, (64 + 200 * c)::DOUBLE AS x0, (320 + 32 * (s_suppkey % 40))::DOUBLE AS y0, (264 + 200 * c)::DOUBLE AS x1 FROM ({_SUPPLIER_CELLS})")
def text_layer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, paths = drawn_table(spark, sf_dir)
    items = textlayer.segments(textlayer.real_chars(chars), textlayer.standing_rules(paths))
    return items.select("doc_id", "page_no", "t", "x0", "y0", "x1")


@query("SELECT DISTINCT s_suppkey // 40 AS doc_id, x, 300::DOUBLE AS y0, 2000::DOUBLE AS y1 FROM supplier, (SELECT unnest([264.0, 464.0])::DOUBLE AS x)")
def standing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textlayer.standing_rules(drawn_table(spark, sf_dir)[1]).select("doc_id", "x", "y0", "y1")


# ---- whole pages


def scanned_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scanned page for each region, and its items: header, intro, a ruled table, an outro with a fraction, a square, a footer.

    The table's first row is one cell; its left side has no rule; right cells hold two lines. The page of region 3 is damaged.
    """
    rows = T.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("nations"))
    box = "struct<seq long, t string, x0 double, y0 double, x1 double, y1 double, s double>"
    kind = pa.struct([("seq", pa.int64()), ("t", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1", "s"))])

    def drawn(doc: int, nations: list[dict]) -> tuple[bytes, list[dict]]:
        px, items = np.full((1400, 900), 255, np.uint8), []
        put = lambda t, x0, y0, x1, y1: items.append({"seq": len(items), "t": t, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "s": 0.99})
        put("Page 1/9", 400.0, 60.0, 500.0, 90.0)
        put(f"Region {doc} in words", 90.0, 200.0, 500.0, 230.0)
        ys = [300 + 60 * k for k in range(len(nations) + 2)]
        for y in ys:
            px[y : y + 2, 100:802] = 0
        px[ys[1] : ys[-1], 400:402] = px[ys[0] : ys[-1] + 2, 800:802] = 0
        put("Nations", 420.0, 318.0, 500.0, 342.0)
        for k, n in enumerate(nations, 1):
            put(n["n_name"], 120.0, ys[k] + 18.0, 260.0, ys[k] + 42.0)
            put(f"key {n['n_nationkey']}", 420.0, ys[k] + 6.0, 500.0, ys[k] + 26.0)
            put("two lines", 420.0, ys[k] + 30.0, 520.0, ys[k] + 50.0)
        low = ys[-1]
        put("half is", 90.0, low + 60.0, 200.0, low + 104.0)
        put("1", 230.0, low + 58.0, 270.0, low + 78.0)
        put("2", 230.0, low + 86.0, 270.0, low + 106.0)
        px[low + 81 : low + 83, 226:274] = 0
        px[low + 160 : low + 220, 400 : 460 + 10 * doc] = 0
        put("12", 430.0, 1340.0, 460.0, 1365.0)
        return px.tobytes()[: -1 if doc == 3 else None], items

    def run(batches):
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            made = [drawn(d, n) for d, n in zip(docs, batch.column("nations").to_pylist(), strict=True)]
            n = len(docs)
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([900] * n, pa.int32()), pa.array([1400] * n, pa.int32()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(kind))], names=["doc_id", "page_no", "w", "h", "px", "boxes"])

    pages = rows.mapInArrow(run, f"doc_id long, page_no int, w int, h int, px binary, boxes array<{box}>")
    return pages.drop("boxes"), pages.select("doc_id", "page_no", F.explode("boxes").alias("b")).select("doc_id", "page_no", "b.*")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, items = scanned_pages(spark, sf_dir)
    return compose.pages_of(items, pages)


_SHAPE = "r AS (SELECT n_regionkey::BIGINT AS doc_id, count(*) AS n, string_agg(n_name || '=key ' || n_nationkey || chr(10) || 'two lines', '|' ORDER BY n_name) AS cells FROM nation GROUP BY 1)"


@query(f"""WITH {_SHAPE} SELECT doc_id, 0 AS block, 'text' AS kind, 'Region ' || doc_id || ' in words' AS content, 1 AS n_spans FROM r WHERE doc_id <> 3
UNION ALL SELECT doc_id, 1, 'grid', 'Nations=|' || cells, 2 FROM r WHERE doc_id <> 3 UNION ALL SELECT doc_id, 2, 'text', 'half is 1/2', 1 FROM r WHERE doc_id <> 3
UNION ALL SELECT doc_id, 3, 'figure', '397,' || (517 + 60 * n) || ',' || (463 + 10 * doc_id) || ',' || (583 + 60 * n), 1 FROM r WHERE doc_id <> 3 UNION ALL SELECT 3, 0, 'failed', NULL, 1""")
def composed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = compose.blocks_of(composed(spark, sf_dir))
    f = F.col("figure")
    content = (
        F.when(F.col("kind") == "text", F.array_join(F.transform("paras", lambda p: X.flat_text(p["text"])), " / "))
        .when(F.col("kind") == "grid", F.array_join(F.transform("rows", lambda r: F.array_join(r, "=")), "|"))
        .when(F.col("kind") == "figure", F.concat_ws(",", f["x0"].cast("string"), f["y0"].cast("string"), f["x1"].cast("string"), f["y1"].cast("string")))
    )
    spans = F.coalesce(F.array_max(F.transform("cells", lambda c: c["w"])), F.lit(1))
    return blocks.select("doc_id", "block", "kind", content.alias("content"), spans.alias("n_spans"))


@query(f"WITH {_SHAPE} SELECT doc_id, (3 * n + 7)::INT AS n_items, 4 AS n_blocks, 0 AS n_tables, 1 AS n_grids, 2 AS n_aside FROM r WHERE doc_id <> 3")
def page_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.statistics(composed(spark, sf_dir)).drop("page_no")


@query(f"WITH {_SHAPE} SELECT doc_id, (doc_id <> 3)::BIGINT AS n_read, (doc_id = 3)::BIGINT AS n_failed, doc_id = 3 AS failed, CASE WHEN doc_id = 3 THEN '1 ValueError' ELSE '' END AS errors FROM r")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compose.summary(composed(spark, sf_dir))
    errors = F.array_join(F.transform("errors", lambda e: F.concat(e["page_no"].cast("string"), F.lit(" "), F.split(e["error"], ":")[0])), ",")
    return found.select("doc_id", "n_read", "n_failed", "failed", errors.alias("errors"))


@query("SELECT DISTINCT n_regionkey::BIGINT AS doc_id, CASE WHEN 27 * n_regionkey < 32 THEN 0 ELSE 27 * n_regionkey END::INT AS spread, (n_regionkey - 2) * .5::DOUBLE AS angle FROM nation")
def shaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose paper darkens to the right and whose lines slope, by region."""
    rows = T.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id")).distinct()

    def run(batches):
        for batch in batches:
            docs, out = batch.column("doc_id").to_pylist(), []
            for doc in docs:
                px = np.full((576, 960), 255, np.uint8)
                px -= (np.arange(960) // imaging.TILE * 3 * doc).astype(np.uint8)
                x = np.arange(960)
                for y in range(60, 540, 40):
                    at = np.floor(y - (x - 480) * np.tan(np.radians((doc - 2) * 0.5))).astype(int)
                    for k in range(4):
                        px[at + k, x] = 0
                out.append(px.tobytes())
            n = len(docs)
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([960] * n, pa.int32()), pa.array([576] * n, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "page_no", "w", "h", "px"])

    pages = rows.mapInArrow(run, "doc_id long, page_no int, w int, h int, px binary")
    return imaging.prepared(pages).select("doc_id", "spread", (F.round(F.col("angle") * 2) / 2).alias("angle"))


_FIGS = "SELECT n_regionkey::BIGINT AS doc_id, count(*) AS n FROM nation GROUP BY 1"


@query(f"""SELECT doc_id, 0 AS figure, (97 + 100 * doc_id)::INT AS x0, 297 AS y0, (183 + 100 * doc_id)::INT AS x1, 363 AS y1, CASE WHEN (280 + 200 * doc_id) / 1800.0 > .62 THEN 'right' WHEN (280 + 200 * doc_id) / 1800.0 < .38 THEN 'left' ELSE 'center' END AS align FROM ({_FIGS})
UNION ALL SELECT doc_id, 1, 597, 497, 663, 563, 'right' FROM ({_FIGS}) WHERE doc_id % 2 = 0""")
def figure_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts near each other are one figure; specks, small parts, rules, text and what stands in the margins are none."""
    rows = T.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id")).distinct()
    box = pa.struct([("t", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1"))])

    def run(batches):
        for batch in batches:
            docs, out = batch.column("doc_id").to_pylist(), []
            for doc in docs:
                px = np.full((800, 900), 255, np.uint8)
                px[300:360, 100 + 100 * doc : 140 + 100 * doc] = px[300:360, 150 + 100 * doc : 180 + 100 * doc] = 0
                if doc % 2 == 0:
                    px[500:560, 600:660] = 0
                px[450, 50:850:40] = 0  # specks
                px[620:635, 100:120] = 0  # too small
                px[20:80, 400:460] = px[740:790, 400:460] = 0  # header and footer
                px[600:602, 50:850] = 0  # a rule
                px[650:670, 200:400] = 0  # text
                out.append(px.tobytes())
            n, text = len(docs), [{"t": "word", "x0": 200.0, "y0": 650.0, "x1": 400.0, "y1": 670.0}]
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array([1] * n, pa.int32()), pa.array([900] * n, pa.int32()), pa.array([800] * n, pa.int32()), pa.array(out, pa.binary()), pa.array([text] * n, pa.list_(box))], names=["doc_id", "page_no", "w", "h", "px", "boxes"])

    pages = rows.mapInArrow(run, "doc_id long, page_no int, w int, h int, px binary, boxes array<struct<t string, x0 double, y0 double, x1 double, y1 double>>")
    return figures.figures_of(pages).select("doc_id", "figure", "x0", "y0", "x1", "y1", figures.alignment(F.col("x0"), F.col("x1"), F.lit(900)).alias("align"))


# ---- paragraphs

_zh = lambda t: f"len(regexp_extract_all({t}, '[\\x{{4E00}}-\\x{{9FFF}}]')) >= 2"
_ESSAY = f"""{_PIECES}, e AS (SELECT doc_id, pos, CASE WHEN pos % 23 = 7 THEN substr(t, 1, 20) ELSE {{heads}}[(pos // 3 + doc_id) % 16 + 1] || t || {{tails}}[(pos // 2 + 3 * doc_id) % 6 + 1] END AS t,
CASE WHEN pos % 23 = 7 THEN 412 WHEN pos % 11 = 5 THEN 104 WHEN pos % 7 = 0 THEN 84 ELSE 64 END AS x FROM pieces WHERE t <> ''),
essay AS (SELECT doc_id, (pos // 40 + 1)::INT AS page_no, pos, {_clean("t")} AS t, x / 1024.0::DOUBLE AS a, (x + 10 * len(t)) / 1024.0::DOUBLE AS b, (320 + 32 * (pos % 40)) / 2048.0::DOUBLE AS y FROM e)""".replace(
    "{heads}", "[" + ", ".join(f"'{h}'" for h in T.ESSAY_HEADS) + "]"
).replace("{tails}", "[" + ", ".join(f"'{t}'" for t in T.ESSAY_TAILS) + "]")
_PARAS = f"""RECURSIVE {_ESSAY}, steps AS (SELECT doc_id, page_no, y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS d FROM essay WHERE t <> ''),
pitch AS (SELECT doc_id, page_no, list_sort(list(d) FILTER (d > 0 AND d < .08)) AS ds FROM steps GROUP BY ALL),
lines AS (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id, e.page_no ORDER BY pos) AS k, 1.75 * coalesce(ds[len(ds) // 2 + 1], .02)::DOUBLE AS most,
regexp_matches(t, '{_NUM}') AS num, {_zh("t")} AS zh, len(regexp_extract_all(t, '\\p{{L}}')) >= 2 AS speaks, abs((a + b) / 2 - .5) < .07 AND b - a < .5 AND a > .25 AS center
FROM essay e JOIN pitch p ON e.doc_id = p.doc_id AND e.page_no = p.page_no WHERE t <> ''),
walk AS (SELECT doc_id, page_no, k, 0 AS para, t AS text, a AS cx0, b, y, center, num, 1 AS n FROM lines WHERE k = 1 UNION ALL
SELECT doc_id, page_no, k, CASE WHEN part THEN para + 1 ELSE para END, CASE WHEN part THEN t ELSE {_clean("text || CASE WHEN zh0 THEN '' ELSE ' ' END || t")} END, CASE WHEN part THEN a ELSE cx0 END, b, y,
CASE WHEN part THEN c1 ELSE c0 END, CASE WHEN part THEN num ELSE num0 END, CASE WHEN part THEN 1 ELSE n + 1 END FROM (
SELECT l.doc_id, l.page_no, l.k, w.para, w.text, l.t, w.cx0, l.a, l.b, l.y, w.center AS c0, l.center AS c1, l.num, w.num AS num0, w.n, {_zh("w.text")} AS zh0,
w.b <= .78 OR l.num OR regexp_matches(w.text, '{_STOP}') OR (l.speaks AND l.zh <> ({_zh("w.text")})) OR l.y - w.y > l.most
OR (abs(l.a - w.cx0) > .025 AND NOT (w.num AND l.a - w.cx0 BETWEEN 0 AND .06) AND NOT ({_zh("w.text")} AND l.a - w.cx0 BETWEEN -.06 AND 0 AND l.a < w.b - .35)) AS part
FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.page_no = w.page_no AND l.k = w.k + 1)),
paras AS (SELECT doc_id, page_no, para::INT AS para, arg_max(text, k) AS text, arg_max(cx0, k) AS cx0, arg_max(b, k) AS rx1, arg_max(y, k) AS ry0, arg_max(center, k) AS center, arg_max(num, k) AS num, max(n)::INT AS n_lines FROM walk GROUP BY ALL),
often AS (SELECT doc_id, page_no, floor(cx0 * 200 + .5) AS u, count(*) AS n FROM paras GROUP BY ALL),
usual AS (SELECT doc_id, page_no, u / 200.0::DOUBLE AS base FROM often QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, u) = 1),
marked AS (SELECT p.*, cx0 - base > .03 AND cx0 - base <= .10 AND NOT num AND NOT center AS bullet FROM paras p JOIN usual u ON p.doc_id = u.doc_id AND p.page_no = u.page_no)"""


def essay_paras(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = T.essay(T.table(spark, sf_dir, "documents"))
    return page.paragraphs_of(items, W, H), items


@query(f"WITH {_PARAS} SELECT doc_id, page_no, para, text, cx0, rx1, ry0, center, bullet, n_lines FROM marked")
def para_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return essay_paras(spark, sf_dir)[0].select("doc_id", "page_no", "para", "text", "cx0", "rx1", "ry0", "center", "bullet", "n_lines")


@query(f"""WITH {_PARAS}, hits AS (SELECT doc_id, page_no, a, count(*) AS n FROM essay WHERE t <> '' GROUP BY ALL),
sums AS (SELECT doc_id, sum(n) FILTER (a = 64 / 1024.0) AS n64, sum(n) FILTER (a = 84 / 1024.0) AS n84, sum(n) FILTER (a = 104 / 1024.0) AS n104, sum(n) FILTER (a = 412 / 1024.0) AS n412 FROM hits GROUP BY doc_id),
zero AS (SELECT doc_id, CASE WHEN n64 >= 3 THEN 64 WHEN n84 >= 3 THEN 84 WHEN n104 >= 3 THEN 104 WHEN n412 >= 3 THEN 412 WHEN n64 > 0 THEN 64 WHEN n84 > 0 THEN 84 WHEN n104 > 0 THEN 104 ELSE 412 END / 1024.0::DOUBLE AS zero FROM sums)
SELECT m.doc_id, page_no, para, least(greatest(round((cx0 - zero) / .035), 0), 15)::INT AS level, round((cx0 - zero) / .035) > 15 AND rx1 - cx0 < .25 AS "right" FROM marked m JOIN zero z ON m.doc_id = z.doc_id""")
def para_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras, items = essay_paras(spark, sf_dir)
    return crosspage.indented(paras, page.text_lines_of(items, W, H)).select("doc_id", "page_no", "para", "level", "right")


@query(rf"""WITH {_PARAS}, x AS (SELECT *, trim(text) AS t, lead(rx1) OVER (PARTITION BY doc_id, page_no ORDER BY para) AS after FROM marked),
h AS (SELECT *, CASE WHEN regexp_matches(t, '[。；;]\z') THEN NULL WHEN regexp_matches(t, '^[A-Z]\.\s+[A-Z]') AND len(t) < 70 THEN 1 WHEN regexp_matches(t, '^\d{{1,2}}[.、]\s*\S') AND len(t) < 90 AND NOT regexp_matches(t, '^\d{{1,2}}\.\d') THEN 2
WHEN regexp_matches(t, '^[一二三四五六七八九十]+[、．.]') AND len(t) < 60 THEN 2 WHEN regexp_matches(t, '^\d{{1,2}}\.\d{{1,2}}[\s、．.]') AND len(t) < 90 THEN 3 WHEN regexp_matches(t, '^\d{{1,2}}\s+[A-Z][a-z]') AND len(t) < 70 THEN 3 END AS level FROM x),
s AS (SELECT *, CASE WHEN regexp_matches(text, '{_GLYPH}') THEN 'glyph' WHEN bullet THEN 'bullet' WHEN level IS NOT NULL THEN 'heading'
WHEN rx1 < .58 AND NOT regexp_matches(text, '{_STOP}') AND len(text) < 60 AND NOT num AND after > .78 THEN 'subheading' WHEN center THEN 'center' ELSE 'plain' END AS style FROM h)
SELECT doc_id, page_no, para, style, CASE style WHEN 'heading' THEN 12.0 - level WHEN 'center' THEN 13.0 ELSE 10.5 END::DOUBLE AS size, style IN ('heading', 'subheading', 'center') AS bold, CASE WHEN style = 'center' THEN 'center' ELSE 'left' END AS align FROM s""")
def paragraph_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras, items = essay_paras(spark, sf_dir)
    return styles.styled(crosspage.indented(paras, page.text_lines_of(items, W, H))).select("doc_id", "page_no", "para", "style", "size", "bold", "align")


# ---- files, read back


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    items = T.cells(T.table(spark, sf_dir, "supplier"), F.floor(key / 500), F.pmod(key, F.lit(500)), [F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey"), F.format_string("%.2f", "s_acctbal")], 240)
    sizes = items.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(W).alias("w"), F.lit(H).alias("h"))
    return compose.pages_of(items, sizes)


def _read(content: DataFrame, rows_of, column: str = "content") -> DataFrame:
    """doc_id, r, line: what rows_of finds in each file, numbered."""

    def run(batches):
        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column(column).to_pylist(), strict=True):
                lines = rows_of(blob)
                yield pa.record_batch([pa.array([doc] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())], names=["doc_id", "r", "line"])

    return content.select("doc_id", column).mapInArrow(run, "doc_id long, r int, line string")


_ROWS = """s AS (SELECT s_suppkey // 500 AS doc_id, (s_suppkey % 500)::INT AS n, s_suppkey || chr(9) || s_name || chr(9) || s_nationkey || chr(9) || printf('%.2f', s_acctbal) AS line FROM supplier),
d AS (SELECT doc_id, max(n) // 40 + 1 AS pages FROM s GROUP BY doc_id)"""


@query(f"""WITH {_ROWS} SELECT doc_id::BIGINT AS doc_id, 0 AS r, doc_id::VARCHAR AS line FROM d UNION ALL
SELECT doc_id, 1, CASE pages WHEN 1 THEN '—— page 1 of the original ——' ELSE '—— pages 1–' || pages || ' of the original ——' END FROM d UNION ALL SELECT doc_id, n + 2, line FROM s""")
def workbook_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spreadsheet.books(supplier_pages(spark, sf_dir)), lambda blob: ["\t".join(r) for r in spreadsheet.read_back(blob)])


@query(f"""WITH {_ROWS}, o AS (SELECT doc_id, n + n // 40 AS r, line FROM s UNION ALL SELECT doc_id, 41 * p - 1, '—— page ' || p + 1 || ' of the original ——' FROM (SELECT doc_id, unnest(range(0, pages)) AS p FROM d))
SELECT doc_id::BIGINT AS doc_id, (r + 1)::INT AS r, line FROM o""")
def word_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(document.books(supplier_pages(spark, sf_dir)), lambda blob: [text for _, text, *_ in document.outline(blob)])


@query(f"""WITH {_ROWS} SELECT doc_id::BIGINT AS doc_id, '# ' || doc_id || chr(10) || chr(10) || '<!-- —— page 1 of the original —— -->' || chr(10) || chr(10) || '|  |  |  |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
|| string_agg('| ' || replace(line, chr(9), ' | ') || ' |' || chr(10), '' ORDER BY n) || chr(10) AS markdown FROM s GROUP BY doc_id""")
def markdown_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.books(supplier_pages(spark, sf_dir)).select("doc_id", "markdown")


@query("""SELECT n_regionkey::BIGINT AS doc_id, 1 AS figures, '# ' || n_regionkey || E'\\n\\n' || '<!-- —— page 1 of the original —— -->' || E'\\n\\n' || 'Region ' || n_regionkey || E' in words\\n\\n' || E'|  |  |\\n| --- | --- |\\n| Nations |  |\\n'
|| string_agg('| ' || n_name || ' | key ' || n_nationkey || E'<br>two lines |\\n', '' ORDER BY n_name) || E'\\n' || 'half is ' || chr(57344) || '1' || chr(57344) || '2' || chr(57344) || E'\\n\\n' || '![](' || n_regionkey || E'.assets/fig-1.png)\\n\\n' AS markdown
FROM nation WHERE n_regionkey <> 3 GROUP BY n_regionkey UNION ALL SELECT 3, 0, E'# 3\\n\\n> **[page 1 failed and was skipped: ValueError: cannot reshape array of size 1259999 into shape (1400,900)]**\\n\\n'""")
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.books(composed(spark, sf_dir)).select("doc_id", F.size("figures").alias("figures"), "markdown")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation WHERE n_regionkey <> 3)
SELECT n_regionkey::BIGINT AS doc_id, (k + 2)::INT AS r, 'row' AS kind, n_name || chr(9) || 'key ' || n_nationkey || chr(10) || 'two lines' AS text, 0 AS spans FROM n
UNION ALL SELECT DISTINCT n_regionkey, 0, 'p', '—— page 1 of the original ——', 0 FROM n UNION ALL SELECT DISTINCT n_regionkey, 1, 'p', 'Region ' || n_regionkey || ' in words', 0 FROM n UNION ALL SELECT DISTINCT n_regionkey, 2, 'row', 'Nations', 1 FROM n
UNION ALL SELECT DISTINCT n_regionkey, (m + 3)::INT, 'p', 'half is 12', 0 FROM n UNION ALL SELECT DISTINCT n_regionkey, (m + 4)::INT, 'picture', '', 0 FROM n
UNION ALL SELECT 3, 0, 'p', '[page 1 failed and was skipped: ValueError: cannot reshape array of size 1259999 into shape (1400,900)]', 0""")
def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(document.books(composed(spark, sf_dir)), lambda blob: [f"{kind}\x1f{text}\x1f{spans}" for kind, text, _, _, _, spans in document.outline(blob)])
    part = F.split("line", "\x1f")
    return found.select("doc_id", "r", part[0].alias("kind"), part[1].alias("text"), part[2].cast("int").alias("spans"))


@query(rf"WITH {_PIECES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS r, (pos // 40 + 1) || ' ' || regexp_replace(t, '\p{{Cc}}', '', 'g') AS line FROM pieces WHERE regexp_replace(t, '\p{{Cc}}', '', 'g') <> ''")
def searchable_pdf_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = searchable_pdf.documents(T.prose(T.table(spark, sf_dir, "documents")), W, H)
    return _read(found, lambda blob: [f"{no} {t}" for no, some in zip(searchable_pdf.page_numbers(blob), searchable_pdf.texts(blob), strict=True) for t in some])


# ---- around recognition


@query("""WITH b AS (SELECT p_partkey AS doc_id, 40 + p_partkey % 7 AS a, 60 + p_partkey % 11 AS c, 30 + p_partkey % 50 AS w, 8 + p_partkey % 13 AS h FROM part),
g AS (SELECT *, w * h * 1.6::DOUBLE / (2.0 * (w + h)) AS d FROM b)
SELECT doc_id::BIGINT AS doc_id, floor(a - 1 - d + .5)::DOUBLE AS x0, floor(c - 1 - d + .5)::DOUBLE AS y0, floor(a - 1 + w + d + .5)::DOUBLE AS x1, floor(c - 1 + h + d + .5)::DOUBLE AS y1 FROM g""")
def detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of probability maps that hold one likely rectangle, one unlikely one and a speck."""

    def run(batches):
        for batch in batches:
            rows = []
            for k in batch.column("p_partkey").to_pylist():
                p = np.zeros((160, 200))
                p[60 + k % 11 : 68 + k % 11 + k % 13, 40 + k % 7 : 70 + k % 7 + k % 50] = 0.9
                p[130:140, 20:60], p[10, 10] = 0.4, 0.9
                rows += [(k, *q.min(0).tolist(), *q.max(0).tolist()) for q in detection.quadrilaterals(p, 200, 160)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.float64()] * 4], strict=True)], names=["doc_id", "x0", "y0", "x1", "y1"])

    parts = T.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"))
    return spread(parts).mapInArrow(run, "doc_id long, x0 double, y0 double, x1 double, y1 double")


@query("""WITH c AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq, 20 + l_partkey % 400 AS w, 16 + (l_linenumber % 8) * 2 AS h FROM lineitem),
n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY w / h::DOUBLE, seq) - 1) // 6 AS batch FROM c), m AS (SELECT *, greatest(320 / 48.0::DOUBLE, max(w / h::DOUBLE) OVER (PARTITION BY doc_id, batch)) AS r FROM n)
SELECT doc_id::BIGINT AS doc_id, seq::BIGINT AS seq, batch::INT AS batch, floor(48 * r)::INT AS padded, greatest(least(ceil(48 * (w / h::DOUBLE)), floor(48 * r)), 1)::INT AS wide FROM m""")
def read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).cast("long")
    crops = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("doc_id"), F.lit(1).alias("page_no"), seq.alias("seq"), (20 + F.col("l_partkey") % 400).alias("w"), (16 + F.col("l_linenumber") % 8 * 2).alias("h"))
    return detection.read_batches(crops).select("doc_id", "seq", "batch", "padded", "wide")


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS doc_id, 10 + 200 * n_nationkey AS w, 20 + 90 * n_nationkey AS h FROM nation),
k AS (SELECT *, CASE WHEN greatest(w, h) > 2000 THEN 2000.0::DOUBLE / greatest(w, h) WHEN least(w, h) < 30 THEN 30.0::DOUBLE / least(w, h) ELSE 1 END AS k FROM s)
SELECT doc_id, CASE WHEN k = 1 THEN w ELSE greatest(floor(w * k / 32 + .5) * 32, 32) END::INT AS w, CASE WHEN k = 1 THEN h ELSE greatest(floor(h * k / 32 + .5) * 32, 32) END::INT AS h FROM k""")
def fitted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = batch.column("k").to_pylist()
            shapes = [detection.fitted(np.zeros((20 + 90 * k, 10 + 200 * k), np.uint8))[0].shape for k in keys]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([s[1] for s in shapes], pa.int32()), pa.array([s[0] for s in shapes], pa.int32())], names=["doc_id", "w", "h"])

    return T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")).mapInArrow(run, "doc_id long, w int, h int")


@query("SELECT o_orderkey, least(greatest(round(2560 / (300 + o_orderkey % 900)::DOUBLE * 72), 150), 300)::INT AS dpi FROM orders")
def page_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "orders").select("o_orderkey", render.resolution(300 + F.col("o_orderkey") % 900).alias("dpi"))


# ---- names, caches and the queue


@query("""SELECT p_partkey, CASE WHEN regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') = '' THEN 'DOC' ELSE substr(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'), 1, 16) END || '_120_' || (1000 + p_partkey % 3 * 100) || CASE p_partkey % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'd' WHEN 2 THEN 'f' ELSE 'df' END
|| '_' || CASE WHEN p_partkey > 9999 THEN p_partkey::VARCHAR ELSE printf('%04d', p_partkey) END || '.json' AS name FROM part""")
def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return T.table(spark, sf_dir, "part").select(k, X.cache_name(F.col("p_name"), "1.2.0", 1000 + k % 3 * 100, k % 4 >= 2, k % 2 == 1, k).alias("name"))


@query("""SELECT '/out/' || c_custkey || '.docx' AS path, '/out/' || c_custkey || CASE WHEN c_custkey % 2 = 1 THEN '' WHEN c_custkey % 3 > 0 THEN '-20260102030405' WHEN c_custkey % 5 > 0 THEN '-20260102030405-2' ELSE '-20260102030405-3' END || '.docx' AS out FROM customer""")
def vacant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second name is taken, every sixth also with the time stamp, every thirtieth with a number too."""
    k = F.col("c_custkey")
    base = T.table(spark, sf_dir, "customer")
    name = lambda mark: F.concat(F.lit("/out/"), k.cast("string"), F.lit(f"{mark}.docx")).alias("path")
    taken = base.filter(k % 2 == 0).select(name("")).union(base.filter(k % 6 == 0).select(name("-20260102030405"))).union(base.filter(k % 30 == 0).select(name("-20260102030405-2")))
    return files.vacant(base.select(name("")), taken, "20260102030405")


@query("""SELECT '/in/' || o_orderkey AS path, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 1 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'waiting' END AS status FROM orders WHERE o_orderkey <> 1
UNION ALL SELECT '/in/1', 'waiting' FROM orders WHERE o_orderkey = 1""")
def queue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job is taken out and put back, and tried again; nothing else changes."""
    key = F.col("o_orderkey")
    state = F.when((key == 1) | (F.col("o_orderstatus") == "F") & (key % 4 == 1), "failed").when(F.col("o_orderstatus") == "F", "done").otherwise("waiting")
    queue = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("/in/"), key.cast("string")).alias("path"), state.alias("status"))
    left, taken = jobs.removed(queue, "/in/1")
    return jobs.retried(jobs.undone(left, taken), "/in/1")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P'))::BIGINT AS "left", coalesce(sum(o_orderkey % 3) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS failed_pages FROM orders""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return jobs.run_summary(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.when(s == "F", "done").when(s == "P", "failed").otherwise("waiting").alias("status"), (F.col("o_orderkey") % 3).alias("n_errors")))


@query(f"WITH {_PIECES} SELECT doc_id::VARCHAR AS key, (pos // 40 + 1)::INT AS page_no, (row_number() OVER (PARTITION BY doc_id, pos // 40 ORDER BY pos) - 1)::INT AS seq, t, (320 + 32 * (pos % 40))::DOUBLE AS y0 FROM pieces WHERE t <> ''")
def cached_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.prose(T.table(spark, sf_dir, "documents")).withColumn("key", F.col("doc_id").cast("string"))
    return files.from_json(files.as_json(items)).select("key", "page_no", "seq", "t", "y0")


@query(f"""WITH {_PIECES}, p AS (SELECT doc_id, (pos // 40 + 1)::INT AS page_no, t, sum(len(regexp_replace(t, '\\s', '', 'g'))) OVER (PARTITION BY doc_id, pos // 40) >= 20 AS usable FROM pieces WHERE t <> '')
SELECT doc_id, page_no, CASE WHEN usable THEN 'layer ' ELSE 'read ' END || t AS t FROM p""")
def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import relational

    items = T.prose(T.table(spark, sf_dir, "documents"))
    told = lambda name: items.select("doc_id", "page_no", F.concat(F.lit(f"{name} "), "t").alias("t"))
    return files.chosen_source(relational.usable_pages(T.characters(items)), told("layer"), told("read"))


# ---- what single rules leave to be shown


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'x' || p_partkey || '/2y' WHEN 2 THEN '(a + ' || p_partkey || ')/c_1 and 3/(4 5)' ELSE '/' END AS flat FROM part""")
def flat_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = "", F.col("p_partkey")
    t = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit(f"x{m}"), k, F.lit(f"{m}2{m}y"))).when(k % 4 == 2, F.concat(F.lit(f"{m}a + "), k, F.lit(f"{m}c_1{m} and {m}3{m}4 5{m}"))).otherwise(F.lit(f"{m}{m}{m}"))
    flat = F.when(k % 4 == 3, F.replace(F.replace(X.flat_text(t), F.lit("("), F.lit("")), F.lit(")"), F.lit(""))).otherwise(X.flat_text(t))
    return T.table(spark, sf_dir, "part").select("p_partkey", flat.alias("flat"))


@query("""WITH p AS (SELECT o_orderkey, repeat(['i', 'I', 'l', 'L', '1'][o_orderkey % 5 + 1], (o_orderkey % 3 + 1)::INT) AS a, repeat(['i', 'I', 'l', 'L', '1'][(o_orderkey % 7) % 5 + 1], (o_orderkey % 4 + 1)::INT) AS b, CASE WHEN o_orderkey % 11 = 0 THEN ') other' ELSE '. same' END AS tail FROM orders)
SELECT o_orderkey, CASE WHEN len(b) > len(a) AND a[1] = b[1] AND tail = '. same' THEN b ELSE a END || '. same' AS t FROM p""")
def marker_rereads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import recognition

    k, letters = F.col("o_orderkey"), F.array(*map(F.lit, "iIlL1"))
    run = lambda at, n: F.repeat(F.element_at(letters, (at + 1).cast("int")), (n + 1).cast("int"))
    items = T.table(spark, sf_dir, "orders").select(k, F.concat(run(k % 5, k % 3), F.lit(". same")).alias("t"), F.concat(run(k % 7 % 5, k % 4), F.when(k % 11 == 0, ") other").otherwise(". same")).alias("again"))
    return recognition.reread(items)


@query("SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 2 AS x0, l_discount::DOUBLE * 10 AS s FROM lineitem WHERE l_discount * 10 >= .5 AND l_returnflag <> 'A'")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import recognition

    x = F.col("l_quantity").cast("double")
    items = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "").otherwise("t").alias("t"), (F.col("l_discount").cast("double") * 10).alias("s"), *[x.alias(c) for c in ("x0", "y0", "x1", "y1")])
    return recognition.accepted(items, 0.5).select("l_orderkey", "l_linenumber", "x0", "s")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'xlsx' ELSE 'docx' END AS formats, CASE o_orderkey % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx,xlsx' ELSE 'docx' END AS toggled FROM orders WHERE o_orderstatus = 'F'""")
def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs are tried again with their own formats or the default; a format is switched, the last one stays."""
    k = F.col("o_orderkey")
    queue = T.table(spark, sf_dir, "orders").select(k, F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.when(k % 3 == 0, "xlsx").alias("formats"))
    chosen = F.when(k % 3 == 2, F.array(F.lit("docx"), F.lit("xlsx"))).when(k % 3 == 0, F.array(F.lit("xlsx"))).otherwise(F.array(F.lit("docx")))
    return jobs.batch(queue, "docx", failed_only=True).select(k, "formats", F.array_join(jobs.toggled(chosen, F.lit("xlsx")), ",").alias("toggled"))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(E'  ' || text || E'\n x', '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN len(t) <= 30 THEN t ELSE substr(t, 1, 30) || '…' END AS line, (len(t) * 700) // 1024 AS kb, printf('%.1f MB', len(t) * 700 / 1e6) AS mb, CASE WHEN turn <= 6 THEN 10 WHEN turn <= 10 THEN 9 ELSE 8 END AS font FROM c""")
def interface_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import interface

    t = F.concat(F.lit("  "), "text", F.lit("\n x"))
    flat = interface.one_line(t, 10**9)
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", interface.one_line(t, 30).alias("line"), interface.kilobytes(F.length(flat) * 700).cast("long").alias("kb"), interface.megabytes(F.length(flat) * 700).alias("mb"), X.grid_font(F.col("turn")).alias("font"))


@query("""WITH v AS (SELECT o_custkey AS doc_id, o_orderkey AS id, floor(o_totalprice) % 900 AS x, (o_orderkey % 40) * 10 AS y0, (o_orderkey % 40) * 10 + 200 AS y1 FROM orders), b AS (SELECT c_custkey AS doc_id, (c_custkey % 5) * 100 AS bx0, (c_custkey % 5) * 100 + 300 AS bx1, 100 AS by0, 500 AS by1 FROM customer)
SELECT doc_id, id FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = v.doc_id AND v.x >= bx0 + 45 AND v.x <= bx1 - 45 AND (least(y1, by1) - greatest(y0, by0)) / (y1 - y0) > .8)""")
def upright_rules_off_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators import relational

    key, k = F.col("o_orderkey"), F.pmod("c_custkey", F.lit(5)) * 100
    segs = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no"), key.alias("id"), (F.floor("o_totalprice") % 900).cast("double").alias("x"), (key % 40 * 10).cast("double").alias("y0"), (key % 40 * 10 + 200).cast("double").alias("y1"))
    boxes = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page_no"), k.alias("bx0"), (k + 300).alias("bx1"), F.lit(100).alias("by0"), F.lit(500).alias("by1"))
    return relational.uncovered(segs, boxes, vertical=True).select("doc_id", "id")


def _drawn(spark: SparkSession, sf_dir: str, found_in, schema: str) -> DataFrame:
    """Rows that found_in gives for the key of each nation, in Python."""
    names, kinds = [c.split()[0] for c in schema.split(", ")], [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for k in batch.column("k").to_pylist() for r in found_in(k)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names=names)

    return T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")).mapInArrow(run, schema)


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS k, unnest(range(0, 1 + n_nationkey % 4)) AS i FROM nation) SELECT k, (10 + 40 * i)::INT AS x, (20 + k)::INT AS y, (5 + i)::INT AS w, (3 + k % 5)::INT AS h, ((5 + i) * (3 + k % 5))::INT AS area FROM s
UNION ALL SELECT n_nationkey, 5, 150, 20, 20, 20 FROM nation""")
def raster_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of drawn rectangles, and of a diagonal, which hangs together by corners."""

    def found(k: int) -> list[tuple]:
        bits = np.zeros((200, 200), bool)
        for i in range(1 + k % 4):
            bits[20 + k : 23 + k + k % 5, 10 + 40 * i : 15 + 41 * i] = True
        bits[150 + np.arange(20), 24 - np.arange(20)] = True
        return [(k, *b) for b in imaging.blobs(bits)]

    return _drawn(spark, sf_dir, found, "k long, x int, y int, w int, h int, area int")


@query("SELECT n_nationkey::BIGINT AS k, (1 + n_nationkey % 3)::INT AS columns, 2 AS rows, (n_nationkey % 3 + 1) * 2 AS cells FROM nation")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids whose standing rules have gaps of a few pixels and lean by one; one more bar crosses text and is a letter's stroke."""
    from quire.operators import grids
    from quire.operators.page import Box

    def found(k: int) -> list[tuple]:
        n = 1 + k % 3
        px = np.full((800, 1200), 255, np.uint8)
        xs, ys = [100 + 900 * i // n for i in range(n + 1)], (200, 300, 400)
        for y in ys:
            px[y : y + 2, xs[0] : xs[-1] + 2] = 0
        for x in xs:
            px[200:252, x : x + 2] = px[255:340, x + 1 : x + 3] = px[343:402, x : x + 2] = 0
        px[205:395, 150:153] = 0
        hs, vs, tol = imaging.page_rules(px)
        boxes = [Box("stroke", 120.0, 190.0, 190.0, 410.0)]
        return [(k, len(g.xs) - 1, len(g.ys) - 1, len(g.cells)) for g in grids.grids_of(hs, vs, boxes, 1200, tol)]

    return _drawn(spark, sf_dir, found, "k long, columns int, rows int, cells int")


@query("""SELECT s_suppkey, s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey = max(s_suppkey) OVER (PARTITION BY s_suppkey // 16) THEN s_name ELSE s_name || CASE WHEN s_suppkey % 4 = 1 THEN ' ' ELSE chr(10) END || 'more of it' END AS name, s_nationkey::VARCHAR AS nation FROM supplier""")
def continued_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of which every second goes on in a line of its own: joined where the cell's first line was full.

    A table ends with its last wide line, so what goes on below that is text.
    """
    key = F.col("s_suppkey")
    rows = T.table(spark, sf_dir, "supplier")
    full = F.when(key % 4 == 1, 700).otherwise(460)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).alias("n"), t.cast("string").alias("t"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1")) for c, n, t, x0, x1 in (
        (0, 0, key, F.lit(64), F.lit(120)), (1, 0, F.col("s_name"), F.lit(256), full), (2, 0, F.col("s_nationkey"), F.lit(768), F.lit(800)), (3, 1, F.when(key % 2 == 1, "more of it"), F.lit(256), F.lit(400)))])
    items = rows.select(F.floor(key / 16).alias("doc_id"), F.lit(1).alias("page_no"), key, F.explode(cells).alias("i")).filter("i.t IS NOT NULL")
    y0 = T.TOP + 64 * F.pmod(key, F.lit(16)) + T.PITCH * F.col("i.n")
    items = items.select("doc_id", "page_no", (key * 4 + F.col("i.c")).alias("seq"), "i.t", "i.x0", y0.cast("double").alias("y0"), "i.x1", (y0 + T.TALL).cast("double").alias("y1"))
    found = page.blocks_of(items, W, H).filter("kind = 'table'").select(F.explode("rows").alias("r"))
    return found.select(F.col("r")[0].cast("long").alias("s_suppkey"), F.col("r")[0].alias("key"), F.col("r")[1].alias("name"), F.col("r")[2].alias("nation"))
