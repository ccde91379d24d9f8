"""Named queries over the driver's tables, each with an independent DuckDB statement where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import interface
from quire.functions import text as X
from quire.operators import components, crosspage, figures, grids, imaging, noise, page, recognition, styles, textlayer
from quire.operators import relational as R
from quire.plans.folding import dealt
from quire.sinks import markdown, searchable_pdf
from quire.sources import jobs
from quire.sources import typeset as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W, H = T.WIDTH, T.HEIGHT


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(c: Column) -> Column:
    return F.format_string("%.2f", c)


def table_text(items: DataFrame, names: list[str], together: bool = False) -> DataFrame:
    """The rows of rebuilt tables, as text columns."""
    rows = page.blocks_of(items, W, H, together=together).filter("kind = 'table'").select(F.explode("rows").alias("r"))
    return rows.select(*[F.get("r", F.lit(k)).alias(n) for k, n in enumerate(names)])


# ---- tables set as pages and rebuilt


def nation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "nation")
    return T.cells(rows, F.lit(1), F.col("n_nationkey"), [F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")], 300)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def table_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_text(nation_items(spark, sf_dir), ["n_nationkey", "n_name", "n_regionkey"])


flagship = table_roundtrip_nation


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, printf('%.2f', s_acctbal) AS s_acctbal FROM supplier")
def table_roundtrip_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    columns = [key, F.col("s_name"), F.col("s_nationkey"), money(F.col("s_acctbal"))]
    return table_text(T.cells(T.table(spark, sf_dir, "supplier"), F.floor(key / 500), F.pmod(key, F.lit(500)), columns, 240), ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the line tables of orders that have at least two lines; a single row would be text.

    Lines are dealt by document, so a page's items lie together; one sort serves both windows.
    """
    by = Window.partitionBy("doc", "l_orderkey")
    lines = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.floor(F.col("l_orderkey") / 8).alias("doc"))
    rows = dealt(lines, "doc").withColumn("place", F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).withColumn("n", F.count("*").over(by)).filter("n > 1")
    columns = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int"), F.col("l_returnflag")]
    return T.cells(rows, F.col("doc"), F.pmod(F.col("l_orderkey"), F.lit(8)) * T.ROWS + F.col("place"), columns, 150)


@query("""SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_partkey::VARCHAR AS l_partkey, l_suppkey::VARCHAR AS l_suppkey,
l_quantity::INT::VARCHAR AS l_quantity, l_returnflag FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n > 1""")
def table_roundtrip_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_text(order_lines(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"], together=True)


@query("""SELECT doc_id, markdown FROM (SELECT 1::BIGINT AS doc_id,
string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' || CASE WHEN n_nationkey = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY n_nationkey) AS markdown FROM nation)""")
def markdown_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.rendered(page.blocks_of(nation_items(spark, sf_dir), W, H))


# ---- text rules

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# The patterns of the SQL, written out from the rules; the implementation's are never read here.
_NUM = r"^(\d{1,2}\.\d{1,2}(\.\d{1,2})?[\s、．.]|\d{1,2}[.、]\s*|[一二三四五六七八九十]+[、．.]|[（(]\d{1,2}[）)]|[（(][A-Za-z][）)]|[ivxIVX]{2,4}[.、](\s|[A-Z][a-z])|[A-Za-z][.、](\s|[A-Z][a-z])|[•·●○*]\s*|[-–—]\s+)"
_STOP = r"[。．.：:；;!?！？）)】\]\"”]\z"
_GLYPH = r"^([•·●○*]\s*|[-–—]\s+)"
_PROSE = r"[。！？；：]\z|^([•·●○。]\s*\S|\d{1,2}[.、]\s*\S|[（(]\d{1,2}[）)]|[一二三四五六七八九十]+[、．.])"
_LABEL = r"^[\dA-Za-z][.、)）]?\z"
_ABOVE = r"^(Contract No\.|January \d+|Attachment \d|Page\s*\d+\s*/\s*\d+)"
_BELOW = r"^(\d{1,3}\s*/\s*\d{1,3}\z|\d{1,3}\z|[-—–]\s*\d{1,3}\s*[-—–.．。]?\z|邮箱|地址|邮编|网址|http)"


def _clean(t: str) -> str:
    return f"regexp_replace(regexp_replace(replace({t}, chr(12288), ' '), '^{_WS}+|{_WS}+\\z', '', 'g'), '{_WS}{{2,}}', ' ', 'g')"



@query(f"SELECT doc_id, {_clean('t')} AS cleaned FROM (SELECT doc_id, chr(12288) || ' ' || replace(text, '. ', '.  ' || chr(12288)) || chr(10) || ' ' AS t FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("　 "), F.replace(F.col("text"), F.lit(". "), F.lit(".  　")), F.lit("\n "))
    return T.table(spark, sf_dir, "documents").select("doc_id", X.clean(t).alias("cleaned"))


#: Fixed values of this adapter: beginnings and ends that the text rules tell apart.
HEADS = ("", "1. ", "a. ", "• ", "第二条 ", "1.2 ", "A. ", "一、", "(1) ", "ii. ", "3 ", "- ", "e.g. ")
TAILS = ("", "。", ":", "；", "]")
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_PIECES = """pieces AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT doc_id,
flatten([[substr(l, k * 80 + 1, 80) for k in range(0, greatest(0, (len(l) - 1) // 80) + 1)] for l in string_split(text, chr(10))]) AS ps FROM documents))"""
_MARKED = f"""{_PIECES}, marked AS (SELECT doc_id, pos, {_LIST(HEADS)}[(pos + doc_id) % {len(HEADS)} + 1] || t || {_LIST(TAILS)}[(pos + 3 * doc_id) % {len(TAILS)} + 1] AS t FROM pieces)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(k, F.lit(len(xs))) + 1).cast("int"))
    rows = T.pieces(T.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "pos", F.concat(pick(HEADS, F.col("pos") + F.col("doc_id")), F.col("t"), pick(TAILS, F.col("pos") + 3 * F.col("doc_id"))).alias("t"))


@query(rf"""WITH {_MARKED} SELECT doc_id, pos, regexp_matches(t, '{_NUM}') AS starts, regexp_matches(t, '{_STOP}') AS ends, regexp_matches(t, '{_GLYPH}') AS bullet,
regexp_matches(t, '{_PROSE}') AS prose, len(regexp_extract_all(t, '\p{{L}}')) >= 2 AS speaks FROM marked""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return marked(spark, sf_dir).select("doc_id", "pos", X.num_start(t).alias("starts"), X.end_punct(t).alias("ends"), X.bullet(t).alias("bullet"), X.looks_like_prose(t).alias("prose"), X.lang_clear(t).alias("speaks"))


@query(rf"""WITH {_MARKED}, x AS (SELECT doc_id, pos, trim(t) AS t FROM marked)
SELECT doc_id, pos, CASE WHEN regexp_matches(t, '[。；;]\z') THEN NULL WHEN regexp_matches(t, '^[A-Z]\.\s+[A-Z]') AND len(t) < 70 THEN 1
WHEN regexp_matches(t, '^\d{{1,2}}[\.、]\s*\S') AND len(t) < 90 AND NOT regexp_matches(t, '^\d{{1,2}}\.\d') THEN 2
WHEN regexp_matches(t, '^[一二三四五六七八九十]+[、．.]') AND len(t) < 60 THEN 2 WHEN regexp_matches(t, '^\d{{1,2}}\.\d{{1,2}}[\s、．.]') AND len(t) < 90 THEN 3
WHEN regexp_matches(t, '^\d{{1,2}}\s+[A-Z][a-z]') AND len(t) < 70 THEN 3 END AS level FROM x""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", "pos", X.heading_level(F.col("t")).alias("level"))


@query(rf"""WITH {_MARKED} SELECT doc_id, pos, (len(t) + len(regexp_extract_all(t, '[\x{{2E81}}-\x{{10FFFF}}]')))::INT AS width, len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FFF}}]')) >= 2 AS zh FROM marked""")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", "pos", X.disp_w(F.col("t")).alias("width"), X.is_zh(F.col("t")).alias("zh"))


@query(r"""SELECT page_id, replace(replace(html, '|', '\|'), chr(10), '<br>') AS cell, regexp_replace(html, '^([#>|])', '\\\1') AS escaped,
replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml, regexp_replace(html, '\n{3,}', chr(10) || chr(10), 'g') AS squeezed FROM pages""")
def markdown_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return T.table(spark, sf_dir, "pages").select("page_id", X.md_cell(h).alias("cell"), X.md_escape(h).alias("escaped"), X.xml_escape(h).alias("xml"), X.squeeze(h).alias("squeezed"))


@query(r"""SELECT conv_id, turn, array_to_string([printf('%04X', unicode(c)) for c in string_split(regexp_replace(text, '\p{Cc}', '', 'g'), '') if c <> ''], '') AS hex FROM conversations""")
def utf16_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.utf16_hex(F.col("text")).alias("hex"))


_CELLS = "SELECT l_orderkey, l_linenumber, CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN printf('%.2f', l_extendedprice) WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN '0' || l_suppkey WHEN 3 THEN '-' || l_linenumber || '.5' WHEN 4 THEN l_returnflag || l_orderkey ELSE l_orderkey || '00000000' END AS t FROM lineitem"


@query(rf"""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(t, '^-?\d{{1,10}}(\.\d+)?\z') AND NOT regexp_matches(t, '^-?0\d') THEN TRY_CAST(t AS DOUBLE) END AS value,
CASE WHEN regexp_matches(t, '^-?\d{{1,10}}\.\d+\z') AND NOT regexp_matches(t, '^-?0\d') THEN '0.' || repeat('0', len(split_part(t, '.', 2))) END AS format FROM ({_CELLS})""")
def cell_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(6))
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    t = F.when(kind == 0, money(F.col("l_extendedprice"))).when(kind == 1, F.col("l_partkey").cast("string")).when(kind == 2, F.concat(F.lit("0"), F.col("l_suppkey"))).when(kind == 3, F.concat(F.lit("-"), line, F.lit(".5"))).when(kind == 4, F.concat("l_returnflag", key)).otherwise(F.concat(key, F.lit("00000000")))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.cell_number(t).alias("value"), X.cell_format(t).alias("format"))


@query("SELECT p_partkey, CASE WHEN regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') = '' THEN 'DOC' ELSE substr(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'), 1, 16) END AS stem FROM part")
def cache_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", X.cache_stem(F.col("p_name")).alias("stem"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d h %d min', s // 3600, (s % 3600) // 60) WHEN s >= 60 THEN printf('%d min %d s', s // 60, s % 60) ELSE printf('%d s', s) END AS took
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 59 ELSE floor(o_totalprice / 20)::BIGINT END AS s FROM orders)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.pmod("o_orderkey", F.lit(59))).otherwise(F.floor(F.col("o_totalprice") / 20))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", X.duration(s).alias("took"))


# ---- noise, text layer, geometry

_STREWN = f"""{_PIECES}, k AS (SELECT *, (pos + doc_id) % 17 AS kind, CASE WHEN pos % 13 = 0 THEN 992 ELSE 128 END AS x0, 48 * (pos % 42) AS y0, 1 - (pos % 24) / 64.0 AS s FROM pieces),
strewn AS (SELECT doc_id, pos, x0, y0, s, CASE WHEN kind < {len(T.STRAYS)} THEN {_LIST(T.STRAYS)}[kind + 1] ELSE t END AS t FROM k)"""


@query(rf"""WITH {_STREWN}, c AS (SELECT doc_id, pos, s::DOUBLE AS s, x0 / 1024.0 AS rx0, (x0 + least(10 * len(t), 1020 - x0)) / 1024.0 AS rx1, y0 / 2048.0 AS ry0, (y0 + 24) / 2048.0 AS ry1, {_clean("t")} AS t FROM strewn),
p AS (SELECT *, len(t) AS n, rx0 <= .95 AND rx1 >= .05 AND regexp_matches(t, '{_PROSE}') AS prose FROM c WHERE t <> '')
SELECT doc_id, pos, t, CASE WHEN ry1 < .125 AND regexp_matches(t, '{_ABOVE}') THEN 'header' WHEN ry0 > .85 AND regexp_matches(t, '{_BELOW}') THEN 'footer' ELSE 'body' END AS zone FROM p
WHERE NOT ((ry1 > .90 OR ry0 < .05) AND s < .88 AND n <= 3 AND NOT prose) AND NOT ((rx0 > .95 OR rx1 < .05) AND n <= 3)
AND NOT (s < .88 AND n <= 4 AND NOT prose AND NOT regexp_matches(t, '{_LABEL}'))""")
def noise_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.zones(T.strewn(T.table(spark, sf_dir, "documents")), W, H).select("doc_id", F.col("seq").alias("pos"), "t", "zone")


@query(rf"""WITH {_PIECES} SELECT doc_id, (pos // 40 + 1)::INT AS page_no, sum(len(regexp_replace(t, '\s', '', 'g')))::BIGINT AS visible, sum(len(regexp_replace(t, '\s', '', 'g'))) >= 20 AS usable FROM pieces WHERE t <> '' GROUP BY ALL""")
def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usable_pages(T.prose(T.table(spark, sf_dir, "documents")), column="t")


@query(rf"""WITH {_PIECES} SELECT doc_id, (pos // 40 + 1)::INT AS page_no, t, (64 + 32 * (pos % 3))::DOUBLE AS x0, (320 + 32 * (pos % 40))::DOUBLE AS y0 FROM pieces WHERE trim(t) <> ''""")
def segment_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textlayer.segments_packed(T.packed_characters(T.prose(T.table(spark, sf_dir, "documents")))).select("doc_id", "page_no", "t", "x0", "y0")


@query("""WITH d AS (SELECT l_suppkey, l_extendedprice AS v, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER w > 50 OR lag(l_extendedprice) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)),
g AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY v) AS cluster FROM d)
SELECT l_suppkey, cluster::BIGINT AS cluster, round(avg(v), 4) AS mean, count(*) AS n FROM g GROUP BY ALL""")
def gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.gap_clusters(T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 50.0)
    return found.withColumn("mean", F.round("mean", 4))


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_quantity * 3 AS y0, (l_partkey % 1000)::DOUBLE AS x0 FROM lineitem),
s AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0, seq) >= 10 THEN 1 ELSE 0 END AS b FROM b),
l AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY y0, seq) AS line FROM s)
SELECT doc_id, seq, line::BIGINT AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line, x0, seq)::INT AS place FROM l""")
def box_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") * 3).alias("y0"), F.pmod("l_partkey", F.lit(1000)).cast("double").alias("x0"))
    return R.reading_order(boxes).select("doc_id", "seq", "line", "place")


_RULES = """h AS (SELECT o_custkey AS doc_id, o_orderkey AS h_id, floor(o_totalprice) % 500 AS x0, floor(o_totalprice) % 500 + 300 AS x1, (o_orderkey % 97) * 10 AS y FROM orders),
v AS (SELECT o_custkey AS doc_id, o_orderkey AS v_id, (o_orderkey % 83) * 12 AS x, floor(o_totalprice) % 700 AS y0, floor(o_totalprice) % 700 + 400 AS y1 FROM orders),
c AS (SELECT h.doc_id, h_id, v_id FROM h JOIN v ON h.doc_id = v.doc_id AND v.x BETWEEN h.x0 - 5 AND h.x1 + 5 AND h.y BETWEEN v.y0 - 5 AND v.y1 + 5)"""


def rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, at = T.table(spark, sf_dir, "orders"), F.floor("o_totalprice").cast("double")
    own = [F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no")]
    h = o.select(*own, F.col("o_orderkey").alias("h_id"), (at % 500).alias("x0"), (at % 500 + 300).alias("x1"), (F.pmod("o_orderkey", F.lit(97)) * 10).alias("y"))
    return h, o.select(*own, F.col("o_orderkey").alias("v_id"), (F.pmod("o_orderkey", F.lit(83)) * 12).alias("x"), (at % 700).alias("y0"), (at % 700 + 400).alias("y1"))


@query(f"WITH {_RULES} SELECT doc_id, h_id, v_id FROM c")
def rule_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crossings(*rules(spark, sf_dir), 5.0).select("doc_id", "h_id", "v_id")


@query(f"""WITH RECURSIVE {_RULES}, e AS (SELECT doc_id, h_id * 2 AS a, v_id * 2 + 1 AS b FROM c UNION SELECT doc_id, v_id * 2 + 1, h_id * 2 FROM c),
r AS (SELECT DISTINCT doc_id, a, a AS z FROM e UNION SELECT e.doc_id, e.a, r.z FROM e JOIN r ON e.doc_id = r.doc_id AND e.b = r.a)
SELECT doc_id, CASE WHEN a % 2 = 0 THEN 'h' ELSE 'v' END AS kind, a // 2 AS id, min(z) FILTER (z % 2 = 0) // 2 AS root FROM r GROUP BY doc_id, a""")
def rule_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.rule_components(R.crossings(*rules(spark, sf_dir), 5.0)).select("doc_id", "kind", "id", "root")


@query(f"""WITH {_RULES}, n AS (SELECT doc_id, y, CASE WHEN y - lag(y) OVER w > 5 OR lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY y)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY y) AS g FROM n), y AS (SELECT doc_id, avg(y) AS y FROM g GROUP BY doc_id, g)
SELECT v.doc_id, v_id, count(*) AS reached FROM v JOIN y ON v.doc_id = y.doc_id AND y.y BETWEEN v.y0 - 10 AND v.y1 + 10 GROUP BY ALL HAVING count(*) >= 2""")
def anchored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, v = rules(spark, sf_dir)
    return R.anchored(v, h.select("doc_id", "page_no", "y"), 5.0).select("doc_id", "v_id", "reached")


_BOXES = """bx AS (SELECT c_custkey AS doc_id, abs(floor(c_acctbal)) % 400 AS bx0, abs(floor(c_acctbal)) % 400 + 500 AS bx1, (c_custkey % 60) * 10 AS by0, (c_custkey % 60) * 10 + 400 AS by1 FROM customer)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, key = F.abs(F.floor("c_acctbal")).cast("double") % 400, F.pmod("c_custkey", F.lit(60)) * 10
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page_no"), at.alias("bx0"), (at + 500).alias("bx1"), key.alias("by0"), (key + 400).alias("by1"))


@query(f"""WITH {_RULES}, {_BOXES} SELECT doc_id, h_id FROM h WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.doc_id = h.doc_id AND h.y >= by0 + greatest(.15 * (by1 - by0), 2) AND h.y <= by1 - greatest(.15 * (by1 - by0), 2)
AND (least(x1, bx1) - greatest(x0, bx0)) / (x1 - x0) > .8)""")
def rules_off_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = rules(spark, sf_dir)[0].withColumnRenamed("h_id", "id")
    return R.uncovered(segs, boxes(spark, sf_dir)).select("doc_id", F.col("id").alias("h_id"))


_POINTS = "i AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, floor(o_totalprice) % 900 AS x, (o_orderkey % 97) * 10 AS y FROM orders)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.floor("o_totalprice").cast("double") % 900, F.pmod("o_orderkey", F.lit(97)) * 10
    return T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("o_orderkey").alias("seq"), (x - 4).alias("x0"), (x + 4).alias("x1"), (y - 6).alias("y0"), (y + 6).alias("y1"))


@query(f"WITH {_POINTS}, {_BOXES} SELECT i.doc_id, seq FROM i JOIN bx ON i.doc_id = bx.doc_id AND x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1")
def items_in_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_boxes(points(spark, sf_dir), boxes(spark, sf_dir)).select("doc_id", "seq")


@query(f"WITH {_POINTS}, {_BOXES} SELECT doc_id, seq FROM i WHERE NOT EXISTS (SELECT 1 FROM bx WHERE i.doc_id = bx.doc_id AND x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1)")
def items_off_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_boxes(points(spark, sf_dir), boxes(spark, sf_dir), inside=False).select("doc_id", "seq")


@query("""SELECT l_orderkey, l_linenumber, len([e for e in [10, 20, 30, 40] if e <= l_quantity])::INT AS band,
CASE WHEN l_quantity / 64.0 >= .75 - .02 THEN 2 WHEN l_quantity / 64.0 >= .25 - .02 THEN 1 ELSE 0 END AS col FROM lineitem""")
def cell_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    edges, starts = F.array(*[F.lit(float(e)) for e in range(0, 60, 10)]), F.array(F.lit(0.125), F.lit(0.25), F.lit(0.75))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.band(q, edges).alias("band"), R.col_of(q / 64.0, starts).cast("int").alias("col"))


@query("""WITH r AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT event_type, min(event_id) AS start, count(*) AS length FROM r GROUP BY event_type, k HAVING count(*) >= 2""")
def runs_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs(T.table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 2)


# ---- lines, paragraphs, pages


def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prose(T.table(spark, sf_dir, "documents")).select("doc_id", "page_no", "seq", "t", (F.col("x0") / W).alias("cx0"), (F.col("y0") / H).alias("ry0"))


_LINES = f"{_PIECES}, l AS (SELECT doc_id, (pos // 40 + 1)::INT AS page_no, pos, t, (64 + 32 * (pos % 3)) / 1024.0::DOUBLE AS cx0, (320 + 32 * (pos % 40)) / 2048.0::DOUBLE AS ry0 FROM pieces WHERE t <> '')"


@query(f"""WITH {_LINES}, d AS (SELECT doc_id, page_no, ry0 - lag(ry0) OVER (PARTITION BY doc_id, page_no ORDER BY ry0) AS d FROM l),
s AS (SELECT doc_id, page_no, list_sort(list(d) FILTER (d > 0 AND d < .08)) AS ds FROM d GROUP BY ALL)
SELECT doc_id, page_no, coalesce(ds[len(ds) // 2 + 1], .02)::DOUBLE AS lead FROM s""")
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_pitch(prose_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, page_no, round(cx0 * 200)::BIGINT AS k, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT doc_id, page_no, k FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, k) = 1)
SELECT l.doc_id, l.page_no, pos, k / 200.0::DOUBLE AS base, least(greatest(round((cx0 - k / 200.0) / .035), 0), 15)::INT AS level FROM l JOIN b ON l.doc_id = b.doc_id AND l.page_no = b.page_no""")
def indent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = prose_lines(spark, sf_dir)
    joined = lines.join(R.usual_indent(lines), ["doc_id", "page_no"])
    return joined.select("doc_id", "page_no", F.col("seq").alias("pos"), "base", R.indent_level(F.col("cx0"), F.col("base")).alias("level"))


@query(f"""WITH {_LINES} SELECT doc_id, page_no, {_clean("t")} AS text, cx0, ry0 FROM l WHERE {_clean("t")} <> ''""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.lines_of(T.prose(T.table(spark, sf_dir, "documents")), W, H).select("doc_id", "page_no", "text", "cx0", "ry0")


@query(f"WITH {_LINES} SELECT doc_id, page_no, count(*) AS n_lines, count(DISTINCT cx0) AS n_starts, min(ry0) AS top FROM l GROUP BY ALL")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_lines(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.countDistinct("cx0").alias("n_starts"), F.min("ry0").alias("top"))


@query("SELECT p_size AS doc_id, sum((p_retailprice > 1200)::INT) * 2 > count(*) AS landscape FROM part GROUP BY p_size")
def orientation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mostly_landscape(T.table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_retailprice").alias("w"), F.lit(1200.0).alias("h")))


_TABLES = """p AS (SELECT o_custkey AS doc_id, (row_number() OVER w + sum((o_orderstatus = 'F')::INT) OVER w)::INT AS page_no, [.125, .25 + (o_orderkey % 3) * .03125, .5] AS starts FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
q AS (SELECT *, CASE WHEN page_no = lag(page_no) OVER w + 1 AND abs(starts[2] - lag(starts[2]) OVER w) < .05 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page_no)::BIGINT AS island FROM q)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    at = (F.row_number().over(by) + F.sum((F.col("o_orderstatus") == "F").cast("int")).over(by)).cast("int")
    starts = F.array(F.lit(0.125), 0.25 + F.pmod("o_orderkey", F.lit(3)) * 0.03125, F.lit(0.5))
    return T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), at.alias("page_no"), starts.alias("starts"))


@query(f"WITH {_TABLES} SELECT doc_id, page_no, island FROM i")
def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.islands(pieces(spark, sf_dir)).select("doc_id", "page_no", "island")


@query(f"WITH {_TABLES} SELECT doc_id, island, CASE WHEN min(page_no) = max(page_no) THEN min(page_no)::VARCHAR ELSE min(page_no) || '-' || max(page_no) END AS label FROM i GROUP BY ALL")
def page_span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_labels(pieces(spark, sf_dir)).select("doc_id", "island", "label")


@query(f"""WITH RECURSIVE {_TABLES}, n AS (SELECT doc_id, page_no, starts[2] AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM p),
f AS (SELECT doc_id, page_no, k, s AS anchor, 1 AS table_no FROM n WHERE k = 1 UNION ALL
SELECT n.doc_id, n.page_no, n.k, CASE WHEN n.page_no = f.page_no + 1 AND abs(n.s - f.anchor) < .05 THEN f.anchor ELSE n.s END, CASE WHEN n.page_no = f.page_no + 1 AND abs(n.s - f.anchor) < .05 THEN f.table_no ELSE f.table_no + 1 END
FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1)
SELECT doc_id, page_no, table_no::INT AS table_no FROM f""")
def doc_anchor_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces(spark, sf_dir).withColumns({"block": F.lit(0), "kind": F.lit("table")})
    return crosspage.continued(rows).select("doc_id", "page_no", "table_no")


# ---- rasters and recognition


def ruled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ruled table drawn for each region: a row for each nation, two columns and one more for each region key."""
    rows = T.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        box = pa.struct([("t", pa.string()), *((k, pa.float64()) for k in ("x0", "y0", "x1", "y1"))])
        for batch in batches:
            for doc, names in zip(batch.column("doc_id").to_pylist(), batch.column("names").to_pylist(), strict=True):
                columns, px = 2 + doc, np.full((600, 900), 255, np.uint8)
                xs, ys = [50 + 800 * k // columns for k in range(columns + 1)], [40 + 60 * k for k in range(len(names) + 1)]
                for y in ys:
                    px[y : y + 2, xs[0] : xs[-1] + 2] = 0
                for x in xs:
                    px[ys[0] : ys[-1] + 2, x : x + 2] = 0
                boxes = [{"t": f"{name}-{c}", "x0": xs[c] + 8.0, "y0": ys[r] + 20.0, "x1": xs[c] + 60.0, "y1": ys[r] + 40.0} for r, name in enumerate(names) for c in range(columns)]
                yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([1], pa.int32()), pa.array([900], pa.int32()), pa.array([600], pa.int32()), pa.array([px.tobytes()], pa.binary()), pa.array([boxes], pa.list_(box))], names=["doc_id", "page_no", "w", "h", "px", "boxes"])

    return rows.mapInArrow(run, "doc_id long, page_no int, w int, h int, px binary, boxes array<struct<t string, x0 double, y0 double, x1 double, y1 double>>")


@query("""WITH n AS (SELECT n_regionkey::BIGINT AS doc_id, n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS r FROM nation)
SELECT doc_id, r, c::INT AS c, n_name || '-' || c AS text, true AS closed FROM (SELECT *, unnest(range(0, 2 + doc_id)) AS c FROM n)""")
def raster_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.raster_grids(ruled_pages(spark, sf_dir)).select("doc_id", "r", "c", "text", F.forall("edges", lambda e: e).alias("closed"))


@query("SELECT n_regionkey::BIGINT AS doc_id, 1::INT AS page_no, 0::INT AS spread, 0::DOUBLE AS angle FROM nation GROUP BY n_regionkey")
def raster_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.prepared(ruled_pages(spark, sf_dir)).select("doc_id", "page_no", "spread", "angle")


@query("""WITH f AS (SELECT conv_id, turn, text AS t FROM conversations), c AS (SELECT conv_id, turn, regexp_replace(lower(t), '[^a-z]', ' ', 'g') AS t FROM f),
k AS (SELECT conv_id, turn, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) AS p FROM c),
d AS (SELECT *, lag(x) OVER (PARTITION BY conv_id, turn ORDER BY p) AS b FROM k)
SELECT conv_id, turn, coalesce(string_agg(x, '' ORDER BY p) FILTER (x BETWEEN 'a' AND 'z' AND x IS DISTINCT FROM b), '') AS read FROM d GROUP BY ALL""")
def greedy_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(chr(97 + k)) for k in range(26)])
    steps = F.split(F.regexp_replace(F.lower("text"), "[^a-z]", " "), "")
    frame = lambda x: F.concat(F.array(F.when(x == " ", 0.9).otherwise(0.05)), F.transform(letters, lambda a: F.when(a == x, 0.9).otherwise(0.05)))
    text, _ = recognition.decoded(F.transform(F.filter(steps, lambda x: x != ""), frame), letters)
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("read"))


@query("""SELECT c_custkey, CASE WHEN k = 0 THEN 'docx,xlsx' WHEN k = 1 THEN 'md' WHEN k = 2 THEN NULL WHEN k = 3 THEN NULL ELSE 'docx,pdf' END AS formats FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def format_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("XLSX, docx", "markdown", "docs", "", "pdf+word/pdf")
    t = F.element_at(F.array(*map(F.lit, names)), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(X.parse_formats(t), ",").alias("formats"))


# ---- files


@query(f"""WITH {_PIECES} SELECT doc_id, pos, 24 * 72 / 150.0::DOUBLE AS size, least(greatest(round(100 * (10 * len(t)) * .48 / (greatest(len(t), 1) * 11.52), 6), 10), 400)::DOUBLE AS stretch,
round((64 + 32 * (pos % 3)) * .48, 6)::DOUBLE AS x, round(2048 * .48 - (344 + 32 * (pos % 40)) * .48 + .15 * 11.52, 6)::DOUBLE AS baseline FROM pieces WHERE t <> ''""")
def text_run_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.lit(72 / 150)
    found = T.prose(T.table(spark, sf_dir, "documents")).withColumns(searchable_pdf.placement(k, k, F.lit(H) * k))
    return found.select("doc_id", F.col("seq").alias("pos"), *[F.round(c, 6).alias(c) for c in ("size", "stretch", "x", "baseline")])


# ---- figures, looks, texts and the queue


def stamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ruled pages with a black square below the table."""
    pages = ruled_pages(spark, sf_dir)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                px = np.frombuffer(r["px"], np.uint8).reshape(r["h"], r["w"]).copy()
                px[400:460, 400:460] = 0
                r["px"] = px.tobytes()
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return pages.mapInArrow(run, pages.schema)


@query("SELECT n_regionkey::BIGINT AS doc_id, 0::INT AS figure, 397::INT AS x0, 397::INT AS y0, 463::INT AS x1, 463::INT AS y1, 'center' AS align FROM nation GROUP BY n_regionkey")
def figure_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = figures.figures_of(stamped_pages(spark, sf_dir))
    return found.select("doc_id", "figure", "x0", "y0", "x1", "y1", figures.alignment(F.col("x0"), F.col("x1"), F.lit(900)).alias("align"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS y FROM lineitem GROUP BY ALL), f AS (SELECT o_orderkey AS k, o_totalprice % 50 AS y FROM orders),
a AS (SELECT f.k, min(n) FILTER (b.y > f.y) AS first, count(n) AS n FROM f LEFT JOIN b ON b.k = f.k GROUP BY f.k)
SELECT a.k AS doc_id, CASE WHEN first IS NULL THEN a.n ELSE (SELECT count(*) FROM b WHERE b.k = a.k AND b.n < first) END::INT AS place FROM a""")
def figure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).alias("page_no")
    numbered = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("y0"))  # line numbers repeat; blocks' don't
    blocks = numbered.select(F.col("l_orderkey").alias("doc_id"), one, F.col("l_linenumber").alias("block"), "y0")
    figs = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), one, F.lit(0).alias("figure"), (F.col("o_totalprice") % 50).alias("y0"))
    return figures.interleaved(blocks, figs).filter("kind = 'figure'").select("doc_id", F.col("at").alias("place"))


@query("""SELECT n_nationkey, round(greatest(9000 * ((1 + n_nationkey) / 100.0::DOUBLE) / .9, 680.4))::INT AS first, round(9000 * (.9 - (1 + n_nationkey) / 100.0::DOUBLE) / .9)::INT AS second,
round(9000 * (1 + n_nationkey) / (5.0 + n_nationkey))::INT AS ruled FROM nation""")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.col("n_nationkey") + 1) / 100
    free = styles.table_widths(F.array(F.lit(0.1), F.lit(0.1) + step), 9000.0)
    ruled = styles.grid_widths(F.array(F.lit(0.0), step, step + 0.04), 9000.0)
    return T.table(spark, sf_dir, "nation").select("n_nationkey", free[0].alias("first"), free[1].alias("second"), ruled[0].alias("ruled"))


_TAGS = {"zh_TW.UTF-8": "zh-Hant", "zh-Hans-SG": "zh", "EN_us": "en", "fr": None, "de": "de", "ja_JP": "ja", "ko.eucKR": "ko"}


@query(f"""SELECT c_custkey, CASE c_custkey % 7 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_TAGS.values()) if v)} END AS language FROM customer""")
def locale_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (F.pmod("c_custkey", F.lit(7)) + 1).cast("int"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", interface.language(tag).alias("language"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '—— pages ' || c_custkey || '–' || (c_custkey + 2) || ' of the original ——'
WHEN 1 THEN '—— Seiten ' || c_custkey || '–' || (c_custkey + 2) || ' des Originals ——' ELSE '—— páginas ' || c_custkey || '–' || (c_custkey + 2) || ' del original ——' END AS mark FROM customer""")
def output_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "es"))), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", interface.mark("pages", lang, F.col("c_custkey"), F.col("c_custkey") + 2).alias("mark"))


@query("""WITH p AS (SELECT '/in/' || (c_custkey % 100) || CASE WHEN c_custkey % 3 = 0 THEN '.txt' ELSE '.PDF' END AS path FROM customer), q AS (SELECT DISTINCT '/in/' || s_suppkey || '.PDF' AS path FROM supplier),
u AS (SELECT path, count(*) AS n, path IN (FROM q) AS held, path LIKE '%.PDF' AS pdf FROM p GROUP BY path)
SELECT count(*) FILTER (pdf AND NOT held)::BIGINT AS added, (sum(n) FILTER (pdf) - count(*) FILTER (pdf AND NOT held))::BIGINT AS dup, (sum(n) FILTER (NOT pdf))::BIGINT AS skipped FROM u""")
def queue_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    paths = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("/in/"), key % 100, F.when(key % 3 == 0, ".txt").otherwise(".PDF")).alias("path"))
    return jobs.addition(paths, T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/in/"), "s_suppkey", F.lit(".PDF")).alias("path")))


@query("""WITH s AS (SELECT o_orderkey, (o_orderkey % 5 + (o_orderkey % 10) / 10.0::DOUBLE) / 5 AS s FROM orders)
SELECT o_orderkey, round(least(s, 1.0), 9)::DOUBLE AS share, CASE WHEN least(s, 1.0) > .05 THEN floor(600 * (1 - least(s, 1.0)) / least(s, 1.0))::BIGINT END AS seconds FROM s""")
def queue_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    share, left = jobs.progress(key % 5, F.lit(5), key % 10, F.lit(10), F.lit(600))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", F.round(share, 9).alias("share"), left.alias("seconds"))
