"""Text rules as Column expressions; none runs Python on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.config import FORMATS
from quire.functions import patterns as P

L = F.lit


def like(t: Column, pattern: str) -> Column:
    return t.rlike(P.java(pattern))


def clean(t: Column) -> Column:
    """Wide spaces become plain, ends are trimmed, two or more white spaces become one space; a single one stays."""
    t = F.replace(t, L("　"), L(" "))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+|\s+\z", ""), r"(?U)\s{2,}", " ")


def is_zh(t: Column) -> Column:
    return F.regexp_count(t, L(r"[一-鿿]")) >= 2


def disp_w(t: Column) -> Column:
    """Columns on display: two for each code point above U+2E80."""
    return F.length(t) + F.regexp_count(t, L(r"[\x{2e81}-\x{10ffff}]"))


def lang_clear(t: Column) -> Column:
    return F.regexp_count(t, L(r"\p{IsAlphabetic}")) >= 2


def num_start(t: Column) -> Column:
    return like(t, P.NUM_START)


def end_punct(t: Column) -> Column:
    return like(t, P.END_PUNCT)


def bullet(t: Column) -> Column:
    return like(t, P.BULLET)


def looks_like_prose(t: Column) -> Column:
    return like(t, P.PROSE_TAIL) | like(t, P.PROSE_HEAD)


def short_label(t: Column) -> Column:
    return like(t, P.SHORT_LABEL)


def heading_level(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    n = F.length(t)
    return (
        F.when(like(t, P.SENTENCE), L(None).cast("int"))
        .when(like(t, P.HEADING_LETTER) & (n < 70), 1)
        .when(like(t, P.HEADING_NUMBER) & (n < 90) & ~like(t, P.HEADING_NOT), 2)
        .when(like(t, P.HEADING_HAN) & (n < 60), 2)
        .when(like(t, P.HEADING_DOTTED) & (n < 90), 3)
        .when(like(t, P.HEADING_PLAIN) & (n < 70), 3)
    )


def marker_run(t: Column) -> Column:
    """The leading run of one of i, I, l, L, 1 before a point or bracket; empty if there is none."""
    return F.regexp_extract(t, P.MARKER_RUN, 1)


def adopted_marker(first: Column, again: Column) -> Column:
    """A second reading replaces the first only where its run is longer, of the same letter, before the same tail."""
    a, b = marker_run(first), marker_run(again)
    longer = (a != "") & (F.length(b) > F.length(a)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    same_tail = F.substr(first, F.length(a) + 1) == F.substr(again, F.length(b) + 1)
    return F.when(longer & same_tail, again).otherwise(first)


def flat_text(t: Column) -> Column:
    """Fractions (three marks around numerator and denominator) become a/b, with brackets around compound terms."""
    parts = F.split(t, P.FRACTION)
    term = lambda i: F.when(F.get(parts, i).rlike(P.java(P.SIMPLE_TERM)), F.get(parts, i)).otherwise(F.concat(L("("), F.get(parts, i), L(")")))
    steps = F.sequence(L(0), ((F.size(parts) - 1) / 3).cast("int"))
    piece = lambda k: F.concat(F.get(parts, 3 * k), F.when(3 * k + 2 < F.size(parts), F.concat(term(3 * k + 1), L("/"), term(3 * k + 2))).otherwise(L("")))
    return F.when(F.size(parts) == 1, t).otherwise(F.array_join(F.transform(steps, piece), ""))


def cell_number(t: Column) -> Column:
    """The value of a cell that is a number of up to ten digits before the point and without leading zeros."""
    s = F.regexp_replace(flat_text(t), r"(?U)^\s+|\s+\z", "")
    return F.when(like(s, P.NUMBER) & ~like(s, P.LEADING_ZERO), s.try_cast("double"))


def cell_format(t: Column) -> Column:
    s = F.regexp_replace(flat_text(t), r"(?U)^\s+|\s+\z", "")
    decimals = F.length(F.regexp_extract(s, r"\.(\d+)\z", 1))
    return F.when(like(s, P.NUMBER) & ~like(s, P.LEADING_ZERO) & (decimals > 0), F.concat(L("0."), F.repeat(L("0"), decimals)))


def xml_escape(t: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, L(p[0]), L(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], t)


def md_cell(t: Column) -> Column:
    return F.replace(F.replace(t, L("|"), L(r"\|")), L("\n"), L("<br>"))


def md_escape(t: Column) -> Column:
    """A backslash before a leading #, > or |."""
    return F.regexp_replace(t, r"\A([#>|])", r"\\$1")


def squeeze(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def utf16_hex(t: Column) -> Column:
    return F.hex(F.encode(F.regexp_replace(t, r"\p{Cc}", ""), "UTF-16BE"))


def parse_formats(t: Column) -> Column:
    """The named formats in order; null if a word is unknown or there is none."""
    words = F.filter(F.split(F.lower(t), r"[,+\s/]+"), lambda w: w != "")
    alias = F.create_map(*[L(x) for pair in {**{f: f for f in FORMATS}, "word": "docx", "excel": "xlsx", "markdown": "md"}.items() for x in pair])
    named = F.transform(words, lambda w: F.try_element_at(alias, w))
    return F.when((F.size(words) > 0) & F.forall(named, lambda w: w.isNotNull()), F.array_intersect(F.array(*map(L, FORMATS)), named))


def grid_font(columns: Column) -> Column:
    return F.when(columns <= 6, 10).when(columns <= 10, 9).otherwise(8)


def cache_stem(stem: Column) -> Column:
    kept = F.regexp_replace(stem, r"[^A-Za-z0-9一-鿿]", "")
    return F.when(kept == "", "DOC").otherwise(F.substring(kept, 1, 16))


def cache_name(stem: Column, version: str, long_edge: Column, flattened: Column, straightened: Column, page_no: Column) -> Column:
    """The name that a page's items are kept under: stem, version digits, size, how the page was prepared, and the page."""
    prepared = F.when(straightened & flattened, "df").when(straightened, "d").when(flattened, "f").otherwise("r")
    return F.concat(cache_stem(stem), L("_" + version.replace(".", "") + "_"), long_edge.cast("string"), prepared, L("_"), F.when(page_no > 9999, page_no.cast("string")).otherwise(F.lpad(page_no.cast("string"), 4, "0")), L(".json"))


def cache_key(content: Column, *options: Column) -> Column:
    """A key by content and everything that changes what is read, so that like names don't meet."""
    return F.sha2(F.concat_ws("\n", F.sha2(content, 256), *[F.coalesce(o.cast("string"), L("")) for o in options]), 256)


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%d h %d min", F.floor(s / 3600), F.floor(F.pmod(s, L(3600)) / 60))).when(s >= 60, F.format_string("%d min %d s", F.floor(s / 60), F.pmod(s, L(60)))).otherwise(F.format_string("%d s", s))
