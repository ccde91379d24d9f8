"""Languages, templates and the texts that go into outputs, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts written into outputs, by key and language.
MARKS = {
    "page": {
        "zh": "—— 原第 {0} 页 ——",
        "zh-Hant": "—— 原第 {0} 頁 ——",
        "en": "—— page {0} of the original ——",
        "es": "—— página {0} del original ——",
        "de": "—— Seite {0} des Originals ——",
        "ja": "—— 原文 {0} ページ ——",
        "ko": "—— 원본 {0}쪽 ——",
    },
    "pages": {
        "zh": "—— 原第 {0}–{1} 页 ——",
        "zh-Hant": "—— 原第 {0}–{1} 頁 ——",
        "en": "—— pages {0}–{1} of the original ——",
        "es": "—— páginas {0}–{1} del original ——",
        "de": "—— Seiten {0}–{1} des Originals ——",
        "ja": "—— 原文 {0}–{1} ページ ——",
        "ko": "—— 원본 {0}–{1}쪽 ——",
    },
    "failed": {
        "zh": "[第 {0} 页解析失败, 已跳过: {1}]",
        "zh-Hant": "[第 {0} 頁解析失敗，已略過：{1}]",
        "en": "[page {0} failed and was skipped: {1}]",
        "es": "[la página {0} falló y se omitió: {1}]",
        "de": "[Seite {0} fehlgeschlagen und übersprungen: {1}]",
        "ja": "[{0} ページの解析に失敗したため飛ばしました: {1}]",
        "ko": "[{0}쪽 처리에 실패해 건너뛰었습니다: {1}]",
    },
    "sheet": {"zh": "表格", "zh-Hant": "表格", "en": "Tables", "es": "Tablas", "de": "Tabellen", "ja": "表", "ko": "표"},
    "no_table": {
        "zh": "（本文件没有识别到表格。整页版面请用 Word 输出。）",
        "zh-Hant": "（本檔案沒有辨識到表格。整頁版面請用 Word 輸出。）",
        "en": "(No tables were found in this file. Use the Word output for full-page layout.)",
        "es": "(No se encontraron tablas en este archivo. Usa la salida de Word para el diseño de página completa.)",
        "de": "(In dieser Datei wurden keine Tabellen gefunden. Für das ganzseitige Layout die Word-Ausgabe verwenden.)",
        "ja": "（このファイルからは表が見つかりませんでした。ページ全体の版面は Word 出力をお使いください。）",
        "ko": "(이 파일에서는 표를 찾지 못했습니다. 페이지 전체 레이아웃은 Word 출력을 쓰세요.)",
    },
}
LANGUAGES = ("zh", "zh-Hant", "en", "es", "de", "ja", "ko")
TRADITIONAL = ("hant", "tw", "hk", "mo")


def language(tag: Column) -> Column:
    """The language of a BCP 47 tag or a POSIX locale; null if it is none of LANGUAGES."""
    parts = F.split(F.lower(F.replace(F.split_part(tag, F.lit("."), F.lit(1)), F.lit("_"), F.lit("-"))), "-")
    base, rest = F.get(parts, 0), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    plain = F.when(base.isin("en", "es", "de", "ja", "ko"), base)
    return F.when(base == "zh", F.when(F.arrays_overlap(rest, F.array(*map(F.lit, TRADITIONAL))), "zh-Hant").otherwise("zh")).otherwise(plain)


def detected(*variables: Column) -> Column:
    """The language of the first locale variable that is set; en if it is unknown, zh if none is set."""
    some = [F.trim(F.split_part(v, F.lit(":"), F.lit(1))) for v in variables]
    first = F.coalesce(*[F.when(~v.isin("", "C", "POSIX"), v) for v in some])
    return F.when(first.isNull(), "zh").otherwise(F.coalesce(language(first), F.lit("en")))


def fill(template: Column, *args: Column) -> Column:
    """{n} becomes the n-th argument, or nothing if there is none; other braces stay. Arguments aren't filled again."""
    pieces = F.split(template, r"\{[0-9]+\}", -1)
    numbers = F.regexp_extract_all(template, F.lit(r"\{([0-9]+)\}"), F.lit(1))
    given = F.array(*[F.coalesce(a.cast("string"), F.lit("")) for a in args] or [F.lit("")])
    value = lambda n: F.coalesce(F.get(given, n.try_cast("int")), F.lit(""))
    return F.concat(F.get(pieces, 0), F.array_join(F.transform(numbers, lambda n, i: F.concat(value(n), F.get(pieces, i + 1))), ""))


def mark(key: str, lang: Column, *args: Column) -> Column:
    """The output text of a key in a language, filled; unknown languages read Chinese."""
    texts = MARKS[key]
    chosen = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), lang), F.lit(texts["zh"]))
    return fill(chosen, *args)


def one_line(t: Column, most: int) -> Column:
    """White space runs become one space; longer texts are cut and end in an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | \z", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("…")))


def kilobytes(size: Column) -> Column:
    return F.floor(size / 1024)


def megabytes(size: Column) -> Column:
    """One decimal, rounded as the number's binary value says."""
    return F.concat(F.replace(F.format_number(size / 1e6, 1), F.lit(","), F.lit("")), F.lit(" MB"))
