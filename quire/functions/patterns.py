"""Text patterns that both the Column functions (Java) and the page folds (Python) use."""

from __future__ import annotations

import re

# What numbering, sentence ends, headings, headers and footers look like. <end> is the end of the text.
NUM_START = r"^(\d{1,2}\.\d{1,2}(\.\d{1,2})?[\s、．.]|\d{1,2}[\.、]\s*|[一二三四五六七八九十]+[、．.]|[（(]\d{1,2}[）)]|[（(][A-Za-z][）)]|[ivxIVX]{2,4}[\.、](\s|[A-Z][a-z])|[A-Za-z][\.、](\s|[A-Z][a-z])|[•·●○\*]\s*|[-–—]\s+)"
END_PUNCT = r"[。．.：:；;!?！？）)】\]\"”]<end>"
BULLET = r"^([•·●○\*]\s*|[-–—]\s+)"
PROSE_TAIL = r"[。！？；：]<end>"
PROSE_HEAD = r"^([•·●○。]\s*\S|\d{1,2}[\.、]\s*\S|[（(]\d{1,2}[）)]|[一二三四五六七八九十]+[、．.])"
SHORT_LABEL = r"^[\dA-Za-z][\.、)）]?<end>"
HEADER = r"^(TROESTER|EXCELLENCE IN EXTRUSION|Contract No\.|January \d+|Attachment \d|De?a?tailed Technical Description|Page\s*\d+\s*/\s*\d+|正直诚信|山东泰开电缆有限公司<end>)"
FOOTER = r"^(\d{1,3}\s*/\s*\d{1,3}<end>|\d{1,3}<end>|[-—–]\s*\d{1,3}\s*[-—–.．。]?<end>|邮箱|地址|邮编|网址|http|tkdlsc)"
#: Headers and footers that name nobody, for Config(header=..., footer=...).
ANY_HEADER = r"^(Contract No\.|January \d+|Attachment \d|Page\s*\d+\s*/\s*\d+)"
ANY_FOOTER = r"^(\d{1,3}\s*/\s*\d{1,3}<end>|\d{1,3}<end>|[-—–]\s*\d{1,3}\s*[-—–.．。]?<end>|邮箱|地址|邮编|网址|http)"
SENTENCE = r"[。；;]<end>"
HEADING_LETTER = r"^[A-Z]\.\s+[A-Z]"
HEADING_NUMBER = r"^\d{1,2}[\.、]\s*\S"
HEADING_NOT = r"^\d{1,2}\.\d"
HEADING_HAN = r"^[一二三四五六七八九十]+[、．.]"
HEADING_DOTTED = r"^\d{1,2}\.\d{1,2}[\s、．.]"
HEADING_PLAIN = r"^\d{1,2}\s+[A-Z][a-z]"
MARKER_RUN = r"^(i+|I+|l+|L+|1+)[.)]"
NUMBER = r"^-?\d{1,10}(\.\d+)?<end>"
LEADING_ZERO = r"^-?0\d"
SIMPLE_TERM = r"^[\w.]+<end>"
FRACTION = "\ue000"


def java(pattern: str) -> str:
    return "(?U)" + pattern.replace("<end>", r"\z")


def python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("<end>", r"\Z"))
