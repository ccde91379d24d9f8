"""Licence scans: one Aho-Corasick pass finds identifier tags and notice phrases, a shunting-yard parser evaluates
the expressions that the tags carry.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; a phrase matches where its words
stand consecutively. All phrases, and the words of the tag itself, are in one automaton. Where the tag occurs, the longest
leading part of its line that is an expression of identifiers with `and`, `or`, `with` and parentheses (with binds before
and, and before or) is evaluated to an obligation rank: `or` takes the lesser, `and` the greater, and an exception granted
by `with` lowers a copyleft rank by one. What follows that part (a comma, prose, a closing quote) is not the tag's.

Defined cases: null text is empty; a line without an expression gives no labels and no rank; several tags are evaluated
each and joined as by `and`; very long texts and lines are scanned whole, in time in proportion to their length; phrases
that overlap count each; repeated rows are scanned each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.decontaminate import folded
from quire.llm.words import chunks

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, obligation int, expressions array<string>"

#: Phrases and labels of the base.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method: label and confidence.
NOTICES = {
    "released under the mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "licensed under the apache license": ("apache", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by 4 0": ("cc-by", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "this is free and unencumbered software": ("unlicense", 0.8),
    "all rights reserved": ("proprietary", 0.6),
}
TAG = "spdx license identifier"
#: Identifier prefixes of expressions: family and obligation rank (0 free, 1 notice, 2 weak and 3 strong copyleft, 4 restricted).
FAMILIES = (
    ("agpl", "agpl", 3), ("lgpl", "lgpl", 2), ("gpl", "gpl", 3), ("mpl", "mpl", 2), ("epl", "epl", 2), ("mit", "mit", 1), ("apache", "apache", 1),
    ("bsd", "bsd", 1), ("isc", "isc", 1), ("0bsd", "bsd", 0), ("cc0", "cc0", 0), ("unlicense", "unlicense", 0), ("cc-by-nc", "cc-by-nc", 4),
    ("cc-by-sa", "cc-by-sa", 2), ("cc-by", "cc-by", 1), ("proprietary", "proprietary", 4),
)
_LEVEL = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+_:-]*)")
_TAG = re.compile(r"spdx-license-identifier:[ \t]*[\"'`]?([^\n\r*#<>]*)", re.IGNORECASE)


def postfix(text: str) -> list[str] | None:
    """The shunting-yard form of an expression: operands and lower-case operators; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True
    text = text.strip().rstrip("-/ \t")
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            return None
        token, at = m[1], m.end()
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _LEVEL:
            if operand:
                return None
            while stack and stack[-1] != "(" and _LEVEL[stack[-1]] >= _LEVEL[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def leading(text: str) -> list[str] | None:
    """postfix() of the longest leading part that parses; None if there is none."""
    at = depth = end = 0
    operand = True
    while m := _TOKEN.match(text, at):
        low = m[1].lower()
        if operand == (low == ")" or low in _LEVEL):
            break
        depth += (low == "(") - (low == ")")
        if depth < 0:
            break
        operand, at = low == "(" or low in _LEVEL, m.end()
        if not operand and not depth:
            end = at
    return postfix(text[:end]) if end else None


def evaluate(form: list[str]) -> tuple[int, set[str]]:
    """Obligation rank and families of a postfix expression; an unknown identifier is restricted and its own family."""
    stack: list[tuple[int, set[str]]] = []
    for token in form:
        if token not in _LEVEL:
            low = token.lower()
            stack.append(next(((rank, {family}) for head, family, rank in FAMILIES if low.startswith(head)), (4, {low})))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a - 1 if a in (2, 3) else a, left))
        else:
            stack.append((min(a, b) if token == "or" else max(a, b), left | right))
    return stack[0]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Over words joined and enclosed by single spaces."""
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str | None) -> tuple:
    words = folded(text)
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places, labels, base, score, tagged = [], set(), set(), 0.0, False
    seen = upto = 0
    for end, phrase in automaton().iter(line):
        if phrase in BASE:
            seen, upto = seen + line.count(" ", upto, end), end  # spaces before the one that closes the phrase
            places.append(seen - phrase.count(" ") - 1)
            base.add(BASE[phrase])
            score = max(score, 0.7)
        if phrase in NOTICES:
            label, sure = NOTICES[phrase]
            labels.add(label)
            score = max(score, sure)
        tagged |= phrase == TAG
    rank, expressions = None, []
    for m in _TAG.finditer(text or "") if tagged else ():
        if form := leading(m[1]):
            own, families = evaluate(form)
            rank, score = max(own, rank or 0), 1.0
            labels |= families
            expressions.append(" ".join(form))
    join = lambda names: ",".join(sorted(names))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(base | labels), score, rank, expressions


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string())]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "obligation", "expressions"]
    for whole in batches:
        for batch in chunks(whole):
            rows = zip(*map(scan_text, batch.column("text").to_pylist()), strict=True)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True))], names=["doc_id", *names])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs; see RESULT. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_scan, RESULT)
