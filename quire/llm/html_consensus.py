"""Main-text extraction by consensus host paths.

1. Every page is parsed once into a light tree; its containers are scored by text length, damped by link density and by
   the share of text that sits in boilerplate. All containers vote with their generalised path: the tags and digit-free
   classes from the root, as a digest that is carried on from the parent, so that depth costs nothing.
2. Votes are summed by host and path in Spark (partial sums before the shuffle), and each host keeps its best path.
3. Each page is extracted with its host's path where the page has containers there that hold at least `least_share`
   of the text of its own best one, else with its own best container.

Winners are broadcast if their measured size is at most `broadcast_bytes`, and else joined by host and salt: every
winner is repeated for each salt, so that a host with very many pages is spread over `salts` tasks.

Text: blocks in page order joined by one newline; character references are decoded, white space inside a block becomes
one space. Dropped: scripts, styles, comments, the elements of DROP_TAGS, and elements marked by a whole class name, id or
role. A compound name marks only if every part is known, at least one of them a DROP_WORDS: site-footer does, ads-free
and share-of-market don't. An element so marked (or a form) that holds half of the page's text or more, in three
paragraphs at least, is a wrapper of the article and stays.

Defined cases: null html is empty and gives empty text; a page without markup is one block; broken or unclosed tags are
closed where their parent ends; elements below DEEPEST levels keep their text, as part of the level above them; very
long pages are read whole, in time in proportion to their length; a null url shares the host of other null urls; of
paths with equal votes the smallest digest wins; repeated rows are extracted each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored
from quire.llm.words import chunks

RESULT = "page_id long, url string, text string, n_chars long, path string, by_host boolean"

#: Fixed values of this operator: elements without text of the article, and class or id words that mark them.
DROP_TAGS = frozenset("nav footer header aside form script style noscript template svg math canvas iframe object embed button select textarea input dialog menu head title audio video map".split())
DROP_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar aside rail widget widgets footer foot header masthead topbar toolbar comment comments commentlist disqus replies
    cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social
    related recommended recommendations pagination pager skip copyright disclaimer legal paywall""".split()
)
#: Words that may stand beside one of these in a compound name.
NAME_WORDS = frozenset(
    """site page main global top bottom left right primary secondary sticky fixed mobile desktop web blog post article user reader
    container wrapper wrap inner outer box bar bars block list item items section area zone region panel row column col links link
    button buttons icon icons form thread count google text block large small header body unit slot placeholder policy message and by the js""".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg")
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
#: A start tag of the key closes open elements of these tags, up to the enclosing one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= dict.fromkeys("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 blockquote pre main figure hr address".split(), {"p"})
_BREAK = frozenset("article section div main body td th li blockquote table ul ol form aside nav header footer html".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Levels of nesting that are told apart, as in browsers; dropped elements nest twice as deep.
DEEPEST = 512
#: An unquoted value that ends in a slash; the tag isn't self-closed then.
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/$")
_NAME = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
#: Between blocks that aren't told apart.
_EDGE = "\0edge\0"
_GOOD = re.compile(r"article|content|post|entry|story|main|body|text")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "label", "dropped", "marked", "depth", "children", "text", "linked", "whole", "paragraphs", "key")

    def __init__(self, tag: str, parent: Node | None, label: str, dropped: bool, marked: bool = False):
        self.tag, self.parent, self.label, self.dropped, self.marked = tag, parent, label, dropped, marked
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.text = self.linked = self.whole = self.paragraphs = 0
        self.key = b""

    def where(self) -> str:
        parts = []
        node: Node | None = self
        while node is not None and node.parent is not None:
            parts.append(node.label)
            node = node.parent
        return ">".join(parts[::-1])


def boilerplate(name: str) -> bool:
    """Whether a class name or id marks an element that isn't the article's."""
    parts = [x.lower() for x in _NAME.findall(name)]
    return any(x in DROP_WORDS for x in parts) and all(x in DROP_WORDS or x in NAME_WORDS for x in parts)


def _attributes(tag: str, text: str) -> tuple[str, bool, bool]:
    """The generalised label of a start tag, whether its element is dropped, and whether it is marked as boilerplate."""
    gone, marked = tag in DROP_TAGS and tag != "form", tag == "form"
    if not text.strip(" /\t\r\n"):
        return tag, gone, marked
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}
    names = values.get("class", "").split()
    gone |= "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body", "article", "main"):
        marked |= values.get("role", "").lower() in DROP_ROLES or any(boilerplate(x) for x in (*names, *values.get("id", "").split()))
    return ".".join([tag, *sorted({re.sub(r"\d+", "", x.lower()) for x in names})]), gone, marked


def parsed(html: str) -> Node:
    root = Node("", None, "", False)
    here, at, n = root, 0, len(html)
    unopened: dict[str, int] = {}  # start tags below the deepest level, by tag
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            here.children.append(entities.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if unopened.get(tag):
                unopened[tag] -= 1
                continue
            node: Node | None = here
            while node is not None and node.tag != tag and not (node.tag in _BREAK and tag in INLINE):
                node = node.parent
            if node is not None and node.tag == tag and node.parent is not None:
                here = node.parent
            continue
        if tag in RAW_TAGS:
            if m[4].endswith("/") and not _UNQUOTED.search(m[4]):
                continue
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            here.children.append("\n" if tag == "br" else " " if tag not in ("wbr",) else "")
            continue
        if closes := CLOSES.get(tag):
            node = here
            while node.parent is not None and node.tag not in closes and (node.tag in INLINE or (tag in ("tr", "td", "th") and node.tag not in ("table",))):
                node = node.parent
            while node.tag in closes and node.parent is not None:
                here = node = node.parent
        label, dropped, marked = _attributes(tag, m[4])
        gone = dropped or marked
        if here.depth >= (2 * DEEPEST if gone else DEEPEST):
            if tag not in INLINE:
                here.children.append(_EDGE)
            if not m[4].endswith("/"):
                unopened[tag] = unopened.get(tag, 0) + 1
            continue
        node = Node(tag, here, label, dropped, marked)
        here.children.append(node)
        if not m[4].endswith("/"):
            here = node
    return root


def measured(root: Node) -> list[Node]:
    """The nodes that aren't dropped, parents before children, with their lengths of kept and of linked text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)
    for node in reversed(order):
        node.paragraphs = node.tag == "p"
        for c in node.children:
            if isinstance(c, str):
                node.whole += len(c.strip()) if c is not _EDGE else 0
            elif not c.dropped:
                node.whole += c.whole
                node.paragraphs += c.paragraphs
    kept, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.marked and (node.paragraphs < 3 or 2 * node.whole < root.whole):
            node.dropped = True
            continue
        node.key = hashlib.blake2b(node.parent.key + node.label.encode("utf-8", "replace"), digest_size=12).digest() if node.parent else b""
        kept.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)
    for node in reversed(kept):
        for c in node.children:
            if isinstance(c, str):
                node.text += len(c.strip()) if c is not _EDGE else 0
            elif not c.dropped:
                node.text += c.text
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.text
    return kept


_CONTAINERS = frozenset("article main section div td body blockquote center".split())
_BONUS = {"article": 1.6, "main": 1.4, "section": 1.05, "body": 0.8, "": 0.75}


def containers(root: Node) -> list[tuple[float, Node]]:
    """Scored containers, best first: most text, few links, and little text lost against what it encloses."""
    order = measured(root)
    total = max(1, root.text)
    found = []
    for i, node in enumerate(order):
        if not (node.parent is None or node.tag in _CONTAINERS) or not node.text:
            continue
        density = node.linked / node.text
        share = node.text / total
        good = share * (1 - density) ** 2 * _BONUS.get(node.tag, 1.0)
        if _GOOD.search(node.label.partition(".")[2]):
            good *= 1.2
        found.append((-good, i, node))
    found.sort(key=lambda x: x[:2])
    return [(-s, node) for s, _, node in found]


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(text)
            held.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.tag not in INLINE:
            flush()
        while k < len(here.children):
            child = here.children[k]
            k += 1
            if child is _EDGE:
                flush()
            elif isinstance(child, str):
                held.append(child)
            elif not child.dropped:
                stack += [(here, k), (child, 0)]
                break
        else:
            if here.tag not in INLINE:
                flush()
    flush()
    return out


def votes_of(html: str | None) -> list[tuple[str, float]]:
    return [(node.key.hex(), score) for score, node in containers(parsed(html or ""))]


def extract(html: str | None, path: str | None, least_share: float = 0.9) -> tuple[str, str, bool]:
    """Text, the container's path, and whether the host's path (its digest) gave it."""
    root = parsed(html or "")
    found = containers(root)
    if not found:
        return "", "", False
    best = found[0][1]
    same = [node for _, node in found if node.key.hex() == path]
    if not same or sum(x.text for x in same) < least_share * best.text:
        return "\n".join(blocks(best)), best.where(), False
    if len(same) > 1:  # of one depth, so none encloses another
        order = {id(x): i for i, x in enumerate(_in_order(root))}
        same.sort(key=lambda x: order[id(x)])
    return "\n".join(b for x in same for b in blocks(x)), same[0].where(), True


def _in_order(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes summed within each batch, by host and path."""
    for whole in batches:
        for batch in chunks(whole, "html"):
            sums: dict[tuple[str, str], float] = {}
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, score in votes_of(html):
                    sums[name, path] = sums.get((name, path), 0.0) + round(score, 6)
            names, paths = zip(*sums, strict=True) if sums else ((), ())
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(list(sums.values()), pa.float64())], names=["host", "path", "score"])


def _extracted(least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "html"):
                rows = [extract(html, path, least_share) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                text, path, by = zip(*rows, strict=True)
                yield pa.record_batch(
                    [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(path, pa.string()), pa.array(by)],
                    names=["page_id", "url", "text", "n_chars", "path", "by_host"],
                )

    return run


def winners(pages: DataFrame) -> DataFrame:
    """host, path: the digest of the path with most votes on each host; of equal ones the smallest."""
    rows = pages.select(host(F.col("url")).alias("host"), "html")
    sums = rows.mapInArrow(_votes, "host string, path string, score double").groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1e6).cast("long")).alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("best")).select("host", "best.path")


def extracted(pages: DataFrame, least_share: float = 0.9, broadcast_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """One row per row of pages; see RESULT."""
    best = stored(winners(pages), "paths", narrow=True)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    size = best.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0)).alias("b")).first().b
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(best), "host", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extracted(least_share), RESULT)
