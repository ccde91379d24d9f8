"""op3: against a plain parser on the pages table, article text that looks like boilerplate, and odd pages."""

import time
from html.parser import HTMLParser

import pytest
from quire.llm import html_consensus, queries

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """The text inside <article>, by the standard library's parser: blocks end at every p, h and article tag."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.handle_endtag(tag) if tag in ("p", "h1", "h2", "li", "ul") else None
        self.blocks[-1] += " " if tag == "br" and self.inside else ""

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "article", "li", "ul"):
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def of(self, html):
        self.feed(html)
        self.close()
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_pages_table(spark):
    rows = queries.op3_html_consensus(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == Article().of(pages[r.page_id]), r.page_id
        assert r.n_chars == len(r.text)


def text(html):
    return html_consensus.extract(html, None)[0]


@pytest.mark.parametrize("mark", ['section class="ads-free"', 'div class="social-context"', 'div class="widget"', 'div id="share-of-market"', 'form id="aspnetForm"', 'div class="modal overlay"'])
def test_wrappers_stay(mark):
    page = f"<body><nav><a href=x>menu</a></nav><{mark}><article><h1>T</h1><p>one two three</p><p>four five</p><p>six</p></article></{mark.split()[0]}></body>"
    assert text(page) == "T\none two three\nfour five\nsix"


@pytest.mark.parametrize("mark", ['class="copyright-law"', 'id="share-of-market"', 'class="social-context"', 'class="adsorption"', 'class="noticeable"', 'class="footnote"', 'class="commentary"', 'class="headerless"'])
def test_parts_of_names_stay(mark):
    assert text(f"<article><p>one</p><p {mark}>two</p><div {mark}>three</div></article>") == "one\ntwo\nthree"


@pytest.mark.parametrize("mark", ["site-footer", "cookie-notice", "comments", "comment-list", "mainNav", "adBanner", "side-bar sidebar", "share_buttons", "page-header", "advert", "ad"])
def test_boilerplate_goes(mark):
    assert text(f'<article><p>one</p><p>two</p><p>three</p></article><div class="{mark}"><p>x</p></div><form>y</form>') == "one\ntwo\nthree"
    assert text(f'<article><p>one</p><div class="{mark}">x</div><p>two</p></article>') == "one\ntwo"


def test_consensus_takes_no_text_away():
    """A host's path that holds only part of a page's own best container does not win there."""
    page = "<body><div class=content><article>" + "a " * 55 + "</article><div>" + "b " * 450 + "</div></div></body>"
    own, _, _ = html_consensus.extract(page, None)
    path = next(n.key.hex() for _, n in html_consensus.containers(html_consensus.parsed(page)) if n.tag == "article")
    assert "b b" in own and html_consensus.extract(page, path)[0] == own


@pytest.mark.parametrize("unit", ["<div class=a>", "<div>", "<b><i>", "<nav>", "<div class=ad><p>", "</u><i>", "<!--x--><p>", "<svg ", "&lt;<a "])
def test_time_follows_length(unit):
    times = []
    for n in (250_000, 1_000_000):
        page = "<article>one<u>two</u>" + unit * (n // len(unit))
        began = time.process_time()
        html_consensus.votes_of(page)
        assert html_consensus.extract(page, None)[0].startswith("one")
        times.append(time.process_time() - began)
    assert times[1] < 12 and times[1] < 12 * max(0.2, times[0])


def test_depth_loses_no_text():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(f"<article><p>a</p>{deep}<p>b</p></article>") == "a\nx\nb"
    assert text("<article><p>a" + "<nav>" * 3000 + "x" + "</nav>" * 3000 + "<p>b</p></article>") == "a\nb"
    assert text("<article>" + "".join(f"<div>{k}" for k in range(1000))) == "\n".join(map(str, range(1000)))


def test_defined_cases(spark):
    rows = [(1, "http://h/a", None), (2, "http://h/b", ""), (3, None, "plain &amp; simple"), (3, None, "plain &amp; simple"), (4, "x", "<p>a <b>b</b>\n c</p>"), (5, "http://h/c", "<article><p>" + "long " * 400_000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "c", "d", 0.5) for r in rows], "page_id long, url string, html string, host string, path string, score double")
    found = sorted((r.page_id, r.text, r.n_chars) for r in html_consensus.extracted(pages).collect())
    long = "long " * 399_999 + "long"
    assert found == [(1, "", 0), (2, "", 0), (3, "plain & simple", 14), (3, "plain & simple", 14), (4, "a b c", 5), (5, long, len(long))]
    assert html_consensus.extracted(pages.limit(0)).count() == 0


def test_equal_votes(spark):
    pages = spark.createDataFrame([(1, "//h/a", "<div class=a>" + "x " * 40 + "</div>"), (2, "//h/b", "<div class=b>" + "x " * 40 + "</div>")], "page_id long, url string, html string")
    first = html_consensus.winners(pages).collect()
    assert first == html_consensus.winners(pages.orderBy("page_id", ascending=False)).collect() and len(first) == 1
