"""The page reader, without Spark, and page operators on awkward pages."""

import random
import time
from html.parser import HTMLParser

from rolefeed.functions.html import PageReader, card_rows, link_rows, tree_rows
from rolefeed.operators.fallback import generic_postings
from rolefeed.sources.pages import card_tree, job_cards, keyword_links, page_cards, page_links

BASE = "https://x.example.com/careers/"


def links(html):
    return [(href, url, text) for _, href, url, text in link_rows(BASE, html)]


def test_links():
    assert links('<a href="/a">One</a><a>no</a><A HREF=b>Two</A>') == [
        ("/a", "https://x.example.com/a", "One"), ("b", BASE + "b", "Two")]
    assert links('<a href>empty</a>') == [("", BASE, "empty")]
    assert links('<a href="#top">t</a><a href="mailto:a@b">m</a>') == [
        ("#top", BASE + "#top", "t"), ("mailto:a@b", "mailto:a@b", "m")]
    assert links('<a href="?a=1&amp;b=2">q</a>')[0][0] == "?a=1&b=2"


def test_link_text_has_no_separator():
    assert links('<a href="/a"> <b> Soft </b> ware<br>Dev</a>')[0][2] == "SoftwareDev"
    assert links('<a href="/a">x<script>no()</script><!-- no -->y</a>')[0][2] == "xy"


def test_nested_and_unclosed():
    assert [t for _, _, t in links('<a href="/a">out<a href="/b">in</a>side</a>')] == ["outinside", "in"]
    assert [t for _, _, t in links('<div><a href="/a">x<p>y</div>z')] == ["xy"]
    assert [t for _, _, t in links('<a href="/a">x</b>y</a>')] == ["xy"]


def test_unresolvable_address():
    assert links('<a href="http://[bad">x</a>')[0][1] is None
    assert list(card_rows(BASE, '<a href="/ok">x</a><a href="http://[bad">x</a>')) == []
    assert list(tree_rows(BASE, '<a href="/ok">x</a><a href="http://[bad">x</a>')) == []


def cards(html, context=True):
    if not context:
        return [row[1:] for row in card_rows(BASE, html)]
    rows = list(tree_rows(BASE, html))
    chunks = {r[9]: r[10] for r in rows if r[0] is None}
    assert len(chunks) == sum(r[0] is None for r in rows)
    return [(*r[1:6], " ".join(chunks[i] for i in range(r[7], r[8]))) for r in rows if r[0] is not None]


def test_cards():
    (card,) = cards('<div>Pune <a href=" /job/1 " aria-label="Apply"><img><h3>Data <i>Dev</i></h3><span>New</span></a> now</div>')
    href, url, text, heading, label, around = card
    assert (href, url) == ("/job/1", "https://x.example.com/job/1")
    assert (text, heading, label) == ("DataDevNew", "DataDev", "Apply")
    assert around == "Pune Data Dev New now"
    assert cards('<a href="/x">t</a>', context=False) == [("/x", "https://x.example.com/x", "t", None, "")]


def test_heading_is_inside_its_link():
    rows = cards('<a href="/1">one</a><h2>Outside</h2><a href="/2"><p>Inside</p></a>')
    assert [r[3] for r in rows] == [None, "Inside"]


class Tree(HTMLParser):
    """The obvious reader: builds the tree, then walks it."""

    def __init__(self, html):
        super().__init__()
        self.root = ["", {}, [], None]
        self.at = self.root
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], self.at]
        self.at[2].append(node)
        if tag != "br":
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node[3] and node[0] != tag:
            node = node[3]
        if node[3]:
            self.at = node[3]
        self.at[2].append("")  # ends the text before it

    def handle_comment(self, data):
        self.at[2].append("")

    def handle_data(self, data):
        self.at[2].append(data)

    def nodes(self, node):
        for child in node[2]:
            if not isinstance(child, str):
                yield child
                yield from self.nodes(child)

    def texts(self, node, muted=False):
        muted = muted or self.muted(node)
        for child in node[2]:
            if isinstance(child, str):
                if child.strip() and not muted:
                    yield child.strip()
            else:
                yield from self.texts(child, muted)

    def muted(self, node):
        return bool(node) and (node[0] in ("script", "template") or self.muted(node[3]))

    def cards(self):
        for node in self.nodes(self.root):
            if node[0] == "a" and "href" in node[1]:
                heading = next((n for n in self.nodes(node) if n[0] in ("h3", "p", "span")), None)
                yield (node[1]["href"], "".join(self.texts(node)), heading and "".join(self.texts(heading)),
                       " ".join(self.texts(node[3])))


def test_agrees_with_a_tree():
    rng = random.Random(13)
    pieces = ['<a href="/1">', '<a href="/2">', "<a>", "</a>", "<p>", "</p>", "<h3>", "</h3>", "<span>", "</span>", "<div>",
              "</div>", "<li>", "<br>", "<!-- c -->", "<template>", "</template>", "<script>x</script>", " one", "two ", "  "]
    found = 0
    for _ in range(4000):
        # Two texts in a row would be one, so there is markup between them.
        html = ""
        for piece in rng.choices(pieces, k=rng.randint(1, 25)):
            if piece[0] == "<" or html.endswith(">") or not html:
                html += piece
        expected = list(Tree(html).cards())
        got = [(href, text, heading, around) for href, _, text, heading, _, around in cards(html)]
        assert got == expected, html
        found += len(got)
    assert found > 4000


class Parsed(PageReader):
    """Every page by the standard parser."""

    def _read_regular(self, html):
        return False


def test_regular_pages_are_read_as_the_parser_does():
    rng = random.Random(1)
    pieces = [
        '<a href="/1">', '<a href=/x/ >', "<a href='q?a=1&amp;b=2' aria-label=Go>", '<A HREF="a&lt;b">', '<a href="x"/>', '<a href>',
        '<a>', '</a>', '</A>', '<p class="c d">', '</p>', '<p/>', '<br>', '<br/>', '<br />', '</br>', '<h3 id=a disabled>', '</h3>',
        '<!-- c -->', '<!---->', '<!-->', '<!-- a--b -->', '<!--x', '<!DOCTYPE html>', '<!doctype', '<script>', '</script>',
        '<script>a<b</script>', '<script>"</p>"</script>', '<SCRIPT><!-- </SCRIPT>', '</ script>', '<style>p{}</style>', '<title>',
        '</title>', '<title>a &amp; b</title>', '<textarea><b></textarea>', '<iframe>', '</iframe>', '<template>', '</template>',
        '&amp;', '&nbsp;', '&#160;', '&#x41;', '&#150;', '&#0;', '&#x110000;', '&#55296;', '&copy', '&bogus;', '& ', '&', '<', '< ',
        '>', '"', "'", '=', ' text ', 'a', '\n', '\t', 'é', '<x-y>', '</x-y>', '<b:c>', '<img src="a>b">', '<a href="a>b">t',
        '<![CDATA[x]]>', '<?pi?>', '</>', '</ a>', '<a\xa0href=x>', '<a href="x"title=y>', '<div', '<a href = "sp" >',
        "<a href='x\" y'>", '\x00', '\r\n', '&lt;b&gt;', '<rt>', '</rt>',
    ]

    def seen(page):
        span = lambda s: s and (s.tag, s.start, s.end)
        return page.chunks, [(span(a), a.href, a.aria_label, span(a.parent), span(a.heading)) for a in page.anchors]

    regular = 0
    for _ in range(20000):
        html = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        assert seen(PageReader(html)) == seen(Parsed(html)), html
        page = PageReader("")
        regular += page._read_regular(html)
    assert regular > 500


def test_deep_and_long_pages_scan_in_linear_time():
    start = time.time()
    PageReader("<p><a href=x>" * 20000 + "</b>" * 20000)
    PageReader("<div>" * 50000 + "</div>" * 50000)
    assert time.time() - start < 20


def test_rejected_markup_is_an_empty_page():
    assert PageReader("a<![if x").anchors == []
    assert PageReader("<a href=x>&#" + "9" * 5000 + ";</a>").anchors == []


def test_pages(spark):
    pages = spark.createDataFrame([
        (1, BASE, '<a href="/swe/1">x</a><a href="/x">LLM</a><a href="/swe/1">again</a><a href="/swe/2"></a>'),
        (2, BASE, None), (3, BASE, "no links"), (4, None, '<a href="/llm">x</a>'),
    ], "page_id long, url string, html string")
    assert page_links(pages).count() == 5
    hits = {(r.page_id, r.link_ord, r.title) for r in keyword_links(pages).collect()}
    assert hits == {(1, 0, "x"), (1, 1, "LLM"), (1, 3, "(untitled link — check URL)"), (4, 0, "x")}


def test_rejected_card_does_not_hide_a_later_one(spark):
    page = '<a href="/job/1">Dev</a><a href="/job/1">Developer</a><a href="/job/1">Developers</a><a href="/about">About us</a>'
    pages = spark.createDataFrame([(1, BASE, page)], "page_id long, url string, html string")
    (card,) = job_cards(pages).collect()
    assert (card.link_ord, card.title, card.location) == (1, "Developer", "India")


def test_many_links_with_context(spark):
    """Output larger than one flush stays whole."""
    html = "<body>" + "".join(f'<a href="/job/{i}">Job number {i}</a>' for i in range(1500)) + "</body>"
    pages = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    assert page_cards(pages, context=True).where("length(context_text) > 10000").count() == 1500


SCHEMA = "page_id long, url string, html string"


def test_context_is_linear_in_the_page(spark):
    """A page of 4,000 sibling links, and one whose links stand in nested parents."""
    html = "<ul>" + "".join(f'<a href="/job/{i}">Job number {i}</a>' for i in range(4000)) + "</ul>"
    rows = list(tree_rows(BASE, html))
    assert sum(len(v) for r in rows for v in r if isinstance(v, str)) < 4 * len(html)
    pages = spark.createDataFrame([(1, BASE, html)], SCHEMA)
    tree = card_tree(pages)
    assert tree.cards.count() == 4000 and tree.chunks.count() == 4000
    (around,) = tree.contexts(tree.cards).collect()
    assert around.context_text == " ".join(f"Job number {i}" for i in range(4000))
    # Only accepted cards get a context.
    some = job_cards(pages, fragments=("/job/39",), context=True)
    assert some.count() == 111 and some.where("length(context_text) < 60000").count() == 0


def test_context_of_nested_parents_and_odd_pages(spark):
    html = (
        '<div>Pune <ul><li><a href="/job/1"><h3>Data Dev</h3>apply</a> now</li><li><a href="/job/2">Second one</a></li></ul>'
        '<a href="/job/3">Third one</a></div><p><a href="/job/4" aria-label="A fourth job"><img></a></p>'
    )
    pages = spark.createDataFrame([(1, BASE, html), (None, BASE, html), (2, BASE, None), (3, BASE, "<p>none</p>"), (4, None, '<a href="/job/9">No base</a>')], SCHEMA)
    expected = {
        "/job/1": ("Data Dev", "Data Dev apply now"), "/job/2": ("Second one", "Second one"),
        "/job/3": ("Third one", "Pune Data Dev apply now Second one Third one"), "/job/4": ("A fourth job", ""),
    }
    got = page_cards(pages, context=True).collect()
    for page in (1, None):
        assert {r.href: (r.title, r.context_text) for r in got if r.page_id == page} == expected
    assert [(r.title, r.context_text) for r in got if r.page_id == 4] == [("No base", "No base")] and len(got) == 9
    assert page_cards(pages.limit(0), context=True).count() == 0


def test_several_pages_of_a_company(spark):
    """Every posting has a number of its own; equal pages count once."""
    pages = spark.createDataFrame([
        (5, "C", BASE + "b", '<a href="/swe/1">One</a><a href="/swe/2">Two</a>'), (5, "C", BASE + "a", '<a href="/swe/3">Three</a>'),
        (5, "C", BASE + "a", '<a href="/swe/3">Three</a>'), (5, "C", BASE + "a", '<a href="/swe/4">Four</a>'),
        (6, "D", BASE, '<a href="/swe/1">One</a>'), (7, "E", BASE, "<p>"),
    ], "company_ord long, company string, url string, html string")
    shown = spark.createDataFrame([(7, "E", BASE + u, f'<a href="/jobs/{u}">Role at {u}</a>') for u in "xy"],
                                  "company_ord long, company string, url string, html string")
    rows = generic_postings(pages, shown).collect()
    places = [(r.company_ord, r.posting_ord) for r in rows]
    assert len(places) == len(set(places)) == 7
    assert sorted(r.title for r in rows if r.company_ord == 5) == ["Four", "One", "Three", "Two"]
    order = [r.title for r in sorted(rows, key=lambda r: (r.company_ord, r.posting_ord))]
    assert order[2:] == ["One", "Two", "One", "Role at x", "Role at y"]
    # One page a company is numbered as before.
    assert sorted(r.posting_ord for r in generic_postings(pages.where("company_ord > 5"), None).collect()) == [0]
