"""HTML parsing, the only Python in the hot path.

The parser is the standard library's. It records text chunks in document order and, for each
element of interest, the slice of chunks it spans, so no tree is built.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, elements whose text is not page text, and the elements
# a card title is taken from.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
NO_TEXT = frozenset("script style template rt rp".split())
HEADINGS = frozenset("h1 h2 h3 h4 span p".split())

_FLUSH_CHARS = 16 * 1024 * 1024

# Markup without any irregularity, with the text before it. Nothing backtracks. What the standard
# parser would read in a different way in some Python version is not matched either.
_TOKEN = re.compile(
    r"""
    (?P<text>[^<&]*+)(?:
    <(?P<start>[a-zA-Z][a-zA-Z0-9]*+)
      (?P<attributes>(?>[ \t\n\r\f]++[a-zA-Z_:][a-zA-Z0-9_:.-]*+
        (?>[ \t\n\r\f]*+=[ \t\n\r\f]*+(?>"[^"<>]*+"|'[^'<>]*+'|[^ \t\n\r\f"'=<>`]++))?+)*+)
      [ \t\n\r\f]*+(?P<closed>/?+)>
    |</(?P<end>[a-zA-Z][a-zA-Z0-9]*+)>
    |(?P<skipped><!--(?!-?>)[^-]*+(?>-[^-]++)*+-->|<!(?i:doctype)[^<>]*+>)
    |&(?P<entity>[a-zA-Z][a-zA-Z0-9]*+);
    |&\#(?P<number>[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});
    |(?P<ampersand>&)(?=[ \t\n\r\f])
    |\Z)
    """,
    re.VERBOSE,
)
_ATTRIBUTE = re.compile(
    r"""([a-zA-Z_:][a-zA-Z0-9_:.-]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f"'=<>`]+)))?"""
)
# Elements whose content is, in some version, not read as markup. Here it may be text only.
_SCRIPT = {tag: re.compile(rf"</\s*{tag}", re.IGNORECASE) for tag in ("script", "style")}
_TEXT_ONLY = frozenset("title textarea xmp iframe noembed noframes plaintext".split())


class _Span:
    """An element: its tag and the slice of text chunks inside it."""

    __slots__ = ("tag", "start", "end")

    def __init__(self, tag: str, start: int):
        self.tag, self.start, self.end = tag, start, None


class _Anchor(_Span):
    __slots__ = ("href", "aria_label", "parent", "heading")

    def __init__(self, start: int, href: str, aria_label: str, parent: _Span):
        super().__init__("a", start)
        self.href, self.aria_label, self.parent, self.heading = href, aria_label, parent, None


class PageReader(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self._start_over()
        if not self._read_regular(html):
            self._start_over()
            try:
                self.feed(html)
                self.close()
            except (AssertionError, ValueError):
                # A malformed declaration or an absurd character number: the page is unusable.
                self._start_over()
        self._end_text()
        for span in self._open:
            span.end = len(self.chunks)

    def _start_over(self):
        self.chunks: list[str] = []
        self.anchors: list[_Anchor] = []
        self._pending: list[str] = []
        self._open = [_Span("", 0)]
        self._open_tags = Counter()
        self._no_heading: list[_Anchor] = []
        self._muted = 0

    def _read_regular(self, html: str) -> bool:
        """Read a page of regular markup, faster than the parser does; False if it is not."""
        position, inside = 0, None
        while position < len(html):
            token = _TOKEN.match(html, position)
            if not token:
                return False
            position, kind = token.end(), token.lastgroup
            if text := token["text"]:
                self._pending.append(text)
            if kind == "end":
                tag = token["end"].lower()
                if inside and inside != tag:
                    return False
                inside = None
                self.handle_endtag(tag)
            elif kind == "text":
                break
            elif inside:
                return False
            elif kind == "closed":
                tag = token["start"].lower()
                attributes = self._attributes(token["attributes"]) if tag == "a" else ()
                if attributes is None:
                    return False
                if token["closed"]:
                    if tag in _TEXT_ONLY or tag in _SCRIPT:
                        return False
                    self.handle_startendtag(tag, attributes)
                    continue
                self.handle_starttag(tag, attributes)
                if tag in _SCRIPT:
                    end = _SCRIPT[tag].search(html, position)
                    if not end or "<!--" in html[position : end.start()]:
                        return False
                    position, inside = end.start(), tag
                elif tag in _TEXT_ONLY:
                    inside = tag
            elif kind == "entity":
                self.handle_entityref(token["entity"])
            elif kind == "number":
                self.handle_charref(token["number"])
            elif kind == "ampersand":
                self._pending.append("&")
            else:
                self._end_text()
        return inside is None

    @staticmethod
    def _attributes(source: str) -> list[tuple[str, str | None]] | None:
        """Name and value pairs; None if a value has an entity other than ``&amp;``."""
        pairs = []
        for match in _ATTRIBUTE.finditer(source):
            value = match[match.lastindex] if match.lastindex > 1 else None
            if value and "&" in value:
                if "&" in value.replace("&amp;", ""):
                    return None
                value = value.replace("&amp;", "&")
            pairs.append((match[1].lower(), value))
        return pairs

    def text(self, span: _Span, separator: str = "") -> str:
        return separator.join(self.chunks[span.start : span.end])

    def updatepos(self, i, j):
        # Line numbers are not needed, and counting them costs a scan.
        return j

    # A chunk ends wherever markup interrupts the text.
    def _end_text(self):
        if self._pending:
            chunk = "".join(self._pending).strip()
            self._pending.clear()
            if chunk and not self._muted:
                self.chunks.append(chunk)

    def handle_starttag(self, tag, attrs):
        self._end_text()
        position = len(self.chunks)
        if tag == "a" and (attributes := dict(attrs)).get("href", False) is not False:
            span = _Anchor(
                position, attributes["href"] or "", attributes.get("aria-label") or "", self._open[-1]
            )
            self.anchors.append(span)
            self._no_heading.append(span)
        else:
            span = _Span(tag, position)
            if tag in HEADINGS:
                for anchor in self._no_heading:
                    if anchor.end is None:
                        anchor.heading = span
                self._no_heading.clear()
        if tag in VOID:
            span.end = position
        else:
            self._open.append(span)
            self._open_tags[tag] += 1
            self._muted += tag in NO_TEXT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text()
        # An end tag closes everything opened since its start tag; without one it is ignored.
        while self._open_tags[tag]:
            span = self._open.pop()
            span.end = len(self.chunks)
            self._open_tags[span.tag] -= 1
            self._muted -= span.tag in NO_TEXT
            if span.tag == tag:
                break

    def handle_data(self, data):
        self._pending.append(data)

    def handle_entityref(self, name):
        self._pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        if code < 256:
            char = bytes([code]).decode("cp1252", "ignore") or chr(code)
        elif code > sys.maxunicode or 0xD800 <= code < 0xE000:
            char = "\ufffd"
        else:
            char = chr(code)
        self._pending.append(char)

    def handle_comment(self, data):
        self._end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._end_text()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[len("CDATA[") :])
            self._end_text()


@arrow_udf(T.StringType())
def text_of_html(html: pa.Array) -> pa.Array:
    """Text chunks of an HTML fragment joined by one blank; NULL stays NULL."""
    return pa.array(
        [None if h is None else " ".join(PageReader(h).chunks) for h in html.to_pylist()], pa.string()
    )


def _resolve(base: str | None, href: str) -> str | None:
    try:
        return urljoin(base or "", href)
    except ValueError:  # such as an unclosed IPv6 bracket
        return None


# Name and SQL type of what is extracted per anchor.
LINK_FIELDS = (
    ("link_ord", "bigint"), ("href", "string"), ("full_url", "string"), ("text", "string"),
)
CARD_FIELDS = (*LINK_FIELDS, ("heading_text", "string"), ("aria_label", "string"))
# A card's parent and the chunks of text inside it, and, in rows of their own, these chunks.
PARENT_FIELDS = (("parent_ord", "bigint"), ("first_chunk", "bigint"), ("end_chunk", "bigint"))
CHUNK_FIELDS = (("chunk_ord", "bigint"), ("chunk_text", "string"))
TREE_FIELDS = (*CARD_FIELDS, *PARENT_FIELDS, *CHUNK_FIELDS)

_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def link_rows(url: str, html: str) -> Iterator[tuple]:
    """One ``LINK_FIELDS`` tuple per ``<a href>``."""
    page = PageReader(html)
    for i, a in enumerate(page.anchors):
        yield i, a.href, _resolve(url, a.href), page.text(a)


def card_rows(url: str, html: str) -> Iterator[tuple]:
    """One ``CARD_FIELDS`` tuple per ``<a href>``.

    An address that cannot be resolved spoils the whole page.
    """
    for row, _ in _cards(PageReader(html), url):
        yield row


def _cards(page: PageReader, url: str) -> Iterator[tuple[tuple, _Anchor]]:
    hrefs = [a.href.strip() for a in page.anchors]
    resolved = [_resolve(url, href) for href in hrefs]
    if None in resolved:
        return
    for i, a in enumerate(page.anchors):
        heading = page.text(a.heading) if a.heading else None
        yield (i, hrefs[i], resolved[i], page.text(a), heading, a.aria_label), a


def tree_rows(url: str, html: str) -> Iterator[tuple]:
    """``TREE_FIELDS`` tuples: the cards of ``card_rows``, each with the number of its parent and the
    interval of text chunks inside that, then every chunk that lies in some parent, once."""
    page = PageReader(html)
    parents: dict[int, tuple[int, _Span]] = {}
    for row, anchor in _cards(page, url):
        number, span = parents.setdefault(id(anchor.parent), (len(parents), anchor.parent))
        yield (*row, number, span.start, span.end, None, None)
    shown = 0
    for start, end in sorted((span.start, span.end) for _, span in parents.values()):
        for chunk in range(max(start, shown), end):
            yield (*[None] * (len(CARD_FIELDS) + len(PARENT_FIELDS)), chunk, page.chunks[chunk])
        shown = max(shown, end)


def _gather(batch: pa.RecordBatch, keys, fields, indices, rows) -> pa.RecordBatch:
    index = pa.array(indices, pa.int32())
    columns = [batch.column(key).take(index) for key in keys]
    columns += [pa.array(v, _ARROW[kind]) for v, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, *(name for name, _ in fields)])


def explode_pages(batches: Iterable[pa.RecordBatch], keys, fields, extract):
    """Arrow batches of (keys, url, html) -> batches of (keys, extracted fields).

    Key columns are gathered by row index and never leave Arrow. Output is cut by size, so a few
    huge pages cannot pile up in a worker.
    """
    for batch in batches:
        indices, rows, size = [], [], 0
        pages = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
        for index, (url, html) in enumerate(pages):
            for row in extract(url, html):
                indices.append(index)
                rows.append(row)
                size += sum(len(value) for value in row if isinstance(value, str))
                if size >= _FLUSH_CHARS:
                    yield _gather(batch, keys, fields, indices, rows)
                    indices, rows, size = [], [], 0
        if rows:
            yield _gather(batch, keys, fields, indices, rows)
