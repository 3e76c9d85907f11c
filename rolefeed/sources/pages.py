"""Links and job cards out of landed HTML pages."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefeed import rules
from rolefeed.functions import html
from rolefeed.functions.text import card_title, clean_text, link_title
from rolefeed.operators.dedup import first_per_page
from rolefeed.operators.filters import is_card_title, is_job_link, link_matches
from rolefeed.session import settle

_TYPES = {"bigint": T.LongType(), "string": T.StringType()}


def _extract(pages: DataFrame, keys: Sequence[str], fields, extract) -> DataFrame:
    keys = list(keys)
    extracted = [T.StructField(name, _TYPES[kind]) for name, kind in fields]
    schema = T.StructType([*(pages.schema[k] for k in keys), *extracted])
    # Only pages that can hold a link are sent to Python.
    linked = pages.where(F.col("html").contains("<a") | F.col("html").contains("<A"))
    wanted = dict.fromkeys([*keys, "url", "html"])
    return linked.select(*wanted).mapInArrow(
        functools.partial(html.explode_pages, keys=keys, fields=fields, extract=extract), schema
    )


def page_links(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per ``<a href>`` of (keys, url, html): ordinal, address as written and resolved
    (NULL if it cannot be), cleaned text."""
    links = _extract(pages, keys, html.LINK_FIELDS, html.link_rows)
    return links.withColumn("text", clean_text(F.col("text")))


def _titled(cards: DataFrame, location: str) -> DataFrame:
    title = card_title(F.col("heading_text"), F.col("text"), F.col("aria_label"))
    return cards.withColumn("title", title).withColumn("location", F.lit(location))


class CardTree(NamedTuple):
    """Cards that know their parent element, and the texts of the pages, each once."""

    cards: DataFrame  # keys, the card's fields, parent_ord, first_chunk, end_chunk
    chunks: DataFrame  # keys, chunk_ord, chunk_text
    keys: tuple[str, ...]

    def contexts(self, cards: DataFrame) -> DataFrame:
        """The text of the parents of some of the cards, one row per page and parent: keys,
        ``parent_ord``, ``context_text``.

        Parents are intervals of chunks, so the text of a page stands in ``chunks`` once, however
        many links and nested parents share it; a text is put together only for a parent that is
        asked for, and once for all cards in it.
        """
        keys, piece = self.keys, F.struct("chunk_ord", "chunk_text")
        parents = cards.select(*keys, "parent_ord", "first_chunk", "end_chunk").distinct()
        # An element without text has an interval without chunks.
        inside = F.when(F.col("first_chunk") < F.col("end_chunk"), F.sequence("first_chunk", F.col("end_chunk") - 1))
        wanted = parents.select(*keys, "parent_ord", F.explode_outer(inside).alias("chunk_ord")).alias("w")
        texts = self.chunks.alias("c")
        same = functools.reduce(operator.and_, (F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys))
        joined = wanted.join(texts, same & (F.col("w.chunk_ord") == F.col("c.chunk_ord")), "left").select(
            *[F.col(f"w.{k}").alias(k) for k in keys], "parent_ord", "c.chunk_ord", "chunk_text"
        )
        pieces = F.array_sort(F.collect_list(F.when(F.col("chunk_text").isNotNull(), piece)))
        return joined.groupBy(*keys, "parent_ord").agg(
            F.array_join(F.transform(pieces, lambda x: x["chunk_text"]), " ").alias("context_text")
        )

    def with_context(self, cards: DataFrame) -> DataFrame:
        """Some of the cards with the text around them. Every row holds its parent's whole text, so
        choose the cards first."""
        helpers = ("parent_ord", "first_chunk", "end_chunk")
        around = self.contexts(cards).alias("t")
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*self.keys, "parent_ord")]
        kept = [F.col(f"k.{c}").alias(c) for c in cards.columns if c not in helpers]
        return cards.alias("k").join(around, functools.reduce(operator.and_, same), "left").select(*kept, "context_text")


def card_tree(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), location: str = rules.DEFAULT_LOCATION
) -> CardTree:
    """The cards of ``page_cards`` with what is needed to tell the text around them. Pages are
    parsed once, and the result grows with their size alone."""
    rows = settle(_extract(pages, keys, html.TREE_FIELDS, html.tree_rows))
    is_card, chunk_names = F.col("link_ord").isNotNull(), [name for name, _ in html.CHUNK_FIELDS]
    cards = _titled(rows.where(is_card).drop(*chunk_names), location)
    return CardTree(cards, rows.where(~is_card).select(*keys, *chunk_names), tuple(keys))


def page_cards(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), context: bool = False,
    location: str = rules.DEFAULT_LOCATION,
) -> DataFrame:
    """One row per ``<a href>`` of a rendered page with its heading, text, aria-label, title and
    location; ``context`` adds the text around the link."""
    if context:
        tree = card_tree(pages, keys, location)
        return tree.with_context(tree.cards)
    return _titled(_extract(pages, keys, html.CARD_FIELDS, html.card_rows), location)


def keyword_links(
    pages: DataFrame, keywords: Sequence[str] = rules.KEYWORDS, keys: Sequence[str] = ("page_id",)
) -> DataFrame:
    """Links of static pages with a keyword in text or address, once per page and address. ``keys``
    identify a page."""
    hits = page_links(pages, keys).where(link_matches(F.col("text"), F.col("href"), keywords))
    titled = hits.withColumn("title", link_title(F.col("text"), rules.UNTITLED_LINK))
    return first_per_page(titled.drop("text"), *keys)


def job_cards(
    pages: DataFrame, fragments: Sequence[str] = rules.JOB_LINK_FRAGMENTS,
    boilerplate: Sequence[str] = rules.BOILERPLATE_TITLES, keys: Sequence[str] = ("page_id",),
    context: bool = False, location: str = rules.DEFAULT_LOCATION,
) -> DataFrame:
    """Cards of rendered pages that link to a job, once per page and address. ``keys`` identify a
    page. ``context`` adds the text around those cards."""
    tree = card_tree(pages, keys, location) if context else None
    cards = tree.cards if tree else page_cards(pages, keys, location=location)
    accepted = cards.where(
        is_job_link(F.col("href"), fragments) & is_card_title(F.col("title"), boilerplate)
    )
    once = first_per_page(accepted.drop("text", "heading_text", "aria_label"), *keys)
    return tree.with_context(settle(once)) if tree else once
