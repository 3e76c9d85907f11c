"""Static pages first, rendered pages only where those gave nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefeed import rules
from rolefeed.operators.filters import drop_senior, title_matches
from rolefeed.session import broadcast_if_small, settle
from rolefeed.sources.pages import job_cards, keyword_links

PAGE_LINKS = 1 << 32  # more links than a page holds
COMPANY = ("company_ord",)


def numbered(pages: DataFrame, company: Sequence[str] = COMPANY) -> DataFrame:
    """``pages`` with ``page_ord``, which numbers the pages of a company from 0 by address, then
    content. Equal pages of a company have one number, and each is taken once."""
    company = list(company)
    several = pages.groupBy(*company).agg(F.count("*").alias("n")).where("n > 1").select(*company)
    # As a rule a company has one page; then no html is read here.
    if several.isEmpty():
        return pages.withColumn("page_ord", F.lit(0).cast("bigint"))
    several = broadcast_if_small(settle(several))
    single = pages.join(several, company, "left_anti").withColumn("page_ord", F.lit(0).cast("bigint"))
    among = pages.join(several, company, "left_semi").withColumn("_content", F.md5("html"))
    place = F.row_number().over(Window.partitionBy(*company).orderBy("url", "_content")) - 1
    numbers = settle(among.select(*company, "url", "_content").distinct().withColumn("page_ord", place.cast("bigint")))
    numbers = numbers.withColumnsRenamed({"url": "_url", "_content": "_of"})
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("_content").eqNullSafe(F.col("_of"))
    for c in company:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    marked = among.alias("a").join(broadcast_if_small(numbers).alias("b"), same).select("a.*", "page_ord")
    return single.unionByName(marked.drop("_content").dropDuplicates([*company, "page_ord"]))


def _posting_ord() -> Column:
    return (F.col("page_ord") * PAGE_LINKS + F.col("link_ord")).alias("posting_ord")


def _keys(company: Sequence[str]) -> tuple[str, ...]:
    return (*company, "company", "page_ord")


def static_hits(
    pages: DataFrame, keywords: Sequence[str] = rules.KEYWORDS, company: Sequence[str] = COMPANY
) -> DataFrame:
    """Keyword links of static pages, as a settled table: parsed once, used for the postings and to
    decide who falls back."""
    return settle(keyword_links(numbered(pages, company), keywords, _keys(company)))


def static_postings(
    hits: DataFrame, exclude: Sequence[str] = rules.SENIORITY_TERMS, company: Sequence[str] = COMPANY
) -> DataFrame:
    """Postings out of keyword links. One whose address cannot be resolved fails its company."""
    failed = broadcast_if_small(hits.where("full_url is null").select(*company).distinct())
    return (
        hits.join(failed, list(company), "left_anti")
        .transform(drop_senior, exclude)
        .select(*company, "company", F.lit("static").alias("source_type"), _posting_ord(),
                "title", F.col("full_url").alias("url"))
    )


def rendered_postings(
    pages: DataFrame,
    keywords: Sequence[str] = rules.KEYWORDS,
    exclude: Sequence[str] = rules.SENIORITY_TERMS,
    fragments: Sequence[str] = rules.JOB_LINK_FRAGMENTS,
    boilerplate: Sequence[str] = rules.BOILERPLATE_TITLES,
    filter_rendered: bool = False,
    context: bool = False,
    location: str = rules.DEFAULT_LOCATION,
    company: Sequence[str] = COMPANY,
) -> DataFrame:
    """Postings out of the cards of rendered pages."""
    cards = job_cards(numbered(pages, company), fragments, boilerplate, _keys(company), context, location)
    if filter_rendered:
        cards = cards.where(title_matches(F.col("title"), keywords))
    around = ["context_text"] if context else []
    return cards.transform(drop_senior, exclude).select(
        *company, "company", F.lit("rendered").alias("source_type"), _posting_ord(),
        "title", F.col("full_url").alias("url"), "location", *around,
    )


def generic_postings(
    static_pages: DataFrame,
    rendered_pages: DataFrame | None,
    keywords: Sequence[str] = rules.KEYWORDS,
    exclude: Sequence[str] = rules.SENIORITY_TERMS,
    fragments: Sequence[str] = rules.JOB_LINK_FRAGMENTS,
    boilerplate: Sequence[str] = rules.BOILERPLATE_TITLES,
    filter_rendered: bool = False,
    context: bool = False,
    location: str = rules.DEFAULT_LOCATION,
) -> DataFrame:
    """Postings of the companies without a known platform.

    Pages are (company_ord, company, url, html). A company gets its rendered cards only if none of
    its static pages had a keyword link: links later dropped as too senior count as found.
    Rendered cards are not tested for keywords unless ``filter_rendered`` is set. Without
    ``rendered_pages`` there is no fallback. The links of a company's further pages are numbered
    after those of its first (``numbered``).
    """
    hits = static_hits(static_pages, keywords)
    static = static_postings(hits, exclude)
    if rendered_pages is None:
        return static
    # Companies are removed before their pages are parsed.
    found = broadcast_if_small(hits.select("company_ord").distinct())
    rendered = rendered_postings(
        rendered_pages.join(found, "company_ord", "left_anti"),
        keywords, exclude, fragments, boilerplate, filter_rendered, context, location,
    )
    return static.unionByName(rendered, allowMissingColumns=True)
