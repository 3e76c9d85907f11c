"""A whole run: landed tables in, new postings and their digest out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed import files, rules
from rolefeed.operators.fallback import generic_postings
from rolefeed.operators.filters import title_matches, too_senior, with_experience
from rolefeed.operators.report import company_metrics, run_metrics, write_digest, write_metrics
from rolefeed.session import broadcast_if_small, settle, settled_paths
from rolefeed.sources.adapters import Adapter, fetched, layouts
from rolefeed.sources.catalog import routed
from rolefeed.sources.payloads import normalise_all, quarantined, usable, with_catalog
from rolefeed.sources.seen import record_new


@dataclass(frozen=True)
class Rules:
    keywords: Sequence[str] = rules.KEYWORDS
    exclude: Sequence[str] = rules.SENIORITY_TERMS
    max_years: int = rules.MAX_YEARS
    fragments: Sequence[str] = rules.JOB_LINK_FRAGMENTS
    boilerplate: Sequence[str] = rules.BOILERPLATE_TITLES
    use_rendered: bool = True
    filter_rendered: bool = False
    on_bad: str = "company"
    location: str = rules.DEFAULT_LOCATION
    whole_word: bool = False  # keywords do not match inside words of platform titles
    strict_zero: bool = False  # "10 years of experience" is not 0 years

    @classmethod
    def read(cls, spark: SparkSession, keywords: str, seniority: str, experience: str, **other) -> Rules:
        """Rules from the three rule files, keyed ``keywords``, ``exclude_terms``, ``max_years``."""
        return cls(
            keywords=rules.rule_list(spark, keywords, "keywords"),
            exclude=rules.rule_list(spark, seniority, "exclude_terms"),
            max_years=rules.max_years(spark, experience),
            **other,
        )


def platform_rows(
    catalog: DataFrame, payloads: DataFrame, chosen: Rules = Rules(), adapters: Sequence[Adapter] = ()
) -> DataFrame:
    """Postings of the wanted roles from platform responses, and the records that cannot be used.

    Responses are parsed once; only what can still matter is kept.
    """
    adapted = routed(catalog, adapters).where(F.col("source_type") != rules.GENERIC)
    rows = normalise_all(with_catalog(payloads, broadcast_if_small(adapted)), layouts(adapters))
    for adapter in adapters:
        if adapter.fetch:
            rows = rows.unionByName(fetched(adapted, adapter), allowMissingColumns=True)
    title = F.col("title")
    wanted = title_matches(title, chosen.keywords, chosen.whole_word) & ~too_senior(title, chosen.exclude)
    return settle(rows.where(F.col("bad").isNotNull() | wanted))


def generic_companies(catalog: DataFrame, adapters: Sequence[Adapter] = ()) -> DataFrame:
    """Number and name of the companies whose career pages are read."""
    return routed(catalog, adapters).where(F.col("source_type") == rules.GENERIC).select(
        "company_ord", F.col("name").alias("company")
    )


def matching_postings(
    catalog: DataFrame,
    platform: DataFrame,
    static_pages: DataFrame,
    rendered_pages: DataFrame,
    chosen: Rules = Rules(),
    adapters: Sequence[Adapter] = (),
) -> DataFrame:
    """Postings of the wanted roles from every source, with ``yoe_note`` and ``yoe_ok``.

    ``platform`` comes from ``platform_rows``. Experience is judged last: titles are tested before
    any description is parsed.
    """
    generic = broadcast_if_small(generic_companies(catalog, adapters))
    html = generic_postings(
        static_pages.join(generic, "company_ord"),
        rendered_pages.join(generic, "company_ord") if chosen.use_rendered else None,
        chosen.keywords, chosen.exclude, chosen.fragments, chosen.boilerplate,
        chosen.filter_rendered, location=chosen.location,
    )
    both = usable(platform, chosen.on_bad).unionByName(html, allowMissingColumns=True)
    return with_experience(both, chosen.max_years, chosen.strict_zero).drop("description")


class Outcome(NamedTuple):
    """What a run leaves behind."""

    new: DataFrame  # its rows of the seen table
    companies: DataFrame  # matched and dropped postings per catalog company
    totals: DataFrame  # one row: new postings, postings dropped for experience
    quarantined: DataFrame  # records that could not be used, and why
    scratch: tuple[str, ...] = ()  # folders that the metrics and the quarantine are read from

    def close(self) -> None:
        """Remove what the run has written to the shared folder for its own use. ``new`` stays
        readable; the rest of the outcome does not."""
        for path in self.scratch:
            files.remove(self.new.sparkSession, path)


def run(
    catalog: DataFrame,
    payloads: DataFrame,
    static_pages: DataFrame,
    rendered_pages: DataFrame,
    seen_path: str,
    run_id: int,
    run_ts: dt.datetime,
    digest_path: str | None = None,
    metrics_path: str | None = None,
    chosen: Rules = Rules(),
    adapters: Sequence[Adapter] = (),
) -> Outcome:
    """One run: collect, filter, report what is new.

    The digest is made from the committed rows, so a lost one can be made again. ``adapters`` are
    platforms besides the library's own. Call ``close`` on the outcome once it has been read.
    """
    with settled_paths() as scratch:
        platform = platform_rows(catalog, payloads, chosen, adapters)
        matches = settle(matching_postings(catalog, platform, static_pages, rendered_pages, chosen, adapters))
        new = record_new(matches.where("yoe_ok"), seen_path, run_id, run_ts)
        if digest_path:
            write_digest(new, digest_path)
    companies, totals = company_metrics(catalog, matches), run_metrics(new, matches)
    bad = quarantined(platform).select(
        "company_ord", "company", "source_type", "posting_ord", F.col("bad").alias("reason")
    )
    if metrics_path:
        write_metrics(companies, f"{metrics_path}/companies", run_id)
        write_metrics(totals, f"{metrics_path}/totals", run_id)
        write_metrics(bad, f"{metrics_path}/quarantined", run_id)
    return Outcome(new, companies, totals, bad, tuple(scratch))
