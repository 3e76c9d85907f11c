"""The requests a crawler has to make, as a table."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefeed import rules
from rolefeed.session import settle
from rolefeed.functions.choice import first_match
from rolefeed.functions.urls import url_slug, workday_board


def page_offsets(total: Column, limit: int, last: int | None = None) -> Column:
    """0 and every multiple of ``limit`` below ``total``, up to ``last`` if one is given. A NULL
    total is 0."""
    highest = F.greatest(F.coalesce(total, F.lit(0)) - 1, F.lit(0))
    highest = (highest - highest % limit).cast("bigint")
    if last is not None:
        highest = F.least(highest, F.lit(last).cast("bigint"))
    return F.sequence(F.lit(0).cast("bigint"), highest, F.lit(limit).cast("bigint"))


def _once(endpoint: Column) -> Column:
    return F.struct(
        endpoint.alias("endpoint"), F.lit("GET").alias("method"),
        F.array(F.lit(0).cast("bigint")).alias("offsets"),
        F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
    )


def _paged(endpoint: Column, method: str, limit: int, last: int | None, before: str, after: str) -> Column:
    # Without an endpoint there is no request at all.
    return F.struct(
        endpoint.alias("endpoint"), F.lit(method).alias("method"),
        F.when(endpoint.isNotNull(), page_offsets(F.col("total"), limit, last)).alias("offsets"),
        F.lit(before).alias("before"), F.lit(after).alias("after"),
    )


def fetch_plan(catalog: DataFrame, last_offsets: Mapping[str, int] | None = None) -> DataFrame:
    """One row per request for a routed catalog with a ``total`` column: endpoint, method, page
    offset and, for paged platforms, what is sent along (a JSON body or a query string).

    A Workday company whose address does not parse gets none. All pages are requested, unless
    ``last_offsets`` names the last offset of a paged platform.
    """
    last_offsets = last_offsets or {}
    url, slug = F.col("url"), url_slug(F.col("url"))
    tenant, host, site = workday_board(url)
    workday = F.concat(
        F.lit("https://"), tenant, F.lit("."), host, F.lit(".myworkdayjobs.com/wday/cxs/"),
        tenant, F.lit("/"), site, F.lit("/jobs"),
    )
    # The public list endpoint of each platform and its parameters.
    requests = {
        "greenhouse": _once(F.concat(
            F.lit("https://boards-api.greenhouse.io/v1/boards/"), slug, F.lit("/jobs?content=true"))),
        "lever": _once(F.concat(
            F.lit("https://api.lever.co/v0/postings/"), slug, F.lit("?mode=json"))),
        "smartrecruiters": _once(F.concat(
            F.lit("https://api.smartrecruiters.com/v1/companies/"), slug, F.lit("/postings"))),
        "ashby": _once(F.concat(F.lit("https://api.ashbyhq.com/posting-api/job-board/"), slug)),
        "workday": _paged(
            workday, "POST", rules.WORKDAY_LIMIT, last_offsets.get("workday"),
            '{"limit":%d,"offset":' % rules.WORKDAY_LIMIT, ',"searchText":""}'),
        "amazon": _paged(
            F.lit("https://www.amazon.jobs/en/search.json"), "GET",
            rules.AMAZON_LIMIT, last_offsets.get("amazon"),
            "base_query=&offset=", "&result_limit=%d&sort=recent" % rules.AMAZON_LIMIT),
    }
    cases = ((F.col("source_type") == name, request) for name, request in requests.items())
    return (
        catalog.select("company_ord", "source_type", first_match(cases, _once(url)).alias("r"))
        # The outer form keeps Spark from evaluating the whole CASE in an inferred filter too.
        .select("company_ord", "source_type", "r", F.explode_outer("r.offsets").alias("page_offset"))
        .where("page_offset is not null")
        .select(
            "company_ord", "source_type", "r.endpoint", "r.method", "page_offset",
            F.concat("r.before", F.col("page_offset").cast("string"), "r.after").alias("request"),
        )
    )


# What a landed page says about its listing.
REPORT = "company_ord bigint, page_offset bigint, total bigint, empty boolean"


def page_reports(payloads: DataFrame) -> DataFrame:
    """Per landed response: the number of postings that it reports (0 if it does not say) and
    whether it holds none. A response that cannot be read reports 0 and holds none."""
    said = F.from_json("body", "total bigint, hits bigint, jobPostings array<variant>, jobs array<variant>")
    workday = F.col("source_type") == "workday"
    total = F.when(workday, said["total"]).otherwise(said["hits"])
    items = F.when(workday, F.size(said["jobPostings"])).otherwise(F.size(said["jobs"]))
    return payloads.select(
        "company_ord", "page_offset", F.coalesce(total, F.lit(0)).alias("total"),
        (F.col("source_type").isin("workday", "amazon") & (F.coalesce(items, F.lit(0)) <= 0)).alias("empty"),
    )


def outstanding(catalog: DataFrame, reports: DataFrame, last_offsets: Mapping[str, int] | None = None) -> DataFrame:
    """Requests of a routed catalog that are still to be made, given what has landed
    (``page_reports``): as ``fetch_plan``, with the total that the last landed page of a company
    reports. Of a company without a landed page only the first is known; nothing behind an empty
    page is asked for."""
    known = reports.groupBy("company_ord").agg(
        F.max_by("total", "page_offset").alias("total"), F.min(F.when(F.col("empty"), F.col("page_offset"))).alias("end"),
    )
    companies = catalog.drop("total").join(known, "company_ord", "left")
    plan = fetch_plan(companies.select("company_ord", "source_type", "url", "total"), last_offsets)
    open_ = plan.join(reports.select("company_ord", "page_offset"), ["company_ord", "page_offset"], "left_anti")
    ends = known.where("end is not null").select("company_ord", "end")
    return open_.join(ends, "company_ord", "left").where("end is null or page_offset < end").select(*plan.columns)


def fetch_rounds(
    catalog: DataFrame, fetch: Callable[[DataFrame], DataFrame], last_offsets: Mapping[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Request and land pages until nothing is outstanding. ``fetch`` turns requests into landed
    responses (company_ord, source_type, page_offset, body); a request that it does not answer is
    taken as an empty page.

    Returns the requests, each with its ``round``, and the responses. A round requests every page
    that is known by then, so their number follows how often a total grows, not how many pages
    there are.
    """
    spark = catalog.sparkSession
    reports, asked, landed = spark.createDataFrame([], REPORT), [], []
    while True:
        todo = settle(outstanding(catalog, reports, last_offsets).withColumn("round", F.lit(len(asked)).cast("bigint")))
        if todo.isEmpty():
            break
        asked.append(todo)
        landed.append(settle(fetch(todo.drop("round"))))
        answered = page_reports(landed[-1])
        silent = todo.join(answered.select("company_ord", "page_offset"), ["company_ord", "page_offset"], "left_anti").select(
            "company_ord", "page_offset", F.lit(0).cast("bigint").alias("total"), F.lit(True).alias("empty"))
        reports = reports.unionByName(settle(answered.unionByName(silent)))
    if not asked:
        none = fetch_plan(catalog.withColumn("total", F.lit(0).cast("bigint")).limit(0)).withColumn("round", F.lit(0).cast("bigint"))
        return none, fetch(none.drop("round"))
    return tuple(functools.reduce(DataFrame.unionByName, part) for part in (asked, landed))
