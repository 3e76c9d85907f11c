"""Every query of the library over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import functools
import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefeed import rules, schemas
from rolefeed.functions import experience, resolve, text, urls
from rolefeed.operators import dedup, fallback, filters, report
from rolefeed.plans import flow, inputs
from rolefeed.session import settle, shared_dir
from rolefeed.sources.adapters import Adapter
from rolefeed.sources import catalog as catalogs
from rolefeed.sources import fetch_plan as plans
from rolefeed.sources import pages as html_pages
from rolefeed.sources import payloads as responses
from rolefeed.sources import seen as seen_store
from rolefeed.streaming import incremental, landings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Words and addresses that occur in the test pages; the role rules do not.
PAGE_KEYWORDS = ("de", "the")
FALLBACK_KEYWORDS = ("de", "the", "en")
PAGE_FRAGMENTS = ("/de", "/th", "/en", "/a")
PAGE_BOILERPLATE = ("ther", "tion")

# The test history in three landings, and the split between seen and incoming postings.
LANDINGS = (0, 199501, 199701, 999999)
SPLIT_RUN = 199601
RUN_TS = dt.datetime(2025, 1, 1)
# Runs of two years each.
FIRST_YEAR, RUNS = 1995, 4
SEEN_COLUMNS = ("run_id", "company_ord", "posting_ord", "company", "title", "url")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _flagged(spark, sf_dir):
    """Postings of the wanted roles with the verdict on experience."""
    return inputs.postings(spark, sf_dir).transform(filters.role_filter).transform(filters.with_experience)


def _matches(spark, sf_dir):
    return _flagged(spark, sf_dir).where("yoe_ok").drop("description", "yoe", "yoe_ok")


def _landed(spark, sf_dir, source_type=None, damaged=False):
    """Responses as they land, next to their company's catalog entry."""
    make = inputs.damaged_payloads if damaged else inputs.payloads
    landed = make(spark, sf_dir) if damaged else make(spark, sf_dir, source_type)
    return responses.with_catalog(landed, inputs.companies(spark, sf_dir, source_type))


# --- flagship -----------------------------------------------------------------------------


@query
def flagship(spark, sf_dir):
    """Roles, seniority, experience, then one posting per url."""
    return dedup.first_per_url(
        _matches(spark, sf_dir).select("company_ord", "posting_ord", "company", "title", "url", "yoe_note")
    )


# --- sources ------------------------------------------------------------------------------


@query
def catalog_scan(spark, sf_dir):
    """The catalog as read from a file."""
    path = shared_dir(spark)
    inputs.catalog(spark, sf_dir).write.parquet(path)
    return catalogs.read_catalog(spark, path)


def _source_query(source_type: str) -> Query:
    def run(spark, sf_dir):
        rows = responses.normalise(_landed(spark, sf_dir, source_type), source_type)
        return rows.where("bad is null").select(
            "company_ord", "company", "source_type", "posting_ord", "title", "url", "description"
        )

    return run


for _name in responses.PLATFORMS:
    QUERIES[f"src_{_name}"] = _source_query(_name)


@query
def union_sources(spark, sf_dir):
    landed = _landed(spark, sf_dir).select(
        "company_ord", "company", "catalog_url", "page_offset", "body", "source_type"
    )
    rows = responses.normalise_all(settle(landed, partition_by="source_type"))
    return rows.where("bad is null").select("company_ord", "source_type", "posting_ord", "title", "url")


def _damaged(spark, sf_dir):
    landed = _landed(spark, sf_dir, damaged=True).select(
        "company_ord", "company", "catalog_url", "page_offset", "body", "source_type"
    )
    return responses.normalise_all(settle(landed, partition_by="source_type"))


@query
def quarantine(spark, sf_dir):
    """What is left when a company with any unusable record is left out."""
    return responses.usable(settle(_damaged(spark, sf_dir))).select("company_ord", "source_type", "posting_ord", "title", "url")


@query
def quarantine_rows(spark, sf_dir):
    """What is left when only unusable records are left out."""
    kept = responses.usable(_damaged(spark, sf_dir), on_bad="row")
    return kept.select("company_ord", "source_type", "posting_ord", "title", "url")


@query
def quarantine_report(spark, sf_dir):
    """Unusable records per company and reason."""
    return (
        responses.quarantined(_damaged(spark, sf_dir))
        .groupBy("company_ord", "source_type", "bad").agg(F.count("*").alias("n"))
    )


@query
def html_links(spark, sf_dir):
    return html_pages.page_links(inputs.pages(spark, sf_dir))


@query
def rendered_cards(spark, sf_dir):
    return html_pages.page_cards(inputs.pages(spark, sf_dir), context=True)


@query
def card_contexts(spark, sf_dir):
    """The accepted cards of pages whose links hold headings and have parents inside parents, each
    with the text around it."""
    pages = inputs.nested_pages(spark, sf_dir)
    cards = html_pages.job_cards(pages, inputs.NESTED_FRAGMENTS, (), context=True)
    return cards.select("page_id", "link_ord", "full_url", "title", "context_text")


@query
def fetch_plan(spark, sf_dir):
    return plans.fetch_plan(catalogs.routed(inputs.catalog(spark, sf_dir)))


def _site(catalog, requests):
    """Answers to requests: the first page of a listing reports half of it; every seventh company's
    third page and those behind it are empty."""
    of = requests.join(catalog.select("company_ord", "total"), "company_ord")
    limit = F.when(F.col("source_type") == "workday", rules.WORKDAY_LIMIT).otherwise(rules.AMAZON_LIMIT)
    total = F.coalesce("total", F.lit(0))
    said = F.when(F.col("page_offset") == 0, F.ceil(total / 2)).otherwise(total)
    rows = F.greatest(F.least(total - F.col("page_offset"), limit), F.lit(0))
    rows = F.when((F.col("company_ord") % 7 == 3) & (F.col("page_offset") >= 2 * limit), 0).otherwise(rows)
    items = F.array_repeat(F.struct(F.lit("x").alias("title")), rows.cast("int"))
    body = (
        F.when(F.col("source_type") == "workday", F.to_json(F.struct(said.alias("total"), items.alias("jobPostings"))))
        .when(F.col("source_type") == "amazon", F.to_json(F.struct(said.alias("hits"), items.alias("jobs"))))
        .otherwise("{}")
    )
    return of.select("company_ord", "source_type", "page_offset", body.alias("body"))


@query
def fetch_outstanding(spark, sf_dir):
    """The requests of every round until nothing is outstanding, on a site whose totals grow."""
    catalog = settle(catalogs.routed(inputs.catalog(spark, sf_dir)))
    asked, _ = plans.fetch_rounds(catalog, lambda todo: _site(catalog, todo))
    return asked.select("company_ord", "source_type", "page_offset", "round")


# A platform that the library does not know: its responses, and the addresses of its companies.
SEVENTH = Adapter(
    name="roleboard", fragment="roleboard.example/",
    layout=responses.Platform(
        items="openings",
        fields=(responses.Field("headline", required=True, nullable=False), responses.Field("ref", text=False, optional=True),
                responses.Field("summary", optional=True)),
        title=lambda: responses.value_of("headline"),
        url=lambda: urls.host_path(F.lit("https://roleboard.example/o/"), responses.value_of("ref"), F.col("catalog_url")),
        description=lambda: text.html_to_text(responses.value_of("summary")),
    ),
)


def _fetch_two(company, url):
    """Two postings for any company but one."""
    if company == "CHINA":
        raise ConnectionError(url)
    return [{"title": f"Software Engineer, {company}", "url": f"{url}/{n}", "description": f"<p>{n} years of experience</p>"} for n in (1, 2)]


CALLED = Adapter(name="called", fragment="called.example/", fetch=_fetch_two)


@query
def adapter_run(spark, sf_dir):
    """A run over two platforms of a user's own, one by its landed responses, one called per company;
    the rows it reports."""
    own = F.when(F.col("company_ord") % 2 == 0, "https://roleboard.example/c").otherwise("https://called.example/c")
    catalog = settle(inputs.companies(spark, sf_dir).select(
        "company_ord", "name", F.concat(own, F.col("company_ord").cast("string")).alias("url"), F.lit(None).cast("string").alias("type")
    ))
    payloads = settle(inputs.seventh_payloads(spark, sf_dir, SEVENTH.name))
    pages = spark.createDataFrame([], schemas.PAGE)
    outcome = flow.run(catalog, payloads, pages, pages, shared_dir(spark), 0, RUN_TS, adapters=(SEVENTH, CALLED))
    return outcome.new.select("company_ord", "posting_ord", "company", "title", "url", "yoe_note")


@query
def reported_totals(spark, sf_dir):
    return responses.reported_totals(inputs.payloads(spark, sf_dir))


@query
def seen_append(spark, sf_dir):
    """The seen table after two runs, the second of them repeated."""
    history = inputs.postings(spark, sf_dir)
    path = shared_dir(spark)
    for run_id, landed in enumerate((F.col("run_id") < SPLIT_RUN, F.col("run_id") >= SPLIT_RUN)):
        seen_store.record_new(history.where(landed), path, run_id, RUN_TS)
    seen_store.record_new(history.where(F.col("run_id") >= SPLIT_RUN), path, 1, RUN_TS)
    return seen_store.read_seen(spark, path).select(
        "run_id", "company_ord", "posting_ord", "company", "title", "url", "first_seen"
    )


def _broken(df):
    """``df`` whose last rows cannot be computed, as if the job failed on the way."""
    fails = F.when(F.col("posting_ord") % 5 == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("title"))
    return df.withColumn("title", fails.cast("string"))


@query
def seen_commit(spark, sf_dir):
    """The seen table after a run, a run that fails while it writes, and that run once more. While
    it fails the table stays as it was."""
    history, path = inputs.postings(spark, sf_dir), shared_dir(spark)
    earlier, later = history.where(F.col("run_id") < SPLIT_RUN), history.where(F.col("run_id") >= SPLIT_RUN)
    seen_store.record_new(earlier, path, 0, RUN_TS)
    seen_store.record_new(later.where("posting_ord % 2 = 0"), path, 1, RUN_TS)
    before = seen_store.read_seen(spark, path).select(*SEEN_COLUMNS, F.lit("before").alias("state"))
    try:
        seen_store.append_run(_broken(later), path, 1, RUN_TS)
    except PySparkException:
        pass
    else:
        raise AssertionError("the run was to fail")
    kept = seen_store.read_seen(spark, path).select(*SEEN_COLUMNS, F.lit("kept").alias("state"))
    seen_store.record_new(later, path, 1, RUN_TS)
    after = seen_store.read_seen(spark, path).select(*SEEN_COLUMNS, F.lit("after").alias("state"))
    return before.unionByName(kept).unionByName(after)


@query
def seen_compacted(spark, sf_dir):
    """What runs of two years each report when the table is merged after every second run, two runs
    that are merged by then are repeated, and everything is merged at the end."""
    history, path = inputs.postings(spark, sf_dir), shared_dir(spark)
    for run_id in (*range(RUNS), 1, 2):
        part = history.where(F.floor((F.col("run_id") / 100 - FIRST_YEAR) / 2) == run_id)
        seen_store.record_new(part, path, run_id, RUN_TS, order=dedup.HISTORY_ORDER, merge_after=1)
    seen_store.merge(spark, path, everything=True)
    return seen_store.read_seen(spark, path).select("run_id", "company_ord", "posting_ord", "title", "url")


# --- scalar functions ---------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return docs.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query
def html_to_text(spark, sf_dir):
    return inputs.pages(spark, sf_dir).select("page_id", text.html_to_text(F.col("html")).alias("plain"))


@query
def description_text(spark, sf_dir):
    return inputs.postings(spark, sf_dir).select(
        "posting_ord", text.html_to_text(F.col("description")).alias("plain")
    )


@query
def url_slug(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select("company_ord", urls.url_slug(F.col("url")).alias("slug"))


@query
def workday_url_parts(spark, sf_dir):
    tenant, host, site = urls.workday_board(F.col("url"))
    return inputs.catalog(spark, sf_dir).select(
        "company_ord", tenant.alias("tenant"), host.alias("host"), site.alias("site")
    )


@query
def resolve_url(spark, sf_dir):
    """Addresses of every form against the address of every page."""
    forms = F.array(*map(F.lit, inputs.ADDRESS_FORMS))
    pages = inputs.pages(spark, sf_dir).select("page_id", "url", F.posexplode(forms).alias("form", "href"))
    return pages.select("page_id", "form", resolve.resolved(F.col("url"), F.col("href")).alias("resolved"))


@query
def detect_platform(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select(
        "company_ord", urls.detect_platform(F.col("url")).alias("platform")
    )


@query
def resolve_type(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select(
        "company_ord", urls.resolve_type(F.col("type"), F.col("url")).alias("resolved")
    )


@query
def yoe_extract(spark, sf_dir):
    return inputs.postings(spark, sf_dir).select(
        "posting_ord", experience.min_years_required(F.col("description")).alias("yoe")
    )


@query
def yoe_documents(spark, sf_dir):
    """The same reading of whole documents, each with a claim appended."""
    claim = F.concat_ws(" ", "text", (F.col("doc_id") % 40).cast("string"), F.lit("years of experience"))
    return inputs.documents(spark, sf_dir).select(
        "doc_id", experience.min_years_required(claim).alias("yoe")
    )


@query
def yoe_note(spark, sf_dir):
    years = experience.min_years_required(F.col("description"))
    return inputs.postings(spark, sf_dir).select(
        "posting_ord", experience.experience_note(years).alias("note")
    )


@query
def rendered_title(spark, sf_dir):
    """Title choice over headings, link texts and aria-labels of every relative length."""
    cards = inputs.postings(spark, sf_dir).select(
        "posting_ord",
        F.expr("case when posting_ord % 3 = 0 then company end").alias("heading"),
        "title",
        F.expr("case posting_ord % 4 when 0 then url when 1 then company else '' end").alias("aria"),
    )
    chosen = text.card_title(F.col("heading"), F.col("title"), F.coalesce("aria", F.lit("")))
    return cards.select("posting_ord", chosen.alias("title"))


# --- filters ------------------------------------------------------------------------------


@query
def kw_title(spark, sf_dir):
    rows = inputs.postings(spark, sf_dir)
    return rows.where(filters.title_matches(F.col("title"))).select("posting_ord", "title")


@query
def kw_documents(spark, sf_dir):
    """The keyword test over whole documents."""
    docs = inputs.documents(spark, sf_dir)
    return docs.where(filters.title_matches(F.col("text"))).select("doc_id")


@query
def not_senior(spark, sf_dir):
    return inputs.postings(spark, sf_dir).transform(filters.drop_senior).select("posting_ord", "title")


@query
def role_filter(spark, sf_dir):
    return inputs.postings(spark, sf_dir).transform(filters.role_filter).select("posting_ord", "title")


@query
def yoe_gate(spark, sf_dir):
    rows = inputs.postings(spark, sf_dir).transform(filters.experience_gate)
    return rows.select("posting_ord", "yoe_note")


@query
def html_keyword_links(spark, sf_dir):
    hits = html_pages.page_links(inputs.pages(spark, sf_dir)).where(
        filters.link_matches(F.col("text"), F.col("href"), PAGE_KEYWORDS)
    )
    return hits.select("page_id", "link_ord", "full_url", text.link_title(F.col("text"), rules.UNTITLED_LINK).alias("title"))


@query
def job_link_filter(spark, sf_dir):
    cards = html_pages.page_cards(inputs.pages(spark, sf_dir))
    accepted = cards.where(
        filters.is_job_link(F.col("href"), PAGE_FRAGMENTS)
        & filters.is_card_title(F.col("title"), PAGE_BOILERPLATE)
    )
    return accepted.select("page_id", "link_ord", "full_url", "title")


@query
def catalog_lookup(spark, sf_dir):
    return catalogs.lookup(inputs.catalog(spark, sf_dir), "SUPPLIER#000000007")


@query
def strict_roles(spark, sf_dir):
    """Roles by whole words, and experience with zero years in earnest."""
    rows = filters.role_filter(inputs.postings(spark, sf_dir), whole_word=True)
    return filters.experience_gate(rows, strict_zero=True).select("posting_ord", "title", "yoe_note")


# --- joins --------------------------------------------------------------------------------


@query
def route_counts(spark, sf_dir):
    landed = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company_ord"))
    return catalogs.route_counts(landed, inputs.catalog(spark, sf_dir))


def _one_page_companies(spark, sf_dir):
    """Every test page as the career page of a company of its own."""
    name = F.concat(F.lit("Company "), F.col("page_id").cast("string"))
    return inputs.pages(spark, sf_dir).select(
        F.col("page_id").alias("company_ord"), name.alias("company"), "url", "html"
    )


def _fallback(spark, sf_dir):
    landed = _one_page_companies(spark, sf_dir)
    return fallback.generic_postings(
        landed, landed, FALLBACK_KEYWORDS, ("los", "las"), PAGE_FRAGMENTS, PAGE_BOILERPLATE
    )


@query
def static_or_rendered(spark, sf_dir):
    return _fallback(spark, sf_dir).select("company_ord", "source_type", "posting_ord", "title", "url")


QUERIES["fallback"] = QUERIES.pop("static_or_rendered")


@query
def static_only(spark, sf_dir):
    """Career pages without rendered ones to fall back on."""
    found = fallback.generic_postings(
        _one_page_companies(spark, sf_dir), None, FALLBACK_KEYWORDS, ("los", "las")
    )
    return found.select("company_ord", "source_type", "posting_ord", "title", "url")


@query
def rendered_roles(spark, sf_dir):
    """Rendered cards of all pages: not tested for keywords, only for seniority."""
    cards = html_pages.job_cards(inputs.pages(spark, sf_dir), PAGE_FRAGMENTS, PAGE_BOILERPLATE)
    kept = cards.transform(filters.drop_senior, ("los", "las"))
    return kept.select("page_id", "link_ord", "title", "full_url", "location")


def _history_split(spark, sf_dir):
    history = inputs.postings(spark, sf_dir)
    return history.where(F.col("run_id") < SPLIT_RUN), history.where(F.col("run_id") >= SPLIT_RUN)


@query
def new_postings(spark, sf_dir):
    earlier, incoming = _history_split(spark, sf_dir)
    seen = earlier.select("url").where("url is not null").distinct()
    return dedup.new_postings(incoming, seen).select("posting_ord", "company", "title", "url")


def _rule_table(spark, words):
    return spark.createDataFrame([(word,) for word in words], "term string")


@query
def kw_semi_join(spark, sf_dir):
    rows = filters.matching_rule_table(inputs.postings(spark, sf_dir), _rule_table(spark, rules.KEYWORDS))
    return rows.select("posting_ord", "title")


@query
def senior_anti_join(spark, sf_dir):
    rows = filters.without_rule_table(inputs.postings(spark, sf_dir), _rule_table(spark, rules.SENIORITY_TERMS))
    return rows.select("posting_ord", "title")


# --- de-duplication -----------------------------------------------------------------------


@query
def dedup_page(spark, sf_dir):
    links = html_pages.keyword_links(inputs.pages(spark, sf_dir), PAGE_KEYWORDS)
    return links.select("page_id", "link_ord", "full_url", "title")


@query
def dedup_run(spark, sf_dir):
    rows = inputs.postings(spark, sf_dir).select("company_ord", "posting_ord", "title", "url")
    return dedup.first_per_url(rows)


@query
def new_per_run(spark, sf_dir):
    rows = inputs.postings(spark, sf_dir).select("run_id", "company_ord", "posting_ord", "title", "url")
    return dedup.new_per_run(rows)


@query
def first_seen(spark, sf_dir):
    return dedup.first_seen(inputs.postings(spark, sf_dir))


# --- reports ------------------------------------------------------------------------------


@query
def digest(spark, sf_dir):
    # Settled like the committed rows of a run, which the lines read twice.
    new = settle(dedup.first_per_url(_matches(spark, sf_dir)))
    return report.digest_lines(new).orderBy(*report.DIGEST_ORDER)


@query
def digest_subject(spark, sf_dir):
    return report.digest_subject(dedup.first_per_url(_matches(spark, sf_dir)))


@query
def company_metrics(spark, sf_dir):
    return report.company_metrics(inputs.companies(spark, sf_dir), _flagged(spark, sf_dir))


@query
def metrics_sink(spark, sf_dir):
    """Metrics of two runs, the second written twice, as read back."""
    path = shared_dir(spark)
    metrics = settle(report.company_metrics(inputs.companies(spark, sf_dir), _flagged(spark, sf_dir)))
    for run_id in (0, 1, 1):
        report.write_metrics(metrics.where(F.col("company_ord") % 2 == run_id), path, run_id)
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("bigint"))


@query
def run_metrics(spark, sf_dir):
    flagged = settle(_flagged(spark, sf_dir).drop("title", "description"))
    return report.run_metrics(dedup.first_per_url(flagged.where("yoe_ok")), flagged)


@query
def preview(spark, sf_dir):
    # Settled, because the rows are both counted and listed.
    return report.preview(settle(
        dedup.first_per_url(_matches(spark, sf_dir)).select("company_ord", "posting_ord", "title", "url")
    ))


# --- whole runs ---------------------------------------------------------------------------

# Page companies come after the 25 platform companies in the catalog.
PAGE_COMPANY_BASE = 1000


def _everything(spark, sf_dir):
    """Catalog, platform responses, career pages and rules of a whole run."""
    page_companies = _one_page_companies(spark, sf_dir).withColumn(
        "company_ord", F.col("company_ord") + PAGE_COMPANY_BASE
    )
    platform = inputs.companies(spark, sf_dir).select("company_ord", "name", "url", "type")
    catalog = settle(platform.unionByName(
        page_companies.select("company_ord", F.col("company").alias("name"), "url", F.lit("generic").alias("type"))
    ))
    landed = page_companies.select("company_ord", "url", "html")
    payloads = settle(
        inputs.payloads(spark, sf_dir).select("company_ord", "page_offset", "body", "source_type"),
        partition_by="source_type",
    )
    chosen = flow.Rules(
        keywords=(*rules.KEYWORDS, *FALLBACK_KEYWORDS), fragments=PAGE_FRAGMENTS, boilerplate=PAGE_BOILERPLATE
    )
    return catalog, payloads, landed, chosen


@query
def full_run(spark, sf_dir):
    """One run over platform responses and career pages; the rows it reports."""
    catalog, payloads, landed, chosen = _everything(spark, sf_dir)
    outcome = flow.run(catalog, payloads, landed, landed, shared_dir(spark), 0, RUN_TS, chosen=chosen)
    outcome.close()
    return outcome.new.select("company_ord", "posting_ord", "company", "title", "url", "yoe_note")


@query
def run_quarantine(spark, sf_dir):
    """What a run over damaged responses sets aside, as its table keeps it."""
    catalog = settle(inputs.companies(spark, sf_dir).select("company_ord", "name", "url", "type"))
    payloads = settle(
        inputs.damaged_payloads(spark, sf_dir).select("company_ord", "page_offset", "body", "source_type"),
        partition_by="source_type",
    )
    pages = spark.createDataFrame([], schemas.PAGE)
    kept = shared_dir(spark)
    flow.run(catalog, payloads, pages, pages, shared_dir(spark), 0, RUN_TS, metrics_path=kept)
    return (
        spark.read.parquet(f"{kept}/quarantined").withColumnRenamed("reason", "bad")
        .groupBy("company_ord", "source_type", "bad").agg(F.count("*").alias("n"))
    )


# Rules of a user's own, as they stand in rule files.
FILE_RULES = {
    "keywords": {"keywords": ["Backend Engineer", "llm", "full stack"]},
    "seniority": {"exclude_terms": ["Lead", "senior"]},
    "experience": {"max_years": 3},
}


@query
def rule_files(spark, sf_dir):
    """Postings under rules read from files."""
    base = shared_dir(spark)
    for name, content in FILE_RULES.items():
        spark.range(1).select(F.lit(json.dumps(content))).coalesce(1).write.text(f"{base}/{name}")
    chosen = flow.Rules.read(spark, *(f"{base}/{name}" for name in FILE_RULES))
    rows = filters.role_filter(inputs.postings(spark, sf_dir), chosen.keywords, chosen.exclude)
    return filters.experience_gate(rows, chosen.max_years).select("posting_ord", "title", "yoe_note")


def _replay(spark, sf_dir, after=None, **options):
    """Land the history in parts and process each with its own stream run."""
    base = shared_dir(spark)
    names = schemas.POSTING.names
    history = inputs.postings(spark, sf_dir)
    for name in set(names) - set(history.columns):
        history = history.withColumn(name, F.lit(None).cast("string"))
    if "digest_path" in options:
        options["digest_path"] = f"{base}/{options['digest_path']}"
    for low, high in zip(LANDINGS, LANDINGS[1:]):
        part = history.where((F.col("run_id") >= low) & (F.col("run_id") < high))
        part.select(*names).write.mode("append").parquet(f"{base}/landed")
        stream = incremental.landed_stream(spark, f"{base}/landed", schemas.POSTING)
        query = incremental.report_new(
            stream, f"{base}/seen", f"{base}/checkpoint", order=dedup.HISTORY_ORDER,
            run_ts=lambda batch_id: RUN_TS, **options,
        )
        query.awaitTermination()
        if after:
            after(query, f"{base}/seen")
    return base


@query
def stream_new(spark, sf_dir):
    base = _replay(spark, sf_dir)
    return seen_store.read_seen(spark, f"{base}/seen").select("company_ord", "posting_ord", "title", "url")


@query
def stream_digest(spark, sf_dir):
    """The lines of every micro-batch's digest."""
    def matching(batch):
        return batch.transform(filters.role_filter).transform(filters.with_experience)

    base = _replay(spark, sf_dir, to_postings=matching, digest_path="digest")
    return spark.read.text(f"{base}/digest").select(F.col("run_id").cast("bigint").alias("run_id"), "value")


@query
def stream_metrics(spark, sf_dir):
    """Metrics of every micro-batch as observed on the way through."""
    def matching(stream):
        return stream.transform(filters.role_filter).transform(filters.with_experience)

    found = []
    _replay(spark, sf_dir, gate=matching, after=lambda query, seen: found.append(incremental.observed_metrics(query, seen)))
    return settle(functools.reduce(DataFrame.unionByName, found))


# A posting counts as landed at the begin of its landing; a url is forgotten after so long.
LANDED_DAYS = (0, 10, 25, 32, 60)
FORGET = "10 days"


@query
def stream_bounded(spark, sf_dir):
    """What a stream of bounded memory reports per landing: urls, and how many postings without."""
    base = shared_dir(spark)
    history = inputs.postings(spark, sf_dir).select("posting_ord", "company_ord", "url")
    schema = "posting_ord bigint, company_ord bigint, url string, landed_at timestamp_ntz"
    for number, day in enumerate(LANDED_DAYS):
        at = F.lit((RUN_TS + dt.timedelta(days=day)).isoformat()).cast("timestamp_ntz")
        part = history.where(F.pmod(F.col("posting_ord"), F.lit(len(LANDED_DAYS))) == number)
        part.withColumn("landed_at", at).write.mode("append").parquet(f"{base}/landed")
        stream = incremental.landed_stream(spark, f"{base}/landed", T.StructType.fromDDL(schema))
        new = incremental.new_within(stream, FORGET, "landed_at")
        incremental.append_batches(new, f"{base}/new", f"{base}/checkpoint").awaitTermination()
    days = F.datediff(F.col("landed_at").cast("date"), F.lit(RUN_TS.date())).cast("bigint")
    return spark.read.parquet(f"{base}/new").groupBy(days.alias("day"), "url").agg(F.count("*").alias("n"))


def _land(spark, parts, run):
    """Land rows of ``schemas.LANDING`` part by part, with a stream run after each."""
    base = shared_dir(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/landed")
        stream = incremental.landed_stream(spark, f"{base}/landed", schemas.LANDING)
        run(stream, f"{base}/state", f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return f"{base}/out"


FALLBACK_RULES = flow.Rules(
    keywords=FALLBACK_KEYWORDS, exclude=("los", "las"), fragments=PAGE_FRAGMENTS, boilerplate=PAGE_BOILERPLATE
)


@query
def stream_pages(spark, sf_dir):
    """Career pages that land in three parts, a third of the companies with the rendered page first,
    a third with the static one first, a third with both at once; the postings of all batches."""
    companies = _one_page_companies(spark, sf_dir)
    catalog = settle(companies.select("company_ord", F.col("company").alias("name"), "url", F.lit("generic").alias("type")))
    pages = companies.drop("company")
    static, rendered = landings.landing(pages, landings.STATIC), landings.landing(pages, landings.RENDERED)
    third = F.col("company_ord") % 3
    parts = [
        rendered.where(third == 0).unionByName(static.where(third == 1)),
        static.where(third == 2).unionByName(rendered.where(third == 2)),
        static.where(third == 0).unionByName(rendered.where(third == 1)),
    ]

    def run(stream, state, checkpoint, out):
        def sink(postings, batch_id):
            postings.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        return landings.run_landings(stream, catalog, state, checkpoint, sink, FALLBACK_RULES)

    out = _land(spark, parts, run)
    return spark.read.parquet(out).select("company_ord", "source_type", "posting_ord", "title", "url")


@query
def stream_landings(spark, sf_dir):
    """Responses, then rendered pages, then static pages, each reported as it lands; all that was
    reported in the end."""
    catalog, payloads, pages, chosen = _everything(spark, sf_dir)
    parts = [
        landings.landing(payloads, landings.PAYLOAD), landings.landing(pages, landings.RENDERED),
        landings.landing(pages, landings.STATIC),
    ]

    def run(stream, state, checkpoint, out):
        return landings.report_landings(stream, catalog, out, state, checkpoint, chosen, run_ts=lambda batch_id: RUN_TS)

    seen = seen_store.read_seen(spark, _land(spark, parts, run))
    return seen.select("company_ord", "posting_ord", "company", "title", "url", "yoe_note")
