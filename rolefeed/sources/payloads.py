"""Landed platform responses -> postings.

A payload row is one JSON response. ``from_json`` gets a schema with only the fields that are
read; each is VARIANT, which keeps a missing field, a null and a value of the wrong type apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefeed.functions.text import clean_text, falsy_to_null, html_to_text
from rolefeed.functions.urls import host_path, url_slug, workday_board
from rolefeed.session import broadcast_if_small, settle

NOT_JSON, MISSING, WRONG_TYPE = "unreadable body", "missing field", "unusable value"

_JSON = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}


@dataclass(frozen=True)
class Field:
    """A field that is read from a record, and what makes its value unusable."""

    name: str
    required: bool = False  # must be present
    text: bool = True  # must be a string, when present and not null
    nullable: bool = True  # may be null
    optional: bool = False  # an empty value of any type counts as missing
    unless: str | None = None  # not read where this field has a value


@dataclass(frozen=True)
class Platform:
    """How one platform's response is laid out.

    ``items`` names the list of records; None means that the response is the list.
    """

    items: str | None
    fields: tuple[Field, ...]
    title: Callable[[], Column]
    url: Callable[[], Column]
    description: Callable[[], Column]


def value_of(name: str) -> Column:
    """The value of a field of a layout."""
    return F.col(f"f_{name}")


_value = value_of


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _workday_url() -> Column:
    tenant, host, _ = workday_board(F.col("catalog_url"))
    site = F.concat(F.lit("https://"), tenant, F.lit("."), host, F.lit(".myworkdayjobs.com"))
    return host_path(site, _value("externalPath"), F.col("catalog_url"))


# The registry of normalisers. Field names and address prefixes are fixed values.
PLATFORMS = {
    "greenhouse": Platform(
        items="jobs",
        fields=(
            Field("title", required=True, nullable=False),
            Field("absolute_url", required=True, text=False),
            Field("content", optional=True),
        ),
        title=lambda: _value("title"),
        url=lambda: _value("absolute_url"),
        description=lambda: html_to_text(_value("content")),
    ),
    "lever": Platform(
        items=None,
        fields=(
            Field("text", required=True, nullable=False),
            Field("hostedUrl", required=True, text=False),
            Field("descriptionPlain", optional=True),
            Field("description", optional=True, unless="descriptionPlain"),
        ),
        title=lambda: _value("text"),
        url=lambda: _value("hostedUrl"),
        description=lambda: F.coalesce(
            clean_text(falsy_to_null(_value("descriptionPlain"))),
            # Parsed only where there is no plain text.
            html_to_text(F.when(falsy_to_null(_value("descriptionPlain")).isNull(), _value("description"))),
        ),
    ),
    "smartrecruiters": Platform(
        items="content",
        fields=(
            Field("id", required=True, text=False),
            Field("name", required=True, nullable=False),
        ),
        title=lambda: _value("name"),
        url=lambda: F.concat(
            F.lit("https://jobs.smartrecruiters.com/"), url_slug(F.col("catalog_url")), F.lit("/"),
            F.coalesce(_value("id"), F.lit("None")),
        ),
        description=_no_text,
    ),
    "ashby": Platform(
        items="jobs",
        fields=(
            Field("title", required=True, nullable=False),
            Field("jobUrl", text=False, optional=True),
            Field("applyUrl", text=False),
            Field("descriptionHtml", optional=True),
        ),
        title=lambda: _value("title"),
        url=lambda: F.coalesce(falsy_to_null(_value("jobUrl")), _value("applyUrl")),
        description=lambda: F.when(
            falsy_to_null(_value("descriptionHtml")).isNotNull(), html_to_text(_value("descriptionHtml"))
        ),
    ),
    "workday": Platform(
        items="jobPostings",
        fields=(Field("title", nullable=False), Field("externalPath", text=False, optional=True)),
        title=lambda: _value("title"),
        url=_workday_url,
        description=_no_text,
    ),
    "amazon": Platform(
        items="jobs",
        fields=(
            Field("title", nullable=False),
            Field("job_path", text=False, optional=True),
            Field("description_short", optional=True),
        ),
        title=lambda: _value("title"),
        url=lambda: host_path(
            F.lit("https://www.amazon.jobs"), _value("job_path"), F.col("catalog_url")
        ),
        description=lambda: clean_text(falsy_to_null(_value("description_short"))),
    ),
}


# How values that count as empty are written.
_EMPTY = ("null", "false", "0", "-0", "0.0", "-0.0", "[]", "{}")


def _is_empty(raw: Column) -> Column:
    """Whether a value is null, false, zero, or a string, list or object without content. NULL if it
    is missing."""
    text = F.try_variant_get(raw, "$", "string")
    return F.when(F.schema_of_variant(raw) == "STRING", text == "").otherwise(F.to_json(raw).isin(*_EMPTY))


def _float_text(number: Column) -> Column:
    """A double in its shortest form, with an exponent only beyond 16 digits or below 0.0001."""
    java = number.cast("string")
    mantissa, power = F.regexp_extract(java, "^(.*)E", 1), F.regexp_extract(java, "E(.*)$", 1).try_cast("int")
    plain = F.rtrim(java.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.concat(plain, F.when(plain.endswith("."), "0").otherwise(""))
    sign = F.when(power < 0, "-").otherwise("+")
    short = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(power.isNull(), java).when(power.between(-4, 15), plain).otherwise(
        F.when(F.abs(power) > 99, F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, F.abs(power).cast("string"))).otherwise(short)
    )


def _written(raw: Column) -> Column:
    """A value as it is written inside an address: booleans with a capital letter, numbers with a
    point or an exponent as the shortest decimal that has a point."""
    kind, text = F.schema_of_variant(raw), F.try_variant_get(raw, "$", "string")
    # Whole numbers beyond BIGINT are decimals too.
    fraction = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & ~kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    return (
        F.when(kind == "BOOLEAN", F.initcap(text))
        .when(fraction, _float_text(F.try_variant_get(raw, "$", "double")))
        .otherwise(text)
    )


def _field_value(f: Field) -> Column:
    raw = F.col(f"r.{f.name}")
    if not f.text:
        return F.when(~_is_empty(raw), _written(raw)) if f.optional else _written(raw)
    # A text that is no string is unusable or empty; an empty string is told by who reads it.
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))


def records(payloads: DataFrame, source_type: str, layout: Platform | None = None) -> DataFrame:
    """One row per record of one platform's responses: the payload columns, ``posting_ord``,
    ``bad`` (why the record cannot be used, else NULL) and one ``f_<name>`` per field.

    An unreadable response gives one bad row without a ``posting_ord``. ``payloads`` carries
    ``catalog_url`` (see ``with_catalog``).
    """
    layout = layout or PLATFORMS[source_type]
    fields = ", ".join(f"{f.name} variant" for f in layout.fields)
    records_type = f"array<struct<{fields}>>"
    response_type = f"struct<{layout.items} {records_type}>" if layout.items else records_type
    # As the one element of a list, a response followed by anything else is unreadable.
    wrapped = F.concat(F.lit('{"responses":['), "body", F.lit("]}"))
    parsed = F.from_json(wrapped, f"responses array<{response_type}>, _corrupt string", _JSON)
    only = F.get("p.responses", F.lit(0))
    unreadable = F.col("p._corrupt").isNotNull() | only.isNull() | (F.size("p.responses") != 1)
    items = only[layout.items] if layout.items else only
    listed = F.when(unreadable, F.array(F.lit(None))).otherwise(items)
    carried = [c for c in payloads.columns if c != "body"]
    exploded = (
        payloads.where(F.col("source_type") == source_type)
        .select(*carried, parsed.alias("p"))
        .select(*carried, unreadable.alias("unreadable"), listed.alias("listed"))
        # The outer form keeps Spark from parsing the body in an inferred filter too.
        .select(*carried, "unreadable", F.posexplode_outer("listed").alias("pos", "r"))
        .where("pos is not null")
    )
    problem = F.when(F.col("unreadable"), NOT_JSON).when(F.col("r").isNull(), WRONG_TYPE)
    for f in layout.fields:
        raw = F.col(f"r.{f.name}")
        null = F.is_variant_null(raw)
        if f.required:
            problem = problem.when(raw.isNull(), f"{MISSING}: {f.name}")
        if not f.nullable:
            problem = problem.when(null, f"{WRONG_TYPE}: {f.name}")
        if f.text:
            wrong = raw.isNotNull() & ~null & (F.schema_of_variant(raw) != "STRING")
            if f.optional:
                wrong = wrong & ~_is_empty(raw)
            if f.unless:
                wrong = wrong & F.coalesce(_is_empty(F.col(f"r.{f.unless}")), F.lit(True))
            problem = problem.when(wrong, f"{WRONG_TYPE}: {f.name}")
    values = [_field_value(f).alias(f"f_{f.name}") for f in layout.fields]
    position = (F.col("page_offset") + F.col("pos")).cast("bigint")
    return exploded.select(
        *carried, F.when(~F.col("unreadable"), position).alias("posting_ord"),
        problem.alias("bad"), *values,
    )


def normalise(payloads: DataFrame, source_type: str, layout: Platform | None = None) -> DataFrame:
    """Postings of one platform: the payload columns, ``posting_ord``, ``bad``, ``title``, ``url``
    and ``description``. A Workday company whose catalog address does not parse gives none."""
    layout = layout or PLATFORMS[source_type]
    rows = records(payloads, source_type, layout)
    if source_type == "workday":
        rows = rows.where(workday_board(F.col("catalog_url"))[0].isNotNull())
    made = [c for c in rows.columns if not c.startswith("f_")]
    return rows.select(
        *made,
        # A title with a default may be missing without being bad.
        F.coalesce(clean_text(layout.title()), F.lit("")).alias("title"),
        layout.url().alias("url"),
        layout.description().alias("description"),
    ).drop("page_offset", "catalog_url")


def reported_totals(payloads: DataFrame) -> DataFrame:
    """Per company, the number of postings its platform reports, as read from the last page of a
    paged listing; 0 when it does not say. Feeds the fetch plan for the remaining pages."""
    said = F.from_json("body", "total bigint, hits bigint")
    total = F.when(F.col("source_type") == "workday", said["total"]).otherwise(said["hits"])
    return (
        payloads.where(F.col("source_type").isin("workday", "amazon"))
        .select("company_ord", "page_offset", F.coalesce(total, F.lit(0)).alias("total"))
        .groupBy("company_ord").agg(F.max_by("total", "page_offset").alias("total"))
    )


def with_catalog(payloads: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach company name, route and ``catalog_url`` of a routed catalog. Responses of another
    platform than the company's route are left out."""
    companies = catalog.select(
        "company_ord", "source_type", F.col("name").alias("company"), F.col("url").alias("catalog_url")
    )
    return payloads.join(companies, ["company_ord", "source_type"])


def normalise_all(payloads: DataFrame, more: Mapping[str, Platform] | None = None) -> DataFrame:
    """Postings of every platform, and of ``more`` layouts by name, which come before the library's
    own of that name. Landed responses are partitioned by ``source_type``, so each branch scans only
    its own."""
    layouts = {**PLATFORMS, **(more or {})}
    first, *rest = (normalise(payloads, name, layout) for name, layout in layouts.items())
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def quarantined(rows: DataFrame) -> DataFrame:
    """Records that could not be used, and why."""
    return rows.where("bad is not null")


def usable(rows: DataFrame, on_bad: str = "company") -> DataFrame:
    """Postings without failures. One bad record fails its whole company; with
    ``on_bad="row"`` only itself. Both parts read ``rows``, so give it settled rows."""
    good = rows.where("bad is null").drop("bad")
    if on_bad == "row":
        return good
    if on_bad != "company":
        raise ValueError(f"on_bad must be 'company' or 'row', not {on_bad!r}")
    failed = settle(quarantined(rows).select("company_ord").distinct())
    return good.join(broadcast_if_small(failed), "company_ord", "left_anti")
