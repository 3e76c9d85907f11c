"""URL parsing and platform detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefeed import rules
from rolefeed.functions.choice import first_match
from rolefeed.functions.text import falsy_to_null

# Fixed value: tenant, data-centre host and site of a Workday board, with an optional path
# segment (usually a locale) before the site. Found anywhere in the URL, in any letter case.
WORKDAY_BOARD = (
    r"https?://([\w-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[\w-]+/)?([\w-]+)"
)


def url_slug(url: Column) -> Column:
    """Last path segment, ignoring trailing slashes. A query string stays part of it."""
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def workday_board(url: Column) -> tuple[Column, Column, Column]:
    """(tenant, host, site) of a Workday board URL; all NULL when the URL does not match."""
    pattern = "(?iU)" + WORKDAY_BOARD
    tenant, host, site = (falsy_to_null(F.regexp_extract(url, pattern, i)) for i in (1, 2, 3))
    return tenant, host, site


Fragments = Sequence[tuple[str, str]]


def detect_platform(url: Column, more: Fragments = ()) -> Column:
    """Platform named by the first known fragment in the URL (case-sensitive), else generic. ``more``
    fragments and names are tried first."""
    known = ((url.contains(f), F.lit(name)) for f, name in (*more, *rules.PLATFORM_BY_URL_FRAGMENT))
    return first_match(known, F.lit(rules.GENERIC))


def resolve_type(explicit: Column, url: Column, more: Fragments = ()) -> Column:
    """The catalog's own type when it has one, even a wrong one; else the detected platform."""
    return F.coalesce(falsy_to_null(explicit), detect_platform(url, more))


def route(resolved: Column, more: Fragments = ()) -> Column:
    """Platforms without a payload normaliser, unknown names included, go the generic way."""
    known = [platform for _, platform in (*more, *rules.PLATFORM_BY_URL_FRAGMENT)]
    return F.when(resolved.isin(known), resolved).otherwise(F.lit(rules.GENERIC))


def host_path(host: Column, path: Column, fallback: Column) -> Column:
    """``host`` + ``path``, or ``fallback`` when the path is missing or empty."""
    return F.when(falsy_to_null(path).isNull(), fallback).otherwise(F.concat(host, path))
