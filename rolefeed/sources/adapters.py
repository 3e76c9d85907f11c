"""Platforms of a user's own, given to a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefeed.functions.text import clean_text, html_to_text
from rolefeed.sources.payloads import MISSING, WRONG_TYPE, Platform

FAILED = "adapter failed"
FETCHED = (
    "company_ord bigint, company string, source_type string, posting_ord bigint, bad string, title string, url string, "
    "description string"
)


@dataclass(frozen=True)
class Adapter:
    """A platform by name. Companies go to it by their catalog type, or by ``fragment`` in their
    address, which is tried before the library's own fragments.

    Its postings come from landed responses of that ``source_type``, which ``layout`` describes, or
    from ``fetch(company, url)``, which is called on the executors, once per company, and returns
    mappings with ``title`` and ``url`` and, if it has them, ``description`` (HTML or text).
    """

    name: str
    fragment: str
    layout: Platform | None = None
    fetch: Callable[[str, str], Iterable[Mapping]] | None = None


def layouts(adapters: Iterable[Adapter]) -> dict[str, Platform]:
    return {a.name: a.layout for a in adapters if a.layout}


def _rows(fetch: Callable, company: str, url: str):
    """Ordinal, problem, title, url and description of each posting. Whatever ``fetch`` raises
    becomes a problem of the company."""
    try:
        for place, posting in enumerate(fetch(company, url)):
            problem = None
            for name in ("title", "url"):
                if name not in posting:
                    problem = problem or f"{MISSING}: {name}"
            for name in ("title", "description"):
                value = posting.get(name)
                if not isinstance(value, str) and (name == "title" or value is not None):
                    problem = problem or f"{WRONG_TYPE}: {name}"
            values = (posting.get(name) for name in ("title", "url", "description"))
            yield (place, problem, *(v if v is None or isinstance(v, str) else str(v) for v in values))
    except Exception as error:  # the code of a user: whatever it raises concerns one company
        yield None, f"{FAILED}: {type(error).__name__}", None, None, None


def fetched(companies: DataFrame, adapter: Adapter) -> DataFrame:
    """Postings that an adapter fetches for the companies of a routed catalog that go to it, in the
    form of ``normalise``."""
    fetch, name = adapter.fetch, adapter.name

    def run(batches):
        for batch in batches:
            for ord_, company, url in zip(*(batch.column(c).to_pylist() for c in ("company_ord", "name", "url"))):
                rows = [*_rows(fetch, company, url)]
                if rows:
                    place, problem, title, link, text = zip(*rows)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ord_] * n, pa.int64()), pa.array([company] * n, pa.string()), pa.array([name] * n, pa.string()),
                         pa.array(place, pa.int64()), *(pa.array(v, pa.string()) for v in (problem, title, link, text))],
                        names=["company_ord", "company", "source_type", "posting_ord", "bad", "title", "url", "description"])

    own = companies.where(F.col("source_type") == adapter.name).select("company_ord", "name", "url")
    rows = own.mapInArrow(run, FETCHED)
    return rows.withColumn("title", F.coalesce(clean_text(F.col("title")), F.lit(""))).withColumn(
        "description", F.when(F.col("description").isNotNull(), html_to_text(F.col("description")))
    )
