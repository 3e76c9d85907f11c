"""Incremental runs over raw responses and pages, in whatever order they land.

A company without a known platform is judged by its static page first, and its rendered page counts
only if that had no keyword link. The two may land in different micro-batches, so what waits for its
counterpart is carried over: which static pages had links, and the cards of rendered pages whose
static page is still to come. Once both have landed, both are forgotten, so the carried state is as
large as what is outstanding, not as the history.

State is a snapshot per batch, written whole, and a batch reads its predecessor's; so a batch that
is repeated after a failure finds what it found before. Snapshots before that are removed.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolefeed import files, schemas
from rolefeed.operators.fallback import rendered_postings, static_hits, static_postings
from rolefeed.operators.filters import with_experience
from rolefeed.operators.report import write_digest
from rolefeed.plans.flow import Rules, generic_companies, platform_rows
from rolefeed.session import broadcast_if_small, settle, settled_paths
from rolefeed.sources.payloads import usable
from rolefeed.sources.seen import record_new

PAYLOAD, STATIC, RENDERED = "payload", "static", "rendered"

# A crawl of a company: its static and its rendered page belong together.
CRAWL = ("run_id", "company_ord")
_CRAWL = [T.StructField(c, T.LongType()) for c in CRAWL]
_STATUS = T.StructType([*_CRAWL, T.StructField("found", T.BooleanType())])
_CARDS = T.StructType([
    *_CRAWL, T.StructField("company", T.StringType()), T.StructField("source_type", T.StringType()),
    T.StructField("posting_ord", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("location", T.StringType()),
])


class Waiting(NamedTuple):
    """What has landed without its counterpart."""

    static: DataFrame  # crawls whose static page has landed, and whether it had a keyword link
    rendered: DataFrame  # crawls whose rendered page has landed
    cards: DataFrame  # postings of these

    @classmethod
    def read(cls, spark: SparkSession, path: str, batch_id: int) -> Waiting:
        """What a batch left; nothing if there was none. A batch follows only one that has ended, so
        what is there is whole."""
        folder = f"{path}/{batch_id}"
        if not files.exists(spark, f"{folder}/cards"):
            return cls(*(spark.createDataFrame([], s) for s in (_STATUS, T.StructType(_CRAWL), _CARDS)))
        return cls(
            spark.read.schema(_STATUS).parquet(f"{folder}/static"),
            spark.read.schema(T.StructType(_CRAWL)).parquet(f"{folder}/rendered"),
            spark.read.schema(_CARDS).parquet(f"{folder}/cards"),
        )

    def write(self, path: str, batch_id: int) -> None:
        for name, part in zip(self._fields, self):
            part.write.mode("overwrite").parquet(f"{path}/{batch_id}/{name}")


def _kinds(rows: DataFrame) -> set[str]:
    return {r.kind for r in rows.select("kind").distinct().collect()}


def _united(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def page_postings(
    pages: DataFrame, kinds: set[str], before: Waiting, chosen: Rules, keep_runs: int | None = None
) -> tuple[DataFrame, Waiting]:
    """Postings that can be told from the pages landed now and what waits, and what waits then.

    ``pages`` is (run_id, company_ord, company, kind, url, html), of the ``kinds`` given. With
    ``keep_runs``, crawls that many runs older than the latest are waited for no longer.
    """
    # What is joined here is settled, so its size is known: small tables are broadcast.
    key = list(CRAWL)
    landed, shown = (pages.where(F.col("kind") == kind) for kind in (STATIC, RENDERED))
    status, found, cards = before.static, [], before.cards
    if STATIC in kinds:
        hits = static_hits(landed.drop("kind"), chosen.keywords, CRAWL)
        linked = hits.select(*key).distinct().withColumn("found", F.lit(True))
        now = landed.select(*key).distinct().join(linked, key, "left").fillna(False, ["found"])
        status = settle(status.unionByName(now).groupBy(*key).agg(F.max("found").alias("found")))
        found.append(static_postings(hits, chosen.exclude, CRAWL))
    if RENDERED in kinds and chosen.use_rendered:
        # A page whose company is known to need none is not parsed.
        needless = status.where("found").select(*key)
        fresh = rendered_postings(
            shown.drop("kind").join(needless, key, "left_anti"),
            chosen.keywords, chosen.exclude, chosen.fragments, chosen.boilerplate, chosen.filter_rendered,
            location=chosen.location, company=CRAWL,
        )
        cards = cards.unionByName(fresh.select(*_CARDS.names))
    else:
        shown = pages.limit(0)
    cards = settle(cards)
    rendered = settle(before.rendered.unionByName(shown.select(*key)).distinct())
    found.append(cards.join(status.where("not found"), key, "left_semi"))
    after = Waiting(
        status.join(rendered, key, "left_anti"),
        rendered.join(status, key, "left_anti"),
        cards.join(status, key, "left_anti"),
    )
    if keep_runs is not None:
        latest = status.select("run_id").unionByName(rendered.select("run_id")).agg(F.max("run_id")).first()[0]
        if latest is not None:
            after = Waiting(*(part.where(F.col("run_id") > latest - keep_runs) for part in after))
    return _united(found), after


def landed_postings(
    batch: DataFrame, catalog: DataFrame, before: Waiting, chosen: Rules = Rules(), keep_runs: int | None = None
) -> tuple[DataFrame, Waiting]:
    """Postings of the wanted roles out of one batch of ``schemas.LANDING`` and what waits, with
    ``yoe_note`` and ``yoe_ok``, and what waits then. A bad record fails its company within its batch.
    """
    landed = settle(batch, partition_by="kind")
    kinds, parts, after = _kinds(landed), [], before
    if PAYLOAD in kinds:
        payloads = landed.where(F.col("kind") == PAYLOAD).select("company_ord", "source_type", "page_offset", "body")
        parts.append(usable(platform_rows(catalog, payloads, chosen), chosen.on_bad))
    if kinds & {STATIC, RENDERED}:
        generic = broadcast_if_small(generic_companies(catalog))
        pages = landed.where(F.col("kind").isin(STATIC, RENDERED)).join(generic, "company_ord").select(
            *CRAWL, "company", "kind", "url", F.col("body").alias("html")
        )
        found, after = page_postings(pages, kinds, before, chosen, keep_runs)
        parts.append(found.drop("run_id"))
    both = _united(parts) if parts else batch.sparkSession.createDataFrame([], schemas.POSTING).drop("run_id", "captured_at", "context_text")
    return with_experience(both, chosen.max_years, chosen.strict_zero).drop("description"), after


def run_landings(
    stream: DataFrame,
    catalog: DataFrame,
    state_path: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None],
    chosen: Rules = Rules(),
    keep_runs: int | None = None,
) -> StreamingQuery:
    """Process all that has landed since the last call, a stream of ``schemas.LANDING``, and stop.

    ``sink`` gets the postings of each micro-batch and its number; it must replace what it wrote for
    that number before. Keep ``state_path`` and ``checkpoint`` together.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with settled_paths() as scratch:
            postings, after = landed_postings(
                batch, catalog, Waiting.read(spark, state_path, batch_id - 1), chosen, keep_runs)
            sink(postings, batch_id)
            after.write(state_path, batch_id)
        files.remove(spark, f"{state_path}/{batch_id - 2}")
        for path in scratch:
            files.remove(spark, path)

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def report_landings(
    stream: DataFrame,
    catalog: DataFrame,
    seen_path: str,
    state_path: str,
    checkpoint: str,
    chosen: Rules = Rules(),
    digest_path: str | None = None,
    run_ts: Callable[[int], dt.datetime] | None = None,
    keep_runs: int | None = None,
) -> StreamingQuery:
    """``run_landings`` that reports what is new: each micro-batch is a run of the seen table."""
    def sink(postings: DataFrame, batch_id: int) -> None:
        stamp = run_ts(batch_id) if run_ts else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        new = record_new(postings.where("yoe_ok"), seen_path, batch_id, stamp)
        if digest_path:
            write_digest(new, f"{digest_path}/run_id={batch_id}")

    return run_landings(stream, catalog, state_path, checkpoint, sink, chosen, keep_runs)


def landing(rows: DataFrame, kind: str, run_id: int = 0) -> DataFrame:
    """Pages or payloads as rows of ``schemas.LANDING``."""
    named = rows.withColumnRenamed("html", "body") if "html" in rows.columns else rows
    for name, kind_of in (("source_type", "string"), ("page_offset", "bigint"), ("url", "string")):
        if name not in named.columns:
            named = named.withColumn(name, F.lit(None).cast(kind_of))
    return named.withColumn("kind", F.lit(kind)).withColumn("run_id", F.lit(run_id).cast("bigint")).select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.LANDING]
    )
