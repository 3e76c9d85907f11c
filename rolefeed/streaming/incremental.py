"""Incremental runs over landed files with Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rolefeed import files
from rolefeed.operators.dedup import RUN_ORDER, own_key
from rolefeed.operators.report import run_metrics, write_digest, write_metrics
from rolefeed.session import settle, settled_paths
from rolefeed.sources.seen import committed, record_new

OBSERVED = "gate"


def landed_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Files landing in a folder, as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def report_new(
    stream: DataFrame,
    seen_path: str,
    checkpoint: str,
    to_postings: Callable[[DataFrame], DataFrame] = lambda df: df,
    digest_path: str | None = None,
    order: Sequence[str] = RUN_ORDER,
    run_ts: Callable[[int], dt.datetime] | None = None,
    metrics_path: str | None = None,
    gate: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Process everything that has landed since the last call, as one run, and stop.

    Each micro-batch is a run whose ``run_id`` is the batch id: it is de-duplicated, compared with
    the seen table, recorded, and reported from the recorded rows if there are any. A batch that
    is repeated after a failure replaces its own partition. What has been seen must never expire,
    so it lives in the table and not in stream state; keep table and checkpoint together.

    ``to_postings`` turns a batch into postings. If it leaves postings that fail the experience
    gate in, marked by ``yoe_ok``, they are not reported but counted in the metrics.

    ``gate`` does the same to the stream itself, before it is cut into batches; it may use only what
    a stream can. What it lets through and drops is then observed on the way, without another
    read of the batch: see ``observed_metrics``.

    Across runs the first posting wins only if files land in run order, so call this once per
    landing, as a scheduler would.
    """

    def one_run(batch: DataFrame, batch_id: int) -> None:
        stamp = run_ts(batch_id) if run_ts else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        with settled_paths() as scratch:
            postings = to_postings(batch)
            if "yoe_ok" not in postings.columns:
                postings = postings.withColumn("yoe_ok", F.lit(True))
            if metrics_path:
                postings = settle(postings)  # read by the run and by its metrics
            new = record_new(postings.where("yoe_ok"), seen_path, batch_id, stamp, order)
            if metrics_path:
                write_metrics(run_metrics(new, postings), metrics_path, batch_id)
            if digest_path:
                write_digest(new, f"{digest_path}/run_id={batch_id}")
        for path in scratch:
            files.remove(batch.sparkSession, path)

    if gate:
        stream = gate(stream)
        stream = stream.observe(
            OBSERVED, F.count_if("yoe_ok").alias("matched"), F.count_if(~F.col("yoe_ok")).alias("dropped_for_experience"))
    return (
        stream.writeStream.foreachBatch(one_run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def observed_metrics(query: StreamingQuery, seen_path: str) -> DataFrame:
    """``run_id, new_postings, dropped_for_experience`` per micro-batch of a finished ``report_new``
    with a ``gate``, from the query's progress and the commits of the seen table. No row of either
    is read. A query keeps its last progress reports only (100, unless set otherwise)."""
    spark = SparkSession.active()
    new = {f.first_run: f.rows for f in committed(spark, seen_path)[1] if not f.merged}
    rows = []
    for report in query.recentProgress:
        seen = report.observedMetrics.get(OBSERVED)
        if seen is not None and (seen["matched"] or seen["dropped_for_experience"]):
            rows.append((report.batchId, new.get(report.batchId, 0), seen["dropped_for_experience"]))
    return spark.createDataFrame(rows, "run_id bigint, new_postings bigint, dropped_for_experience bigint")


def new_within(stream: DataFrame, delay: str, event_time: str = "captured_at", order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """Postings of a stream that no earlier one of the same url precedes, as far as the stream
    remembers: bounded state instead of a table that never forgets.

    The watermark is the latest ``event_time`` of earlier batches less ``delay``. A posting older than
    that is dropped as late. A url is forgotten once the watermark has passed the time of its report
    plus ``delay``; a posting of it is then new again. This is a different meaning from
    ``report_new``, for feeds where a url that comes back after so long counts as new. Of equal urls
    in one batch any one stays. A NULL url is never a duplicate.
    """
    keyed = stream.withColumn("_key", own_key(F.col("url"), order)).withColumn("_at", F.col(event_time).cast("timestamp"))
    return keyed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_at")


def append_batches(stream: DataFrame, path: str, checkpoint: str, batch_column: str = "batch_id") -> StreamingQuery:
    """Write what a stream gives, each micro-batch to a folder of its own that a repeat replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_column}={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
