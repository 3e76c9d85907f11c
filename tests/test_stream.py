"""Incremental runs."""

import datetime as dt

from rolefeed import schemas
from rolefeed.operators import dedup
from rolefeed.session import shared_dir
from rolefeed.sources.seen import read_seen
from rolefeed.streaming.incremental import landed_stream, report_new

NOW = dt.datetime(2025, 1, 1)


def posting(run, company, ordinal, url):
    return (run, NOW, company, ordinal, f"c{company}", "greenhouse", f"t{ordinal}", url, None, None, None)


RUNS = [
    [posting(0, 1, 1, "a"), posting(0, 0, 2, "a"), posting(0, 0, 3, None)],
    [posting(1, 0, 4, "a"), posting(1, 0, 5, "b"), posting(1, 0, 6, None)],
    [posting(2, 0, 7, "a"), posting(2, 0, 8, "b")],
]


def test_each_landing_is_one_run(spark, tmp_path):
    base, digest = shared_dir(spark), str(tmp_path / "digest")
    for rows in RUNS:
        spark.createDataFrame(rows, schemas.POSTING).write.mode("append").parquet(f"{base}/in")
        stream = landed_stream(spark, f"{base}/in", schemas.POSTING)
        report_new(stream, f"{base}/seen", f"{base}/cp", digest_path=digest, run_ts=lambda b: NOW).awaitTermination()
    # A call with nothing new to process is no run.
    report_new(landed_stream(spark, f"{base}/in", schemas.POSTING), f"{base}/seen", f"{base}/cp").awaitTermination()
    got = sorted((r.run_id, r.posting_ord) for r in read_seen(spark, f"{base}/seen").collect())
    assert got == [(0, 2), (0, 3), (1, 5), (1, 6)]
    whole = dedup.new_per_run(spark.createDataFrame([r for rows in RUNS for r in rows], schemas.POSTING))
    assert got == sorted((r.run_id, r.posting_ord) for r in whole.collect())
    # The third run had nothing to report.
    assert sorted(p.name for p in (tmp_path / "digest").iterdir()) == ["run_id=0", "run_id=1"]


def test_metrics_count_what_was_dropped(spark):
    from rolefeed.operators.filters import with_experience

    base = shared_dir(spark)
    rows = [posting(0, 0, i, f"u{i}")[:8] + (text, None, None) for i, text in enumerate(["9 yrs experience", None, "1 yr experience"])]
    spark.createDataFrame(rows, schemas.POSTING).write.parquet(f"{base}/in")
    report_new(
        landed_stream(spark, f"{base}/in", schemas.POSTING), f"{base}/seen", f"{base}/cp", with_experience,
        metrics_path=f"{base}/metrics",
    ).awaitTermination()
    (metrics,) = spark.read.parquet(f"{base}/metrics").collect()
    assert (metrics.run_id, metrics.new_postings, metrics.dropped_for_experience) == (0, 2, 1)
    notes = {r.posting_ord: r.yoe_note for r in read_seen(spark, f"{base}/seen").collect()}
    assert notes == {1: "YOE not stated", 2: "~1+ yrs stated"}


def test_raw_payloads(spark):
    """A stream of responses, normalised inside the batch."""
    from rolefeed.sources.payloads import normalise_all, usable, with_catalog

    base = shared_dir(spark)
    catalog = spark.createDataFrame([(0, "lever", "Acme", "u")], "company_ord long, source_type string, name string, url string")
    body = '[{"text":"Dev","hostedUrl":"https://l/1"},{"text":"Ops","hostedUrl":null}]'
    spark.createDataFrame([(0, "lever", 0, body)], schemas.PAYLOAD).write.json(f"{base}/in")
    stream = landed_stream(spark, f"{base}/in", schemas.PAYLOAD, "json")
    report_new(
        stream, f"{base}/seen", f"{base}/cp", lambda batch: usable(normalise_all(with_catalog(batch, catalog)))
    ).awaitTermination()
    assert sorted(r.title for r in read_seen(spark, f"{base}/seen").collect()) == ["Dev", "Ops"]
