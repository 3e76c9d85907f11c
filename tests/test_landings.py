"""Streams over raw responses and pages, bounded memory, and metrics on the way."""

import datetime as dt
import json

from pyspark.sql.types import StructType

from rolefeed import files, schemas
from rolefeed.operators.filters import role_filter, with_experience
from rolefeed.plans.flow import Rules, run
from rolefeed.session import shared_dir
from rolefeed.sources.seen import read_seen
from rolefeed.streaming import incremental, landings

NOW = dt.datetime(2025, 1, 1)
CATALOG = [(i, f"C{i}", f"https://c{i}.example.com/", "generic") for i in range(6)] + [(9, "P", "https://boards.greenhouse.io/p", None)]
HIT, NONE = '<a href="/swe/{0}">x{0}</a>', "<p>nothing</p>"
SHOWN = '<a href="/jobs/{0}">Role number {0}</a><a href="/jobs/x{0}">Senior role</a>'


def landing(kind, company, body, run_id=0, source_type=None):
    return (run_id, company, kind, source_type, 0 if source_type else None, f"https://c{company}.example.com/", body)


# Company 0 has hits, 1 has none, 2 has hits that are too senior, 3 no rendered page, 4 no static one.
PAGES = [
    landing("static", 0, HIT.format(0)), landing("rendered", 0, SHOWN.format(0)),
    landing("static", 1, NONE), landing("rendered", 1, SHOWN.format(1)),
    landing("static", 2, '<a href="/swe/2">Senior SWE</a>'), landing("rendered", 2, SHOWN.format(2)),
    landing("static", 3, HIT.format(3)), landing("rendered", 4, SHOWN.format(4)),
]
PAYLOAD = landing("payload", 9, json.dumps({"jobs": [{"title": "SWE", "absolute_url": "https://p/1", "content": "1 yr experience"}]}),
                  source_type="greenhouse")
REPORTED = {(0, "x0"), (1, "Role number 1"), (3, "x3"), (9, "SWE")}


def replay(spark, batches, **options):
    base = shared_dir(spark)
    catalog = spark.createDataFrame(CATALOG, schemas.CATALOG)
    for rows in batches:
        spark.createDataFrame(rows, schemas.LANDING).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = incremental.landed_stream(spark, f"{base}/in", schemas.LANDING)
        landings.report_landings(
            stream, catalog, f"{base}/seen", f"{base}/state", f"{base}/cp", run_ts=lambda b: NOW, **options).awaitTermination()
    return base, {(r.company_ord, r.title) for r in read_seen(spark, f"{base}/seen").collect()}


def test_any_order_of_landing(spark):
    # Static pages first; both kinds in two parts that cross.
    for batches in ([PAGES[::2], [PAYLOAD], PAGES[1::2]],
                    [[PAGES[1], PAGES[2], PAGES[5], PAGES[6]], [PAGES[0], PAGES[3], PAGES[4], PAGES[7], PAYLOAD]]):
        base, found = replay(spark, batches)
        assert found == REPORTED, batches
    # Only what is outstanding is carried over, and only the last two snapshots are kept.
    state = landings.Waiting.read(spark, f"{base}/state", 1)
    assert [r.company_ord for r in state.static.collect()] == [3] and [r.company_ord for r in state.rendered.collect()] == [4]
    assert {r.company_ord for r in state.cards.collect()} == {4} and files.child_names(spark, f"{base}/state") == ["0", "1"]


def test_a_whole_run_agrees(spark):
    pages = [spark.createDataFrame([(c, u, b) for _, c, k, _, _, u, b in PAGES if k == kind], schemas.PAGE) for kind in ("static", "rendered")]
    payload = spark.createDataFrame([(9, "greenhouse", 0, PAYLOAD[-1])], schemas.PAYLOAD)
    outcome = run(spark.createDataFrame(CATALOG, schemas.CATALOG), payload, *pages, shared_dir(spark), 0, NOW)
    # A batch run has no pages to wait for: company 4 is reported at once.
    assert {(r.company_ord, r.title) for r in outcome.new.collect()} == REPORTED | {(4, "Role number 4")}
    assert outcome.scratch and all(files.exists(spark, p) for p in outcome.scratch)
    outcome.close()
    assert not any(files.exists(spark, p) for p in outcome.scratch) and outcome.new.count() == 5


def test_crawls_are_kept_apart_and_forgotten(spark):
    later = [landing(k, c, b, 5) for _, c, k, _, _, _, b in PAGES if c == 1 and k == "static"]
    base, found = replay(spark, [[PAGES[3]], later], keep_runs=3)
    # The rendered page of crawl 0 does not go with the static page of crawl 5, and is given up.
    assert found == set()
    state = landings.Waiting.read(spark, f"{base}/state", 1)
    assert [tuple(r) for r in state.static.collect()] == [(5, 1, False)] and state.cards.count() == state.rendered.count() == 0


def test_a_repeated_batch_finds_the_same(spark):
    catalog, chosen = spark.createDataFrame(CATALOG, schemas.CATALOG), Rules()
    state = shared_dir(spark)
    first, second = (spark.createDataFrame(rows, schemas.LANDING) for rows in (PAGES[1::2], PAGES[::2]))
    landings.landed_postings(first, catalog, landings.Waiting.read(spark, state, -1), chosen)[1].write(state, 0)
    results = []
    for _ in range(2):
        postings, after = landings.landed_postings(second, catalog, landings.Waiting.read(spark, state, 0), chosen)
        results.append(sorted((r.company_ord, r.title) for r in postings.collect()))
        after.write(state, 1)
    assert results[0] == results[1] == sorted(REPORTED - {(9, "SWE")})


def test_metrics_are_observed_on_the_way(spark):
    base, reads = shared_dir(spark), []
    schema = "run_id bigint, company_ord bigint, posting_ord bigint, company string, title string, url string, description string"

    def gate(stream):
        return with_experience(role_filter(stream))

    for run_id, texts in enumerate(([None, "9 yrs experience", "1 yr experience"], ["5 yrs experience", None], ["x"])):
        rows = [(run_id, 0, 10 * run_id + i, "C", "SWE", f"u{i}", t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        stream = incremental.landed_stream(spark, f"{base}/in", StructType.fromDDL(schema))
        query = incremental.report_new(stream, f"{base}/seen", f"{base}/cp", gate=gate)
        query.awaitTermination()
        reads += [p.numInputRows for p in query.recentProgress if p.numInputRows]
        metrics = [tuple(r) for r in incremental.observed_metrics(query, f"{base}/seen").collect()]
        assert metrics == [[(0, 2, 1)], [(1, 1, 1)], [(2, 0, 0)]][run_id], metrics
    # Each row of a batch was read once.
    assert reads == [3, 2, 1]


def test_bounded_memory(spark):
    base, schema = shared_dir(spark), "company_ord bigint, posting_ord bigint, url string, captured_at timestamp_ntz"
    for day, urls in ((0, ["a", "b", None, None]), (1, ["a", "c", None]), (9, ["a"]), (20, ["b"]), (40, ["a", "c", "a"])):
        at = NOW + dt.timedelta(days=day)
        spark.createDataFrame([(0, 10 * day + i, u, at) for i, u in enumerate(urls)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        new = incremental.new_within(incremental.landed_stream(spark, f"{base}/in", StructType.fromDDL(schema)), "5 days")
        incremental.append_batches(new, f"{base}/out", f"{base}/cp").awaitTermination()
    got = sorted(((r.captured_at - NOW).days, str(r.url)) for r in spark.read.parquet(f"{base}/out").collect())
    # Day 9: the watermark is -4, so "a" of day 0 is known. Day 20: it is 4, "b" of day 0 is known until 5.
    # Day 40: it is 15, all are forgotten but "b" of day 20, had it been reported then.
    assert got == [(0, "None"), (0, "None"), (0, "a"), (0, "b"), (1, "None"), (1, "c"), (40, "a"), (40, "c")]
