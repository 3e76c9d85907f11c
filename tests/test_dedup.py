"""First-wins de-duplication against a plain loop, on skewed keys."""

import datetime as dt
import random

import pytest

from rolefeed.operators import dedup
from rolefeed.sources.seen import read_seen, record_new
from rolefeed.session import shared_dir

SCHEMA = "run_id long, company_ord long, posting_ord long, company string, title string, url string, captured_at timestamp_ntz"
NOW = dt.datetime(2025, 1, 1)


def history(n=3000, seed=3):
    """A third of the postings share one url and a third have none."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        url = "hot" if kind < 0.33 else None if kind < 0.66 else f"u{rng.randrange(200)}"
        rows.append((rng.randrange(6), rng.randrange(4), i, f"c{i % 4}", f"t{i}", url, NOW + dt.timedelta(seconds=i)))
    rng.shuffle(rows)
    return rows


def loop(rows, seen=()):
    """Rows that are new, one after the other."""
    seen, new = set(seen), []
    for row in sorted(rows, key=lambda r: r[:3]):
        if row[5] is None or row[5] not in seen:
            new.append(row)
            seen.add(row[5])
    return sorted(new, key=lambda r: r[2])


def rows_of(df):
    return sorted((tuple(r) for r in df.select("run_id", "company_ord", "posting_ord", "company", "title", "url", "captured_at").collect()),
                  key=lambda r: r[2])


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_new_per_run_is_the_loop(spark, partitions):
    df = spark.createDataFrame(history(), SCHEMA).repartition(partitions)
    assert rows_of(dedup.new_per_run(df)) == loop(history())


def test_only_the_first_row_of_a_hot_key_is_shuffled(spark):
    plan = dedup.first_per_url(spark.createDataFrame(history(), SCHEMA))._jdf.queryExecution().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit"):]


def test_new_postings_is_the_loop(spark):
    rows = history()
    old, incoming = [r for r in rows if r[0] < 3], [r for r in rows if r[0] >= 3]
    seen = {r[5] for r in old} - {None}
    df = dedup.new_postings(
        spark.createDataFrame(incoming, SCHEMA), spark.createDataFrame([(u,) for u in seen], "url string"), dedup.HISTORY_ORDER)
    assert rows_of(df) == loop(incoming, seen)


def test_first_seen(spark):
    got = {(r.url, r.title, r.run_id, r.first_seen) for r in dedup.first_seen(spark.createDataFrame(history(), SCHEMA)).collect()}
    assert got == {(r[5], r[4], r[0], r[6]) for r in loop(history())}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_runs_one_after_the_other(spark, limit):
    """The same postings, whether the run's addresses are broadcast or joined; repeats change nothing."""
    path, rows = shared_dir(spark), history(900)
    for run in (0, 1, 2, 2, 3, 1, 4, 5):
        part = spark.createDataFrame([r for r in rows if r[0] == run], SCHEMA)
        new = record_new(part, path, run, NOW, limit=limit)
        assert {r.run_id for r in new.select("run_id").distinct().collect()} <= {run}
    seen = read_seen(spark, path)
    assert sorted(r.posting_ord for r in seen.collect()) == [r[2] for r in loop(rows)]
    assert seen.select("first_seen").distinct().first()[0] == NOW


def test_nothing_seen_yet(spark):
    assert read_seen(spark, shared_dir(spark)).count() == 0
