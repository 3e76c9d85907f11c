"""The seen table: commits, merges, and what a run reads of it."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rolefeed import files
from rolefeed.session import shared_dir
from rolefeed.sources import seen

NOW = dt.datetime(2025, 1, 1)
POSTING = "company_ord long, posting_ord long, company string, title string, url string, yoe_note string"


def postings(spark, urls, start=0):
    return spark.createDataFrame([(0, start + i, "C", "t", u, None) for i, u in enumerate(urls)], POSTING)


def table(spark, path):
    return sorted(((r.run_id, r.url) for r in seen.read_seen(spark, path).collect()), key=str)


def test_a_run_that_fails_changes_nothing(spark):
    path = shared_dir(spark)
    seen.record_new(postings(spark, ["a", "b"]), path, 1, NOW)
    seen.record_new(postings(spark, ["c", None]), path, 2, NOW)
    before = table(spark, path)
    broken = postings(spark, ["x", "y", "z"]).withColumn(
        "title", F.when(F.col("url") == "z", F.raise_error(F.lit("lost")).cast("string")).otherwise("t"))
    for run_id in (2, 3):
        with pytest.raises(PySparkException):
            seen.record_new(broken, path, run_id, NOW)
        assert table(spark, path) == before
    # What it left is no part of the table, also when the run is repeated with less.
    seen.record_new(postings(spark, ["d"]), path, 2, NOW)
    assert table(spark, path) == [(1, "a"), (1, "b"), (2, "d")]


def test_rows_are_replaced_in_one_step(spark):
    """Between the old rows of a run and the new ones there is no moment with neither."""
    path = shared_dir(spark)
    seen.record_new(postings(spark, ["a"]), path, 1, NOW)
    reader = seen.read_seen(spark, path)
    version, folders = seen.committed(spark, path)
    seen.record_new(postings(spark, ["b"]), path, 1, NOW)
    assert [r.url for r in reader.collect()] == ["a"] and table(spark, path) == [(1, "b")]
    # A commit that another writer has made meanwhile is not overwritten.
    with pytest.raises(FileExistsError):
        seen.commit(spark, path, version + 1, folders)
    assert table(spark, path) == [(1, "b")]


def test_merged_runs_can_be_repeated(spark):
    path = shared_dir(spark)
    for run_id in range(6):
        seen.record_new(postings(spark, [f"u{run_id}", "all", None], 10 * run_id), path, run_id, NOW, merge_after=2)
    assert len(seen.committed(spark, path)[1]) <= 3
    expected = [(0, "all"), *((i, f"u{i}") for i in range(6)), *((i, None) for i in range(6))]
    assert table(spark, path) == sorted(expected, key=str)
    # An older run, merged by now, without its own url, then as it was; and one with nothing.
    seen.record_new(postings(spark, [None]), path, 3, NOW, merge_after=99)
    assert (3, "u3") not in table(spark, path) and seen.read_run(spark, path, 3).count() == 1
    seen.record_new(postings(spark, ["u3", "all", None]), path, 3, NOW, merge_after=99)
    seen.record_new(postings(spark, []), path, 5, NOW, merge_after=99)
    kept = [r for r in expected if r[0] != 5]
    assert table(spark, path) == sorted(kept, key=str)
    seen.merge(spark, path, everything=True)
    assert len(seen.committed(spark, path)[1]) == 1 and table(spark, path) == sorted(kept, key=str)
    seen.merge(spark, path)
    seen.vacuum(spark, path, keep=1)
    assert len(files.child_names(spark, f"{path}/data")) == 1 and table(spark, path) == sorted(kept, key=str)


def test_merges_rewrite_a_row_a_few_times(spark):
    """Sizes only: folders stay few, and what is rewritten grows with the logarithm of the table."""
    folders, rewritten, runs = [], 0, 3000
    for run_id in range(runs):
        folders.append(seen.Folder(str(run_id), run_id, run_id, 10))
        if len(folders) > seen.MERGE_AFTER:
            taken, rows = 0, 0
            while taken < len(folders):
                older = folders[-taken - 1]
                if taken and older.merged and older.rows > 2 * rows:
                    break
                taken, rows = taken + 1, rows + older.rows
            rewritten += rows
            folders[len(folders) - taken:] = [seen.Folder("m", 0, run_id, rows)]
    assert len(folders) <= seen.MERGE_AFTER + 12 and rewritten < 12 * 10 * runs


def test_a_run_over_many_earlier_runs_opens_few_files(spark):
    path, runs = shared_dir(spark), 2000
    # Two thousand runs of ten postings, each in a folder of its own, as the library writes them.
    rows = spark.range(runs * 10).select(
        F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url"), F.lit("C").alias("company"), F.lit("t").alias("title"),
        F.lit(NOW.isoformat()).cast("timestamp_ntz").alias("first_seen"), F.lit(0).cast("bigint").alias("company_ord"),
        F.col("id").alias("posting_ord"), F.lit(None).cast("string").alias("yoe_note"), F.floor(F.col("id") / 10).cast("bigint").alias("run_id"),
        F.floor(F.col("id") / 10).alias("folder"),
    )
    rows.repartition(8, "folder").write.partitionBy("folder").parquet(f"{path}/data")
    seen.commit(spark, path, 1, [seen.Folder(f"folder={i}", i, i, 10) for i in range(runs)])
    seen.record_new(postings(spark, ["https://x/7", "new"]), path, runs, NOW)
    read = seen.read_seen(spark, path)
    assert len(read.inputFiles()) <= 40 and read.count() == runs * 10 + 1
    new = seen.record_new(postings(spark, [f"https://x/{i}" for i in range(0, 400)] + ["newer"]), path, runs + 1, NOW)
    assert [r.url for r in new.collect()] == ["newer"] and len(seen.read_seen(spark, path).inputFiles()) <= 41


def _scanned(df):
    """Rows that a plan's scans have given."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    text = plan.toString()
    assert "FileScan parquet" in text or "Scan parquet" in text
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        found += leaves.apply(i).metrics().apply("numOutputRows").value()
    return found


def test_files_answer_for_a_few_addresses(spark):
    """Files are sorted and carry bloom filters, so few addresses read next to nothing."""
    path = shared_dir(spark)
    urls = [f"https://jobs.example.com/{i:06d}" for i in range(20000)]
    random.Random(1).shuffle(urls)
    seen.record_new(postings(spark, urls), path, 1, NOW)
    seen.merge(spark, path, everything=True)
    rows = seen.read_seen(spark, path).select("url")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Between the first and the last address of the table, but not in it.
        absent = seen.only_urls(rows, spark.createDataFrame([(u + "x",) for u in urls[:30]], "url string"))
        assert absent.count() == 0 and _scanned(absent) < 1000
        present = seen.only_urls(rows, spark.createDataFrame([(u,) for u in urls[:3]], "url string"))
        assert present.count() == 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    many = seen.only_urls(rows, spark.createDataFrame([(u,) for u in urls[:300]], "url string"))
    assert many.count() == 300
    assert seen.only_urls(rows, spark.createDataFrame([], "url string")).count() == 0
