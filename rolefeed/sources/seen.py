"""The table of everything ever reported.

A run's rows are written to a folder of their own and count only once a commit names that folder.
A commit is one small file with a row per folder that counts, moved into place in one step, so a
run that fails while it writes changes nothing, and a run that is repeated replaces its rows all
at once. A run compares itself with all other runs, earlier and later: a url stays in one run even
if an older run is repeated with more postings.

Folders of many small runs are merged as they accumulate, newest first and each at most a few
times, so a run reads a number of folders that grows with the logarithm of the table, not with the
number of runs. Files are sorted by url and carry a bloom filter of their urls, by which a run of a
few addresses skips what cannot hold them.

    data/<folder>       parquet files
    commits/<version>   which folders count; the highest version holds

One writer at a time: a second one that commits the same version fails.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rolefeed import files, schemas
from rolefeed.operators.dedup import RUN_ORDER, first_per_url, not_seen
from rolefeed.session import BROADCAST_BYTES, fits_broadcast, settle

MERGE_AFTER = 32  # folders
KEEP_COMMITS = 8  # older ones, and what only they name, are removed when folders are merged
LOOKUP_URLS = 64  # a run of so few addresses asks the files for each of them

ENTRIES = "folder string, first_run bigint, last_run bigint, rows bigint, without array<bigint>"


@dataclass(frozen=True)
class Folder:
    """Rows of the runs from ``first_run`` to ``last_run``, but for those replaced since."""

    folder: str
    first_run: int
    last_run: int
    rows: int
    without: tuple[int, ...] = field(default=())

    @property
    def merged(self) -> bool:
        return self.first_run != self.last_run or bool(self.without)

    def less(self, run_id: int) -> Folder | None:
        """What is left without a run; None if that is nothing."""
        if not self.first_run <= run_id <= self.last_run or run_id in self.without:
            return self
        return replace(self, without=(*self.without, run_id)) if self.first_run < self.last_run else None


# --- commits --------------------------------------------------------------------------------


def committed(spark: SparkSession, path: str) -> tuple[int, list[Folder]]:
    """The version of the last commit, 0 before the first, and the folders that count, oldest
    first."""
    names = files.child_names(spark, f"{path}/commits")
    if not names:
        return 0, []
    rows = spark.read.schema(f"place int, {ENTRIES}").json(f"{path}/commits/{names[-1]}").orderBy("place").collect()
    return int(names[-1]), [
        Folder(r.folder, r.first_run, r.last_run, r.rows, tuple(r.without or ())) for r in rows
    ]


def commit(spark: SparkSession, path: str, version: int, folders: list[Folder]) -> None:
    """Make ``folders`` the table. ``version`` is the one after the last."""
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    rows = [(i, f.folder, f.first_run, f.last_run, f.rows, list(f.without)) for i, f in enumerate(folders)]
    spark.createDataFrame(rows, f"place int, {ENTRIES}").coalesce(1).write.json(staged)
    files.move(spark, staged, f"{path}/commits/{version:012d}")


def vacuum(spark: SparkSession, path: str, keep: int = KEEP_COMMITS) -> None:
    """Remove all but the last ``keep`` commits, and folders that none of these names. A table read
    before one of them stays readable."""
    names = files.child_names(spark, f"{path}/commits")
    kept = names[-keep:]
    if not kept:
        return
    named = {
        r.folder for r in spark.read.schema(ENTRIES).json([f"{path}/commits/{n}" for n in kept]).select("folder").distinct().collect()
    }
    for name in names[:-keep]:
        files.remove(spark, f"{path}/commits/{name}")
    for name in files.child_names(spark, f"{path}/data"):
        if name not in named:
            files.remove(spark, f"{path}/data/{name}")
    files.remove(spark, f"{path}/staged")


def _less(folders: list[Folder], run_id: int) -> list[Folder]:
    return [f for f in (f.less(run_id) for f in folders) if f]


# --- reading --------------------------------------------------------------------------------


def _read(spark: SparkSession, path: str, folders: list[Folder]) -> DataFrame:
    plain = [f"{path}/data/{f.folder}" for f in folders if not f.without]
    parts = [spark.read.schema(schemas.SEEN).parquet(*plain)] if plain else []
    for f in folders:
        if f.without:
            rows = spark.read.schema(schemas.SEEN).parquet(f"{path}/data/{f.folder}")
            parts.append(rows.where(~F.col("run_id").isin(*f.without)))
    return functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schemas.SEEN)


def read_seen(spark: SparkSession, path: str, except_run: int | None = None) -> DataFrame:
    """Rows ever reported, but for one run's; empty if nothing has been committed yet."""
    folders = committed(spark, path)[1]
    return _read(spark, path, folders if except_run is None else _less(folders, except_run))


def read_run(spark: SparkSession, path: str, run_id: int, folders: list[Folder] | None = None) -> DataFrame:
    """Rows that one run reported. ``folders`` are those committed, if they are known already."""
    folders = committed(spark, path)[1] if folders is None else folders
    own = [f for f in folders if f.first_run <= run_id <= f.last_run and run_id not in f.without]
    return _read(spark, path, own).where(F.col("run_id") == run_id)


def only_urls(seen: DataFrame, urls: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``seen`` whose url is in ``urls``, as far as that saves work.

    A few addresses become conditions that files answer by their bloom filters. More are broadcast
    if they fit, so that the table is scanned but not shuffled; if not, all rows are returned.
    """
    few = urls.limit(LOOKUP_URLS + 1).collect()
    if not few:
        return seen.limit(0)
    if len(few) <= LOOKUP_URLS:
        return seen.where(functools.reduce(operator.or_, (F.col("url") == r.url for r in few)))
    return seen.join(F.broadcast(urls), "url", "left_semi") if fits_broadcast(urls, limit) else seen


# --- writing --------------------------------------------------------------------------------


def _write(rows: DataFrame, path: str) -> tuple[str, int]:
    """A new folder with some rows, and how many they are, counted on the way."""
    folder, counted = uuid.uuid4().hex, Observation()
    rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.option("parquet.bloom.filter.enabled#url", "true").parquet(
        f"{path}/data/{folder}")
    return folder, int(counted.get.get("rows", 0))


def append_run(
    new: DataFrame, path: str, run_id: int, run_ts: dt.datetime, last: tuple[int, list[Folder]] | None = None
) -> list[Folder]:
    """Record the new postings of a run, all of them or none; what the run recorded before goes in
    the same step. ``run_ts`` is UTC, without zone. ``last`` is the last commit, if it is known
    already; returned are the folders that count now."""
    spark, run_id = new.sparkSession, int(run_id)
    note = F.col("yoe_note") if "yoe_note" in new.columns else F.lit(None).cast("string")
    rows = new.select(
        "url", "company", "title", F.lit(run_ts.isoformat()).cast("timestamp_ntz").alias("first_seen"),
        F.col("company_ord").cast("bigint").alias("company_ord"), "posting_ord",
        note.alias("yoe_note"), F.lit(run_id).cast("bigint").alias("run_id"),
    )
    # Rebalanced, so that a small run does not leave many tiny files.
    folder, count = _write(rows.hint("rebalance").sortWithinPartitions("url"), path)
    version, folders = last or committed(spark, path)
    kept = _less(folders, run_id)
    if count:
        kept.append(Folder(folder, run_id, run_id, count))
    if kept != folders:
        commit(spark, path, version + 1, kept)
    return kept


def merge(spark: SparkSession, path: str, everything: bool = False) -> None:
    """Merge the newest folders into one, and older ones as long as they are not more than twice
    as large as what is merged already. A row is so rewritten a few times only, however long the
    table grows. ``everything`` merges all."""
    version, folders = committed(spark, path)
    taken, rows = 0, 0
    while taken < len(folders):
        older = folders[-taken - 1]
        if not everything and taken and older.merged and older.rows > 2 * rows:
            break
        taken, rows = taken + 1, rows + older.rows
    if taken < 2 and not any(f.without for f in folders[len(folders) - taken:]):
        return
    kept, chosen = folders[:len(folders) - taken], folders[len(folders) - taken:]
    # In ranges of urls; rows without one are told apart by their ordinals, so they spread too.
    order = "url", "run_id", *RUN_ORDER
    sorted_rows = _read(spark, path, chosen).repartitionByRange(*order).sortWithinPartitions(*order)
    folder, count = _write(sorted_rows, path)
    if count:
        kept.append(Folder(folder, min(f.first_run for f in chosen), max(f.last_run for f in chosen), count))
    commit(spark, path, version + 1, kept)
    vacuum(spark, path)


def record_new(
    df: DataFrame, path: str, run_id: int, run_ts: dt.datetime,
    order=RUN_ORDER, limit: int = BROADCAST_BYTES, merge_after: int = MERGE_AFTER,
) -> DataFrame:
    """Find the new postings of a run, record them, and return them from the table.

    The table only grows, so it is not shuffled for an ordinary run (``only_urls``). A run too large
    to broadcast its addresses is joined with the whole table. Once more than ``merge_after``
    folders have accumulated, they are merged.
    """
    spark = df.sparkSession
    candidates = settle(first_per_url(df, order))
    last = committed(spark, path)
    urls = candidates.select("url").where("url is not null")
    known = _less(last[1], run_id)
    new = candidates
    if known:
        new = not_seen(candidates, only_urls(_read(spark, path, known).select("url"), urls, limit), order)
    folders = append_run(new, path, run_id, run_ts, last)
    if len(folders) > merge_after:
        merge(spark, path)
        folders = committed(spark, path)[1]
    return read_run(spark, path, run_id, folders)
