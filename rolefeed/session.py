"""Session building and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, app_name: str = "rolefeed", **conf) -> SparkSession:
    """A session with the settings the library is tuned for.

    Adaptive execution is what keeps one plan good at every size: it coalesces small shuffle
    partitions, splits skewed ones and turns a sort-merge join into a broadcast join once the
    measured side is small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new, unused folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``, or under the folder given to ``setCheckpointDir``.
    There is no fallback: a job without such a folder fails before it does any work.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ensure_scratch(spark: SparkSession, path: str) -> None:
    """Give a local session without a checkpoint folder one. For entry points, benchmarks and
    tests; a cluster names its own shared folder."""
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_already and spark.conf.get("spark.master", "local").startswith("local"):
        spark.sparkContext.setCheckpointDir(path)


_collecting: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("collecting", default=())


@contextlib.contextmanager
def settled_paths() -> Iterator[list[str]]:
    """The folders that ``settle`` makes meanwhile, so that they can be removed once nothing reads
    them any more."""
    made: list[str] = []
    token = _collecting.set((*_collecting.get(), made))
    try:
        yield made
    finally:
        _collecting.reset(token)


def settle(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where a costly result feeds two branches: it is computed once, it survives the loss of
    executors, and its size is known to the planner and to ``fits_broadcast``.
    """
    path = shared_dir(df.sparkSession)
    for made in _collecting.get():
        made.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of ``df`` allows a broadcast. Meant for settled tables, where
    measuring is a cheap scan."""
    values = (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns)
    width = sum(values, F.lit(16 * (len(df.columns) + 1)))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it. If not, the join shuffles, and
    adaptive execution splits skewed keys."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a table scan that has fewer splits than the cluster has cores.

    For scans that feed costly per-row work. A large table already has enough splits and is left
    alone, so only small ones are ever shuffled here. Give it a plain scan: counting the splits
    of a join would run the join.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
