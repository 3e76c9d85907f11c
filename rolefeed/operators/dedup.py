"""First-wins de-duplication within a page, within a run and across runs.

A NULL url is never a duplicate of anything. ``own_key`` gives each such posting a key of its
own, so that NULLs spread over all tasks and need no second pass over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_ORDER = ("company_ord", "posting_ord")
HISTORY_ORDER = ("run_id", "company_ord", "posting_ord")


def own_key(url: Column, order: Sequence[str]) -> Column:
    """The url, or for NULL a key made of the ordinals, which identify the posting. It starts
    with U+0000, so it equals no address."""
    return F.coalesce(url, F.concat_ws("\0", F.lit(""), *order))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Spark keeps only the first row per key and task before the
    shuffle, so a key that fills a third of the input costs no more than any other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_per_page(df: DataFrame, *page: str) -> DataFrame:
    """First accepted link per page and resolved address. Filter before calling: a rejected link
    must not hide a later one."""
    return first_by(df, [*(page or ("page_id",)), "full_url"], ["link_ord"])


def first_per_url(df: DataFrame, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """One posting per url, the first in ``order``, and every posting without a url."""
    keyed = df.withColumn("_key", own_key(F.col("url"), order))
    return first_by(keyed, ["_key"], order).drop("_key")


def new_per_run(df: DataFrame) -> DataFrame:
    """What each run would have reported as new, for a whole history in one pass."""
    return first_per_url(df, HISTORY_ORDER)


def not_seen(df: DataFrame, seen: DataFrame, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """Postings whose url is not in ``seen``, which has each url once; a NULL url never is."""
    keyed = df.withColumn("_key", own_key(F.col("url"), order))
    known = seen.select(F.col("url").alias("_key"))
    return keyed.join(known, "_key", "left_anti").drop("_key")


def new_postings(df: DataFrame, seen: DataFrame, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """``first_per_url`` then ``not_seen``, on one shuffle of ``df``."""
    keyed = df.withColumn("_key", own_key(F.col("url"), order))
    known = seen.select(F.col("url").alias("_key"))
    return first_by(keyed, ["_key"], order).join(known, "_key", "left_anti").drop("_key")


def first_seen(df: DataFrame, stamp: str = "captured_at") -> DataFrame:
    """Per url, the attributes it had when it was first reported; they never change later."""
    keyed = df.withColumn("_key", own_key(F.col("url"), HISTORY_ORDER))
    frozen = F.struct("url", "company", "title", F.col(stamp).alias("first_seen"), "run_id")
    return (
        keyed.groupBy("_key")
        .agg(F.min_by(frozen, F.struct(*HISTORY_ORDER)).alias("first"))
        .select("first.*")
    )
