"""Line de-duplication by how common a line is on its site.

A line is boilerplate on a host if more than ``max_ratio`` of the host's pages hold it, and at
least ``min_pages`` of them do. Boilerplate lines are dropped, other text stays as it is.

Lines are compared without the blanks around them; blank lines are never counted or dropped.
Pages of the NULL host form a host of their own. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefeed.llm.rows import digest_of, fresh
from rolefeed.session import broadcast_if_small, settle

MAX_RATIO = 0.02
MIN_PAGES = 5
BLANKS = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """16 bytes for a line without the blanks around it; NULL for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def host_key(host: Column) -> Column:
    """NULL and empty hosts are two hosts."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("-"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, line``: keys of the boilerplate lines of each host.

    Lines are counted per host and line, so a host with a third of all pages is spread over all
    tasks by its lines. Only lines on ``min_pages`` pages reach the join with the totals.
    """
    pages = docs.select(host_key(docs[host]).alias("host"), docs[text].cast("string").alias("text"))
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: k.isNotNull()))
    counts = (
        pages.select("host", F.explode(keys).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    totals = settle(pages.groupBy("host").agg(F.count("*").alias("pages")))
    return counts.join(broadcast_if_small(totals), "host").where(
        F.col("n") > F.col("pages") * F.lit(float(max_ratio))
    ).select("host", "line")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    No row is dropped: a page of nothing but boilerplate keeps an empty text. NULL texts stay
    NULL, with no lines. Equal rows get equal results. Columns named like the two new ones are
    replaced.
    """
    common = settle(boilerplate(docs, host, text, max_ratio, min_pages))
    row, lines, gone = fresh("row"), fresh("lines"), fresh("gone")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    pages = docs.select(*kept).withColumn(row, digest_of(docs[host], docs[text].cast("string")))
    # Positions of boilerplate lines, one entry per distinct page content that has any.
    exploded = pages.select(
        F.col(row), host_key(F.col(host)).alias("host"), F.posexplode(lines_of(F.col(text).cast("string"))).alias("at", "one")
    ).select(row, "host", "at", line_key(F.col("one")).alias("line"))
    hits = exploded.join(broadcast_if_small(common), ["host", "line"], "left_semi")
    dropped = settle(hits.groupBy(row).agg(F.collect_set("at").alias(gone)))
    marked = pages.join(broadcast_if_small(dropped), row, "left").withColumn(lines, lines_of(F.col(text).cast("string")))
    # array_except hashes, so a page of very many lines takes linear time.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cleaned = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    return marked.select(*[
        F.when(F.col(gone).isNull(), F.col(c).cast("string")).otherwise(cleaned).alias(c) if c == text else F.col(c)
        for c in kept
    ], _count(lines, "n_lines"), _count(gone, "n_dropped"))


def _count(column: str, name: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.size(column)).cast("bigint").alias(name)
