"""URL lists that change over time, applied as they stood when each page was fetched.

Dated list entries (``key, at, action``) become validity intervals: an entry holds until the next
one for its key. A capture is looked up under every key that covers its URL: its host, the domains
above it, and the host with its first path segments, as many as the longest key in the list has.
Of the entries that hold at fetch time, the most specific decides.

The as-of join is an equality join on key and a period of time, with the exact times as a
condition. Periods split a host that a third of all captures share, and adaptive execution splits
what is still too much. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefeed.llm.rows import digest_of, fresh
from rolefeed.session import broadcast_if_small, settle

PERIOD = 30 * 86_400  # seconds
PATH_DEPTH = 2  # path segments of keys, unless more are asked for
# Of entries for one key at one time the last of these counts; "remove" ends what held before.
ACTIONS = ("remove", "allow", "block")


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.rtrim(host, F.lit(".")), F.lit(""))


def url_keys(url: Column, depth: int = PATH_DEPTH, most_labels: int | None = None) -> Column:
    """Keys that cover a URL, as an array of (key, rank): the domains above its host, widest
    first, then the host, then the host with one to ``depth`` path segments; empty segments do not
    count. Of the domains only those of at most ``most_labels`` labels. Empty without a host."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), n if most_labels is None else F.least(n, F.lit(max(most_labels, 1)))),
        lambda i: F.struct(F.array_join(F.slice(labels, n - i + 1, i), ".").alias("key"), i.alias("rank")),
    )
    domains = F.filter(domains, lambda d: (d["rank"] >= 2) | (n == 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*/([^?#]*)", 1)
    segments = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth)
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(segments)), lambda i: i > 0),
        lambda i: F.struct(
            F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("key"),
            (i + 1000).alias("rank"),
        ),
    )
    return F.when(host != "", F.concat(domains, paths)).otherwise(
        F.array().cast("array<struct<key:string,rank:int>>")
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` (seconds, end exclusive, NULL for open) from dated entries
    ``key, at, action``. Entries without key, time or known action take no part."""
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    # One entry per key and second, before any key is brought together.
    states = (
        entries.select("key", F.unix_seconds(F.col("at").cast("timestamp")).alias("since"), place.alias("place"))
        .where("key is not null and since is not null and place > 0")
        .groupBy("key", "since").agg(F.max("place").alias("place"))
    )
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("place").cast("int"))
    return states.withColumn("until", until).where("place > 1").select("key", action.alias("action"), "since", "until")


def apply_lists(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at",
                period: int = PERIOD) -> DataFrame:
    """``captures`` with ``n_active`` (entries that held), ``verdict`` (block, allow or none) and
    ``rule`` (the deciding key, or NULL).

    A capture without URL, host or time matches nothing. An entry holds from its own second on.
    Equal captures get equal results; columns of the three names are replaced.
    """
    row, hit = fresh("row"), fresh("hit")
    kept = [c for c in captures.columns if c.lower() not in ("n_active", "verdict", "rule")]
    when = F.unix_seconds(F.col(fetched).cast("timestamp"))
    numbered = captures.select(*kept).withColumn(row, digest_of(captures[url].cast("string"), captures[fetched].cast("string")))
    ends = captures.select(F.min(when).alias("low"), F.max(when).alias("high")).first()
    held = settle(intervals(entries))
    # Only keys as long as those in the list can match.
    parts = F.split("key", "/")
    longest = held.agg(
        F.max(F.size(parts) - 1).alias("depth"), F.max(F.size(F.split(parts[0], r"\."))).alias("labels")
    ).first()
    keys = url_keys(F.col(url).cast("string"), longest.depth or 0, longest.labels or 1)
    asked = (
        numbered.select(F.col(row), when.alias("t"), F.explode(keys).alias("k"))
        .where("t is not null")
        .select(row, "t", "k.key", "k.rank", F.floor(F.col("t") / period).alias("period"))
    )
    low, high = ends.low or 0, ends.high or 0
    # Intervals are cut to the time that captures span, so there are finitely many periods.
    spread = held.where((F.col("since") <= high) & (F.coalesce(F.col("until"), F.lit(high + 1)) > low)).select(
        F.col("key").alias("l_key"), "action", "since", "until",
        F.explode(F.sequence(
            F.floor(F.greatest("since", F.lit(low)) / period),
            F.floor(F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high)) / period),
        )).alias("l_period"),
    )
    spread = settle(spread)
    matched = asked.join(
        broadcast_if_small(spread),
        (F.col("key") == F.col("l_key")) & (F.col("period") == F.col("l_period"))
        & (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))),
    ).select(row, "rank", "action", "key").distinct()  # repeated captures count once
    best = settle(
        matched.groupBy(row).agg(
            F.count("*").alias("n"), F.max(F.struct("rank", "action", "key")).alias(hit)
        )
    )
    out = numbered.join(broadcast_if_small(best), row, "left")
    return out.select(
        *kept, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"),
        F.coalesce(F.col(hit)["action"], F.lit("none")).alias("verdict"), F.col(hit)["key"].alias("rule"),
    )
