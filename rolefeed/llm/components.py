"""Connected components of a graph of links, by alternating large and small stars.

Every round is two joins and two aggregations on a node; nothing is collected. A round's links
are written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefeed.session import settle


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang every node's neighbours on the smallest of them: those above the node, or, for the
    small star, those below it and the node itself.

    The minimum is aggregated before the shuffle and joined back, so a node with very many
    neighbours is never gathered; adaptive execution splits its share of the join.
    """
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    lowest = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(lowest, "u")
    if small:
        moved = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _fingerprint(edges: DataFrame):
    h = F.xxhash64("a", "b")
    return edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, of any ordered type): the smallest
    node that links lead to. Loops and repeated links change nothing; no links, no rows.
    """
    current = settle(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct())
    before = _fingerprint(current)
    while before[0]:
        current = settle(_star(_star(current, small=False), small=True))
        now = _fingerprint(current)
        if now == before:
            break
        before = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)
