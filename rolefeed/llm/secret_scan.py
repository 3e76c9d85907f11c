"""Secrets in text, with parts of credentials that only count together.

Strong kinds are reported wherever they occur: ``assign`` (a password-like name and its value),
``access`` (an access key id), ``hex`` (a long hexadecimal run). Weak kinds are too common alone:
``user`` (an account name and its value), ``secret`` (a long mixed run, like a secret access key)
and ``endpoint`` (a URL). A weak candidate is reported only if a part that complements it lies in
its scope, within ``REACH`` characters.

Everything is DataFrame expressions. Places come from the lengths between matches: the text is
split by the same pattern that finds the matches. Candidates of one document are linked by an
interval join: each part is put into the stretches of ``REACH`` characters that its scope touches
and joined on document and stretch, so a document of very many parts is never compared with
itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefeed.llm.rows import digest_of, fresh
from rolefeed.session import broadcast_if_small, settle

REACH = 200

# --- fixed values: what counts as which kind ---
# (kind, pattern, group of the value, least length of the value). For access and hex the least
# length is part of the pattern: runs are matched from their start, so that finds the same.
STRONG = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("user", r"""((?i:user|username|login|account|client_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    ("secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{40})(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]++", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/._%-]*", 0, 10),
)
# What makes a weak candidate count.
COMPLEMENTS = {
    "user": ("assign", "secret", "hex"),
    "secret": ("access", "user", "endpoint"),
    "endpoint": ("access", "assign", "secret"),
}
KINDS = tuple(kind for kind, *_ in (*STRONG, *WEAK))
# --- end of fixed values ---


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """For each match: its kind, the characters before it since the last one, and itself."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.transform(
        F.arrays_zip(between.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(value, F.length).alias("value")),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")),
    )
    none = F.array().cast("array<struct<kind:string,gap:int,size:int,value:int>>")
    # Cheap test first: few texts hold any.
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["size"].isNotNull())).otherwise(none)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row, kind, start, stop``: every strong and weak part of each distinct text."""
    texts = docs.select(docs[text].cast("string").alias("text"))
    found = texts.select(
        digest_of(F.col("text")).alias("row"),
        *[_matches(F.col("text"), kind, pattern, group).alias(kind) for kind, pattern, group, _ in (*STRONG, *WEAK)],
    )
    # One row per kind that occurs; a text repeated many times is reduced to one before the shuffle.
    lists = found.select("row", F.explode(F.array(*KINDS)).alias("all")).where(F.size("all") > 0)
    lists = settle(lists.groupBy("row", F.col("all")[0]["kind"].alias("kind")).agg(F.first("all").alias("all")))
    parts = lists.select("row", F.posexplode("all").alias("i", "one")).select("row", "i", "one.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.col("size")).over(order)
    least = F.element_at(F.create_map(*[x for k, _, _, n in (*STRONG, *WEAK) for x in (F.lit(k), F.lit(n))]), F.col("kind"))
    placed = parts.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    return placed.where(F.col("value") >= least).select("row", "kind", "start", "stop")


def _stretches(low: Column, high: Column, reach: int) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / reach), F.floor(high / reach)))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong parts, and weak ones with a complement in their scope."""
    pairs = F.array(*[F.struct(F.lit(w).alias("kind"), F.lit(c).alias("other")) for w, cs in COMPLEMENTS.items() for c in cs])
    weak = parts.where(F.col("kind").isin(*COMPLEMENTS))
    asked = weak.select(
        "row", "kind", "start", "stop", _stretches(F.col("start") - reach, F.col("stop") + reach, reach).alias("stretch")
    ).select("*", F.explode(pairs).alias("p")).where("kind = p.kind").select(
        "row", "kind", "start", "stop", "stretch", F.col("p.other").alias("other")
    )
    others = parts.select(
        F.col("row").alias("o_row"), F.col("kind").alias("o_kind"), F.col("start").alias("o_start"),
        F.col("stop").alias("o_stop"), _stretches(F.col("start"), F.col("stop"), reach).alias("o_stretch"),
    )
    near = (
        (F.col("row") == F.col("o_row")) & (F.col("stretch") == F.col("o_stretch")) & (F.col("other") == F.col("o_kind"))
        & (F.col("o_start") <= F.col("stop") + reach) & (F.col("o_stop") >= F.col("start") - reach)
    )
    kept = asked.join(others, near, "left_semi").select("row", "kind", "start", "stop").distinct()
    return parts.where(F.col("kind").isin(*[k for k, *_ in STRONG])).unionByName(kept)


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex``, ``base_sha256`` (of the strong spans) and
    ``spans`` (all), spans as ``kind:start:end`` in characters, end exclusive, by start and kind.

    NULL and empty texts have none. Columns of these names are replaced. Equal texts are scanned
    like any other but linked once.
    """
    parts = settle(candidates(docs, text))
    spans, key = fresh("spans"), fresh("key")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", place.alias("place"), "kind", "stop")
    lists = settle(linked(parts, reach).groupBy("row").agg(F.sort_array(F.collect_list(one)).alias(spans)).withColumnRenamed("row", key))
    new = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    kept = [c for c in docs.columns if c.lower() not in new]
    joined = docs.join(broadcast_if_small(lists), digest_of(docs[text].cast("string")) == lists[key], "left")
    found = F.coalesce(F.col(spans), F.array().cast(lists.schema[spans].dataType))
    strong = F.filter(found, lambda s: s["place"] <= len(STRONG))

    def count(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")

    return joined.select(
        *[docs[c] for c in kept], *[count(k).alias(f"n_{k}") for k, *_ in STRONG],
        F.sha2(_listed(strong), 256).alias("base_sha256"), _listed(found).alias("spans"),
    )
