"""Exact similarity join of documents on word shingles, through a token-group matrix.

1. Every document becomes the set of its hashed 5-word shingles. Documents with equal sets are
   one class; only classes are compared.
2. Tokens get one order for the whole corpus, rare ones first: counts of all tokens, added up in
   ``BUCKETS`` buckets of hashes, give each token a level, and (level, hash) is its place. The
   order only decides how much work there is; any order gives the same links.
3. Classes are partitioned into groups of similar ones: those that agree on a band of minimum
   hashes are compared with one pivot of the band, the class of the most frequent tokens, which
   is the likeliest centre of its copies. Links found that way are joined up.
4. The token-group matrix stores, for each token of the classes' prefixes, the groups that hold
   it: the union of a group's tokens. Most tokens occur in one group only and are dropped.
5. Each class queries the matrix. A group is opened only if it shares as many prefix tokens with
   the class as a partner in it must; in an opened group the same bound picks the members that
   are compared in full. Pairs within one group need no comparison: they are joined already.

The bound is exact. Partners of sizes ``n <= m`` share at least ``need = t (n + m) / (1 + t)``
tokens, and ``m <= n / t``. After the ``l``-th token that they share come at least ``need - l``
more, so it is among the first ``n - need + l`` tokens of one and ``m - need + l`` of the other:
these prefixes share ``l`` tokens or more (``LEAD``, or ``need`` if that is less). The smaller set
asks; its prefix is short, and no set's is longer than ``m - ceil(t m) + l``. What is frequent
comes last: a passage that a third of all documents quote brings no two of them together.

A dropped token is in no other group's prefix, but a partner may hold it behind its own. Only of
two sets the one whose prefix ends first in the order shares none of its dropped tokens: the other's
prefix would hold them. It shares at most its ``reach``, the tokens that are left. Two copies of one
text that have changed too much to be partners each hold enough rare tokens to be told apart by that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolefeed.llm import words as W
from rolefeed.llm.components import components
from rolefeed.llm.rows import add_columns, digest_of, give_back
from rolefeed.session import broadcast_if_small, settle

SHINGLE = 5
NUM, DEN = 75, 100  # partners: DEN * intersection >= NUM * union
BANDS, BAND_WIDTH = 8, 2
LEAD = 2  # prefixes of partners share so many tokens; more of it, longer prefixes

BUCKETS = 1 << 21  # of token counts; a byte of each is broadcast
CHUNK = 1 << 13  # buckets added up together

SKETCH = "key binary, n bigint, familiar bigint, prefix array<bigint>, bands array<bigint>"


def needed(n):
    """Fewest tokens that a partner shares with a set of ``n``."""
    return -(-NUM * n // DEN)


def prefix_size(n):
    return np.minimum(n, n - needed(n) + LEAD)


def shingle_sets(texts: pa.Array, k: int = SHINGLE):
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle."""
    for block in W.hashed_words(texts, W.SPACED):
        values = W.runs(block.hashes, k).view(np.int64)
        for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
            if b - a >= k:
                yield np.unique(values[a:b - k + 1])
            elif b > a:
                yield W.runs(block.hashes[a:b], b - a).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)


def _bands(tokens: np.ndarray) -> np.ndarray:
    """Band keys: the hash range is cut into equal bins, and the smallest token of each bin is a
    minimum hash. A band with an empty bin is left out."""
    bins = BANDS * BAND_WIDTH
    edges = (np.arange(bins + 1, dtype=object) * (2**64 // bins) - 2**63)
    edges[-1] = 2**63 - 1
    at = np.searchsorted(tokens, edges[:-1].astype(np.int64))
    full = np.diff(np.r_[at, len(tokens)]) > 0
    lows = tokens[np.minimum(at, len(tokens) - 1)].view(np.uint64).reshape(BANDS, BAND_WIDTH)
    whole = full.reshape(BANDS, BAND_WIDTH).all(axis=1)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_WIDTH):
        keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + lows[:, j])
    return keys[whole].view(np.int64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - BUCKETS.bit_length() + 1)).view(np.int64)


def _chunks(counts: np.ndarray):
    """Counts as rows of at most ``CHUNK`` buckets: places and counts, or counts of all places."""
    places, values = [], []
    rows = counts.reshape(-1, CHUNK)
    chunks = np.flatnonzero(rows.any(axis=1))
    for row in rows[chunks]:
        at = np.flatnonzero(row)
        narrow = np.min_scalar_type(row.max())
        dense = len(at) * (2 + narrow.itemsize) > CHUNK * narrow.itemsize
        places.append(b"" if dense else at.astype(np.uint16).tobytes())
        values.append((row if dense else row[at]).astype(narrow).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
        names=["chunk", "places", "counts"],
    )


def token_levels(texts: DataFrame) -> np.ndarray:
    """How frequent the tokens of each bucket are, in quarters of powers of two. Every text of the
    column ``text`` is counted; the result has one size whatever their number."""

    def count(batches):
        give_back()
        seen = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for tokens in shingle_sets(batch.column(0).slice(low, 256)):
                    seen[_bucket(tokens)] += 1
        yield _chunks(seen)
        give_back()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = total.setdefault(chunk, np.zeros(CHUNK, dtype=np.uint64))
                at = np.frombuffer(places, np.uint16) if places else slice(None)
                width = len(counts) // (len(places) // 2 if places else CHUNK)
                own[at] += np.frombuffer(counts, f"<u{width}")
        if total:
            level = [np.minimum(np.log2(np.maximum(t, 1)) * 4, 127).astype(np.uint8).tobytes() for t in total.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], names=["chunk", "levels"]
            )

    counted = texts.select("text").mapInArrow(count, "chunk int, places binary, counts binary")
    levels = np.zeros((BUCKETS // CHUNK, CHUNK), dtype=np.uint8)
    for row in counted.repartition("chunk").mapInArrow(add, "chunk int, levels binary").collect():
        levels[row.chunk] = np.frombuffer(row.levels, np.uint8)
    return levels.reshape(-1)


def _placed(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens as their places in the corpus-wide order: the level, then 56 bits of the hash."""
    low = tokens.view(np.uint64) & np.uint64(2**56 - 1)
    return ((level.astype(np.uint64) << np.uint64(56)) | low).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *parts]))


def _sketch(texts: pa.Array, levels: np.ndarray) -> list[pa.Array]:
    give_back()
    keys, sizes, familiar, prefixes, bands = [], [], [], [], []
    for tokens in shingle_sets(texts):
        n = len(tokens)
        level = levels[_bucket(tokens)]
        p = int(prefix_size(n))
        prefix = np.sort(np.partition(_placed(tokens, level), p - 1)[:p]) if n else tokens
        sizes.append(n)
        keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
        familiar.append(int(1000 * level.mean()) if n else None)
        prefixes.append(prefix)
        bands.append(_bands(tokens) if n else tokens)
    return [
        pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(familiar, pa.int64()),
        _lists(prefixes), _lists(bands),
    ]


def _full(texts: pa.Array) -> list[pa.Array]:
    give_back()
    keys, sets, short = [], [], []
    for tokens in shingle_sets(texts):
        keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
        sets.append(tokens.tobytes())
        short.append(_short(tokens))
    return [pa.array(keys, pa.binary()), pa.array(sets, pa.binary()), pa.array(short, pa.binary())]


def _short(tokens: np.ndarray) -> bytes:
    """The low bits of a set's tokens: 2 bytes of each, or 4 for large sets."""
    return tokens.astype("<u2" if len(tokens) <= 4096 else "<u4").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether the low bits of two sets of ``n`` and ``m`` tokens allow them to be partners. Low
    bits agree at least as often as tokens do, so no partners are ruled out."""
    x, y = np.frombuffer(a, "<u2" if n <= 4096 else "<u4"), np.frombuffer(b, "<u2" if m <= 4096 else "<u4")
    if x.dtype != y.dtype:
        x, y = x.astype("<u2"), y.astype("<u2")
    (x, p), (y, q) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(p[i], q[j]).sum())
    return (NUM + DEN) * shared >= NUM * (n + m)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def _possible(arrays: list[pa.Array]) -> list[pa.Array]:
    out = [may_be_similar(a, b, n, m) for a, b, n, m in zip(*(x.to_pylist() for x in arrays))]
    return [pa.array(out, pa.bool_())]


def _verdicts(arrays: list[pa.Array]) -> list[pa.Array]:
    out = [
        similar(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
        for a, b in zip(arrays[0].to_pylist(), arrays[1].to_pylist())
    ]
    return [pa.array(out, pa.bool_())]


def _could_match(n: Column, m: Column) -> Column:
    """The sizes of two sets allow them to be partners."""
    return (F.least(n, m) * DEN) >= (F.greatest(n, m) * NUM)


class _Corpus:
    """Texts of a corpus and their sketches, each row told by the digest of its text."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
        levels = docs.sparkSession.sparkContext.broadcast(token_levels(self.texts))
        sketched = add_columns(
            self.texts, [self.texts["text"]], SKETCH, lambda a: _sketch(a[0], levels.value)
        )
        self.rows = settle(sketched.select(
            "doc_id", "key", "n", "familiar", "prefix", "bands", digest_of(F.col("text")).alias("digest"),
            digest_of(F.col("doc_id"), F.col("text")).alias("row"),
        ))
        # One row per class, without its tokens.
        self.classes = settle(
            self.rows.where("n > 0").groupBy("key").agg(
                F.min("n").alias("n"),
                F.min("digest").alias("digest"), F.count("*").alias("n_rows"),
            )
        )

    def sets(self, keys: DataFrame) -> DataFrame:
        """``key, tokens, short`` of some classes, read from one text of each."""
        digests = settle(self.classes.join(keys, "key", "left_semi").select("digest"))
        texts = self.texts.select("text", digest_of(F.col("text")).alias("digest"))
        texts = texts.join(broadcast_if_small(digests), "digest", "left_semi")
        one = texts.groupBy("digest").agg(F.first("text").alias("text"))
        full = add_columns(one, [one["text"]], "key binary, tokens binary, short binary", lambda a: _full(a[0]))
        return full.select("key", "tokens", "short")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs of classes ``a, b`` that are partners."""
        pairs = settle(pairs)
        keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        sets = settle(self.sets(keys).withColumn("size", (F.octet_length("tokens") / 8).cast("int")))

        def beside(pairs: DataFrame, *columns: str) -> DataFrame:
            for side in ("b", "a"):
                own = sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
                pairs = pairs.join(own, side)
            return pairs

        # The low bits settle most pairs at a quarter of the bytes.
        rough = beside(pairs, "short", "size")
        rough = add_columns(
            rough, [rough["a_short"], rough["b_short"], rough["a_size"], rough["b_size"]], "possible boolean", _possible
        )
        close = settle(rough.where("possible").select("a", "b"))
        both = beside(close, "tokens")
        checked = add_columns(both, [both["a_tokens"], both["b_tokens"]], "linked boolean", _verdicts)
        return checked.where("linked").select("a", "b")


def _pivot_pairs(corpus: _Corpus) -> DataFrame:
    """Each class of a band with the band's pivot."""
    banded = corpus.rows.where("n > 0").select("key", "n", "familiar", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(
        F.max(F.struct("familiar", "key", "n")).alias("pivot"), F.min("key").alias("low"), F.max("key").alias("high")
    ).where("low <> high").select("band", "pivot")
    return (
        banded.join(ends, "band")
        .where((F.col("key") != F.col("pivot.key")) & _could_match(F.col("n"), F.col("pivot.n")))
        .select(F.greatest("key", "pivot.key").alias("a"), F.least("key", "pivot.key").alias("b")).distinct()
    )


def _need(n: Column, m: Column) -> Column:
    """Fewest tokens that partners of two sizes share."""
    return F.ceil((n + m) * NUM / (NUM + DEN)).cast("bigint")


def _matrix_pairs(corpus: _Corpus, groups: DataFrame) -> DataFrame:
    """Pairs of classes of different groups that the token-group matrix cannot rule out."""
    rows = corpus.rows.where("n > 0").select("key", "n", "prefix")
    rows = rows.join(broadcast_if_small(groups), "key", "left")
    rows = rows.withColumn("grp", F.coalesce("grp", F.xxhash64("key")))
    shared = settle(
        rows.select("grp", F.explode("prefix").alias("token"))
        .groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
        .where("low <> high").select("token")
    )
    n, pos, reach, last = F.col("n"), F.col("pos"), F.col("reach"), F.col("last")
    left = F.count("*").over(Window.partitionBy("key"))
    # Where a prefix ends, in the upper half of the place: of two that agree there neither is first.
    end = F.shiftright(F.element_at("prefix", -1), 32).cast("int")
    # Partners' prefixes share LEAD tokens or all they need, so a class with fewer left has none.
    cells = settle(
        rows.select("key", "n", "grp", end.alias("last"), F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "token"))
        .join(broadcast_if_small(shared), "token").distinct()
        .withColumn("left", left).where(F.col("left") >= F.least(F.ceil(n * NUM / DEN), F.lit(LEAD)))
        .withColumn("reach", n - F.col("p") + F.col("left")).drop("p", "left")
    )
    matrix = cells.groupBy("token", F.col("grp").alias("other")).agg(
        F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.max("reach").alias("high_reach"),
        F.min("last").alias("low_last"), F.max("last").alias("high_last"), F.max(n - pos).alias("left"),
    )
    asked = cells.where(pos < n - _need(n, n) + LEAD)

    def possible(partner_n: Column, partner_reach: Column, low_last: Column, high_last: Column, partner_left: Column) -> Column:
        """The token is in both prefixes, and both sets have enough tokens left; dropped tokens
        count only for the set whose prefix ends first."""
        need = _need(n, partner_n)
        lead = F.least(need, F.lit(LEAD))
        return (
            (pos < n - need + lead) & (partner_left > need - lead)
            & ((last >= low_last) | (reach >= need)) & ((high_last >= last) | (partner_reach >= need))
        )

    def enough(partner_n: Column) -> Column:
        return F.least(_need(n, partner_n), F.lit(LEAD))

    # Of two partners, the smaller set asks.
    least_n = F.greatest("low_n", "n")
    opened = (
        asked.join(matrix, "token")
        .where((F.col("grp") != F.col("other")) & (F.col("high_n") >= n) & (F.col("low_n") * NUM <= n * DEN))
        .where(possible(least_n, F.col("high_reach"), F.col("low_last"), F.col("high_last"), F.col("left")))
        .groupBy("key", "other").agg(F.count("*").alias("shared"), F.min(enough(least_n)).alias("enough"))
        .where("shared >= enough").select("key", "other")
    )
    names = cells.groupBy(F.col("grp").alias("other")).agg(F.min("key").alias("low_key"), F.max("key").alias("high_key"))
    opened = settle(opened.join(names, "other"))
    # A group of one class has been tested as such; in others the members are.
    alone = opened.where("low_key = high_key").select("key", F.col("low_key").alias("partner"))
    members = cells.select(
        "token", F.col("grp").alias("other"), F.col("key").alias("partner"), F.col("n").alias("partner_n"),
        F.col("reach").alias("partner_reach"), F.col("last").alias("partner_last"), (n - pos).alias("partner_left"),
    )
    partner_n, partner_last = F.col("partner_n"), F.col("partner_last")
    inside = (
        asked.join(opened.where("low_key <> high_key").select("key", "other"), "key")
        .join(members, ["token", "other"])
        .where((partner_n >= n) & _could_match(n, partner_n))
        .where(possible(partner_n, F.col("partner_reach"), partner_last, partner_last, F.col("partner_left")))
        .groupBy("key", "partner").agg(F.count("*").alias("shared"), F.first(enough(partner_n)).alias("enough"))
        .where("shared >= enough").select("key", "partner")
    )
    return alone.unionByName(inside).select(
        F.greatest("key", "partner").alias("a"), F.least("key", "partner").alias("b")
    ).distinct()


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, n_copies`` and ``root``, the smallest class that
    links lead to (NULL without shingles)."""
    corpus = _Corpus(docs, doc_id, text)
    certain = settle(corpus.links(_pivot_pairs(corpus)))
    groups = settle(components(certain))
    # A group's name is a hash of its root: 8 bytes instead of 16 beside every token.
    named = groups.select(F.col("node").alias("key"), F.xxhash64("root").alias("grp"))
    more = corpus.links(_matrix_pairs(corpus, named))
    joined = components(certain.unionByName(more))

    ids = corpus.rows.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")
    )
    ids = settle(
        ids.join(joined, ids["key"] == joined["node"], "left")
        .select("key", "first_id", "n_copies", F.coalesce("root", "key").alias("root"))
    )
    lowest = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = ids.join(lowest, "root")
    rows = corpus.rows.select("doc_id", "row", "key", F.col("n").alias("n_shingles"))
    return rows.join(ids, "key", "left").select(
        "doc_id", "row", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"), "root",
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id
    that links lead to), ``n_copies`` (rows with the same shingles, itself included).

    Words are runs of anything but ASCII white space, A-Z lower-cased. NULL and empty texts, and
    texts of white space, have no shingles and are linked with nothing. Documents without an id
    lend none: a component of such documents alone has NULL. Repeated rows are copies.
    """
    return _labelled(docs, doc_id, text).drop("row", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, then
    the smallest content. Rows without an id come last. Texts without shingles all stay.
    """
    found = settle(_labelled(docs, doc_id, text).where("root is not null").select("doc_id", "row", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = found.groupBy("root").agg(F.min(order)["row"].alias("first"))
    gone = settle(found.join(first, "root").where("row <> first").select(F.col("row").alias("_gone")).distinct())
    repeated = settle(found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("_again")))
    row = digest_of(docs[doc_id], docs[text].cast("string"))
    kept = docs.join(broadcast_if_small(gone), row == gone["_gone"], "left_anti")
    if repeated.isEmpty():
        return kept
    again = broadcast_if_small(repeated)
    same = digest_of(kept[doc_id], kept[text].cast("string")) == repeated["_again"]
    once = kept.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(again, same, "left_anti").unionByName(once)
