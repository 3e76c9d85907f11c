"""Benchmark decontamination: find and remove passages of test items.

The test items' windows of ``n`` normalised words become a set of 64-bit hashes that is broadcast,
as sorted arrays beside the items' text. Every document's windows are looked up in it, a block of
documents at a time; what is found is verified word by word. Documents are never shuffled.

Of a benchmark of more than ``SLICE_BYTES`` of text one slice is collected, broadcast and scanned
for at a time; what it finds is written beside the documents before the next one, and its broadcast
is given up. So a larger benchmark costs passes, not memory: arrays take about five times the text.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rolefeed.llm import words as W
from rolefeed.llm.rows import add_columns, fresh, give_back
from rolefeed.session import settle

WINDOW = 10
SLICE_BYTES = 8 << 20
REMEMBERED = 4096  # hit windows whose items a worker keeps at hand

FOUND = ("n_words", "hits", "hit_items")


def _schema(names=FOUND) -> StructType:
    kinds = LongType(), ArrayType(IntegerType()), ArrayType(StringType())
    return StructType([StructField(name, kind) for name, kind in zip(names, kinds)])


class Windows:
    """Windows of some items. ``by_length``: for every length in words, sorted hashes, each with the
    place of its first word and its item. Words are ranges of one lower-cased text."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.ids = [i for i, _ in items]
        texts, starts, ends, size, words = [], [], [], 0, 0
        parts = defaultdict(list)
        for block in W.hashed_words(pa.array([t for _, t in items], pa.large_string()), W.ALPHANUMERIC):
            texts.append(block.data.tobytes().lower())
            starts.append(block.starts + size)
            ends.append(block.ends + size)
            for i in range(len(block)):
                a, b = int(block.bounds[i]), int(block.bounds[i + 1])
                if a < b:
                    hashes = W.runs(block.hashes[a:b], min(n, b - a))
                    parts[min(n, b - a)].append((hashes, words + a + np.arange(len(hashes)), np.full(len(hashes), block.first + i)))
            size, words = size + len(texts[-1]), words + len(block.starts)
        self.text = b"".join(texts)
        place = np.int32 if size < 1 << 31 else np.int64
        self.starts, self.ends = (np.concatenate([np.empty(0, dtype=np.int64), *x]).astype(place) for x in (starts, ends))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, found in parts.items():
            hashes, at, item = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(hashes, kind="stable")
            self.by_length[k] = hashes[order], at[order].astype(np.int32), item[order].astype(np.int32)
        self._known: dict[tuple[int, int], dict[bytes, frozenset[str]]] = {}

    def items(self, k: int, value: int, words: bytes) -> frozenset[str]:
        """Ids of the items that have a window of exactly these words, whose hash is ``value``."""
        known = self._known.get((k, value))
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            hashes, at, item = self.by_length[k]
            low, high = (int(np.searchsorted(hashes, np.uint64(value), side)) for side in ("left", "right"))
            found = defaultdict(set)
            for a, i in zip(at[low:high].tolist(), item[low:high].tolist()):
                spans = zip(self.starts[a:a + k].tolist(), self.ends[a:a + k].tolist())
                found[b" ".join(self.text[s:e] for s, e in spans)].add(self.ids[i])
            known = self._known[k, value] = {w: frozenset(names) for w, names in found.items()}
        return known.get(words, frozenset())


def _words(lowered: bytes, block: W.Words, at: int, k: int) -> bytes:
    starts, ends = block.starts[at:at + k].tolist(), block.ends[at:at + k].tolist()
    return b" ".join(lowered[s:e] for s, e in zip(starts, ends))


def _found(sorted_hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values that occur in a sorted set."""
    # A bitmap over the top bits settles nearly all of them without a search.
    bits = 22
    seen = np.zeros(1 << bits, dtype=bool)
    seen[sorted_hashes >> np.uint64(64 - bits)] = True
    likely = np.flatnonzero(seen[values >> np.uint64(64 - bits)])
    place = np.searchsorted(sorted_hashes, values[likely])
    place[place == len(sorted_hashes)] = 0
    return likely[sorted_hashes[place] == values[likely]]


def _scan_block(block: W.Words, windows: Windows) -> dict[int, tuple[np.ndarray, set[str]]]:
    """Per contaminated text: the positions of its hit words, and the items."""
    hits: dict[int, tuple[list, set[str]]] = {}
    lowered = None
    for k, (hashes, _, _) in windows.by_length.items():
        values = W.runs(block.hashes, k)
        if not len(values):
            continue
        places = _found(hashes, values)
        texts = np.searchsorted(block.bounds, places, side="right") - 1
        whole = places + k <= block.bounds[texts + 1]
        for at, i in zip(places[whole].tolist(), texts[whole].tolist()):
            lowered = lowered if lowered is not None else block.data.tobytes().lower()
            items = windows.items(k, int(values[at]), _words(lowered, block, at, k))
            if items:
                ranges, names = hits.setdefault(i, ([], set()))
                ranges.append((at - int(block.bounds[i]), k))
                names |= items
    return {
        i: (np.unique(np.concatenate([np.arange(a, a + k) for a, k in ranges])), names)
        for i, (ranges, names) in hits.items()
    }


def _scan(texts: pa.Array, windows: Windows, hits=None, names=None) -> list[pa.Array]:
    """The arrays of ``_schema``, joined with what earlier slices found."""
    counts = np.zeros(len(texts), dtype=np.int64)
    out_hits = hits.to_pylist() if hits is not None else [[] for _ in range(len(texts))]
    out_names = names.to_pylist() if names is not None else [[] for _ in range(len(texts))]
    for block in W.hashed_words(texts, W.ALPHANUMERIC):
        counts[block.first:block.first + len(block)] = np.diff(block.bounds)
        for i, (places, items) in _scan_block(block, windows).items():
            row = block.first + i
            out_hits[row] = sorted({*out_hits[row], *places.tolist()})
            out_names[row] = sorted({*out_names[row], *items})
    return [
        pa.array(counts), pa.array(out_hits, pa.list_(pa.int32())), pa.array(out_names, pa.list_(pa.string())),
    ]


def item_windows(benchmark: DataFrame, n: int = WINDOW, item_id: str = "item_id", text: str = "text",
                 slice_bytes: int = SLICE_BYTES) -> tuple[int, Iterator[Broadcast]]:
    """How many slices a benchmark has, and the windows of each as a broadcast variable, made when it
    is asked for.

    Items are dealt to slices by hash, by the measured size of the texts and with room for chance.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    items = items.where("id is not null and text is not null")
    total = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    parts = 1 if total <= slice_bytes else -(-5 * total // (4 * slice_bytes))

    def made():
        for part in range(parts):
            one = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
            yield spark.sparkContext.broadcast(Windows([(r.id, r.text) for r in one.toLocalIterator()], n))

    return parts, made()


def _found_in(docs: DataFrame, text: str, slices: tuple[int, Iterator[Broadcast]], names=FOUND) -> DataFrame:
    """``docs`` with the columns of ``_schema``. With several slices the rows are written after each."""
    parts, windows = slices
    out = docs
    for number, part in enumerate(windows):
        inputs = [out[text], *([out[names[1]], out[names[2]]] if number else [])]
        out = add_columns(out, inputs, _schema(names), lambda a, p=part: _scan(a[0], p.value, *a[1:]))
        if parts > 1:
            out = settle(out)
            part.destroy()
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (positions of words inside an item's window) and
    ``hit_items`` (ids of those items, sorted as strings).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item of fewer
    than ``n`` words is one window; one without words has none. NULL texts have no words, items
    without an id take no part, items with the same id are one. An empty benchmark hits nothing.
    """
    return _found_in(docs, text, item_windows(benchmark, n, item_id, item_text, slice_bytes))


def _without(text: str, hits) -> str:
    """``text`` without the words at some positions and what lies between neighbouring ones."""
    block = next(W.hashed_words(pa.array([text], pa.large_string()), W.ALPHANUMERIC))
    hits = np.asarray(sorted(hits))
    breaks = np.flatnonzero(np.diff(hits) > 1)
    firsts, lasts = hits[np.r_[0, breaks + 1]], hits[np.r_[breaks, len(hits) - 1]]
    raw, kept, at = block.data.tobytes(), [], 0
    for a, b in zip(block.starts[firsts].tolist(), block.ends[lasts].tolist()):
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def _cut(text: str, windows: Windows, hits) -> str:
    """``text`` without its hit words, until nothing is hit: words that were apart may form a window."""
    while hits is not None:
        text = _without(text, hits)
        again = next(W.hashed_words(pa.array([text], pa.large_string()), W.ALPHANUMERIC))
        hits, _ = _scan_block(again, windows).get(0, (None, None))
    return text


def _replaced(texts: pa.Array, changed: dict[int, str]) -> list[pa.Array]:
    """``texts`` with some of them changed; the others are not copied into Python objects."""
    if not changed:
        return [texts]
    rows = sorted(changed)
    mask = np.zeros(len(texts), dtype=bool)
    mask[rows] = True
    return [pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in rows], texts.type))]


def _cut_all(texts: pa.Array, windows: Windows) -> list[pa.Array]:
    give_back()
    changed = {}
    for block in W.hashed_words(texts, W.ALPHANUMERIC):
        for i, (places, _) in _scan_block(block, windows).items():
            changed[block.first + i] = _cut(texts[block.first + i].as_py(), windows, places.tolist())
    return _replaced(texts, changed)


def _cut_hits(texts: pa.Array, hits: pa.Array) -> list[pa.Array]:
    found = ((i, h) for i, h in enumerate(hits.to_pylist()) if h)
    return _replaced(texts, {i: _without(texts[i].as_py(), h) for i, h in found})


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` without the passages of test items; the columns stay. A document of nothing but
    test items keeps what stands around its words.

    A text is cut for all items at once and scanned for all of them again until none hits it, so
    the number of slices does not change the result. With several slices, what was cut is scanned
    again in a round of its own.
    """
    def slices():
        return item_windows(benchmark, n, item_id, item_text, slice_bytes)

    # The new text takes the place of the old one, which so travels to Python once and not back.
    schema = StructType([StructField(text, StringType())])
    parts, windows = slices()
    if parts == 1:
        only = next(windows)
        cut = add_columns(docs, [docs[text].cast("string")], schema, lambda a: _cut_all(a[0], only.value))
        return cut.select(*docs.columns)
    names, clean, todo = [fresh(c) for c in FOUND], [], docs.withColumn(text, docs[text].cast("string"))
    while True:
        found = _found_in(todo, text, slices(), names)
        hit = F.size(names[1]) > 0
        clean.append(found.where(~hit).select(*docs.columns))
        dirty = found.where(hit)
        if dirty.isEmpty():
            return functools.reduce(DataFrame.union, clean)
        cut = add_columns(dirty, [dirty[text], dirty[names[1]]], schema, lambda a: _cut_hits(a[0], a[1]))
        todo = settle(cut.select(*docs.columns))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, **options) -> DataFrame:
    """``docs`` without contaminated documents."""
    found = find_contamination(docs, benchmark, n, **options)
    return found.where(F.size("hits") == 0).select(*docs.columns)


def items_sha256(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One digest row per document."""
    return find_contamination(docs.select("doc_id", "text"), benchmark, **options).select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        items_sha256(F.col("hit_items")).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
