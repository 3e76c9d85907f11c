"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its pairs of neighbouring bytes, hashed into ``TERMS`` bins. Term counts are
weighted by log(1 + count) and inverse document frequency over the whole corpus, and projected on
the leading singular vectors of the labelled sample. The sample's vectors are broadcast; every
document is compared with all of them, a block of documents at a time.

Bounds: at most ``SAMPLE_PER_CLASS`` labelled rows of each class are learned from (those with the
smallest hash of their id), so what is collected and broadcast is of fixed size. Frequencies are
counted over all documents.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolefeed.llm.rows import add_columns, give_back

TERMS = 2048
DIMENSIONS = 48
SAMPLE_PER_CLASS = 1500
NEIGHBOURS = 25
ACCEPT = 0.3
HELD_OUT = 5  # documents whose crc32(doc_id) mod 5 is 0 are never learned from
BLOCK_ROWS = 512
BLOCK_BYTES = 4 << 20
STEP_BYTES = 256 << 10  # text counted at once; its arrays take about 40 times that

_pairs = np.arange(1 << 16, dtype=np.uint64)
_TERM = ((_pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64)


def _count_block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts, rows x TERMS, of texts that lie in ``data`` one behind the other. Bytes are
    taken in steps, so a long text costs no more memory than a short one."""
    counts = np.zeros((len(offsets) - 1, TERMS), dtype=np.int32)
    for start in range(int(offsets[0]), int(offsets[-1]) - 1, STEP_BYTES):
        # The pairs that begin in this step; the last one's second byte is the next step's first.
        part = data[start:min(start + STEP_BYTES + 1, int(offsets[-1]))]
        rows = np.repeat(np.arange(len(counts)), np.diff(np.clip(offsets - start, 0, len(part))))
        same = rows[1:] == rows[:-1]
        term = _TERM[(part[:-1].astype(np.int64) << 8) | part[1:]]
        first, last = int(rows[0]), int(rows[-1]) + 1
        flat = ((rows[:-1] - first) * TERMS + term)[same]
        counts[first:last] += np.bincount(flat, minlength=(last - first) * TERMS).reshape(-1, TERMS)
    return counts


def _counts(texts: pa.Array):
    """Term counts of blocks of texts: first row and an array of rows x TERMS."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), len(texts), low + BLOCK_ROWS)
        yield low, _count_block(data, offsets[low:high + 1])
        low = high


def _frequency_rows(batches):
    total = np.zeros(TERMS, dtype=np.int64)
    n = 0
    for batch in batches:
        for _, counts in _counts(batch.column(0)):
            total += (counts > 0).sum(axis=0)
            n += len(counts)
        give_back()
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, TERMS)), pa.array(np.r_[n, total])], names=["term", "n"]
        )


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A weight per term from all documents; tasks send sums, never documents."""
    counted = docs.select(docs[text].cast("string").alias("text")).mapInArrow(_frequency_rows, "term bigint, n bigint")
    found = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = found.get(-1, 0)
    return np.array([np.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in range(TERMS)], dtype=np.float32)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts.astype(np.float32)) * idf)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # the sample, unit rows
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of the weight of the nearest labelled vectors that says 1. A text without terms
        is near nothing and gets the sample's share."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        share = (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, per_class: int) -> DataFrame:
    """``label, text`` of at most ``per_class`` learnable rows of each class."""
    known = (
        labels.select(labels[doc_id].alias("id"), labels[label].cast("double").alias("label"))
        .where("id is not null and label is not null").where(~held_out(F.col("id")))
        .groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    present = known.join(docs.select(docs[doc_id].alias("id")), "id", "left_semi")
    parts = [
        present.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])
    source = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text"))
    # At most 2 x per_class ids, so they may be broadcast.
    return source.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.first("label").alias("label"), F.min("text").alias("text")
    ).orderBy("id").select("label", "text")


def _features(texts: pa.Array) -> list[pa.Array]:
    rows = []
    for _, counts in _counts(texts):
        rows += [c.astype("<u4").tobytes() for c in counts]
    give_back()
    return [pa.array(rows, pa.binary())]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
        per_class: int = SAMPLE_PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from ``labels`` (``doc_id`` and a 0/1 column). Labels of held-out, unknown and
    NULL documents are not used; of repeated labels of a document the mean counts."""
    idf = inverse_frequencies(docs, text)
    sample = _sample(docs, labels, label, doc_id, text, per_class)
    rows = add_columns(sample, [sample["text"]], "counts binary", lambda a: _features(a[0])).select("label", "counts").collect()
    if not rows:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.stack([np.frombuffer(r.counts, "<u4") for r in rows])
    x = _weighted(counts, idf)
    values, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    axes = vectors[:, np.argsort(-values)[:dimensions]].astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), np.array([r.label for r in rows], dtype=np.float64))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``. Only the text decides. NULL and empty
    texts get the sample's share of label 1; without any label all get 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrays):
        scores = np.zeros(len(arrays[0]))
        for low, counts in _counts(arrays[0]):
            scores[low:low + len(counts)] = sent.value.score(counts)
        give_back()
        return [pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))]

    given = text if text in docs.columns and docs.schema[text].dataType == StringType() else docs[text].cast("string")
    return add_columns(docs, [given], "score double, predicted int", run)
