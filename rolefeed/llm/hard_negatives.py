"""Hard negatives: rows of another label that score almost like an anchor's positives.

Every row gets a few one-bit codes. A code is the signs of the row's components after a random
rotation, that is a unit vector with components of equal size; stored with it is its alignment,
the inner product of code vector and row. What the code leaves of the row is coded again, after
another rotation, and the length of what the last code leaves is stored too.

An anchor's inner product with a code vector comes from popcounts: its rotated components are
rounded to eight bits, and each bit plane is intersected with the code. Alignments turn these into
an estimate of the score. By Cauchy-Schwarz, what is left of the row adds at most its length times
the length of the part of the anchor that the code does not see; with the rounding of the anchor
this bounds the score from both sides, without exception. Pairs whose interval misses what is asked
for go after the first code that shows it; all others are scored in whole numbers.

Anchors are taken in waves of at most ``WAVE``, which are broadcast; rows are coded once, stay
where they are and are never shuffled. Tasks keep the best few results per anchor, and only those
meet in a shuffle.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefeed.llm.vectors import as_doubles, is_finite, matrix, shape_of
from rolefeed.session import settle

SCALE = 256
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100  # per cent of the positive's score
LEVELS = 4
PLANES = 8
WAVE = 16_384
BLOCK_ROWS = 4096
ANCHOR_ROWS = 128

_LEAST = -(1 << 62)
BLOCK = "ids binary, labels binary, rows binary, codes binary, aligned binary, rests binary"


class Coder:
    """Rotations of one dimension, and the codes they give."""

    def __init__(self, dimensions: int, levels: int = LEVELS, seed: int = 5):
        random = np.random.default_rng(seed)
        self.dimensions, self.levels = dimensions, levels
        self.words = -(-dimensions // 64)
        self.rotations = [np.linalg.qr(random.standard_normal((dimensions, dimensions)))[0] for _ in range(levels)]

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), dtype=bool)
        wide[:, :self.dimensions] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (levels x rows x words), alignments (levels x rows), and the length of what is
        left after each level (levels x rows)."""
        left, unit = rows.astype(np.float64), 1 / np.sqrt(self.dimensions)
        codes, aligned, rests = [], [], []
        for rotation in self.rotations:
            turned = left @ rotation.T
            bits = turned > 0
            along = np.abs(turned).sum(axis=1) * unit
            left = left - (np.where(bits, unit, -unit) * along[:, None]) @ rotation
            codes.append(self._packed(bits))
            aligned.append(along)
            rests.append(np.sqrt((left * left).sum(axis=1)))
        return np.array(codes), np.array(aligned), np.array(rests)

    def planes(self, rows: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Per level, the anchors as bit planes (rows x planes x words), the sum of their rounded
        components, what one unit of these stands for, and the length that rounding left out."""
        out, middle = [], 1 << (PLANES - 1)
        for rotation in self.rotations:
            turned = rows.astype(np.float64) @ rotation.T
            unit = np.maximum(np.abs(turned).max(axis=1), 1e-300) / (middle - 1)
            rounded = np.rint(turned / unit[:, None])
            lost = turned - rounded * unit[:, None]
            shifted = rounded.astype(np.int64) + middle
            planes = np.stack([self._packed((shifted >> b) & 1 == 1) for b in range(PLANES)], axis=1)
            out.append((planes, rounded.sum(axis=1), unit, np.sqrt((lost * lost).sum(axis=1))))
        return out


class Block(NamedTuple):
    """Coded rows."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    codes: np.ndarray
    aligned: np.ndarray
    rests: np.ndarray


class Anchors:
    """A wave of anchors, ready to be compared with coded rows."""

    def __init__(self, coder: Coder, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.coder, self.ids, self.labels, self.rows = coder, ids, labels, rows
        self.lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.levels = coder.planes(rows)

    def _counted(self, level: int, anchors, codes: np.ndarray) -> np.ndarray:
        """Inner products of rounded anchors and code vectors, by popcounts. ``anchors`` and
        ``codes`` select pairs that numpy broadcasts."""
        planes, sums, _, _ = self.levels[level]
        total = None
        for word in range(codes.shape[-1]):
            part = -(1 << (PLANES - 1)) * np.bitwise_count(codes[..., word]).astype(np.int32)
            total = part if total is None else total + part
            for b in range(PLANES):
                hits = np.bitwise_count(planes[anchors, b, word] & codes[..., word])
                total = total + (hits.astype(np.int32) << b)
        return 2.0 * total - sums[anchors]

    def survivors(self, low: int, high: int, block: Block, wanted: np.ndarray, possible) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the anchors ``low:high`` and a block's rows that no code rules out: places of
        anchors and of rows. ``possible(anchors, least, most)`` says which intervals matter."""
        unit = 1 / np.sqrt(self.coder.dimensions)
        anchors, rows = np.arange(low, high)[:, None], np.arange(len(block.ids))[None, :]
        estimate = error = 0.0
        for level in range(self.coder.levels):
            _, _, step, lost = self.levels[level]
            along = block.aligned[level][rows]
            seen = self._counted(level, anchors, block.codes[level][rows]) * (step[anchors] * unit)
            estimate = estimate + along * seen
            error = error + along * lost[anchors]
            unseen = self.lengths[anchors] ** 2 - np.maximum(np.abs(seen) - lost[anchors], 0) ** 2
            slack = np.sqrt(np.maximum(unseen, 0)) * block.rests[level][rows]
            # What floating point may have lost, many times over.
            slack = slack + 1e-9 * (np.abs(estimate) + self.lengths[anchors] * (along + block.rests[level][rows])) + 1e-6
            alive = possible(anchors, estimate - error - slack, estimate + error + slack)
            if level == 0:
                anchors, rows = np.nonzero(alive & wanted)
                estimate, error, anchors = estimate[anchors, rows], error[anchors, rows], anchors + low
            else:
                anchors, rows, estimate, error = anchors[alive], rows[alive], estimate[alive], error[alive]
        return anchors, rows

    def scores(self, anchors: np.ndarray, block: Block, rows: np.ndarray) -> np.ndarray:
        """Inner products of pairs in whole numbers."""
        out = np.empty(len(anchors), dtype=np.int64)
        for at in range(0, len(anchors), 1 << 15):
            part = slice(at, at + (1 << 15))
            out[part] = np.einsum("ij,ij->i", self.rows[anchors[part]], block.rows[rows[part]])
        return out


class Best:
    """The best ``k`` results of each of some groups: higher scores first, ties by smaller id. An id
    counts once, with its best score."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group = self.id = self.score = np.empty(0, dtype=np.int64)
        self.least = np.full(groups, _LEAST, dtype=np.int64)  # the k-th score, if there are k

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(group):
            return
        group, ids, score = (np.concatenate(x) for x in ((self.group, group), (self.id, ids), (self.score, score)))
        order = np.lexsort((-score, ids, group))
        group, ids, score = group[order], ids[order], score[order]
        once = np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])]
        group, ids, score = group[once], ids[once], score[once]
        order = np.lexsort((ids, -score, group))
        group, ids, score = group[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        kept = place < self.k
        self.group, self.id, self.score = group[kept], ids[kept], score[kept]
        last = place == self.k - 1
        self.least[group[last]] = score[last]


def _usable(df: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    rows = df.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"),
        as_doubles(F.col(vector_column)).alias("v"),
    )
    return rows.where("id is not null and label is not null").where(is_finite(F.col("v")))


def _coded(rows: DataFrame, coder: Coder, stored: np.dtype) -> DataFrame:
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                x = matrix(part.column(2), coder.dimensions)
                made = [part.column(0).to_numpy(), part.column(1).to_numpy(), x.astype(stored), *coder.codes(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in made], names=["ids", "labels", "rows", "codes", "aligned", "rests"])

    return settle(rows.mapInArrow(run, BLOCK))


def _blocks(batches, coder: Coder, stored: np.dtype):
    for batch in batches:
        for ids, labels, rows, codes, aligned, rests in zip(*(column.to_pylist() for column in batch.columns)):
            ids = np.frombuffer(ids, np.int64)
            n = len(ids)
            yield Block(
                ids, np.frombuffer(labels, np.int64), np.frombuffer(rows, stored).astype(np.int64).reshape(n, -1),
                np.frombuffer(codes, "<u8").reshape(coder.levels, n, coder.words),
                np.frombuffer(aligned, np.float64).reshape(coder.levels, n),
                np.frombuffer(rests, np.float64).reshape(coder.levels, n),
            )


def _nearest_of_label(blocks: DataFrame, sent, stored: np.dtype, k: int) -> DataFrame:
    """``anchor_id, id, score``: the best ``k`` other rows of each anchor's own label."""
    def run(batches):
        wave = sent.value
        best = Best(len(wave.ids), k)
        for block in _blocks(batches, wave.coder, stored):
            for low in range(0, len(wave.ids), ANCHOR_ROWS):
                high = min(low + ANCHOR_ROWS, len(wave.ids))
                wanted = (wave.labels[low:high, None] == block.labels) & (wave.ids[low:high, None] != block.ids)
                anchors, rows = wave.survivors(
                    low, high, block, wanted, lambda a, least, most: most >= best.least[a])
                best.add(anchors, block.ids[rows], wave.scores(anchors, block, rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(wave.ids[best.group]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "id", "score"])

    found = blocks.mapInArrow(run, "anchor_id bigint, id bigint, score bigint")
    once = found.groupBy("anchor_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


class Windows(NamedTuple):
    """What each positive of each anchor of a wave asks for."""

    anchors: Anchors
    positive_ids: np.ndarray  # anchors x positives
    positive_scores: np.ndarray
    least: np.ndarray  # bounds of a negative's score; none fits where least > most
    most: np.ndarray


def _windows(anchors: Anchors, positives: pa.Table, k: int, low: int, high: int) -> Windows:
    shape = (len(anchors.ids), k)
    ids, scores = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
    least, most = np.ones(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
    place_of, filled = {a: i for i, a in enumerate(anchors.ids.tolist())}, np.zeros(shape[0], dtype=np.int64)
    for anchor, row, score in zip(*(column.to_pylist() for column in positives.columns)):
        a = place_of[anchor]
        j, filled[a] = filled[a], filled[a] + 1
        ids[a, j], scores[a, j] = row, score
        least[a, j], most[a, j] = -(-(low * score) // 100), (high * score) // 100
    return Windows(anchors, ids, scores, least, most)


RESULT = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"


def _negatives(blocks: DataFrame, sent, stored: np.dtype, k: int) -> DataFrame:
    def run(batches):
        wave, ids, scores, least, most = sent.value
        each = ids.shape[1]
        best = Best(ids.size, k)

        def possible(anchors, low, high):
            floor = np.maximum(least, best.least.reshape(least.shape))
            out = False
            for j in range(each):
                open_ = least[:, j] <= most[:, j]
                out = out | ((high >= floor[anchors, j]) & (low <= most[anchors, j]) & open_[anchors])
            return out

        for block in _blocks(batches, wave.coder, stored):
            for low in range(0, len(wave.ids), ANCHOR_ROWS):
                high = min(low + ANCHOR_ROWS, len(wave.ids))
                wanted = wave.labels[low:high, None] != block.labels
                anchors, rows = wave.survivors(low, high, block, wanted, possible)
                score = wave.scores(anchors, block, rows)
                for j in range(each):
                    fits = (score >= least[anchors, j]) & (score <= most[anchors, j])
                    best.add(anchors[fits] * each + j, block.ids[rows[fits]], score[fits])
        a, j = np.divmod(best.group, each)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (wave.ids[a], ids[a, j], best.id, scores[a, j], best.score)],
            names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = blocks.mapInArrow(run, RESULT)
    once = found.groupBy("anchor_id", "positive_id", "negative_id", "positive_score").agg(F.max("negative_score").alias("negative_score"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, levels: int = LEVELS, wave: int = WAVE,
         id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component ``x`` counts as ``floor(scale * x)``; a score is the inner product of such vectors.
    An anchor's positives are the ``positives`` best other rows of ``vectors`` with its label. For
    each, the result holds the best ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` per cent of the positive's (none, if that is negative). Ties go to the
    smaller id. Anchors need not be rows of ``vectors``; a row with the anchor's id is no positive.

    Rows without an id or a label, and vectors that are NULL, empty or hold a NULL or non-finite
    component, take no part, nor do those of another length than most rows have (of equally
    frequent lengths the largest). Zero vectors do. Rows that share an id count once per result,
    with their best score; of anchors that share one the largest label, then vector, counts.
    Other columns do not matter. Scores that could leave bigint raise an error.
    """
    spark = vectors.sparkSession
    rows, asked = (_usable(df, id_column, label_column, vector_column) for df in (vectors, anchors))
    shape = shape_of(rows, "v")
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if shape is None:
        return empty
    d, whole = shape.dimensions, F.transform("v", lambda x: F.floor(x * scale).cast("bigint"))
    rows, asked = (df.where(F.size("v") == d).select("id", "label", whole.alias("x")) for df in (rows, asked))
    asked = settle(asked.groupBy("id").agg(F.max(F.struct("label", "x")).alias("one")).select("id", "one.*"))
    size = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.abs(x)))
    found = asked.agg(F.count("*").alias("n"), F.max(size).alias("largest")).first()
    if not found.n:
        return empty
    largest = int(shape.largest * scale) + 1
    if largest * found.largest * d * max(100, low, high) >= -_LEAST:
        raise ValueError("scores of these vectors do not fit a bigint")
    stored = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8")
    coder = Coder(d, levels)
    blocks = _coded(rows, coder, stored)
    waves, out = -(-found.n // wave), []
    for number in range(waves):
        # Ids are distinct here, so their hashes spread anchors evenly over waves.
        part = asked if waves == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == number)
        table = part.toArrow()
        if not table.num_rows:
            continue
        taken = table.combine_chunks()
        some = Anchors(coder, taken["id"].to_numpy(), taken["label"].to_numpy(), matrix(taken["x"].combine_chunks(), d))
        sent = spark.sparkContext.broadcast(some)
        near = _nearest_of_label(blocks, sent, stored, positives).toArrow()
        sent.destroy()
        sent = spark.sparkContext.broadcast(_windows(some, near, positives, low, high))
        out.append(settle(_negatives(blocks, sent, stored, negatives)))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, out, empty)
