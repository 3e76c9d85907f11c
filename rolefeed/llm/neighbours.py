"""Nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and are all that is broadcast. Every row is sent to one
leaf of each tree. A query walks all trees at once through one priority queue, which always opens
the node, of whatever tree, whose splits the query is farthest inside of or least beyond; the
leaves it reaches first are searched. Queries and rows meet by a join on (tree, leaf), as blocks
of bounded size, and candidates are ranked by their exact inner product in double precision.

Inner products are made comparable to angles by one more component: rows are lifted to equal
length, queries get 0 there.

Bounds: the forest is fitted on at most ``SAMPLE`` rows (those with the smallest hash of their
id) and has at most ``SAMPLE / 32`` leaves a tree. All rows are indexed and may be found.

Every tree holds a copy of all vectors, and every probe a copy of a query, so both are few: two
trees of large leaves, of which a query searches a fixed share. What is found then does not
depend on the number of rows. Vectors travel in the precision they are stored in.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

SAMPLE = 16_384
TREES = 2
LEAF_ROWS = 800
SHARE = 0.52  # of all trees' leaves: how many a query searches
BLOCK_ROWS = 4096
HELD_ROWS = 1 << 19  # results that a task holds to compare them
SALTS = 4  # a leaf's rows are gathered in so many tasks

BLOCK = "tree int, leaf int, ids binary, vectors binary"


class Forest(NamedTuple):
    """Complete binary trees. Node ``i`` has children ``2i + 1`` and ``2i + 2``; ``planes`` has
    unit normals, one row per node of every tree, and ``cuts`` the offsets."""

    planes: np.ndarray  # trees x nodes x (dimensions + 1)
    cuts: np.ndarray  # trees x nodes
    depth: int
    longest: float  # squared length of the longest row

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (rows * rows).sum(axis=1), 0))
        return np.column_stack([rows, rest])

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: trees x rows."""
        lifted = self.lift(rows)
        out = np.zeros((len(self.planes), len(rows)), dtype=np.int64)
        for tree in range(len(self.planes)):
            node = out[tree]
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", lifted, self.planes[tree][node]) > self.cuts[tree][node]
                node[:] = 2 * node + 1 + side
        return out - ((1 << self.depth) - 1)

    def probes(self, query: np.ndarray, many: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves to search, nearest first."""
        inner = (1 << self.depth) - 1
        if not inner:
            return [(0, 0)]
        margins = self.planes[:, :, :-1] @ query - self.cuts
        queue = [(-np.inf, tree, 0) for tree in range(len(self.planes))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < many:
            far, tree, node = heapq.heappop(queue)
            if node >= inner:
                found.append((tree, node - inner))
                continue
            margin = float(margins[tree, node])
            heapq.heappush(queue, (max(far, -margin), tree, 2 * node + 2))
            heapq.heappush(queue, (max(far, margin), tree, 2 * node + 1))
        return found


def grow(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
         seed: int = 11) -> Forest:
    """Trees over a sample of a table of ``rows`` rows. A node splits its sample in half, across
    the direction between two of its members."""
    wanted = min(rows // leaf_rows, len(sample) // 32)
    depth = max(0, int(wanted).bit_length() - 1)
    inner = (1 << depth) - 1
    base = Forest(np.zeros((trees if inner else 1, inner, sample.shape[1] + 1)), np.zeros((trees if inner else 1, inner)), depth, longest)
    lifted = base.lift(sample) if len(sample) else np.zeros((0, sample.shape[1] + 1))
    random = np.random.default_rng(seed)
    for tree in range(len(base.planes) if inner else 0):
        members = {0: np.arange(len(lifted))}
        for node in range(inner):
            own = members.pop(node)
            normal = random.standard_normal(lifted.shape[1])
            if len(own) > 1:
                a, b = lifted[random.choice(own, 2, replace=False)]
                if (a != b).any():
                    normal = a - b
            normal /= np.linalg.norm(normal)
            side = lifted[own] @ normal
            cut = float(np.median(side)) if len(own) else 0.0
            base.planes[tree, node], base.cuts[tree, node] = normal, cut
            members[2 * node + 1], members[2 * node + 2] = own[side <= cut], own[side > cut]
    return base


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimensions)


def _blocks(tree_leaf: np.ndarray, ids: np.ndarray, rows: np.ndarray):
    """Rows with equal (tree, leaf) as records of at most ``BLOCK_ROWS`` rows."""
    order = np.argsort(tree_leaf, kind="stable")
    keys, starts = np.unique(tree_leaf[order], return_index=True)
    stops = np.r_[starts[1:], len(order)]
    out = []
    for key, start, stop in zip(keys.tolist(), starts.tolist(), stops.tolist()):
        for low in range(start, stop, BLOCK_ROWS):
            at = order[low:min(low + BLOCK_ROWS, stop)]
            out.append((key >> 32, key & 0xFFFFFFFF, ids[at].tobytes(), rows[at].tobytes()))
    return out


def _record(blocks) -> pa.RecordBatch:
    trees, leaves, ids, vectors = zip(*blocks)
    return pa.RecordBatch.from_arrays(
        [pa.array(trees, pa.int32()), pa.array(leaves, pa.int32()), pa.array(ids, pa.binary()), pa.array(vectors, pa.binary())],
        names=["tree", "leaf", "ids", "vectors"],
    )


def _gathered(blocks: DataFrame) -> DataFrame:
    """Small blocks of a leaf put together, up to ``BLOCK_ROWS`` rows, in one pass over sorted
    blocks. Salted, so a leaf with very many rows is gathered by several tasks."""
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))

    def run(batches):
        key, ids, vectors, size = None, [], [], 0
        for batch in batches:
            for tree, leaf, salt, i, v in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "salt", "ids", "vectors"))):
                if key is not None and (key != (tree, leaf, salt) or size + len(i) // 8 > BLOCK_ROWS):
                    yield _record([(key[0], key[1], b"".join(ids), b"".join(vectors))])
                    ids, vectors, size = [], [], 0
                key = (tree, leaf, salt)
                ids.append(i)
                vectors.append(v)
                size += len(i) // 8
        if key is not None:
            yield _record([(key[0], key[1], b"".join(ids), b"".join(vectors))])

    placed = salted.repartition("tree", "leaf", "salt").sortWithinPartitions("tree", "leaf", "salt")
    return placed.mapInArrow(run, BLOCK)


def _search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """The ``k`` best rows of a block for each query of a block: query, row, score."""
    rough = queries @ rows.T
    rough[query_ids[:, None] == row_ids[None, :]] = -np.inf
    many = min(k, len(row_ids))
    least = np.partition(rough, len(row_ids) - many, axis=1)[:, len(row_ids) - many]
    # Rounding depends on a block's shape. What is near the cut is measured again, row by row.
    scale = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    out = []
    for i, row in enumerate(rough):
        at = np.flatnonzero((row >= least[i] - scale[i]) & np.isfinite(row))
        score = (rows[at] * queries[i]).sum(axis=1)
        best = np.lexsort((row_ids[at], -score))[:k]
        out.append((np.full(len(best), query_ids[i]), row_ids[at][best], score[best]))
    return [np.concatenate(x) for x in zip(*out)]


def _best(parts: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The ``k`` best of all results for each query, each row once: query, row, score."""
    query, row, score = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((-score, row, query))
    query, row, score = query[order], row[order], score[order]
    once = np.r_[True, (query[1:] != query[:-1]) | (row[1:] != row[:-1])]
    query, row, score = query[once], row[once], score[once]
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return [query[place < k], row[place < k], score[place < k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, share: float = SHARE,
            leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``k`` rows of ``vectors`` with the
    largest inner product that the forest finds, ties to the smaller id. A row with the query's
    own id is no candidate.

    Rows without an id, and vectors that are NULL, empty, zero or hold a NULL or non-finite
    component, take no part, nor do those of another length than most have (of equally frequent
    lengths the largest). Rows that share an id count once, with their best score.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_column).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where(
            F.col("id").isNotNull() & F.col("v").isNotNull()
        ).where(fine & F.exists("v", lambda x: x != 0))

    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries)
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(length2).alias("longest")).collect()
    shape = max(shapes, key=lambda r: (r.n, r.d), default=None)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if shape is None:
        return empty
    d = shape.d
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    forest = grow(_matrix(taken.column(0).combine_chunks(), d), shape.n, shape.longest, trees, leaf_rows)
    sent = spark.sparkContext.broadcast(forest)
    probes = int(np.ceil(share * len(forest.planes) * 2**forest.depth))
    kinds = [df.schema[vector_column].dataType for df in (vectors, queries)]
    exact = all(isinstance(t, ArrayType) and isinstance(t.elementType, FloatType) for t in kinds)
    stored = np.dtype("<f4" if exact else "<f8")  # of single-precision input nothing is lost

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
                leaves = sent.value.leaves(x)
                for tree, leaf in enumerate(leaves):
                    yield _record(_blocks((tree << 32) + leaf, ids, x.astype(stored)))

    def route(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), d)
                found = [sent.value.probes(q, probes) for q in x]
                place = np.repeat(np.arange(len(x)), [len(f) for f in found])
                keys = np.array([(t << 32) + leaf for f in found for t, leaf in f], dtype=np.int64)
                yield _record(_blocks(keys, ids[place], x.astype(stored)[place]))

    row_blocks = _gathered(rows.mapInArrow(index, BLOCK)).select("tree", "leaf", "ids", "vectors")
    query_blocks = _gathered(asked.mapInArrow(route, BLOCK)).select(
        "tree", "leaf", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    pairs = row_blocks.join(query_blocks, ["tree", "leaf"]).select("ids", "vectors", "q_ids", "q_vectors")

    def search(batches):
        held, size = [], 0

        def record(part):
            return pa.RecordBatch.from_arrays([pa.array(p) for p in part], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for ids, x, q_ids, q in zip(*(c.to_pylist() for c in batch.columns)):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x, q = (np.frombuffer(v, stored).astype(np.float64).reshape(-1, d) for v in (x, q))
                for low in range(0, len(q_ids), 256):
                    held.append(_search(q[low:low + 256], q_ids[low:low + 256], x, ids, k))
                    size += len(held[-1][0])
                    if size >= HELD_ROWS:
                        held = [_best(held, k)]
                        size = len(held[0][0])
                        if 2 * size >= HELD_ROWS:
                            yield record(held[0])
                            held, size = [], 0
        if size:
            yield record(_best(held, k))

    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
