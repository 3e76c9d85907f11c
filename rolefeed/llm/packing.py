"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Spark tokenizes, cuts and counts; the plan (``packing_plan``) is made from the histogram of piece
lengths, which has at most ``capacity`` rows at any size of the corpus. Each piece then finds its
place by its rank among the pieces of its length, so no piece passes the driver. Ranks are counted
in shares of a length, so a length that a third of all pieces have is split over tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefeed.llm.packing_plan import Filling, plan
from rolefeed.llm.rows import add_columns, fresh, give_back
from rolefeed.llm.tokens import default_vocabulary, encoder
from rolefeed.session import settle

CAPACITY = 4096
END_ID = 1
# Pieces of one length that one task ranks.
SHARE = 20_000

PIECES = "cuts array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>"


def _cut(texts: pa.Array, path: str, capacity: int, end_id: int, with_ids: bool) -> list[pa.Array]:
    rows = []
    end = np.array([end_id], dtype="<u4")
    for _, ids, bounds in encoder(path).encode_all(texts):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            whole = np.concatenate([ids[a:b], end])
            cuts = []
            for piece, start in enumerate(range(0, len(whole), capacity)):
                part = whole[start:start + capacity]
                cuts.append({
                    "piece": piece, "start": start, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes()),
                    "ids": part.view(np.int32) if with_ids else None,
                })
            rows.append(cuts)
    kind = pa.list_(pa.struct([
        ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
    ]))
    made = pa.array(rows, kind)
    del rows
    give_back()
    return [made]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
           doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: the token ids of every document and
    ``end_id``, cut every ``capacity`` ids. A NULL text is empty and gives one piece of one id.
    ``ids`` is NULL unless asked for."""
    path = vocabulary or default_vocabulary()
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    # Larger blocks repeat more words.
    cut = add_columns(source, [source["text"]], PIECES, lambda a: _cut(a[0], path, capacity, end_id, with_ids), rows=1 << 14, drop=["text"])
    return cut.select("doc_id", F.explode("cuts").alias("c")).select("doc_id", "c.*")


def _places(fillings: list[Filling]) -> dict[str, np.ndarray]:
    """Runs of equal pieces of the plan: which ranks of a length lie in which sequences."""
    runs, used, sequence = [], {}, 0
    for copies, items in fillings:
        offset = 0
        for length, many in items:
            rank = used.get(length, 0)
            runs.append((length, rank, many, sequence, offset))
            used[length] = rank + many * copies
            offset += length * many
        sequence += copies
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "many", "sequence", "offset"), table.T.copy()))


def _find(lengths: pa.Array, ranks: pa.Array, runs: dict[str, np.ndarray]) -> list[pa.Array]:
    length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
    far = np.int64(1 << 40)
    run = np.searchsorted(runs["length"] * far + runs["rank"], length * far + rank, side="right") - 1
    copy, slot = np.divmod(rank - runs["rank"][run], runs["many"][run])
    return [pa.array(runs["sequence"][run] + copy), pa.array(runs["offset"][run] + slot * length)]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (settled pieces) with ``sequence_id`` and ``offset``. Every piece has a place,
    sequences are filled from 0 without gaps. No pieces, no rows."""
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    shares = 1 + max(histogram.values(), default=0) // SHARE
    runs = cut.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity)))
    share, rank = fresh("share"), fresh("rank")
    dealt = cut.withColumn(share, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    before = dealt.groupBy("length", share).agg(F.count("*").alias("n")).select(
        "length", share,
        (F.sum("n").over(Window.partitionBy("length").orderBy(share)) - F.col("n")).alias("before"),
    )
    window = Window.partitionBy("length", share).orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn(rank, F.row_number().over(window)).join(before, ["length", share])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col("before") - 1)
    placed = add_columns(
        ranked, [ranked["length"].cast("bigint"), ranked[rank].cast("bigint")],
        "sequence_id bigint, offset bigint", lambda a: _find(a[0], a[1], runs.value),
    )
    return placed.select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Tokenize, cut and pack; one row per piece without its ids."""
    return pack(settle(pieces(docs, vocabulary, capacity, **columns).drop("ids")), capacity)
