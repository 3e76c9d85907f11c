"""Votes, links and recall of the registered settings, recomputed the plain way."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rolefeed.llm import neighbours, quality, secret_scan


# --- quality --------------------------------------------------------------------------------


def pair_counts(text):
    counts, data = np.zeros(quality.TERMS), (text or "").encode()
    for a, b in zip(data, data[1:]):
        counts[(((a << 8 | b) * 0x9E3779B97F4A7C15) % 2**64) >> 53] += 1
    return counts


def unit(rows):
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1)


def test_votes(spark):
    """Vectors and votes of every document from the definition, in double precision."""
    rng = random.Random(31)
    words = [["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)] for _ in range(2)]
    words[1] += words[0][:30]  # the classes share half of their words
    texts = [" ".join(rng.choice(words[i % 2]) for _ in range(rng.randint(8, 40))) for i in range(260)] + ["", None, "x", "é😀" * 400]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 != (i % 17 == 0))) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_documents(table, model).collect()}

    counts = np.array([pair_counts(t) for t in texts])
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    weighted = unit(np.log1p(counts) * idf)
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    x, y = weighted[learned], np.array([int(i % 2 != (i % 17 == 0)) for i in learned], dtype=float)
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, np.argsort(-values)[:quality.DIMENSIONS]]
    placed = weighted @ axes
    near = unit(placed) @ unit(x @ axes).T
    assert len(model.labels) == len(learned)
    differ = 0
    for i, row in enumerate(near):
        order = np.argsort(-row, kind="stable")
        top = order[:quality.NEIGHBOURS]
        weight = np.maximum(row[top], 0) ** 4
        score = (weight * y[top]).sum() / weight.sum() if weight.sum() > 0 else y.mean()
        # Single precision may swap neighbours whose similarity is equal to seven digits.
        # A text that shares no term with the sample has no direction.
        if 0 < np.linalg.norm(placed[i]) < 1e-3:
            assert 0 <= got[i][0] <= 1
            continue
        close = row[order[quality.NEIGHBOURS - 1]] - row[order[quality.NEIGHBOURS]] < 1e-6
        assert close or math.isclose(got[i][0], score, abs_tol=1e-4), (i, got[i][0], score)
        assert got[i][1] == (got[i][0] >= quality.ACCEPT)
        differ += close
    assert differ < 10
    judged = [i for i in range(200, 260)]
    assert sum((got[i][0] >= 0.5) == i % 2 for i in judged) > 45


# --- secrets --------------------------------------------------------------------------------


def brute_links(text, reach):
    """Every strong part, and the weak ones with a complement within reach."""
    found = []
    for kind, pattern, group, least in (*secret_scan.STRONG, *secret_scan.WEAK):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    kept = {
        (kind, start, stop) for kind, start, stop in found
        if kind not in secret_scan.COMPLEMENTS or any(
            k in secret_scan.COMPLEMENTS[kind] and a <= stop + reach and b >= start - reach for k, a, b in found)
    }
    return kept


def test_links(spark):
    rng = random.Random(32)
    parts = ["user: bob ", "login=al_ice ", "AKIA" + "Q" * 16 + " ", "aB3" + "dE5/" * 10 + " ", "https://s3.example.com/x ", "password = hunter22 ",
             "0123456789abcdef" * 2 + " ", "plain words here ", "x" * 150 + " ", "y" * 60 + "\n", "é😀 ", "client_id='zz9' ", "token=abc "]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(250)),
             "user: bob " + "z" * 200 + "password = hunter22", "user: bob" + "z" * 201 + "password = hunter22", "".join(parts) * 300]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for reach in (secret_scan.REACH, 30):
        linked = 0
        for r in secret_scan.scan(table, reach=reach).collect():
            spans = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)}
            expected = brute_links(texts[r.doc_id], reach)
            assert spans == expected, (reach, texts[r.doc_id][:300])
            linked += sum(k in secret_scan.COMPLEMENTS for k, _, _ in spans)
        assert linked > 500


# --- nearest neighbours ---------------------------------------------------------------------


def test_recall_of_the_registered_settings(spark):
    """20,000 random directions, the hardest case for any index: nothing of them is alike."""
    random_ = np.random.default_rng(33)
    vectors = random_.standard_normal((20_000, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    table = pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 64).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    asked = np.arange(0, 20_000, 200)
    found = neighbours.nearest(df, df.where(F.col("vec_id") % 200 == 0)).collect()
    exact = vectors[asked].astype(np.float64) @ vectors.T.astype(np.float64)
    exact[np.arange(len(asked)), asked] = -np.inf
    hits = 0
    for q, row in zip(asked, exact):
        best = set(np.argsort(-row, kind="stable")[:20].tolist())
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(math.isclose(s, row[v], abs_tol=1e-12) for _, v, s in own)
        hits += len(best & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(asked), hits / (20 * len(asked))
