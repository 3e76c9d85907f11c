"""Hard negatives and whitening against brute force in whole numbers and fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefeed.llm import hard_negatives, whitening

ROWS = "vec_id long, embedding array<float>, label int, rank string, N string, x string, v string, whitened string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Vectors with columns named like those that operators add."""
    return spark.createDataFrame([(i, v, label, "a", "b", "c", "d", "e") for i, v, label in rows], ROWS)


def random_rows(rng, n, d, labels=3, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.5) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


ODD = [
    (None, [1.0] * 6, 1), (9001, None, 1), (9002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (9003, [NAN] * 6, 0), (9004, [INF] + [0.0] * 5, 0),
    (9005, [], 1), (9006, [1.0, 2.0], 1), (9007, [0.0] * 6, 1), (9008, [0.5] * 6, None),
]


def single(x):
    return float(np.float32(x))


# --- hard negatives -------------------------------------------------------------------------


def brute_negatives(rows, anchors, scale=256, k=5):
    def taken(some, d):
        return [(i, [math.floor(scale * single(c)) for c in v], label) for i, v, label in some
                if i is not None and label is not None and v and len(v) == d
                and all(c is not None and math.isfinite(c) for c in v)]

    d = len(rows[0][1])
    table, asked = taken(rows, d), {}
    for i, v, label in taken(anchors, d):
        asked[i] = max(asked.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, q) in asked.items():
        same, other = {}, {}
        for i, v, own in table:
            score = sum(x * y for x, y in zip(q, v))
            if own == label and i != a:
                same[i] = max(score, same.get(i, score))
            elif own != label:
                other.setdefault(i, []).append(score)
        for p, ps in sorted(same.items(), key=lambda r: (-r[1], r[0]))[:k]:
            fit = {i: max((s for s in scores if 80 * ps <= 100 * s <= 100 * ps), default=None) for i, scores in other.items()}
            best = sorted(((i, s) for i, s in fit.items() if s is not None), key=lambda r: (-r[1], r[0]))[:k]
            out |= {(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed, n, d, spread", [(1, 400, 6, 1.0), (2, 300, 70, 0.2), (3, 250, 64, 1.0)])
def test_hard_negatives(spark, seed, n, d, spread):
    rng = random.Random(seed)
    rows = random_rows(rng, n, d, spread=spread)
    if d == 6:
        # Odd rows, copies under one id and under others, and ties.
        rows += ODD + rows[:3] + [(i + 5000, v, label + 1) for i, v, label in rows[:40]] + [(20, rows[21][1], 2), (7, rows[8][1], 1)]
    df = table(spark, rows)
    anchors = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    out = hard_negatives.mine(df, table(spark, anchors), wave=17)
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    expected = brute_negatives(rows, anchors)
    assert len(got) == len(set(got)) and set(got) == expected and len(got) > 50
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_hard_negatives_of_nothing(spark):
    rows = random_rows(random.Random(4), 30, 6)
    df = table(spark, rows)
    assert hard_negatives.mine(df.limit(0), df).count() == 0
    assert hard_negatives.mine(df, df.limit(0)).count() == 0
    assert hard_negatives.mine(table(spark, ODD), table(spark, ODD)).count() == 0
    assert hard_negatives.mine(table(spark, [(i, v, 1) for i, v, _ in rows]), df).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(table(spark, [(1, [1e30, 0.0], 1), (2, [1e30, 0.0], 2)]), table(spark, [(1, [1e30, 0.0], 1)]))


def test_intervals_hold_and_filter():
    random_ = np.random.default_rng(6)
    x = random_.integers(-300, 300, (3000, 64))
    q = x[:40] + random_.integers(-100, 100, (40, 64))
    coder = hard_negatives.Coder(64)
    ids, labels = np.arange(3000), np.zeros(3000, dtype=np.int64)
    block = hard_negatives.Block(ids, labels, x, *coder.codes(x))
    wave = hard_negatives.Anchors(coder, np.arange(40), np.zeros(40, dtype=np.int64), q)
    exact = q @ x.T
    seen = []

    def possible(anchors, least, most):
        seen.append((np.broadcast_to(anchors, least.shape), least, most))
        return np.ones(least.shape, dtype=bool)

    anchors, rows = wave.survivors(0, 40, block, np.ones((40, 3000), dtype=bool), possible)
    assert len(anchors) == exact.size and (wave.scores(anchors, block, rows) == exact[anchors, rows]).all()
    for level, (_, least, most) in enumerate(seen):
        true = exact if level == 0 else exact[anchors, rows]
        assert (least <= true).all() and (true <= most).all()
    widths = [float((most - least).mean()) for _, least, most in seen]
    assert all(b < 0.75 * a for a, b in zip(widths, widths[1:]))
    # Of what scores below 80 % of the best, few are left to be scored.
    floor = 0.8 * exact.max(axis=1)
    anchors, rows = wave.survivors(0, 40, block, np.ones((40, 3000), dtype=bool), lambda a, least, most: most >= floor[a])
    assert len(anchors) < 0.1 * exact.size
    kept = np.zeros(exact.shape, dtype=bool)
    kept[anchors, rows] = True
    assert kept[exact >= floor[:, None]].all()


# --- whitening ------------------------------------------------------------------------------


def whole(rows, d, step=64, shift=1_000_000):
    return [(i, tuple(math.floor(step * single(c)) + shift for c in v)) for i, v, _ in rows
            if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


def test_covariances_are_exact(spark):
    rng = random.Random(7)
    rows = random_rows(rng, 300, 6) + ODD
    fit_list = sorted({x for _, x in whole(rows, 6)})
    n = len(fit_list)
    totals = [sum(c) for c in zip(*fit_list)]
    exact = [[Fraction(sum((n * x[i] - totals[i]) * (n * x[j] - totals[j]) for x in fit_list), n**3) for j in range(6)] for i in range(6)]
    df = spark.createDataFrame([(list(x),) for x in fit_list], "x array<bigint>").repartition(5)
    found_n, found = whitening.sums(df, 6, 2_000_000)
    assert found_n == n and found == totals
    centres, rests = [t // n for t in totals], [t % n for t in totals]
    for bound in (1 << 20, 1 << 58):  # in machine integers, and in integers of any size
        squares = whitening.square_sums(df, np.array(centres), bound)
        v, trace = whitening.covariances(n, rests, squares)
        assert (v == np.array([[float(c) for c in row] for row in exact])).all()
        assert trace == float(sum(exact[i][i] for i in range(6)))


def test_whiten(spark):
    rng = random.Random(8)
    rows = random_rows(rng, 400, 6) + ODD
    rows += rows[:5] * 3 + [(i + 5000, v, label) for i, v, label in rows[5:60]] * 4
    expected = whole(rows, 6)
    fit_list = sorted({x for _, x in expected})
    n, totals = len(fit_list), [sum(c) for c in zip(*fit_list)]
    out = whitening.whiten(table(spark, rows), components=4)
    assert [c for c in out.columns if c in ("vec_id", "rank", "x", "v", "label")] and out.columns.count("whitened") == 1
    got = out.collect()
    x_of = dict(expected)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in expected)
    for r in got:
        if r.vec_id is not None:
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x_of[r.vec_id], totals))
    centred = np.array([[a - s / n for a, s in zip(x, totals)] for x in fit_list])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    true = {x: z for x, z in zip(fit_list, centred @ axes / np.sqrt(values))}
    signs = np.sign([a * b for a, b in zip(true[x_of[got[0].vec_id]], got[0].whitened)])
    for r in got:
        if r.vec_id is not None:
            assert np.allclose(np.array(r.whitened) * signs, true[x_of[r.vec_id]], atol=1e-8)
            assert np.allclose(r.explained, values / np.trace(v), rtol=1e-9) and r.identity_error < 1e-9
    flat = whitening.per_component(out)
    assert flat.count() == 4 * len(got) and {r.component for r in flat.select("component").distinct().collect()} == {1, 2, 3, 4}
    assert [t for _, t in flat.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]


def test_whiten_without_variance(spark):
    rows = random_rows(random.Random(9), 50, 6)
    assert whitening.per_component(whitening.whiten(table(spark, rows).limit(0))).count() == 0
    assert whitening.per_component(whitening.whiten(table(spark, [r for r in ODD if r[1] != [0.0] * 6 and len(r[1] or []) != 6]))).count() in (0, 2)
    same = whitening.whiten(table(spark, [(i, [0.5] * 6, 1) for i in range(9)]))
    assert same.count() == 9 and whitening.per_component(same).count() == 0 and same.where("n <> 1 or deviation <> 0").count() == 0
    # Two directions in six dimensions.
    line = [(i, [float(i), 0.0, float(i * i), 0.0, 0.0, 1.0], 1) for i in range(20)]
    assert whitening.per_component(whitening.whiten(table(spark, line))).select(F.max("component")).first()[0] == 2
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [3e30], 1)]))
