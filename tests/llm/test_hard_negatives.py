"""Mining against plain loops, and the bounds of the stages against all products."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank int"


def brute(rows, every=10, positives=5, negatives=10):
    good = [(i, [math.floor(256 * c) for c in v], y) for i, v, y, _ in rows if i is not None and v is not None and y is not None and all(c is not None and math.isfinite(c) for c in v)]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for a, u, y in {(i, tuple(v), y) for i, v, y in good if i % every == 0}:
        scored = sorted((-clip(sum(p * q for p, q in zip(u, v, strict=True))), i, z) for i, v, z in good if i != a and len(v) == len(u))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(n, t) for t, n, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fit)]
    return sorted(out)


def cloud(seed, n, width, labels=4, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    own = rng.integers(0, labels, n)
    vectors = (centres[own] * 0.5 + rng.normal(size=(n, width)) * np.linspace(1, 0.05, width)).round(3) * scale
    return [(i, [float(c) for c in v], int((y + (i % 9 == 0)) % labels), 1) for i, (v, y) in enumerate(zip(vectors, own, strict=True))]


@pytest.mark.parametrize("small", [False, True])
def test_mining(spark, monkeypatch, small):
    if small:  # many blocks and slices, so both passes run
        for name, value in (("_DATA", 40), ("_ASKS", 3), ("_ROWS", 16), ("_ANCHORS", 2)):
            monkeypatch.setattr(hn, name, value)
    rows = cloud(1, 260, 6)
    rows += [(1000, None, 1, 1), (1010, [1.0] * 5 + [None], 1, 1), (1020, [1.0] * 5 + [float("nan")], 1, 1), (1030, [float("inf")] * 6, 1, 1), (1040, [1.0] * 6, None, 1), (None, [1.0] * 6, 1, 1)]
    rows += [(1050, [], 0, 1), (1051, [], 0, 1), (1052, [], 1, 1), (1060, [1.0, 2.0], 0, 1), (1061, [1.5, 2.0], 0, 1), (1062, [0.5, 1.0], 1, 1), (1070, [9.0] * 3, 1, 1)]
    rows += [(1080, [0.0] * 6, 2, 1), (5, rows[5][1], rows[5][2], 1), (5, rows[5][1], rows[5][2], 1), (10, rows[11][1], 3, 1)]  # zero, repeated rows, another row of an anchor's key
    df = spark.createDataFrame([(*r[:3], 7) for r in rows], SCHEMA)
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    if not small:
        assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
        assert hn.hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_mining_of_ties_and_one_label(spark):
    rows = [(i, [1.0, float(i % 3)], i % 2, 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == brute(rows)
    assert hn.hard_negatives(df.where("label = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_mining_of_huge_components(spark):
    rows = cloud(3, 60, 4, scale=1e13)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == brute(rows)


@pytest.mark.parametrize("width", [1, 3, 64])
def test_stages_lose_nothing_and_discard(width):
    rng = np.random.default_rng(width)
    x = np.floor(256 * rng.normal(size=(500, width)) * np.exp(-np.arange(width) / 4)).astype(np.int64)
    cuts = sorted({max(1, width // 8), max(1, width // 4), width})
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1].copy()
    assert np.abs(turn @ turn.T - np.eye(width)).max() < 1e-12
    every = x[:40] @ x.T
    need, most = np.sort(every, axis=1)[:, -9], np.sort(every, axis=1)[:, -3]
    sides = [hn._Side(pd.Series(list(v)), turn, width, cuts) for v in (x[:40], x)]
    i, j, counts = hn.survivors(*sides, cuts, need, most, np.ones(every.shape, dtype=bool))
    left = set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(a, b) for a, b in zip(*np.nonzero((every >= need[:, None]) & (every <= most[:, None])), strict=True)} <= left
    assert (hn._exact(*(s.v for s in sides), i, j) == every[i, j]).all()
    assert counts == sorted(counts, reverse=True)
    if width == 64:
        assert counts[0] < 0.2 * every.size  # an eighth of the components settles most pairs
