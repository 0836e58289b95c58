"""Hard negatives against all pairs, with odd rows, at several sizes of blocks and ranges."""

import random

import numpy as np
import pytest

from graphwarden.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def pairs(rows):
    """The contract, pair by pair."""
    valid = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        valid.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out = []
    for a, la, xa in valid:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, x)), i, lab) for i, lab, x in valid)
        for s, p in [(-s, i) for s, i, lab in scored if lab == la and i != a][:5]:
            negatives = [(-t, i) for t, i, lab in scored if lab != la and 80 * s <= -100 * t <= 100 * s][:5]
            out += [(a, p, k + 1, n, s, t) for k, (t, n) in enumerate(negatives)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hardneg.mine(df).collect())


def table(n, dims, seed, labels=3, step=20):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * step, [v + rng.gauss(0, 0.3) for v in c], rng.randrange(labels)))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    rows = table(600, 6, 1)
    want = pairs(rows)
    assert len(want) > 500 and mined(spark, rows) == want
    monkeypatch.setattr(hardneg, "BLOCK", 8)  # many blocks, ranges and tiles
    monkeypatch.setattr(hardneg, "RANGE", 64)
    monkeypatch.setattr(hardneg, "WINDOWS", 16)
    monkeypatch.setattr(hardneg, "STEP", 7)
    assert mined(spark, rows) == want


def test_hot_label_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    rows = [(i, x, 1 if i % 3 else k) for k, (i, x, _) in enumerate(table(300, 4, 2, step=5))]
    rows += [(10_000 + i * 50, [1.0, 0.5, -0.25, 2.0], i % 2) for i in range(60)]  # one vector, ties by id
    assert mined(spark, rows) == pairs(rows)


def test_odd_rows(spark):
    rows = table(80, 3, 3, step=25)
    odd = [(100, None, 1), (200, [1.0, None, 2.0], 1), (300, [1.0, float("nan"), 2.0], 0), (400, [1.0, float("inf"), 2.0], 2), (500, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (700, [], 1), (800, [2.0], 1), (900, [1.0, 2.0, 3.0, 4.0], 0)]
    rows = [r for r in rows if r[0] not in {o[0] for o in odd}] + odd
    assert mined(spark, rows) == pairs(rows)
    wide = [(i, [3e5 if i % 2 else -2.5, 7.0], i % 3) for i in range(0, 400, 20)]  # beyond doubles' exact sums
    assert mined(spark, wide) == pairs(wide)
    again = [(100, [1.0], 1), (100, [1.0], 1), (5, [1.0], 1), (6, [1.0], 2), (6, [1.0], 2)]  # repeated rows take part each
    assert mined(spark, again) == sorted([(100, 5, 1, 6, 65536, 65536), (100, 5, 2, 6, 65536, 65536)] * 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(100, None, 1)], [(100, [1.0], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)]])
def test_small_tables(spark, rows):
    assert mined(spark, rows) == pairs(rows)


def test_more_ranges_than_asked_for(spark, monkeypatch):
    """A session may deal rows to more partitions than the operator asks for: none may be left out."""
    rows = table(300, 4, 7)
    kind = type(spark.range(1))
    plain = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *by: plain(self, max(n, 150), *by))
    monkeypatch.setattr(hardneg, "BLOCK", 4)
    assert mined(spark, rows) == pairs(rows)


def test_other_columns(spark):
    df = spark.createDataFrame(table(120, 3, 4), SCHEMA).selectExpr("*", "1 AS score", "2 AS place", "'q' AS `a.b`")
    assert sorted(tuple(r)[:2] for r in hardneg.mine(df).collect()) == sorted(w[:2] for w in pairs(table(120, 3, 4)))


def test_curve_is_connected():
    """Neighbours on the curve differ by one in one dimension, and all points are met once."""
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(np.array(hardneg.hilbert(points, 3)))
    assert len(set(hardneg.hilbert(points, 3))) == 512
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    block = rng.integers(-50, 50, (40, 6)) + 300
    x = rng.integers(-200, 200, (9, 6))
    below, above = hardneg.reach(x, block.min(axis=0)[None, :], block.max(axis=0)[None, :])
    scores = x @ block.T
    assert (below[:, 0] <= scores.min(axis=1)).all() and (above[:, 0] >= scores.max(axis=1)).all()


def test_blocks_left_unread(spark, monkeypatch):
    """Clustered vectors: zone maps keep most blocks away from most ranges of windows."""
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in np.eye(8)[i % 8] * 4 + rng.normal(0, 0.05, 8)], int(i % 8)) for i in range(800)]
    df = hardneg.taking_part(spark.createDataFrame(rows, SCHEMA))
    n, low, high = hardneg.ranges(df)
    blocks = hardneg.packed(df, n, low, high, 4).cache()
    windows = hardneg._windows(hardneg.first_windows(blocks).toArrow())
    zones = hardneg._zones(blocks.toArrow())
    fits = hardneg._fits(windows, slice(None), zones, True)
    assert 0 < fits.sum() < 0.3 * fits.size
    blocks.unpersist()
