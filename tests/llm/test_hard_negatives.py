"""Hard negatives against brute force, and on odd rows."""

import math
import random

import numpy as np
import pytest

from offerlens.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, planes string, score double"


def _fits(score):
    return score if -(1 << 63) <= score < 1 << 63 else None


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)


def _plain(rows):
    """The contract, row by row. Rows are (vec_id, vector, label)."""
    usable = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        usable.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], moved))
    by_id = lambda r: (r[0] is None, r[0] or 0)
    found = []
    for a, (anchor, own, label) in enumerate(usable):
        if anchor is None or anchor % 50:
            continue
        scored = [(i, lab, sum(x * y for x, y in zip(own, v))) for j, (i, v, lab) in enumerate(usable) if j != a]
        scored.sort(key=lambda r: (-r[2], by_id(r)))
        for positive, _, p in [r for r in scored if r[1] == label][:5]:
            fits = [r for r in scored if r[1] != label and 50 * p <= 100 * r[2] <= 95 * p][:3]
            found += [(anchor, positive, k, i, _fits(p), _fits(s)) for k, (i, _, s) in enumerate(fits, 1)]
    return sorted(found, key=repr)


def _got(frame):
    return sorted(map(tuple, hard_negatives.hard_negatives(frame).collect()), key=repr)


@pytest.mark.parametrize("dims, largest", [(64, 150), (5, 3), (20, 100_000), (16, (1 << 27) - 1), (9, 0)])
def test_scores_are_inner_products(dims, largest):
    rng = np.random.default_rng(dims)
    rows, anchors = (rng.integers(-largest, largest + 1, (n, dims)) for n in (1500, 37))
    shape = hard_negatives.Shape(dims, largest, largest.bit_length() + 1)
    packed = hard_negatives.planes(hard_negatives.components(rows, shape), shape)
    assert (hard_negatives.scores(packed, hard_negatives.tables(hard_negatives.components(anchors, shape), shape), shape) == rows @ anchors.T).all()


def test_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 150)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(12)], 3 if rng.random() < 0.4 else rng.randrange(10)) for i in range(0, 4000, 5)]
    rows += [(i, [0.25] * 12, 3) for i in range(1, 400, 5)]  # one very common vector, all its scores tied
    want = _plain(rows)
    assert len(want) > 300 and _got(_frame(spark, rows)) == want


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(3)) for i in range(0, 300, 3)]
    rows += rows[:30] + [(rows[0][0], [0.5] * 6, 1)]  # repeats, and an anchor's id with another vector
    rows += [*((None, [x] * 6, label) for x in (0.8, 1.2) for label in range(3)), (50, None, 1), (100, [0.5] * 6, None), (200, [0.5, None, 1.0, 1.0], 1)]
    rows += [(201, [0.5, float("nan"), 1.0, 1.0], 1), (202, [0.5, float("inf"), 1.0, 1.0], 1)]
    rows += [(250, [0.5, 0.5], 2), (251, [], 2), (350, [], 1)]
    want = _plain(rows)
    assert len(want) > 30 and any(r[1] is None for r in want) and any(r[3] is None for r in want)
    assert _got(_frame(spark, rows)) == want
    assert _got(_frame(spark, [r for r in rows if r[0] is None or r[0] % 50])) == []  # no anchors
    assert _got(_frame(spark, [(50, [1.0], 1), (100, [1.0], 1)])) == []  # no negatives
    assert _got(_frame(spark, [(50, [1.0], 1), (101, [1.0], 2)])) == []  # no positives
    assert _got(_frame(spark, [(50, [1e30], 1), (51, [1e30], 1)])) == []
    assert _got(_frame(spark, [])) == []


@pytest.mark.parametrize("dims, sizes", [(6, [1.0, 3e5]), (6, [1.0, 5e5, 6e5, 2e6]), (5, [0.5, 1e6, 3e9, 1e30]), (300, [1.0, 5e5])])
def test_large_components(spark, monkeypatch, dims, sizes):
    """Rows with large components take part, and shares of large scores don't overflow."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 150)
    rng = random.Random(dims)
    rows = [(i, [rng.choice(sizes) * rng.uniform(-0.2, 1) * (rng.random() < 0.8) for _ in range(dims)], rng.randrange(3)) for i in range(0, 2500, 5)]
    want = _plain(rows)
    assert len(want) > 100 and _got(_frame(spark, rows)) == want


def test_few_rows_below_the_ceiling(spark):
    """An anchor with one fitting negative doesn't get those of the next anchor."""
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (100, [0.0, 4.0], 1), (101, [0.0, 4.0], 1), (102, [0.0, 3.0], 2), (103, [0.0, 3.5], 2)]
    assert len(_plain(rows)) > 3
    assert _got(_frame(spark, rows)) == _plain(rows)
