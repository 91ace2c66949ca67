"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest

from longspan.llm.op13_hard_negatives import LONGEST, Lot, hard_negatives


def brute(rows, every=100):
    use = []
    for vec, values, label in rows:
        if vec is None or label is None or values is None or any(x is None or not math.isfinite(x) for x in values):
            continue
        use.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * float(x)) for x in values]))
    out = []
    for k, (vec, label, own) in enumerate(use):
        if vec % every:
            continue
        scored = [(-sum(a * b for a, b in zip(own, e)), v, lab) for j, (v, lab, e) in enumerate(use) if j != k and len(e) == len(own)]
        scored.sort()
        for p, pos, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(vec, pos, r + 1, v, -p, -s) for r, (s, v, _) in enumerate(fits[:5])]
    return sorted(out)


def mined(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], "vec_id bigint, embedding array<double>, label int, n string, lot string")
    return sorted(tuple(r) for r in hard_negatives(frame, **how).collect())


def test_odd_rows(spark):
    rng = random.Random(5)
    one = [0.5, 0.5, 0.1]
    rows = [(100, one, 1), (100, one, 1), (100, [0.5, 0.4, 0.2], 1), (3, one, 1), (3, one, 1), (4, one, 2), (4, one, 2), (5, [0.45, 0.5, 0.1], 2)]
    rows += [(6, one, None), (8, None, 1), (None, one, 2), (9, [float("nan"), 0.1, 0.1], 2), (10, [None, 0.1, 0.1], 2), (11, [float("inf"), 0.0, 0.0], 2)]
    rows += [(200, [0.0] * 3, 1), (12, [0.0] * 3, 2), (300, [1.0, 0.0], 1), (13, [1.0, 0.0], 1), (14, [0.9, 0.0], 3), (400, [], 1), (15, [], 1), (16, [], 2)]
    rows += [(700, [-0.5, -0.5, 0.0], 9), (1400, [3e5, 1.0, 1.0], 0), (17, [2e5, 1.0, 1.0], 1), (18, [2e5, 3.0, 1.0], 5)]
    rows += [(20 + k, [rng.uniform(-1, 1) for _ in range(3)], k % 3 - 1) for k in range(200)]
    got = mined(spark, rows, lot_values=3 * 64)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {100, 200, 300, 400}
    assert mined(spark, []) == []


@pytest.mark.parametrize("dims,lot_values", [(8, 8 * 64), (32, 1 << 18)])
def test_clustered_vectors(spark, dims, lot_values):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims)) * rng.uniform(0.2, 2, (12, 1))
    rows = [(k, (centres[k % 12] + 0.2 * rng.normal(size=dims)).tolist(), int(rng.integers(4))) for k in range(900)]
    assert mined(spark, rows, every=30, lot_values=lot_values) == brute(rows, 30)


def test_candidates_hold_every_row_that_reaches_the_score():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    centre = rng.normal(size=16) * 200
    x = np.concatenate([rng.normal(size=(800, 16)) * 200, centre + rng.normal(size=(200, 16)) * 60])
    # A lot is a length bucket, so its rows are of about one length.
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(780, 800, (1000, 1))).astype(np.int64)
    lot = Lot(pa.table({"vec_id": range(1000), "n": [1] * 1000, "vector": pa.array(x.tolist(), pa.list_(pa.int64()))}))
    seen = []
    for anchor in x[800:820]:
        scores = x @ anchor
        least = float(np.sort(scores)[-20])
        found = lot.candidates(anchor, least, 5)
        assert set(np.flatnonzero(scores >= least)) <= set(found)
        seen.append(len(found))
    # The ranges leave most rows unscored.
    assert np.mean(seen) < 400


def test_scores_beyond_doubles():
    import pyarrow as pa

    big = 2**40 + 1
    lot = Lot(pa.table({"vec_id": [1, 2], "n": [1, 1], "vector": pa.array([[big, 1], [2**62, 2**62]], pa.list_(pa.int64()))}))
    assert lot.scores(np.array([2**20 + 1, 3]), np.array([0])).tolist() == [big * (2**20 + 1) + 3]
    assert lot.scores(np.array([2**62, 3]), np.array([1])).tolist() == [LONGEST]
