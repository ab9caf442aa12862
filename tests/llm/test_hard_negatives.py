"""Hard negatives against brute force: clustered, tied, repeated and odd vectors; annuli that a bound leaves out."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paytrail.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, gid string, pivot string"


def brute(rows):
    """All pairs of the rows that take part."""
    fine = set()
    for i, v, label in rows:
        if i is not None and v and label is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v):
            own = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            fine.add((i, own, (label + 1) % 10 if i % 7 == 0 else label))
    out = set()
    for i, v, label in fine:
        if i % 100:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), j, lab == label) for j, w, lab in fine if j != i})
        for s, j, _ in [x for x in scored if x[2]][:5]:
            hard = [x for x in scored if not x[2] and 80 * s >= 100 * x[0] >= 100 * s] if s <= 0 else []
            out |= {(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(hard[:5], 1)}
    return sorted(out)


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("kind", ["clusters", "ties"])
def test_against_brute_force(spark, kind):
    rng = random.Random(kind)
    centres = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(12)]
    if kind == "clusters":
        rows = [(i, [rng.gauss(x, 0.05), rng.gauss(y, 0.05)], rng.randint(0, 4)) for i in range(1200) for x, y in [rng.choice(centres)]]
    else:  # a third of the rows are one vector, and few values occur
        rows = [(i, [1.0, 0.5] if i % 3 == 0 else [rng.choice([0.0, 0.5, 1.0, -1.0]), rng.choice([0.0, 0.25, 1.0])], rng.randint(0, 2)) for i in range(900)]
    want = brute(rows)
    assert want and mined(spark, rows, block_rows=32) == want == mined(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 0.0], 1), (5, [1.0, 1.0, 1.0], 1), (6, [], 1), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 2)]
    rows += [(10 + i, [1.0 - i / 100, 1.0], 1 + i % 2) for i in range(12)] + [(10, [1.0, 1.0], 1)] * 3 + [(200, [0.0, 0.0], 2), (300, [-1.0, -1.0], 1), (400, [0.9, 0.9], 3), (400, [0.5, 0.5], 1)]
    assert mined(spark, rows) == brute(rows) == mined(spark, rows[::-1], block_rows=2)
    huge = [(900, [1e30, 0.0], 1), (901, [1e30, 0.0], 2)]  # no whole numbers of a double
    assert mined(spark, rows + huge) == brute(rows)
    assert mined(spark, []) == mined(spark, rows[1:5]) == []


def test_bounds_leave_blocks_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 3000, (20, 16))
    v = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 30, (4000, 16)))
    space = hard_negatives.Space(v, float(np.square(v).sum(axis=1).max()), 20)
    far = space.distances(space.lifted(v))
    near, dist = far.argmin(axis=1), far.min(axis=1)
    blocks, rows = [], []
    for p in range(20):
        own = np.flatnonzero(near == p)
        own = own[np.argsort(dist[own])]
        for i in range(0, len(own), 50):
            part = own[i : i + 50]
            blocks.append((len(rows), p, dist[part[0]], dist[part[-1]]))
            rows.append(set(part.tolist()))
    directory = tuple(np.array(c) for c in zip(*blocks, strict=True))
    scores = v @ v[0]
    best = np.argsort(-scores)[:6]
    asks = pa.table({"gid": [0], "label": [0], "v": [v[0].astype(int).tolist()], "tops": [[2**62]], "lows": [[int(scores[best[-1]])]]})
    taken = [b for batch in hard_negatives._plan(space, directory, asks, 16, 0, len(rows)) for b in batch.column(0).to_pylist()]
    assert set(best.tolist()) <= set().union(*(rows[b] for b in taken)) and len(taken) < len(rows) / 4
