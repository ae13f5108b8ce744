"""Exact top-k against all scores."""

import numpy as np
import pytest

from cartlens.llm import topk as op

LIMIT = (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>, score string, n int, size int"


def brute(rows, every, scale=256, k=5):
    fine = [(i, [int(np.floor(scale * v)) for v in x]) for i, x in rows
            if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        found = []
        for _, x in {(i, tuple(x)) for i, x in fine if i == q}:
            found += [(-max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(x, y, strict=True)))), i)
                      for i, y in fine if i != q and len(x) == len(y)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def got(spark, rows, every=50, **given):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, op.top_k(frame.repartition(3), every=every, **given).collect()))


@pytest.mark.parametrize("dims", [1, 5, 16, 17, 64])
def test_equals_all_scores(spark, monkeypatch, dims):
    monkeypatch.setattr(op, "CELLS", 40 * dims)
    monkeypatch.setattr(op, "QUERY_CELLS", 7 * dims)
    r = np.random.default_rng(dims)
    centres = r.standard_normal((6, dims))
    x = centres[r.integers(0, 6, 400)] + 0.1 * r.standard_normal((400, dims))
    x *= r.choice([0.1, 1, 3], (400, 1))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)]  # copies tie
    assert got(spark, rows, every=20) == brute(rows, every=20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-3.0, 0.0]),
            (None, [9.0, 9.0]), (9, None), (100, None), (10, []), (11, [1.0, None]),
            (12, [float("nan"), 1.0]), (13, [float("inf"), 1.0]), (14, [0.0, 0.0]),
            (150, [1.0, 1.0, 1.0]), (151, [2.0, 1.0, 1.0]), (200, [4.0]), (-50, [0.001, 0.001]),
            (250, [1.0, 0.0]), (250, [0.0, 1.0]), (250, [1.0, 0.0])]
    assert got(spark, rows) == brute(rows, 50)
    assert got(spark, rows, k=1, every=1) == brute(rows, 1, k=1)
    assert got(spark, [(1, [1.0])]) == []
    assert op.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_beyond_exact_doubles(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(4) * 10.0 ** r.integers(0, 9)).tolist()) for i in range(60)]
    rows += [(60, [1e300, 1.0, 0.0, 0.0])]
    assert got(spark, rows, every=10) == brute(rows, 10)
