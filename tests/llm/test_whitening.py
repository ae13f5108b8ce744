"""Whitening against NumPy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from cases import SF_SMALL

from cartlens.llm import queries
from cartlens.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, component int, x string"


def expect(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    c = (n * x - total) / n
    cov = c.T @ c / n
    value, basis = np.linalg.eigh(cov)
    value, basis = value[::-1], basis[:, ::-1]
    far = [sum(int(v) ** 2 for v in row) for row in (n * x - total)]
    return value, c @ basis[:, :8] / np.sqrt(np.maximum(value[:8], 1e-300)), far, np.trace(cov)


def held(rows, ids, vectors, components=8):
    value, white, far, trace = expect(vectors)
    rows = sorted(rows, key=lambda r: (r.component, r[0]))
    assert len(rows) == components * len(ids)
    got = np.array([r.whitened for r in rows]).reshape(components, len(ids)).T
    order = np.argsort(ids, kind="stable")
    for j in range(components):
        want = white[order, j]
        sign = 1 if abs(got[:, j] - want).max() < abs(got[:, j] + want).max() else -1
        assert np.allclose(got[:, j], sign * want, atol=1e-8)
    assert [int(r.deviation) for r in rows[:len(ids)]] == [far[i] for i in order]
    assert {r.n for r in rows} == {len(ids)}
    assert [r.explained for r in rows[::len(ids)]] == pytest.approx(
        (value[:components] / trace).tolist(), rel=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-10


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas()
    frame = queries.op12_whitening(spark, SF_SMALL)
    assert dict(frame.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double"}
    held(frame.collect(), table.vec_id.to_numpy(), table.embedding.tolist())


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    good = (r.standard_normal((60, 3)) * [3, 2, 1]).astype(np.float32).tolist()
    rows = [(i, v, 1, "x") for i, v in enumerate(good)] + [(5, good[5], 1, "x")]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    rows += [(100 + i, v, 1, "x") for i, v in enumerate(bad)]
    out = op.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    held(out, np.array([*range(60), 5]), [*good, good[5]], components=3)
    assert op.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, [1.0, 2.0], 1, "x") for i in range(9)] + [(None, None, None, None)]
    assert op.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    line = [(None if i == 3 else i, [float(i), 2.0 * i], 1, "x") for i in range(9)]
    out = op.whiten(spark.createDataFrame(line, SCHEMA)).collect()  # one direction only
    assert len(out) == 9 and {r.component for r in out} == {1}
    assert np.var([r.whitened for r in out]) == pytest.approx(1)
    assert out[0].explained == pytest.approx(1) and sum(r.vec_id is None for r in out) == 1


def test_exact_beyond_longs():
    x = np.array([[1 << 50, -(1 << 50)], [3, 4]], np.int64)
    total = [int(v) for v in x.sum(0)]
    y = op.deviations(x, 1 << 20, total)
    want = [[(1 << 20) * int(v) - t for v, t in zip(row, total, strict=True)] for row in x]
    assert y.tolist() == want
    assert op.squares(y) == [sum(v * v for v in row) for row in want]
    assert op.squares(op.deviations(np.array([[5, 7]]), 2, [3, 4])) == [7**2 + 10**2]


@pytest.mark.parametrize("values", [
    np.linspace(9, 1, 40), np.r_[5.0, 5, 5, 1, np.zeros(16)], np.ones(12), np.r_[1.0],
    np.geomspace(1, 1e-9, 150), np.r_[np.full(9, 3.0), np.linspace(2.9999, 1, 100)]])
def test_eigenpairs(values):
    size = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    a = (turn * values) @ turn.T
    a = (a + a.T) / 2
    got, basis = op.eigenpairs(lambda u: a @ u, size, 8)
    want = np.sort(values)[::-1][:8]
    assert got == pytest.approx(want, abs=1e-13 * values.max())
    assert np.abs(a @ basis - basis * got).max() <= 1e-12 * values.max()
    assert np.allclose(basis.T @ basis, np.eye(len(want)), atol=1e-12)
