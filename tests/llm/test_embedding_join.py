"""Embedding join against all pairs in double precision."""

import cases
import numpy as np
import pytest
from cases import SF_SMALL

from cartlens.llm import embedding_join as op
from cartlens.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, g long, row string, n_links int"


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) per row, by all pairs."""
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, np.float64)
        if x.any():
            unit[i] = x / np.abs(x).max()
    links = [(a, b) for a in unit for b in unit
             if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b]))
             >= cosine]
    root = cases.reachable(range(len(rows)), links)
    degree = np.bincount([x for e in links for x in e], minlength=len(rows))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(((r[0], int(degree[i]), least.get(root[i]), r[0] == least.get(root[i]))
                   for i, r in enumerate(rows)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_given_vectors(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()
    want = brute([tuple(r) for r in rows])
    assert got(queries.op6_embedding_near_dedup(spark, SF_SMALL)) == want
    loose = brute([tuple(r) for r in rows], 0.2)
    assert sum(n > 0 for _, n, _, _ in loose) > 10
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert got(op.near_duplicates(table, cosine=0.2, cell=10)) == loose


@pytest.mark.parametrize("sizes", [{}, {"cell": 8, "block": 16}, {"cell": 30, "pivots": 12}])
def test_odd_rows(spark, sizes):
    r = np.random.default_rng(5)
    rows = []
    for c in range(12):  # loose clusters, so that links cross cell borders
        centre = r.standard_normal(6)
        rows += [(len(rows) + k, (centre + 0.12 * r.standard_normal(6)).tolist(), c % 2)
                 for k in range(25)]
    same = rows[3][1]
    rows += [(1000 + i, same, 0) for i in range(40)] + [rows[3], rows[3]]
    rows += [(2000, None, 0), (2001, [0.0] * 6, 0), (2002, [float("nan")] * 6, 0),
             (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (2004, [float("inf")] + same[1:], 0),
             (2005, same, None), (None, same, 0), (2006, same[:3], 0), (2007, same[:3], 0),
             (2008, [], 0), (2009, [1e-200 * x for x in same], 0),
             (2010, [1e200 * x for x in same], 0), (None, None, None)]
    frame = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], SCHEMA)
    assert got(op.near_duplicates(frame, **sizes)) == brute(rows)


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_reach_every_partner():
    """No link within the radius is lost by the cell rule."""
    r = np.random.default_rng(1)
    x = op._unit(r.standard_normal((400, 5)))
    home, copied = op.cells(x, op.spread_out(x, 20), 0.5)
    near = x @ x.T >= 1 - 0.5**2 / 2
    i, j = np.nonzero(near)
    assert copied[j, home[i]].all()
    assert copied.mean() < 0.8
