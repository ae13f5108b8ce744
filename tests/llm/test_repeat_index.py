"""Repeat removal against a plain count of all windows."""

from collections import Counter

import cases
import numpy as np
import pytest
from cases import SF_SMALL

from cartlens.llm import queries
from cartlens.llm import repeat_index as op


def brute(texts, width=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        out.append((len(r), len(r) - len(kept), spans, cases.sha(kept)))
    return out


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_repeat_removal(spark, SF_SMALL).collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs]), strict=True))
    assert sum(x[1] > 0 for x in got.values()) > 10


def passages():
    """A passage in many surroundings, whole and cut, some within one text."""
    p, q = cases.prose(21, 60), cases.prose(22, 33)
    out = [f"{cases.prose(30 + i, 3 + i % 7)} {p[i % 5:]} {cases.prose(80 + i, 4)}"
           for i in range(40)]
    out += [f"{i} {q[:200 + i % 3 - 1]}{i}" for i in range(6)]  # just shorter, equal, longer
    return [*out, f"{q} {q}", "é" * 150, "é" * 100 + "x", "ab" * 200, "ba" * 101, p * 3]


@pytest.mark.parametrize("sizes", [{}, {"edges": 3}, {"index_bytes": 2000, "edges": 10}])
def test_odd_rows(spark, sizes):
    docs = cases.documents(spark, passages())
    out, name = op.remove(docs, **sizes)
    assert out.columns[:-1] == docs.columns
    rows = docs.collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute([r.text for r in rows]), strict=True))
    got = sorted((str(r.doc_id), (r[name].n_bytes, r[name].n_removed, len(r[name].spans),
                                  cases.sha(bytes(r[name].kept)))) for r in out.collect())
    assert got == want


def test_other_widths_and_empty_tables(spark):
    docs = spark.createDataFrame(list(enumerate(passages()[30:])), "doc_id long, text string")
    out, name = op.remove(docs, width=40, seed=10, edges=5)
    got = {r.doc_id: (r[name].n_bytes, r[name].n_removed, len(r[name].spans),
                      cases.sha(bytes(r[name].kept))) for r in out.collect()}
    assert got == dict(enumerate(brute(passages()[30:], 40)))
    assert op.remove(cases.empty(spark))[0].count() == 0


def test_long_texts_are_cut_into_chunks():
    text = cases.prose(3, 60_000).encode()
    assert len(text) > op._CHUNK
    w = op.Windows()
    i, first, last, anchor, h, body = w.stretches([None, text, b"short"])
    assert (i == 1).all() and first[0] == 0 and last[-1] == len(text) - 200
    assert (first[1:] == last[:-1] + 1).all()
    assert ((anchor >= last) | (anchor >= first)).all() and (anchor <= first + 136).all()
