"""Decontamination against a plain window scan."""

import re
import string

import cases
import pytest

from cartlens.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, items, window=13):
    found = {}
    for key, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for item, body in items:
            v = WORD.findall((body or "").translate(LOWER))
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[i:i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item))
        found.setdefault(key, []).append(
            (len(w), len(hit), len(ids), cases.sha(",".join(sorted(ids)).encode()),
             len(hit) > 0 and 20 * len(hit) >= len(w)))
    return found


def items():
    a, b = cases.prose(1, 120).split(), cases.prose(4, 30_000).split()
    return [(10, " ".join(a[20:50])), (9, " ".join(a[40:52])), (9, "ONE two"), (3, None), (4, ""),
            (None, "né"), (5, " ".join(b[100:130])), (6, " ".join(["ba"] * 20)), (10, "word")]


@pytest.mark.parametrize("block", [200_000, 7])
def test_matches_plain_scan(spark, block):
    long = " ".join(["ba"] * 40)
    docs = cases.documents(spark, [long, cases.prose(1, 60) + " word"])
    bench = spark.createDataFrame(items(), "item_id long, text string")
    out, name = op.annotate(docs, bench, block_windows=block)
    assert out.columns[:-1] == docs.columns
    got = {}
    for r in out.collect():
        c = r[name]
        got.setdefault(r.doc_id, []).append((c.n_words, c.n_hit, c.n_items, c.items_sha256,
                                             c.contaminated))
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(plain, [("null" if k is None else k, t) for k, t in items()])
    assert got == want
    assert sum(x[-1] for v in got.values() for x in v) >= 5


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    out, name = op.annotate(cases.documents(spark), bench)
    assert out.where(out[name]["contaminated"]).count() == 0
    out, _ = op.annotate(cases.empty(spark), spark.createDataFrame(items(),
                                                                   "item_id long, text string"))
    assert out.count() == 0
