"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest
from cases import SF_SMALL
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from cartlens.llm import queries
from cartlens.llm import spelling as op

LOW = str.maketrans(op.UPPER, op.LOWER)


def counted(rows, dropped=31, least=7, fewest=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % dropped == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= fewest}


def edits(word):
    """All strings one deletion away, and the word with each letter open."""
    return {word[:i] + word[i + 1:] for i in range(len(word))}, {
        word[:i] + "*" + word[i + 1:] for i in range(len(word))}


def linked(words):
    shapes, out = {}, {w: set() for w in words}
    for w in words:
        gone, open_ = edits(w)
        for shape in open_:
            shapes.setdefault(shape, []).append(w)
        for x in gone & words.keys():
            out[w].add(x)
            out[x].add(w)
    for same in shapes.values():
        for w in same:
            out[w] |= set(same) - {w}
    return out


def brute(words, factor=10):
    form, near = {}, linked(words)
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.select(
        "word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    frame = queries.op11_spelling_variants(spark, SF_SMALL)
    assert dict(frame.dtypes) == {"word": "string", "form": "string", "root": "string",
                                  "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = brute(counted(rows))
    assert got(frame) == want and any(r[1] for r in want) and any(r[4] > 3 for r in want)


@pytest.mark.parametrize("most", [2, 5, 256])
def test_crowded_words_at_any_group_size(spark, most, monkeypatch):
    """Words of two letters, so prefixes and suffixes are shared by many."""
    monkeypatch.setattr(op, "BLOCK", 7)
    r = np.random.default_rng(3)
    words = {"".join(r.choice(["a", "b"], r.integers(1, 9))): int(r.integers(1, 400))
             for _ in range(300)}
    words |= {"x" * 40: 3, "x" * 41: 50, "x" * 20 + "y" + "x" * 20: 9, "é" * 12: 4, "é" * 11 + "e": 41}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {x.word: (x.n_near, x.form, x.form_n) for x in op.near_words(frame, most).collect()}
    want = {}
    for w, others in linked(words).items():
        if w in ("a", "b"):  # the empty word is no word
            others.discard("")
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            want[w] = (len(others), best, words[best])
    assert near == want


def test_chains_end_in_one_root(spark):
    chain = [("abcdefg" + "h" * i, 2 * 10 ** (i if i < 6 else 6)) for i in range(7)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain, chain[1:], strict=False)],
                                  "word string, form string")
    assert {r.word: r.root for r in op.roots(forms).collect()} == {
        w: chain[-1][0] for w, _ in chain[:-1]}


def test_odd_rows(spark):
    docs = cases.documents(spark, ["Straße STRASSE straßen " * 3, "ÀÉÎÖÜßÿ ÀÉÎÖÜßÿ àéîöüßÿ × ÷÷÷÷÷÷÷÷ " * 2,
                                   "abcdefg abcdefh " * 50 + "abcdefi"])
    named = docs.withColumnRenamed("contamination", "word").withColumnRenamed("shard", "head")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(op.variants(named)) == brute(counted(rows))
    assert got(op.variants(docs, dropped=2, least=3, factor=2, most=4)) == brute(
        counted(rows, dropped=2, least=3), factor=2)
    assert op.variants(cases.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, "...")], "doc_id long, text string")
    assert op.variants(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.text("abc", min_size=1, max_size=7))
def test_common_ends_tell_single_edits(a, b):
    assume(a != b and abs(len(a) - len(b)) < 2)  # what a group holds
    longest = max(len(a), len(b))
    one = lambda w: op._Block(0, np.array([0]), [w], np.array([1]),
                              np.array([longest]), np.array([longest]))
    assert bool(len(op.near(one(a), one(b))[0])) == (b in linked({a: 1, b: 1})[a])
