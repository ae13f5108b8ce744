"""Line dedup against all pairs of lines."""

import random

import cases
import pytest
from cases import SF_SMALL
from pyspark.sql import functions as F

from cartlens.llm import line_dedup as op
from cartlens.llm import queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def near(a, b, edits=2):
    return distance(a, b) <= min(edits, max(len(a), len(b)) // 5)


def brute(texts, edits=2):
    """Cleaned texts of rows in order."""
    seen, out = {}, []
    by_size = {}
    for text in texts:
        if text is None:
            out.append(None)
            continue
        kept = []
        for raw in text.split("\n"):
            line = raw.strip(" ")
            if not line:
                kept.append(raw)
                continue
            goes = line in seen
            if not goes:
                goes = any(near(line, o, edits)
                           for n in range(len(line) - edits, len(line) + edits + 1)
                           for o in by_size.get(n, ()))
                by_size.setdefault(len(line), []).append(line)
                seen[line] = True
            if not goes:
                kept.append(raw)
        out.append("\n".join(kept))
    return out


def lines(seed):
    """Lines, many of them a few edits from another."""
    r = random.Random(seed)
    base = [cases.prose(seed + k, r.randint(3, 12)) for k in range(12)] + ["a" * 40, "ab" * 15]
    out = []
    for _ in range(120):
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 2, 3, 4])):
            at = r.randrange(len(x))
            kind = r.randrange(3)
            if kind == 0:
                x[at] = r.choice("aeé z")
            elif kind == 1:
                x.insert(at, r.choice("aeé z"))
            elif len(x) > 5:
                del x[at]
        out.append("".join(x))
    return out


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 5])
def test_joins_all_near_lines(spark, edits):
    r = random.Random(edits)
    short = {"".join(r.choice("abé") for _ in range(r.randint(1, 16))) for _ in range(300)}
    words = sorted({x.strip() for x in lines(1) + lines(50)} - {""} | short)
    frame = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(words)],
                                  "id long, line string, size int")
    got = {tuple(r) for r in op.near_lines(frame, edits).collect()}
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
            if i < j and near(a, b, edits)}
    assert got == want


def test_bit_parallel_distance(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abé") for _ in range(r.randint(1, 14)))
        b = "".join(r.choice("abé") for _ in range(max(1, len(a) + r.randint(-4, 4))))
        c = list(a)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(c))
            c[at:at + r.randint(0, 1)] = r.choice(["", "a", "é"])
            c = c or ["b"]
        pairs += [(a, b), (a, "".join(c))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", op.within(F.split("a", ""), F.split("b", ""), 2).alias("x")).collect()
    assert all(r.x == near(r.a, r.b) for r in rows)
    assert 50 < sum(r.x for r in rows) < 750


def test_short_lines(spark):
    text = "Und | äbe.\nUnd äbe.\nabcd\nabce\nabcde\nabcdf\nvwxyzabcd\nvwxyzab--"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert op.dedup(docs)[0].head().text == brute([text])[0]
    assert brute([text]) == ["Und | äbe.\nabcd\nabce\nvwxyzabcd\nvwxyzab--"]


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    want = brute([d.text for d in docs])
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, SF_SMALL).collect()}
    for d, text in zip(docs, want, strict=True):
        lost = d.text.count("\n") + 1 - (text.count("\n") + 1 if text else 0)
        assert got[d.doc_id].kept_sha256 == cases.sha(text.encode())
        assert got[d.doc_id].n_lines == d.text.count("\n") + 1
        assert got[d.doc_id].n_removed == lost
    assert sum(r.n_removed for r in got.values()) > 50


def test_odd_rows(spark):
    more = ["\n".join(lines(7)), " " + cases.prose(5, 40) + " ", "\n\n", "x\n\nx\n", "x"]
    docs = cases.documents(spark, more)  # ids repeat: rows go in stored order
    cleaned, name = op.dedup(docs)
    assert cleaned.columns[:-1] == docs.columns
    rows = docs.collect()
    want = sorted((str(r.doc_id), t) for r, t in zip(rows, brute([r.text for r in rows]),
                                                    strict=True) if t is not None)
    got = cleaned.collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text is not None) == want
    assert sum(r.text is None for r in got) == 2
    assert all(r[name].n_lines == 0 for r in got if not r.text and not r[name].n_removed
               and r.text != "\n\n")
    assert op.dedup(cases.empty(spark))[0].count() == 0


def test_shuffled_ids_decide_the_order(spark):
    a, b = cases.prose(1, 30), cases.prose(1, 30)[:-1] + "!"
    docs = spark.createDataFrame([(5, a), (-3, b), (9, "z\n" + a)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in op.dedup(docs)[0].collect()}
    assert got == {-3: b, 5: "", 9: "z"}
