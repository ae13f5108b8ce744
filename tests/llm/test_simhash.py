"""SimHash near-duplicates against all-pairs comparison."""

import re
import string

import cases
import xxhash
from cases import SF_SMALL
from pyspark.sql import functions as F

from cartlens.llm import queries, simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + n]).encode(), seed=42).intdigest()
         for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expect(rows):
    prints = [(k, plain(t)) for k, t in rows]
    distinct = sorted({p for _, p in prints})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:]
             if (a ^ b).bit_count() <= 3]
    root = reach = cases.reachable(distinct, links)
    least = {}
    for k, p in prints:
        if k is not None:
            least[root[p]] = min(least.get(root[p], k), k)
    return sorted(((k, f"{p:016x}", least.get(reach[p])) for k, p in prints), key=str)


def test_sf_small_matches_all_pairs(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op8_simhash(spark, SF_SMALL).collect()]
    assert sorted(got, key=str) == expect([tuple(r) for r in rows])
    assert len({c for _, _, c in got}) < len(got)


def test_odd_rows(spark):
    docs = cases.documents(spark)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == expect([(r.doc_id, r.text) for r in docs.collect()])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c in got}
    assert sorted(ids, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def test_hash_is_the_sql_one(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("one two é"))).head()[0]
    assert value % 2**64 == xxhash.xxh64("one two é".encode(), seed=42).intdigest()


def test_links_for_any_distance(spark):
    base = [0, 1, -1, 1 << 40, 0b111, (1 << 63) - 1, -(1 << 63), 123456789, 123456789 ^ 0b11111,
            123456789 ^ (1 << 50) ^ 3]
    frame = spark.createDataFrame([(x,) for x in base], "fp long")
    for k in (0, 1, 2, 3, 4, 5):
        got = {tuple(r) for r in simhash.links(frame, k).collect()}
        want = {(min(a, b), max(a, b)) for a in base for b in base
                if a != b and ((a ^ b) % 2**64).bit_count() <= k}
        assert got == want
