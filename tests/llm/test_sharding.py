"""Sharding: scheduling by hand, whole groups, near-equal bytes, gapless slots."""

import zlib

import cases
from cases import SF_SMALL

from cartlens.llm import queries
from cartlens.llm.sharding import assign, longest_first


def check(rows, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    assert set(by) <= set(range(shards))


def test_heap_by_hand():
    assert longest_first([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3)], 2) == {
        "a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_groups_stay_whole_and_bytes_are_even(spark):
    rows = queries.op5_lpt_sharding(spark, SF_SMALL).collect()
    text = {r.doc_id: r.text for r in
            spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    check(rows)
    assert len(rows) == len(text)
    home, load = {}, [0] * 16
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert home.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r.size
    largest = max(len(t.encode()) + 1 for t in text.values())
    assert max(load) - min(load) <= largest


def test_odd_rows(spark):
    docs = cases.documents(spark)
    for units in (16_384, 4):
        rows = assign(docs, units=units).collect()
        check(rows)
        assert len(rows) == docs.count()
        assert [(r.size, r.text_crc32) for r in rows if r.size == 1] == [(1, 0)] * 4
        assert len({r.shard for r in rows if r.doc_id in (4, 4)}) == 1
    assert assign(cases.empty(spark)).count() == 0


def test_one_group_holds_a_third(spark):
    docs = spark.createDataFrame(
        [(i, "same text" if i % 3 == 0 else f"text number {i}") for i in range(3000)],
        "doc_id long, text string")
    rows = assign(docs).collect()
    check(rows)
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    hot = next(r.shard for r in rows if r.doc_id == 0)
    rest = [v for k, v in load.items() if k != hot]
    assert max(rest) - min(rest) <= 20
