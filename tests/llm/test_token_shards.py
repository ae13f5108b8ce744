"""Training-order shards: the permutation, and an exact round trip of the ids."""

import os

import cases
import numpy as np
import public_tokenizers as tok
import pytest
from cases import SF_SMALL

from cartlens.llm import queries, token_shards, tokens

RANKS = tok.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_order_is_a_permutation(n):
    o = token_shards.Order(n)
    slots = o.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (o.sequence(slots) == np.arange(n)).all()
    if n >= 1000:
        assert (slots == np.arange(n)).mean() < 0.02
        assert (token_shards.Order(n, 1).slot(np.arange(n)) == slots).mean() < 0.02


def round_trip(spark, docs, **sizes):
    e = tokens.RankEncoder(tokens.read(RANKS), tok.PATTERN)
    e.start()
    path = token_shards.materialise(docs, RANKS, tok.PATTERN, **sizes)
    layout = token_shards.layout_of(spark, path)
    rows = token_shards.read_slots(spark, path).collect()
    assert sorted(r.slot for r in rows) == list(range(layout["sequences"]))
    stream = b"".join(r.ids[:2 * r.n_tokens] for r in sorted(rows, key=lambda r: r.sequence_id))
    ids = np.frombuffer(stream, "<u2")
    got = sorted(tuple(x.tolist()) for x in np.split(ids, np.flatnonzero(ids == 50256) + 1)
                 if len(x))
    texts = [r.text for r in docs.collect()]
    assert got == sorted(tuple(np.frombuffer(x, "<u2").tolist())
                         for x in e.encode(texts, 50256))
    return path, layout, rows


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path, layout, rows = round_trip(spark, docs, length=128, records=64)
    local = path.removeprefix("file:")
    stride = 2 * 128 + 1
    for r in rows[::50]:  # a plain reader seeks to a record
        folder = f"{local}/shards/shard={r.shard}"
        files = [f for f in os.listdir(folder) if f.startswith("part-")]
        assert len(files) == 1
        with open(f"{folder}/{files[0]}", "rb") as f:
            f.seek((r.slot % 64) * stride)
            assert f.read(stride) == r.ids + b"\n"
    part = token_shards.read_slots(spark, path, 100, 140).collect()
    assert sorted(part) == sorted(r for r in rows if 100 <= r.slot < 140)


def test_odd_rows(spark):
    round_trip(spark, cases.documents(spark), length=50, records=10)
    path = token_shards.materialise(cases.empty(spark), RANKS, tok.PATTERN)
    assert token_shards.read_slots(spark, path).count() == 0


def test_query(spark):
    rows = queries.op3_training_order(spark, SF_SMALL).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.byte_offset == r.slot % token_shards.RECORDS * 2049 for r in rows)
