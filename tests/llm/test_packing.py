"""Curve packing: the curve itself, every id in exactly one piece, no gaps."""

import zlib

import cases
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from cases import SF_SMALL
from tokenizers import Tokenizer

from cartlens.llm import packing, queries, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_steps_to_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_words_encode_as_whole_texts(plain):
    odd = ["a  b\n\nc", "́x ý", "A B\tC\x1cD", "it's we'll <|endoftext|> x",
           "don 't\n's", "İSTANBUL Σας ﬁ", "12 345", "", None, "é é   z", "a\r\nb"]
    odd += cases.texts()
    e = tokens.WordEncoder(tokens.read(PATH))
    e.start()
    odd += ["Word, word. WORD!!! x%%%y %% can't, o'clock's İx. ß, ﬁx, 'Σ', a\u0301b. naïve?!", "x,",
            "<|endoftext|>, <|startoftext|>a <|endoftext|>", "...", ",", "日本語。", "٣٤ x²."]
    ids, ends = e.encode(pa.array(odd), 1)
    for text, a, b in zip(odd, ends, ends[1:], strict=False):
        assert ids[a:b].tolist() == [*plain(text), 1]
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet").column("text").combine_chunks()
    ids, ends = e.encode(docs.slice(3), 1)
    for text, a, b in zip(docs.to_pylist()[3:], ends, ends[1:], strict=False):
        assert ids[a:b].tolist() == [*plain(text), 1]
    ids, ends = e.encode(pa.array([], pa.string()), 1)
    assert len(ids) == 0 and ends.tolist() == [0]


def test_every_letter_before_punctuation(plain):
    """Letters that normalisation takes apart join the punctuation behind them."""
    e = tokens.WordEncoder(tokens.read(PATH))
    e.start()
    odd = ["İ. end", "क़ . क़.", "য়, য়"]
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha()
               and not "\u4e00" <= c <= "\u9fff" and not "\uac00" <= c <= "\ud7a3"
               and not c >= "\U00020000"]
    odd += [" ".join(f"ab{c}. {c}!" for c in letters[i:i + 50]) for i in range(0, len(letters), 50)]
    ids, ends = e.encode(pa.array(odd), 1)
    for text, a, b in zip(odd, ends, ends[1:], strict=False):
        assert ids[a:b].tolist() == [*plain(text), 1]


def check(rows, texts, plain, length):
    want = sorted(tuple(plain(t)) + (1,) for t in texts)
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    total = sum(map(len, want))
    assert sorted(by_sequence) == list(range(-(-total // length)))
    for s, part in by_sequence.items():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == min(length, total - s * length)
    got = sorted(tuple(np.frombuffer(b"".join(p), "<u4").tolist())
                 for p in _documents(rows))
    assert got == want


def _documents(rows):
    """Pieces put together again; equal rows follow each other on the curve."""
    out, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            open_ = {"left": r.doc_tokens, "parts": []}
        open_["parts"].append(r.ids)
        open_["left"] -= r.length
        if open_["left"] == 0:
            out.append(open_["parts"])
    return out


def test_sf_small(spark, plain):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    check(rows, [r.text for r in docs.select("text").collect()], plain, 2048)
    digest = queries.op4_curve_packing(spark, SF_SMALL).collect()
    assert sorted(digest) == sorted(tuple(r)[:-1] for r in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(docs, PATH)).collect()}
    assert {len(x) for x in whole.values()} == {4 * 2048}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == r.ids


def test_odd_rows(spark, plain):
    docs = cases.documents(spark)
    check(packing.pack(docs, PATH, length=100).collect(),
          [r.text for r in docs.collect()], plain, 100)
    assert packing.pack(cases.empty(spark), PATH).count() == 0


def test_neighbours_share_sequences(spark):
    """Texts of two vocabularies, shuffled, come out sorted by vocabulary."""
    a, b = ["alpha beta gamma delta", "omega sigma tau kappa"]
    docs = spark.createDataFrame([(i, " ".join([(a, b)[i * 7 % 2]] * (20 + i % 5)))
                                  for i in range(400)], "doc_id long, text string")
    kinds = {}
    for r in packing.pack(docs, PATH, length=512).collect():
        kinds.setdefault(r.sequence_id, set()).add(r.doc_id * 7 % 2)
    assert sum(len(k) > 1 for k in kinds.values()) <= 2
