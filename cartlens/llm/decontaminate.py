"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window). A window's words are ordered by how rare they are
in the whole corpus. A document holds a window only if it holds all its words,
so the necessary prefix is one word: the rarest. Documents are probed with that
word; its place in the window fixes where the window must start and end
(positional and length bound); what is left is compared word by word over that
item-sized stretch of the document.

Windows are dealt over as many blocks as their number needs, so the part that
is broadcast has a fixed bound; each block is one map over the documents and no
document is ever shuffled.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_bytes, with_column

WINDOW = 13
#: windows in one broadcast block (about 100 bytes each)
BLOCK_WINDOWS = 200_000
#: a document is contaminated from this share of hit words (1 in 20)
SHARE = 20

#: A-Z to a-z; ASCII that is neither letter nor digit to a blank; the rest stays
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """Distinct (item, gram, len): all word windows of all items."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)),
                                 strict=True):
                w = words(raw)
                n = min(window, len(w))
                for at in range(0, len(w) - n + 1 if n else 0, 10_000):
                    grams = [b" ".join(w[i:i + n])
                             for i in range(at, min(at + 10_000, len(w) - n + 1))]
                    yield pa.RecordBatch.from_pydict({"item": [item] * len(grams), "gram": grams},
                                                     schema=pa.schema([("item", pa.string()),
                                                                       ("gram", pa.binary())]))

    ids = F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item")
    return items.select(ids, F.col(text)).mapInArrow(cut, "item string, gram binary").distinct()


def word_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Occurrences in all documents of the words of one block of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c = shared.value, Counter()
        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                c.update(filter(known.__contains__, words(raw)))
        yield pa.RecordBatch.from_pydict(
            {"word": list(c), "n": list(c.values())},
            schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = (docs.select(text).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())  # at most the vocabulary
    return {bytes(r.word): r.n for r in rows}


def rarest_first(grams: Iterable[tuple[str, bytes]], counts: dict[bytes, int]) -> dict:
    """word -> (its place in the window, window length) -> gram -> items.

    Each gram is filed under its rarest word, ties by the word itself.
    """
    index: dict = defaultdict(lambda: defaultdict(dict))
    for item, gram in grams:
        w = gram.split()
        at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        index[w[at]][(at, len(w))].setdefault(gram, []).append(item)
    return {k: [(at, n, found) for (at, n), found in v.items()] for k, v in index.items()}


def annotate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
             item_text: str = "text", window: int = WINDOW,
             block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` plus one struct column; also its name.

    The struct has ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``items`` (sorted distinct ids, as strings, of items with an
    occurring window), ``n_items``, ``items_sha256`` and ``contaminated``
    (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and are never contaminated. Null item
    texts have no window; a null item id reads ``null``. Repeated rows are
    judged one by one; a benchmark without windows hits nothing.
    """
    spark = docs.sparkSession
    grams = stored(item_windows(items, item_id, item_text, window), "windows")
    blocks = max(1, math.ceil(grams.count() / block_windows))
    name = fresh("contamination", docs)
    kind = "struct<n_words:bigint,n_hit:bigint,hit:binary,items:array<string>>"
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.binary()),
                       ("items", pa.list_(pa.string()))])
    where = docs.columns.index(text)
    out = docs
    for block in range(blocks):
        mine = grams
        if blocks > 1:
            mine = grams.where(F.pmod(F.xxhash64("item", "gram"), F.lit(blocks)) == block)
        rows = [(r.item, bytes(r.gram)) for r in mine.collect()]  # about block_windows rows
        counts = word_counts(docs, {w for _, g in rows for w in g.split()}, text)
        shared = spark.sparkContext.broadcast(rarest_first(rows, counts))

        def scan(batches: Iterable[pa.RecordBatch], shared=shared, first=block == 0):
            index = shared.value
            for batch in batches:
                before = [None] * batch.num_rows if first else batch.column(-1).to_pylist()
                found = [_hits(words(raw), index, b)
                         for raw, b in zip(text_bytes(batch.column(where)), before, strict=True)]
                if not first:
                    batch = batch.drop_columns([name])
                yield with_column(batch, name, pa.array(found, type=arrow))

        schema = docs.withColumn(name, F.lit(None).cast(kind)).schema
        out = out.mapInArrow(scan, schema)
    c = F.col(name)
    listed = F.array_sort(F.array_distinct(c["items"]))
    return out.withColumn(name, F.struct(
        c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((c["n_hit"] > 0) & (SHARE * c["n_hit"] >= c["n_words"])).alias("contaminated"))), name


def _hits(w: list[bytes], index: dict, before: dict | None) -> dict:
    """Words hit in one document, joined to what earlier blocks have found."""
    n = len(w)
    items = set(before["items"]) if before else set()
    mark = (np.unpackbits(np.frombuffer(before["hit"], np.uint8), count=n).astype(bool)
            if before and before["hit"] is not None else None)
    for at, word in enumerate(w):
        for place, size, grams in index.get(word, ()):
            start = at - place
            if start < 0 or start + size > n:
                continue
            known = grams.get(b" ".join(w[start:start + size]))
            if known:
                if mark is None:
                    mark = np.zeros(n, bool)
                mark[start:start + size] = True
                items.update(known)
    if mark is None:
        return {"n_words": n, "n_hit": 0, "hit": None, "items": []}
    return {"n_words": n, "n_hit": int(mark.sum()), "hit": np.packbits(mark).tobytes(),
            "items": sorted(items)}
