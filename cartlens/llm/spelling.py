"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles.

Two words are one inserted, deleted or replaced code point apart exactly if their
common prefix and common suffix together reach the longer length less one. One of
the two then reaches half of that, so every such pair shares the first or the last
half of its letters: each word is filed under both halves, once among the words of
its own length and once among those one longer. A group that is still large is
halved again inside the stretch that is left, until it is small or a single letter
is left. The groups, in sorted order, are cut into blocks whose padded code-point
matrices are compared pair by pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: shortest word, fewest occurrences, and how much more frequent a form is
LEAST, TWICE, FACTOR = 7, 2, 10
#: one in so many occurrences loses a letter
DROPPED = 31
#: words of a group that are tiled without halving the group again
GROUP = 256
#: rows of a block, and cells of its code-point matrix (a block has one row at least)
BLOCK, CELLS = 128, 1 << 20
_PAD = 0x110000
_GROUP = ["length", "head", "tail", "limit", "key"]
_ROWS = "word string, n long, length int, head int, tail int, limit int, key string"


def words(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
          least: int = LEAST, fewest: int = TWICE, dropped: int = DROPPED) -> DataFrame:
    """(word, n): the counted words of all texts.

    Runs of letters with A-Z lower-cased. With h the crc32 of ``<id>:<run>``, a run
    loses its code point h % length where ``dropped`` divides h. Words shorter than
    ``least`` or rarer than ``fewest`` are left out. A null text has no words, a null
    id counts as an empty one; repeated rows count each time.
    """
    # a run shorter than the shortest word cannot become one
    runs = F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least},}}"), F.lit(0)))
    run = F.translate("run", UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                         F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at),
                     F.col("run").substr(at + 2, F.char_length("run")))
    return (docs.select(F.col(id_col), F.col(text)).select(F.col(id_col), runs.alias("run"))
            .select(F.col(id_col), run.alias("run")).select("run", h.alias("h"))
            .select(F.when(F.col("h") % dropped == 0, short).otherwise(F.col("run")).alias("word"))
            .where(F.char_length("word") >= least)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row once with more of its prefix and once with more of its suffix in the
    key. ``limit``: a pair whose common prefix reaches it is found under a prefix."""
    left = F.col("length") - F.col("head") - F.col("tail")
    half = F.expr("cast((length - head - tail) div 2 as int)")  # ceil((left - 1) / 2)
    pick = F.explode(F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("limit")),
        F.struct(F.col("head"), (F.col("tail") + half).alias("tail"),
                 F.least("limit", F.col("head") + half).alias("limit"))))
    return (rows.where(left > 1).select("word", "n", "length", pick.alias("c"))
            .select("word", "n", "length", "c.head", "c.tail", "c.limit",
                    _key(F.col("c.head"), F.col("c.tail")).alias("key")))


def _key(head: Column, tail: Column) -> Column:
    word = F.col("word")
    end = word.substr(F.char_length("word") - tail + 1, tail)
    return F.concat(word.substr(F.lit(1), head), F.when(tail > 0, end).otherwise(F.lit("")))


def groups(vocabulary: DataFrame, most: int = GROUP) -> DataFrame:
    """Rows of ``vocabulary`` (word, n) under the keys their near words share.

    Each round halves the groups of more than ``most`` rows; what is left at a single
    open letter holds one word a letter at most, and one shorter word.
    """
    length = F.char_length("word")
    filed = vocabulary.where(length > 0).select(
        "word", "n", F.explode(F.array(length, length + 1)).alias("length"))
    filed = stored(_halved(filed.selectExpr(
        "word", "n", "length", "0 head", "0 tail", "length limit")).union(
            # a single letter has no half: such words share the empty key
            filed.where("length = 1").selectExpr("word", "n", "length", "0 head", "0 tail",
                                                 "length limit", "'' key")), "filed")
    done = []
    while True:
        large = stored(filed.groupBy(_GROUP).count()
                       .where((F.col("count") > most) & F.expr("length - head - tail > 1"))
                       .drop("count"), "large")
        if not large.head(1):
            return stored_union([*done, filed])
        done.append(filed.join(large, _GROUP, "left_anti").select(filed.columns))
        filed = stored(_halved(filed.join(large, _GROUP, "left_semi")), "filed")


def stored_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


class _Block:
    """Consecutive rows of the sorted groups."""

    def __init__(self, first: int, group: np.ndarray, words: list[str], n: np.ndarray,
                 length: np.ndarray, limit: np.ndarray):
        self.first, self.group, self.words, self.n = first, group, words, n
        self.length, self.limit = length, limit
        self.size = np.array([len(w) for w in words])
        self.front = np.full((len(words), self.size.max(initial=0)), _PAD, np.uint32)
        self.back = self.front.copy()  # the letters from the last to the first
        for i, w in enumerate(words):
            code = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
            self.front[i, :len(code)], self.back[i, :len(code)] = code, code[::-1]


def _common(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of ``a`` with each row of ``b``, where
    ``open_`` says that it is wanted."""
    run, out = open_.copy(), np.zeros(open_.shape, np.int32)
    for k in range(min(a.shape[1], b.shape[1])):
        run &= a[:, k, None] == b[None, :, k]
        if not run.any():
            break
        out += run
    return out


def near(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and rows of ``b`` that are one edit apart and of one group."""
    wanted = a.group[:, None] == b.group[None, :]
    longest = np.maximum(a.size[:, None], b.size[None, :])
    wanted &= longest == a.length[:, None]
    if a is b:
        wanted &= np.arange(len(a.words))[:, None] < np.arange(len(a.words))[None, :]
    if not wanted.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prefix = _common(a.front, b.front, wanted)
    wanted &= prefix < a.limit[:, None]
    suffix = _common(a.back, b.back, wanted)
    wanted &= prefix + suffix >= longest - 1
    return np.nonzero(wanted)


def _best(block: _Block, at: np.ndarray, other: _Block, to: np.ndarray) -> pa.RecordBatch:
    """Per row of ``block`` that has near words: how many, and the most frequent one
    (the rows of a group are in the order of their words)."""
    order = np.lexsort((to, -other.n[to], at))
    rows, first, count = np.unique(at[order], return_index=True, return_counts=True)
    top = to[order][first]
    return pa.RecordBatch.from_pydict({
        "word": [block.words[i] for i in rows], "n_near": count.astype(np.int64),
        "form": [other.words[i] for i in top], "form_n": other.n[top]})


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each block of sorted rows with itself and with the earlier blocks that
    its first group began in."""
    opened: list[_Block] = []
    last, number, seen = None, -1, 0
    held: list[tuple] = []
    cells = 0

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal opened, seen
        group, found, n, length, limit = zip(*held, strict=True)
        block = _Block(seen, np.array(group), list(found), np.array(n, np.int64),
                       np.array(length), np.array(limit))
        seen += len(held)
        opened = [b for b in opened if b.group[-1] == block.group[0]]
        for b in [*opened, block]:
            i, j = near(b, block)
            if len(i):
                yield _best(b, i, block, j)
                yield _best(block, j, b, i)
        opened.append(block)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        for word, n, *group in zip(*columns, strict=True):
            if group != last:
                last, number = group, number + 1
            if held and (len(held) == BLOCK or (cells + 1) * len(word) > CELLS):
                yield from settle()
                held, cells = [], 0
            held.append((number, word, n, group[0], group[3]))
            cells += 1
    if held:
        yield from settle()


def near_words(vocabulary: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words: their number
    and the most frequent one, the smallest in code-point order among equals."""
    rows = groups(vocabulary, most)
    sorted_rows = (rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "word")
                   .select("word", "n", *_GROUP))
    links = sorted_rows.mapInArrow(_tiles, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return (links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.form").alias("form"),
                    (-F.col("best.less")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms. Chains have no
    circles, as a form is more frequent; each round doubles the steps taken."""
    found = stored(forms.selectExpr("word", "form root"), "roots")
    while True:
        step = found.selectExpr("word root", "root further")
        ahead = found.join(step, "root")
        if not ahead.head(1):
            return found
        found = stored(found.join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
             least: int = LEAST, fewest: int = TWICE, dropped: int = DROPPED,
             factor: int = FACTOR, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words(docs)``.

    ``form``: the near word of largest n (ties: smallest in code-point order) if that
    n is at least ``factor`` (2 or more) times the word's, else null. ``root``: where
    following the forms ends, the word itself without a form. Extra columns of
    ``docs`` are not read; their names do not matter. An empty table, or texts that
    are all null or empty, give no rows. A text of any length is read whole; a word
    of any length is compared whole.
    """
    vocabulary = stored(words(docs, id_col=id_col, text=text, least=least, fewest=fewest,
                              dropped=dropped), "words")
    named = vocabulary.join(near_words(vocabulary, most), "word", "left")
    big = F.col("form_n") >= factor * F.col("n")
    named = stored(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(big, F.col("form")).alias("form"),
        F.when(big, F.col("form_n")).alias("form_n")), "named")
    ends = roots(named.where("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
