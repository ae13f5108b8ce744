"""Line dedup by a segment-partition edit join, in DataFrame functions only.

The first occurrence of a line stays; a later line that is equal to, or near, any
earlier line goes. Lines are near within ``edits`` edits that are also at most a
fifth of the longer line's characters (a similarity of 0.8): two edits from 10
characters on, one from 5, and shorter lines must be equal.

Equal lines are found by hash, and one of each takes part in the join. A line of
n characters is cut into one segment more than the edits that a line of its length
or a longer one may be away: a near line must hold one of them unchanged, near its
place. Segments are filed under (length, segment number, text); each line looks up
the substrings that length and place allow for every shorter length within reach. Letter counts discard most false
meetings inside the join, and what is left is verified by banded bit-parallel
edit distance: one bit per diagonal of the band, one word per number of edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, release, stored, with_row

EDITS = 2
#: near lines have at least as many characters for each edit, the longer one counted
CHARS = 5
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def allowed(longer: Column, edits: int) -> Column:
    """Edits that a line of ``longer`` characters and one no longer may be apart."""
    return F.least(F.lit(edits), F.floor(longer / CHARS).cast("int"))


def reach(length: Column, edits: int) -> Column:
    """The most edits that a line of ``length`` characters and one no shorter may be
    apart: d of them need d * CHARS characters in the longer one, which has at most
    d more than the other."""
    return F.least(F.lit(edits), F.floor(length / (CHARS - 1)).cast("int"))


def segment(length: Column, i: Column, edits: Column) -> tuple[Column, Column]:
    """(start, size) of segment i of the edits + 1 segments of a line, from 0; the
    later ones take what is left over."""
    parts = edits + 1
    short = F.floor(length / parts).cast("int")
    plain = parts - (length - short * parts)  # segments without an extra character
    return (i * short + F.greatest(i - plain, F.lit(0)),
            short + F.when(i >= plain, 1).otherwise(0))


def lookups(edits: int) -> list[tuple[int, int, int]]:
    """(characters shorter, segment, shift) of the substrings that a line looks
    up; its own segments come first. A match of segment i has at most i edits before
    it and edits - i behind it, and the lines' lengths fix their difference."""
    own = [(0, i, 0) for i in range(edits + 1)]
    found = [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
             for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return own + [x for x in found if x not in own]


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the character arrays ``a`` and ``b`` are within ``edits`` edits.

    Bit d of word r: the first j characters of b are within r edits of the first
    j + d - edits of a. Reading a character keeps a bit whose diagonal matches;
    an edit moves it along the band. Near lines are also similar, see ``allowed``.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def equal(c: Column, j: Column) -> Column:
        bits = F.lit(0)  # outside of a there is nothing to match
        for d in range(width):
            bits = bits.bitwiseOR(F.when(F.get(a, j + (d - edits)) == c, 1 << d).otherwise(0))
        return bits

    start = F.array(*[F.lit(((1 << (r + 1)) - 1) << edits & full) for r in range(edits + 1)])

    def read(words: Column, same: Column) -> Column:
        after = [F.get(words, F.lit(0)).bitwiseAND(same)]
        for r in range(1, edits + 1):
            before = F.get(words, F.lit(r - 1))
            after.append(F.get(words, F.lit(r)).bitwiseAND(same).bitwiseOR(before)
                         .bitwiseOR(F.shiftright(before, 1))
                         .bitwiseOR(F.shiftleft(after[-1], 1).bitwiseAND(F.lit(full))))
        return F.array(*after)

    last = F.aggregate(F.transform(b, equal), start, read)
    shorter = F.size(b) - F.size(a)
    end = F.call_function("shiftleft", F.lit(1), F.lit(edits) - shorter)
    most = allowed(F.greatest(F.size(a), F.size(b)), edits)
    return F.when(F.abs(shorter) <= edits, F.get(last, most).bitwiseAND(end) != 0
                  ).otherwise(False)


def _lines(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, n, line): each line without outer blanks; null texts have none."""
    return docs.select(F.col(row).alias("row"), F.posexplode(
        F.split(F.col(text), "\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def _counts(line: Column) -> Column:
    """How often each letter occurs, modulo 4, as two bits of Gray code: bits in
    which two lines differ are at most the sum of differences of their counts."""
    every = F.octet_length(line)

    def gray(n: Column) -> Column:
        return n.bitwiseXOR(F.shiftright(n, 1))

    return F.aggregate(
        F.array(*map(F.lit, _LETTERS)), F.lit(0).cast("long"),
        lambda bits, c: bits * 4 + gray((every - F.octet_length(F.replace(line, c))) % 4))


def _pieces_agree(u: Column, v: Column, edits: int, pieces: int = 8) -> Column:
    """Whether all but ``edits`` of the pieces of u are in v, near their place: an
    edit spoils one piece and shifts what follows by one."""
    n = (F.octet_length(u) / (4 * pieces)).cast("int")

    def cut(text: Column, start: Column) -> Column:
        return F.call_function("substring", text, 4 * start + 1, 4 * n)

    def found(i: Column) -> Column:
        return F.exists(F.sequence(F.lit(-edits), F.lit(edits)), lambda shift: (
            n * i + shift >= 0) & (cut(v, n * i + shift) == cut(u, n * i)))

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: ~found(i))) <= edits


def _keyed(lines: DataFrame, wanted: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """``lines`` (id, size, u and others) with ``key`` for each wanted substring;
    ``u`` has four bytes a character, so a piece is cut without reading up to it."""
    each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(
        ("less", "i", "shift"), x, strict=True)]) for x in wanted])
    length = F.col("size") - F.col("less")
    most = reach(length, edits)
    start, n = segment(length, F.col("i"), most)
    start = start + F.col("shift")
    # what ``lookups`` allows, by the edits that lines of this length may be apart
    behind = most - F.col("i")
    inside = ((most > 0) & (behind >= 0) & (F.abs(F.col("less") - F.col("shift")) <= behind)
              & (start >= 0) & (start + n <= F.col("size")))
    piece = F.call_function("substring", F.col("u"), 4 * start + 1, 4 * n)
    # equal keys stand for equal pieces; a chance meeting fails the verification
    return lines.select("*", F.inline(each)).where(inside).select(
        *[c for c in lines.columns if c not in ("size", "u")],
        (F.col("less") > 0).alias("longer"), F.xxhash64(length, F.col("i"), piece).alias("key"))


def near_lines(distinct: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, other) once for each pair of near lines of ``distinct`` (id, line, size).

    A first pass over all lines only finds those that meet any other in the
    index; the few that do are joined, filtered and verified.
    """
    spark, wanted = distinct.sparkSession, lookups(edits)
    own = wanted[:edits + 1]
    long = distinct.where(reach(F.col("size"), edits) > 0)  # others are near none
    wide = F.encode("line", "UTF-32").alias("u")
    every = long.select("id", "size", wide)
    asks = _keyed(every, wanted, edits).drop("longer")
    has = _keyed(every, own, edits).select(F.col("id").alias("other"),
                                                      F.col("key").alias("its_key"))
    meet = (F.col("key") == F.col("its_key")) & (F.col("id") != F.col("other"))
    met = stored(asks.join(has, meet, "left_semi").select("id")
                 .union(has.join(asks, meet, "left_semi").select("other")).distinct(), "met-lines")
    release(spark)
    texts = stored(distinct.join(met, "id", "left_semi").select(
        "id", "size", "line", _counts(F.col("line")).alias("counts")), "line-texts")
    release(spark)
    few = texts.select("id", "size", "counts", wide)
    index = _keyed(few, own, edits).select(
        F.col("id").alias("other"), F.col("counts").alias("theirs"), "key")
    # of two lines of one length the later id asks; an edit changes the letter
    # counts by 2 in all at most
    apart = F.bit_count(F.col("counts").bitwiseXOR(F.col("theirs")))
    pairs = (_keyed(few, wanted, edits).join(index, "key")
             .where((F.col("longer") | (F.col("id") > F.col("other")))
                    & (F.col("id") != F.col("other")) & (apart <= 2 * edits))
             .select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
             .distinct())
    texts = texts.select("id", F.col("line").alias("a"))
    other_text = texts.select(F.col("id").alias("other"), F.col("a").alias("b"))
    # few bytes, much work: spread over all cores
    both = (pairs.repartition(2 * partitions(distinct.sparkSession), "id", "other")
            .join(texts, "id").join(other_text, "other"))
    likely = stored(both.withColumn("u", F.encode("a", "UTF-32"))
                    .withColumn("v", F.encode("b", "UTF-32"))
                    .where(_pieces_agree(F.col("u"), F.col("v"), edits))
                    .select("id", "other", F.split("a", "").alias("a"),
                            F.split("b", "").alias("b")), "likely-pairs")
    return (likely.repartition(2 * partitions(distinct.sparkSession))
            .where(within(F.col("a"), F.col("b"), edits)).select("id", "other"))


def decided(docs: DataFrame, row: str, *, text: str = "text", edits: int = EDITS) -> DataFrame:
    """(row, drop): for each row that loses a line, whether each of its lines
    goes, in order. ``row`` is a unique long; smaller rows are earlier."""
    lines = _lines(docs, row, text)
    place = F.col("row").cast("decimal(38,0)") * F.lit(1 << 31) + F.col("n")
    hashes = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("k")]
    distinct = stored(
        lines.where("line <> ''").withColumn("place", place.cast("decimal(38,0)"))
        .groupBy("line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("id"), "line", "place", "copies", *hashes,
                F.char_length("line").alias("size")), "lines")
    release(docs.sparkSession)
    pairs = near_lines(distinct, edits)
    first = distinct.select("id", "place")
    later = (pairs.join(first, "id")
             .join(first.select(F.col("id").alias("other"), F.col("place").alias("at")), "other")
             .select(F.when(F.col("place") > F.col("at"), F.col("id")).otherwise(F.col("other"))
                     .alias("id")).distinct())
    near = stored(later, "near-lines")
    # lines that are seen once and near no earlier one stay: only the others are met
    known = (distinct.select("id", "place", "copies", "h", "k")
             .join(near.withColumn("near", F.lit(True)), "id", "left")
             .where("copies > 1 or near").select("h", "k", F.col("place").alias("first"), "near"))
    seen = lines.select("row", "n", *hashes, place.cast("decimal(38,0)").alias("place"))
    goes = F.coalesce(F.col("near") | (F.col("place") > F.col("first")), F.lit(False))
    return (seen.join(known, ["h", "k"], "left").select("row", "n", goes.alias("goes"))
            .groupBy("row").agg(F.max("goes").alias("any"), F.array_sort(
                F.collect_list(F.struct("n", "goes"))).alias("all"))
            .where("any").select("row", F.col("all.goes").alias("drop")))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", edits: int = EDITS
          ) -> tuple[DataFrame, str]:
    """All rows of ``docs`` with ``text`` cleaned, plus a struct column; its name.

    The struct has ``n_lines`` and ``n_removed``. The first occurrence of a line
    stays: rows are ordered by id if ids are integers, unique and not null, else
    as stored. Lines are compared without outer blanks; blank lines always stay.
    Null texts stay null, a text that loses all lines is empty, repeated rows
    lose what the first of them keeps, and an empty table stays empty. Texts and
    lines may have any length; columns of any other names may be there, as the
    operator's own get names that are not taken.
    """
    docs, row = with_row(docs, id_col)
    drop = fresh("drop", docs)
    gone = decided(docs, row, text=text, edits=edits).select(
        F.col("row").alias(row), F.col("drop").alias(drop))
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.get(F.col(drop), i)), "\n")
    name = fresh("line_dedup", docs)
    removed = F.size(F.filter(F.coalesce(F.col(drop), F.array().cast("array<boolean>")),
                              lambda x: x)).cast("long")
    out = docs.join(gone, row, "left").withColumn(name, F.struct(
        F.when(F.octet_length(text) > 0, F.size(lines)).otherwise(0).cast("long")
        .alias("n_lines"), removed.alias("n_removed")))
    out = out.withColumn(text, F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept))
    return out.drop(row, drop), name
