"""CSV records from file ranges, so that one large file is read by many tasks.

A quoted cell may hold line ends, so where a range begins, a line may lie inside a
cell. What a line does is a function of that: it leaves off inside a cell or not, if
it began outside, and if it began inside. The functions of a range's lines are put
together in one aggregate, those of a file's ranges by a running window with one row
a range. Ranges without a cell across lines are then parsed as they are; in the others
the lines of a record, which may lie in several ranges, are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# a quoted cell's inside; a whole cell, with what may follow a closing quote; cells
# that a comma ends
_INSIDE = r'(?:[^"]++|"")*+'
_CELL = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+'
_OPEN = rf'(?:{_CELL},)*+"{_INSIDE}\z'
#: the line ends inside a cell, if it began outside or inside one
FROM_OUTSIDE = rf"\A{_OPEN}"
FROM_INSIDE = rf'\A{_INSIDE}(?:\z|"[^,]*+,{_OPEN})'
_RANGE = ["file", "start"]


def lines(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """(file, start, at, line): every line, the range it begins in, and its place."""
    return spark.read.option("lineSep", line_end).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _functions() -> tuple[Column, Column]:
    """Whether a line ends inside a cell, begun outside and begun inside one."""
    quoted = F.col("line").contains('"')
    return (quoted & F.col("line").rlike(FROM_OUTSIDE),
            ~quoted | F.col("line").rlike(FROM_INSIDE))


def _odd(n: Column) -> Column:
    return n % 2 == 1


def ranges(text: DataFrame) -> DataFrame:
    """(file, start, first, inside, whole) per range of ``lines``: its first line's
    place, whether it begins inside a cell, and whether each of its lines is a record."""
    outside, inside = _functions()
    fixed, turns = outside == inside, outside & ~inside
    per = (text.select("file", "start", "at", outside.alias("outside"), fixed.alias("fixed"),
                       turns.alias("turns"))
           .groupBy(*_RANGE).agg(
               F.min("at").alias("first"),
               # the last line that ends the same way however it began
               F.max(F.when(F.col("fixed"), F.struct("at", "outside"))).alias("last"),
               # lines that open a cell: the only ones that turn the state around
               F.collect_list(F.when(F.col("turns"), F.col("at"))).alias("turned"),
               F.max(F.col("outside")).alias("opens")))
    after = F.size(F.filter("turned", lambda t: F.col("last").isNull() | (t > F.col("last.at"))))
    files = Window.partitionBy("file").orderBy("start")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file", "start", "first", "opens", _odd(after).alias("turn"),
                     F.col("last.outside").alias("ends"))
    per = per.withColumn("turns", F.sum(F.col("turn").cast("int")).over(files))
    known = F.when(F.col("ends").isNotNull(), F.struct(
        (F.col("ends") != F.col("turn")).alias("ends"), "turns"))
    per = per.select("*", F.last(known, ignorenulls=True).over(earlier).alias("known"),
                     F.coalesce(F.sum(F.col("turn").cast("int")).over(earlier), F.lit(0))
                     .alias("before"))
    begins = F.when(F.col("known").isNull(), _odd(F.col("before"))).otherwise(
        F.col("known.ends") != _odd(F.col("before") - F.col("known.turns")))
    return per.select("file", "start", "first", begins.alias("inside"),
                      (~begins & ~F.col("opens")).alias("whole"))


def records(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """(record, header): every record's text and whether it is the first of its file.

    Empty lines between records are none. Lines end in ``line_end``, with or without
    a carriage return before it. A file that Spark cannot split, such as a gzip one,
    is one range. The scan runs twice, once for the ranges' functions.
    """
    text = lines(spark, path, line_end)
    found = ranges(text)
    at_start = F.min("first").over(Window.partitionBy("file"))
    placed = text.join(found.withColumn("head", at_start), _RANGE)
    whole = placed.where("whole").select("line", (F.col("at") == F.col("head")).alias("header"))

    outside, inside = _functions()
    in_range = Window.partitionBy(*_RANGE).orderBy("at")
    earlier = in_range.rowsBetween(Window.unboundedPreceding, -1)
    rows = (placed.where(~F.col("whole")).select(
        "file", "start", "at", "line", "head", "inside", outside.alias("outside"),
        (outside == inside).alias("fixed"), (outside & ~inside).cast("int").alias("turn"))
        .withColumn("turns", F.sum("turn").over(in_range)))
    known = F.when(F.col("fixed"), F.struct("outside", "turns"))
    rows = rows.select("*", F.last(known, ignorenulls=True).over(earlier).alias("known"))
    before = F.col("turns") - F.col("turn")
    begins = F.when(F.col("known").isNull(), F.col("inside") != _odd(before)).otherwise(
        F.col("known.outside") != _odd(before - F.col("known.turns")))
    rows = rows.select("file", "start", "at", "line", "head", F.when(~begins, F.col("at"))
                       .alias("begins"))
    last = F.last("begins", ignorenulls=True)
    # a line inside a cell belongs to the last record begun, in an earlier range if need be
    carried = (rows.groupBy(*_RANGE).agg(F.max("begins").alias("latest"))
               .select("file", "start", F.last("latest", ignorenulls=True).over(
                   Window.partitionBy("file").orderBy("start")
                   .rowsBetween(Window.unboundedPreceding, -1)).alias("carried")))
    rows = (rows.withColumn("own", last.over(in_range)).join(carried, _RANGE)
            .select("file", "head", "at", "line",
                    F.coalesce("own", "carried").alias("record")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start_at", "line"))),
                        lambda p: p["line"])
    joined = (rows.withColumnRenamed("at", "start_at").groupBy("file", "record", "head")
              .agg(F.array_join(parts, line_end).alias("line"))
              .select("line", (F.col("record") == F.col("head")).alias("header")))
    trimmed = F.regexp_replace("line", r"\r\z", "")
    return whole.union(joined).select(trimmed.alias("record"), "header").where("record <> ''")
