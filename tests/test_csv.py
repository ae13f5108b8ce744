"""CSV files read by ranges give the rows of a reader of whole files."""

import csv
import io
import random

import pytest

from cartlens.sources import csv_records
from cartlens.sources.io import read_csv

CELLS = ["a", "", "x y", 'say "hi"', "1,2", "two\nlines", "\n", '"', '""', 'a\n"b",\n"c', "é\r\nü",
         "NA", '",', ',"', "long " * 30, "\n\n\n"]


def written(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


def whole_file(spark, path):
    """What Spark's own reader gives, with one task a file."""
    rows = (spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
            .collect())
    return sorted((tuple(None if v in ("", "NA") else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_same_rows_at_any_range_size(spark, tmp_path, size, quoting):
    r = random.Random(size)
    rows = [["id", "one", "two"]] + [[str(i), r.choice(CELLS), r.choice(CELLS)] for i in range(60)]
    if size == 7:
        rows = rows[:25]
    (tmp_path / "x.csv").write_bytes(written(rows, quoting).encode())
    (tmp_path / "y.csv").write_bytes(written([rows[0], *rows[5:9]], quoting, "\r\n").encode())
    before = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                         "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted(map(tuple, read_csv(spark, str(tmp_path)).collect()), key=str)
        tasks = csv_records.lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == whole_file(spark, str(tmp_path))
    want = [tuple(None if c in ("", "NA") else c for c in row) for row in rows[1:]]
    assert sorted(got, key=str) == sorted([*want, *want[4:8]], key=str)
    assert tasks > 5 or size > 1000


def test_stray_quotes_and_bad_rows(spark, tmp_path):
    text = 'id,one,two\n1,5" pipe,x\n2,"a"b,y\n\n3,short\n4,"open,\n5",z\n6,a,b,c\n'
    (tmp_path / "x.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = read_csv(spark, str(tmp_path), bad_rows="bad").collect()
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
            read_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", 4 << 20)
    sound = {r.id: (r.one, r.two) for r in rows if r.bad is None}
    assert sound == {"1": ('5" pipe', "x"), "2": ('"a"b', "y"), "4": ("open,\n5", "z")}
    assert sorted(r.bad for r in rows if r.bad is not None) == ["3,short", "6,a,b,c"]


def test_empty_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,one\n")
    assert read_csv(spark, str(tmp_path)).collect() == []
    (tmp_path / "x.csv").write_text('id,one\n1,"last line\nhas no end"')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path)).collect()] == [
        ("1", "last line\nhas no end")]
