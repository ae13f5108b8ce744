"""Customer-table sources and sinks: scan, header cleanup, numeric coercion,
and saving/loading of fitted bundles."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_records
from .shop import NUMERIC_COLUMNS, SHOP_COLUMNS


def normalize_header(name: str) -> str:
    """Upper-case, spaces to ``_``, then strip (so ``' b '`` becomes ``_B_``)."""
    return name.upper().replace(" ", "_").strip()


def snake_name(name: str) -> str:
    """Our column naming: lower snake case without punctuation."""
    s = re.sub(r"[^0-9a-zA-Z]+", "_", name.strip()).strip("_").lower()
    return re.sub(r"_+", "_", s)


def normalize_headers(df: DataFrame, snake: bool = True) -> DataFrame:
    """Rename every column in one projection (``toDF``), optionally to snake case."""
    names = [normalize_header(c) for c in df.columns]
    if snake:
        names = [snake_name(n) for n in names]
    return df.toDF(*names)


# What counts as a number in text: Java's own parser would also take the type
# suffixes of its literals (12d, 7f).
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"

# The cells that a CSV reader of data frames takes as missing.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def to_double(col: str | Column) -> Column:
    """Text to double; what is not a number, and NaN, become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    x = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    return F.nanvl(x, F.lit(None).cast("double"))


def coerce_numeric(df: DataFrame, cols: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Coerce named columns to double; numbers are only cast, and columns that
    are absent are skipped."""
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: to_double(c) if kinds[c] == "string"
        else F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        for c in cols if c in kinds})


def read_csv(spark: SparkSession, path: str, na_values: Sequence[str] = NA_VALUES,
             bad_rows: str | None = None, line_end: str = "\n") -> DataFrame:
    """A CSV with a header as text columns, quoted as data-frame readers expect:
    a doubled quote is a quote, and quoted cells may hold commas and line ends.
    One file is read by as many tasks as it has ranges.

    A row with another number of cells than the header fails the read; with
    ``bad_rows`` it is kept, and the column of that name has its text (NULL for
    sound rows).
    """
    options = {"multiLine": "true", "quote": '"', "escape": '"', "inferSchema": "false",
               "columnPruning": "false"}  # else a wrong count of cells goes unseen
    names = spark.read.options(header="true", **options).csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in names]
    if bad_rows:
        fields.append(T.StructField(bad_rows, T.StringType()))
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_rows}
    else:
        options["mode"] = "FAILFAST"
    schema = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in fields)
    cells = F.from_csv("record", schema, options).alias("cells")
    df = (csv_records.records(spark, path, line_end).where(~F.col("header"))
          .select(cells).select("cells.*"))
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(list(na_values)), F.col(f"`{c}`"))
                           for c in names})


def read_customers(spark: SparkSession, path: str, fmt: str = "csv",
                   na_values: Sequence[str] = NA_VALUES, bad_rows: str | None = None
                   ) -> DataFrame:
    """Scan a customer table (CSV with header, or parquet) into snake-case columns.

    CSV goes through :func:`read_csv`. Parquet keeps its own types. Numbers are
    coerced in both cases.
    """
    if fmt == "csv":
        df = read_csv(spark, path, na_values, bad_rows)
        df = df.toDF(*[c if c == bad_rows else snake_name(normalize_header(c))
                       for c in df.columns])
    else:
        df = normalize_headers(spark.read.format(fmt).load(path))
    if "customer_id" in df.columns:
        df = df.withColumn("customer_id", F.col("customer_id").try_cast("long"))
    return coerce_numeric(df)


def validate_columns(df: DataFrame, required: Sequence[str] = SHOP_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# ---------------------------------------------------------------- A4
def save_bundle(path: str, models: dict, tables: dict[str, DataFrame], meta: dict) -> None:
    """Persist fitted ML stages, fitted lookup tables and plain metadata.

    ``path`` should live on shared storage (e.g. under spark.checkpoint.dir).
    """
    for name, model in models.items():
        model.write().overwrite().save(os.path.join(path, "models", name))
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(os.path.join(path, "tables", name))
    meta = dict(meta, _tables=sorted(tables))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "meta"))


def load_bundle(spark: SparkSession, path: str, model_types) -> tuple[dict, dict, dict]:
    """Models, tables and metadata; ``model_types`` maps a model's name to its
    class, or is a function of the metadata that gives such a map."""
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    types = model_types(meta) if callable(model_types) else model_types
    models = {name: cls.load(os.path.join(path, "models", name)) for name, cls in types.items()}
    tables = {name: spark.read.parquet(os.path.join(path, "tables", name))
              for name in meta.pop("_tables", [])}
    return models, tables, meta
