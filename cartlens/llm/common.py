"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import pickle
import time
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the JVM ends."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str, level: int = 3, page: int = 1 << 20) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: later passes read columns of a finished table, and a lost
    executor costs a re-read only. ``level``: of the Zstandard compression;
    ``page``: bytes compressed together.
    """
    path = folder(df.sparkSession, name)
    (df.write.option("compression", "zstd")
     .option("parquet.compression.codec.zstd.level", str(level))
     .option("parquet.page.size", str(page)).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver to let go of finished jobs.

    Spark deletes shuffle files once the driver has collected the plans that
    wrote them; by itself that may be long after a stage's result was stored. A
    plan's Python handle goes first, what it held in the JVM the next time.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def share(spark: SparkSession, value):
    """A function for workers that gives ``value``, sent once to each executor.

    The value travels with the code of its classes, as the functions do."""
    packed, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(pickle.loads(packed.value))
        return held[0]

    return get


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a unique long column that every scan gives alike; its name.

    That is the id itself if it is an integer, unique and never null; otherwise
    the rows are stored once with a number.
    """
    name = fresh("row", docs)
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        ids = docs.groupBy(F.col(id_col).alias("i")).count()
        if not ids.where("i is null or count > 1").head(1):
            return docs.withColumn(name, F.col(id_col).cast("long")), name
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def dense_rank_offsets(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and ``pid`` (stored partition id): rows in earlier partitions.

    The result has at most groups x partitions rows, whatever the row count.
    """
    from pyspark.sql import Window

    per = rows.groupBy(*groups, "pid").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
