"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cartlens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # delete reliable-checkpoint files once their DataFrame is gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def event_log_conf(directory: str | None) -> dict:
    """Spark event-log settings (stage and task times without the UI)."""
    if not directory:
        return {}
    os.makedirs(directory, exist_ok=True)
    return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": directory}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only a local session may leave it unset (tests): it gets a scratch
    folder. Anywhere else executors could not share that folder, so it raises.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="cartlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the JVM ends."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    Used before a block of several passes over the same data (fits, cuts,
    counts), so each pass reads just its columns of the written table instead of
    re-running the joins upstream, and a lost executor costs a re-read only.
    """
    path = scratch_table(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
