"""Scoring requests that arrive as files: the batch scoring job on a stream.

The scoring of a request is stateless (features, aligned slots, scaler,
model, nearest centroid), so it runs unchanged on a streaming DataFrame. The
sink is parquet with a checkpoint in the shared checkpoint folder, so a
restarted query resumes exactly where it stopped (exactly-once file sink).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import ScoringBundle, score_requests
from ..session import ensure_checkpoint_dir

REQUEST_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("gender", T.StringType()),
    T.StructField("purchase_amount_usd", T.DoubleType()),
    T.StructField("previous_purchases", T.DoubleType()),
    T.StructField("frequency_of_purchases", T.StringType()),
    T.StructField("review_rating", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("promo_code_used", T.StringType()),
])


def request_stream(spark: SparkSession, source_dir: str, max_files: int = 1000) -> DataFrame:
    """Parquet request files as a stream with a declared schema."""
    return (spark.readStream.schema(REQUEST_SCHEMA)
            .option("maxFilesPerTrigger", max_files).parquet(source_dir))


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, bundle: ScoringBundle,
                  name: str = "scoring", available_now: bool = True) -> StreamingQuery:
    """Start the scoring stream; ``available_now`` processes what is there and stops."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    scored = score_requests(request_stream(spark, source_dir), bundle)
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).outputMode("append").queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
