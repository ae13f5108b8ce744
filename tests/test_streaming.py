"""The scoring job gives the same rows on a stream as in batch."""

from pyspark.sql import functions as F

from conftest import SF_CHECK
from cartlens import catalog
from cartlens.plans.scoring import score_requests
from cartlens.streaming.scoring import REQUEST_SCHEMA, start_scoring


def test_stream_equals_batch(spark, tmp_path):
    bundle = catalog.scoring_bundle(spark, SF_CHECK)
    req = catalog.shop(spark, SF_CHECK).select(*[f.name for f in REQUEST_SCHEMA.fields])
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    req.repartition(3).write.parquet(src)
    q = start_scoring(spark, src, sink, bundle, name=f"t{id(tmp_path)}")
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    batch = score_requests(req, bundle)
    assert streamed.count() == batch.count() == req.count()
    diff = (streamed.alias("s").join(batch.alias("b"), "customer_id")
            .where((F.abs(F.col("s.probability") - F.col("b.probability")) > 1e-12)
                   | (F.col("s.segment") != F.col("b.segment"))))
    assert diff.count() == 0
