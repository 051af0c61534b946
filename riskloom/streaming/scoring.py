"""Structured Streaming scoring.

Scoring needs no state, so a stream of request records is scored with the
same column expressions / ``PipelineModel`` as the batch path:
``readStream`` (file source with an explicit schema) -> stateless transform
-> ``writeStream`` parquet sink.  The file sink plus the checkpoint location
give exactly-once output across restarts and executor loss; the checkpoint
location must be on shared storage (default: under the session's
``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions import features as ff
from ..operators import scoring
from ..sources.files import scratch_path


def rule_score(requests: DataFrame) -> DataFrame:
    """Rule points + base probability -> final probability and risk level."""
    pts = ff.rule_points("amount", "payment_method", "billing", "shipping", "device")
    out = requests.select("transaction_id", ff.tx_final_probability("base_pct", pts).alias("fraud_probability"))
    return out.withColumn("risk_level", ff.risk_level("fraud_probability", 75, 40))


def model_score(model: PipelineModel, feature_cols: list[str], threshold: float = 0.5,
                keep: tuple[str, ...] = ("transaction_id",)) -> Callable[[DataFrame], DataFrame]:
    """Request rows -> inferred features -> model probability (stateless)."""
    def fn(requests: DataFrame) -> DataFrame:
        x = scoring.infer_features_from_request(requests, feature_cols, keep=list(keep))
        return scoring.batch_score(model, x, feature_cols, threshold, keep=list(keep))
    return fn


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: StructType | str,
                         transform: Callable[[DataFrame], DataFrame], sink_dir: str,
                         checkpoint_dir: str | None = None, available_now: bool = True,
                         max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.  ``available_now``
    processes everything present, in bounded micro-batches, then stops."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = transform(reader.parquet(source_dir))
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream-ckpt"))
         .option("path", sink_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def score_directory_once(spark: SparkSession, source_dir: str, schema: StructType | str,
                         transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the stream over what is in ``source_dir`` now and return the sink
    as a batch DataFrame."""
    sink = scratch_path(spark, "stream-sink")
    q = start_scoring_stream(spark, source_dir, schema, transform, sink)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(sink)


__all__ = ["rule_score", "model_score", "start_scoring_stream", "score_directory_once"]
