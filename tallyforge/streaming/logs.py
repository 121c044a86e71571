"""The append log of scored responses as a stream: running means, and a watermarked window for late records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits

INSTANCE_LOG = (
    "instance_id string, data_source string, track string, step int, ts double, final_reward double, rule_correctness_score double, f2p_frac double, p2p_frac double,"
    " patch_format_score double, patch_apply_score double, infra_excluded double, rubric_score double, gated_out double, err_kind string, note string, resp_len long"
)
FIELDS = ["final_reward", "rule_correctness_score", "f2p_frac", "p2p_frac", "patch_format_score", "patch_apply_score", "infra_excluded", "rubric_score", "gated_out"]


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of a growing folder of JSON lines; ts (epoch seconds) as the timestamp `at`."""
    rows = spark.readStream.schema(INSTANCE_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.withColumn("at", F.timestamp_seconds("ts"))


def running_means(log: DataFrame) -> DataFrame:
    """Means so far by step and track: a state row for each of those."""
    return log.groupBy("step", "track").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in FIELDS])


def windowed_rates(log: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows, share of infrastructure failures and mean reward by time window and track; state is dropped once the watermark has passed a window."""
    return log.withWatermark("at", late).groupBy(F.window("at", width), "track").agg(F.count(F.lit(1)).alias("n"), F.avg("infra_excluded").alias("infra_rate"), F.avg("final_reward").alias("mean_reward"))


def write_means(means: DataFrame, path: str, checkpoint: str):
    """Starts a query that commits the means after each batch to path, for commits.read_committed(): a reader finds the whole table of the last committed batch, and a batch that is run again changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        commits.commit(batch, path, batch_id)

    return means.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def append_batches(log: DataFrame, path: str, checkpoint: str):
    """Starts a query that adds each batch of records to the log at path once, for commits.read_appended()."""

    def put(batch: DataFrame, batch_id: int) -> None:
        commits.append(batch, path, batch_id)

    return log.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()
