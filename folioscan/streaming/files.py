"""Verification of files as they arrive: the batch plan on each micro-batch of a streaming folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.rules import verify
from folioscan.plans.catalog import Profile
from folioscan.sources.pdf import read_files


def verify_stream(spark: SparkSession, path: str, out: str, checkpoint: str, profile: Profile | str = "a_1b", available_now: bool = True) -> StreamingQuery:
    """Writes issues and results of new files below path to out/issues and out/results, by batch: a repeated batch
    replaces its own folder, so every file's rows are there once."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.limit(1).count():
            return
        issues, results = verify(batch, profile)
        issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
        results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")

    writer = read_files(spark, path, stream=True).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def issue_counts(issues: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by rule and window of a stream of issues with a time ts; what is later than `late` is left out."""
    return issues.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "check_id").agg(F.count(F.lit(1)).alias("n"))
