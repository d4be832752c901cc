"""Sweeps as a stream: the best measurement of every frequency so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sweep import measurements


def read_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Event lines that arrive as files in a folder; a file's time, in microseconds, is the order of its lines."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return lines.select(F.col("value").alias("line"), F.unix_micros("_metadata.file_modification_time").alias("ordinal"))


def running_best(lines: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The best-scored measurement of each (freq_mhz, band) so far; state is one row for each key."""
    found = measurements(lines, min_score)
    return (
        found.groupBy("freq_mhz", "band")
        .agg(F.min(F.struct((-F.col("score")).alias("less"), "ordinal", "channel_no", "snr_db", "obw_fraction", "power_db")).alias("best"))
        .select("freq_mhz", "band", "best.snr_db", "best.obw_fraction", (-F.col("best.less")).alias("score"), "best.power_db")
    )


def start(best: DataFrame, folder: str, checkpoint: str):
    """Run over what is there; every batch writes the keys that changed to a part of ``folder``.

    A batch that is run again after a failure overwrites its own part.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return best.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_best(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each (freq_mhz, band) that ``start`` wrote."""
    parts = spark.read.parquet(folder)
    latest = F.max_by(F.struct("snr_db", "obw_fraction", "score", "power_db"), "batch_id").alias("best")
    return parts.groupBy("freq_mhz", "band").agg(latest).select("freq_mhz", "band", "best.*")
