"""Patches followed as acquisitions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_observations(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of observation files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def patch_windows(obs: DataFrame, patch_pixels: DataFrame, value: str, window: str = "90 days", late: str = "30 days") -> DataFrame:
    """Mean and count of the patch pixels by tumbling window; observations later than the watermark are dropped."""
    timed = obs.withColumn("ts", F.col("acq_date").cast("timestamp")).withWatermark("ts", late)
    joined = timed.join(patch_pixels.select("row", "col", "patch_id"), ["row", "col"])
    return joined.groupBy("patch_id", F.window("ts", window)).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select("patch_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def alerts(means: DataFrame, levels: DataFrame) -> DataFrame:
    """Windows whose mean lies below the patch's level: ``patch_id, start, mean, level``."""
    return means.join(levels.select("patch_id", "level"), "patch_id").where(F.col("mean") < F.col("level")).select("patch_id", "start", "mean", "level")
