"""When each patch fell, and how soon each sensor could see it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdatrace.functions.indices import nbr
from verdatrace.model import DetectionConfig, Periods
from verdatrace.operators.detect import Change
from verdatrace.operators.masks import in_window, scl_valid


def patch_dates(obs: DataFrame, patch_pixels: DataFrame, value: str, scene: str = "scene_id") -> DataFrame:
    """Mean of the present pixels, and their share, for each patch and acquisition."""
    joined = obs.select("row", "col", "acq_date", scene, value).join(patch_pixels.select("row", "col", "patch_id"), ["row", "col"])
    return joined.groupBy("patch_id", "acq_date", scene).agg(F.avg(value).alias("mean"), (F.count(value) / F.count("*")).alias("clear_fraction"))


def first_crossing(series: DataFrame, levels: DataFrame, drop_fraction: float = 0.5, min_clear_fraction: float = 0.0, scene: str = "scene_id") -> DataFrame:
    """First acquisition below the level with the next two usable ones below too: ``patch_id, detected``.

    ``levels``: ``patch_id, baseline, floor``; patches whose baseline is not
    above the floor have no date.  Near the end fewer followers suffice.
    """
    known = levels.where(F.col("baseline") > F.col("floor")).select("patch_id", (F.col("floor") + (F.col("baseline") - F.col("floor")) * (1 - drop_fraction)).alias("level"))
    usable = series.where(F.col("mean").isNotNull() & (F.col("clear_fraction") >= min_clear_fraction)).join(known, "patch_id").withColumn("below", F.col("mean") < F.col("level"))
    order = W.partitionBy("patch_id").orderBy("acq_date", scene)
    held = usable.withColumn("held", F.col("below") & F.coalesce(F.lead("below", 1).over(order), F.lit(True)) & F.coalesce(F.lead("below", 2).over(order), F.lit(True)))
    return held.where("held").groupBy("patch_id").agg(F.min("acq_date").alias("detected"))


def _levels(pixels: DataFrame, patch_pixels: DataFrame, before: str, after: str) -> DataFrame:
    return patch_pixels.join(pixels.select("row", "col", before, after), ["row", "col"]).groupBy("patch_id").agg(F.avg(before).alias("baseline"), F.avg(after).alias("floor"))


def estimate(optical_obs: DataFrame, radar_obs: DataFrame | None, optical: Change, radar: Change | None, patch_pixels: DataFrame, periods: Periods, config: DetectionConfig | None = None, buffer_days: int = 60, drop_fraction: float = 0.5, min_clear_fraction: float = 0.6, dense: bool = False) -> DataFrame:
    """``patch_id, s2_detection_date, s1_detection_date, first_detection_date`` for every patch.

    The composites of the detectors are used again instead of made anew.
    """
    config = config or DetectionConfig()
    start, end = periods.pre_end - timedelta(days=buffer_days), periods.post_start + timedelta(days=buffer_days)
    patches = patch_pixels.select("patch_id").distinct()
    masked = scl_valid(in_window(optical_obs, start, end), radius=config.dilation_pixels, dense=dense).withColumn("nbr", F.when(F.col("valid"), nbr()))
    s2 = first_crossing(patch_dates(masked, patch_pixels, "nbr"), _levels(optical.pixels, patch_pixels, "pre_nbr", "post_nbr"), drop_fraction, min_clear_fraction)
    out = patches.join(s2.withColumnRenamed("detected", "s2_detection_date"), "patch_id", "left")
    if radar_obs is not None and radar is not None:
        s1 = first_crossing(patch_dates(in_window(radar_obs, start, end), patch_pixels, "vh_db"), _levels(radar.pixels, patch_pixels, "pre_vh_db", "post_vh_db"), drop_fraction)
        out = out.join(s1.withColumnRenamed("detected", "s1_detection_date"), "patch_id", "left")
    else:
        out = out.withColumn("s1_detection_date", F.lit(None).cast("date"))
    return out.withColumn("first_detection_date", F.least("s2_detection_date", "s1_detection_date"))


def with_latency(timing: DataFrame, truth_patches: DataFrame) -> DataFrame:
    """True event dates and the days until each sensor saw them."""
    joined = timing.join(truth_patches.select("patch_id", "event_date"), "patch_id", "left")
    return joined.select("patch_id", "event_date", "s2_detection_date", "s1_detection_date", "first_detection_date", F.datediff("s2_detection_date", "event_date").alias("s2_latency_days"), F.datediff("s1_detection_date", "event_date").alias("s1_latency_days"))
