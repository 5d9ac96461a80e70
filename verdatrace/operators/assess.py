"""Accuracy against reference patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdatrace.functions.indices import SIZE_CLASSES, size_class
from verdatrace.model import Grid
from verdatrace.operators.patches import ClearingMap


def confusion(detected: DataFrame, reference: DataFrame, grid: Grid, label: str = "") -> DataFrame:
    """Counts and rates of two pixel masks on a grid; rates without a denominator are missing."""
    left = detected.select("row", "col").distinct().withColumn("_d", F.lit(1))
    right = reference.select("row", "col").distinct().withColumn("_r", F.lit(1))
    d, r = F.coalesce("_d", F.lit(0)), F.coalesce("_r", F.lit(0))
    counted = left.join(right, ["row", "col"], "full_outer").agg(F.count_if((d == 1) & (r == 1)).alias("tp"), F.count_if((d == 1) & (r == 0)).alias("fp"), F.count_if((d == 0) & (r == 1)).alias("fn"))
    whole = counted.withColumn("tn", F.lit(grid.width * grid.height) - F.col("tp") - F.col("fp") - F.col("fn"))
    rated = whole.select(F.lit(label).alias("label"), "tp", "fp", "fn", "tn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"))
    return rated.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def match_patches(clearing: ClearingMap, truth_pixels: DataFrame, records: DataFrame, min_iou: float = 0.2, tiers: tuple[str, ...] = ("confirmed",)) -> DataFrame:
    """Best overlapping detection of each reference patch, by intersection over union; ties go to the smaller id.

    Pixels meet in an equi-join; nothing compares all patches with all.
    """
    wanted = records.select("patch_id", "area_ha")
    reference = truth_pixels.join(wanted.select("patch_id"), "patch_id", "left_semi").select("row", "col", F.col("patch_id").alias("reference_id"))
    found = clearing.patch_pixels.join(clearing.of_tiers(*tiers).select("patch_id"), "patch_id", "left_semi").select("row", "col", F.col("patch_id").alias("detected_id"))
    pairs = reference.join(found, ["row", "col"]).groupBy("reference_id", "detected_id").agg(F.count("*").alias("both"))
    sized = pairs.join(found.groupBy("detected_id").agg(F.count("*").alias("d_pixels")), "detected_id").join(reference.groupBy("reference_id").agg(F.count("*").alias("r_pixels")), "reference_id")
    iou = F.col("both") / (F.col("d_pixels") + F.col("r_pixels") - F.col("both"))
    best = sized.groupBy("reference_id").agg(F.max_by(F.struct("detected_id", "d_pixels", iou.alias("iou")), F.struct(iou, -F.col("detected_id"))).alias("b"), F.count("*").alias("fragments"))
    every = reference.groupBy("reference_id").agg(F.count("*").alias("reference_pixels")).join(wanted, F.col("reference_id") == F.col("patch_id"))
    hit = F.coalesce(F.col("b.iou"), F.lit(0.0)) >= min_iou
    tier = clearing.patches.select(F.col("patch_id").alias("_t"), "tier")
    return every.join(best, "reference_id", "left").join(tier, F.col("b.detected_id") == F.col("_t"), "left").select(
        "reference_id", F.col("area_ha").alias("reference_area_ha"), size_class("area_ha").alias("size_class"), hit.alias("detected"),
        F.when(hit, F.col("b.detected_id")).alias("detected_id"), F.when(hit, F.col("b.d_pixels") * F.lit(clearing.grid.pixel_area_ha)).alias("detected_area_ha"),
        F.coalesce(F.col("b.iou"), F.lit(0.0)).alias("iou"), "tier", F.coalesce("fragments", F.lit(0)).alias("fragments"),
    )


def size_class_recall(matches: DataFrame) -> DataFrame:
    """Recall and mean overlap by size class; classes without reference patches are left out."""
    rank = F.array_position(F.array(*(F.lit(n) for n, _, _ in SIZE_CLASSES)), F.col("size_class"))
    grouped = matches.groupBy("size_class").agg(F.count("*").alias("reference_patches"), F.count_if("detected").alias("detected"), F.round(F.avg("iou"), 3).alias("mean_iou"), F.round(F.sum("reference_area_ha"), 2).alias("reference_ha"))
    return grouped.select("size_class", "reference_patches", "detected", F.round(F.col("detected") / F.col("reference_patches"), 3).alias("recall"), "mean_iou", "reference_ha").orderBy(rank)


def decoys(clearing: ClearingMap, kinds: DataFrame) -> DataFrame:
    """How much of each kind of ground each tier called clearing; ``kinds``: ``row, col, kind``."""
    ha = clearing.grid.pixel_area_ha
    px = kinds.select("row", "col", "kind").distinct().join(clearing.patch_pixels.select("row", "col", "tier_code"), ["row", "col"], "left")
    parts = [c for code, t in ((3, "confirmed"), (2, "s2_only"), (1, "s1_only")) for c in (F.round(F.count_if(F.col("tier_code") == code) * F.lit(ha), 2).alias(f"{t}_ha"), F.round(F.count_if(F.col("tier_code") == code) / F.count("*"), 4).alias(f"{t}_fraction"))]
    return px.groupBy("kind").agg(F.round(F.count("*") * F.lit(ha), 2).alias("reference_ha"), *parts)


def latency_summary(timing: DataFrame) -> DataFrame:
    """Median and worst latency of each sensor, and by how much radar is sooner."""
    med = lambda c: F.percentile(c, F.lit(0.5))
    return timing.agg(med("s2_latency_days").alias("s2_median_days"), med("s1_latency_days").alias("s1_median_days"), F.max("s2_latency_days").cast("double").alias("s2_max_days"), F.max("s1_latency_days").cast("double").alias("s1_max_days")).withColumn("advantage_days", F.col("s2_median_days") - F.col("s1_median_days"))


def area_bias(clearing: ClearingMap, records: DataFrame) -> DataFrame:
    """Confirmed area against that of the reference patches."""
    both = clearing.area_ha("confirmed").select(F.col("area_ha").alias("d")).crossJoin(records.agg(F.coalesce(F.sum("area_ha"), F.lit(0.0)).alias("r")))
    return both.select(F.round("d", 2).alias("detected_ha"), F.round("r", 2).alias("reference_ha"), F.round(F.col("d") - F.col("r"), 2).alias("bias_ha"), F.round(F.coalesce(F.try_divide(100 * (F.col("d") - F.col("r")), F.col("r")), F.lit(0.0)), 2).alias("bias_percent"))


def headline(accuracy: DataFrame, area: DataFrame) -> DataFrame:
    """One sentence on the confirmed tier."""
    return accuracy.crossJoin(area).select(F.format_string("Confirmed tier: precision %.3f, recall %.3f, IoU %.3f; area bias %.2f %%", "precision", "recall", "iou", "bias_percent").alias("headline"))
