"""Radar calibration: look-up tables from annotation XML, and digital numbers to decibels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.functions.indices import linear_to_db
from verdatrace.operators.spatial import block_mean_power


def _vectors(annotations: DataFrame, xml: str, vector: str, values: str) -> DataFrame:
    path = f"//{vector}"
    text = lambda tag: F.xpath(xml, F.lit(f"{path}/{tag}/text()"))
    zipped = F.arrays_zip(text("line").alias("line"), text("pixel").alias("pixel"), text(values).alias("value"))
    rows = annotations.select("scene_id", F.posexplode(zipped).alias("line_ix", "v"))
    split = lambda c: F.split(F.trim(c), r"\s+")
    points = rows.select("scene_id", "line_ix", F.col("v.line").cast("bigint").alias("line"), F.posexplode(F.arrays_zip(split(F.col("v.pixel")).alias("p"), split(F.col("v.value")).alias("x"))).alias("pixel_ix", "z"))
    return points.select("scene_id", "line_ix", "pixel_ix", "line", F.col("z.p").cast("bigint").alias("pixel"), F.col("z.x").cast("double").alias("value"))


def calibration_lut(annotations: DataFrame, quantity: str = "gamma", xml: str = "xml") -> DataFrame:
    """``sigmaNought``, ``betaNought`` or ``gamma`` vectors as points ``scene_id, line_ix, pixel_ix, line, pixel, value``."""
    return _vectors(annotations, xml, "calibrationVector", quantity)


def noise_lut(annotations: DataFrame, xml: str = "xml") -> DataFrame:
    """Noise vectors of either annotation baseline; scenes without any have no rows."""
    modern = F.size(F.xpath(xml, F.lit("//noiseRangeVector/line/text()"))) > 0
    return _vectors(annotations.where(modern), xml, "noiseRangeVector", "noiseRangeLut").unionAll(_vectors(annotations.where(~modern), xml, "noiseVector", "noiseLut"))


def calibrate(pixels: DataFrame, factor: int = 1, dn: str = "dn", gain: str = "gain", noise: str | None = "noise") -> DataFrame:
    """Digital numbers to decibels: noise off, gain off, block means in power; nothing at or below zero."""
    power = F.col(dn) * F.col(dn) - (F.coalesce(F.col(noise), F.lit(0.0)) if noise else F.lit(0.0))
    linear = pixels.select("row", "col", (power / (F.col(gain) * F.col(gain))).alias("p")).withColumn("p", F.when(F.col("p") > 0, F.col("p")))
    return block_mean_power(linear, ["p"], factor).select("row", "col", linear_to_db("p").alias("db"))


def interpolate_lut(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values at ``line, pixel`` between the four points around; outside the table its edge holds.

    Look-up tables are a few thousand points a scene.  Each place meets the two
    bracketing lines and columns through equi-joins on their numbers.
    """
    axes = points.groupBy("scene_id").agg(F.array_sort(F.collect_set(F.struct(F.col("line").alias("at"), F.col("line_ix").alias("ix")))).alias("lines"), F.array_sort(F.collect_set(F.struct(F.col("pixel").alias("at"), F.col("pixel_ix").alias("ix")))).alias("pixels"))

    def bracket(axis: str, at: str) -> Column:
        """Numbers of the two entries around a place, and the share of the upper one."""
        below = F.size(F.filter(axis, lambda a: a["at"] <= F.col(at))) - 1
        low = F.greatest(F.least(below, F.size(axis) - 2), F.lit(0))
        lo, hi = F.get(axis, low), F.get(axis, F.least(low + 1, F.size(axis) - 1))
        share = F.greatest(F.least((F.col(at) - lo["at"]) / F.nullif(hi["at"] - lo["at"], F.lit(0)), F.lit(1.0)), F.lit(0.0))
        return F.struct(lo["ix"].alias("lo"), hi["ix"].alias("hi"), F.coalesce(share, F.lit(0.0)).alias("w"))

    placed = wanted.join(axes, "scene_id").select("scene_id", "line", "pixel", bracket("lines", "line").alias("l"), bracket("pixels", "pixel").alias("p"))
    corners = placed.select("scene_id", "line", "pixel", "l.w", F.col("p.w").alias("u"), F.explode(F.array(*(F.struct(F.col(f"l.{a}").alias("line_ix"), F.col(f"p.{b}").alias("pixel_ix"), ((F.col("l.w") if a == "hi" else 1 - F.col("l.w")) * (F.col("p.w") if b == "hi" else 1 - F.col("p.w"))).alias("k")) for a in ("lo", "hi") for b in ("lo", "hi")))).alias("q"))
    flat = corners.select("scene_id", "line", "pixel", "q.line_ix", "q.pixel_ix", "q.k")
    return flat.join(points.select("scene_id", "line_ix", "pixel_ix", "value"), ["scene_id", "line_ix", "pixel_ix"]).groupBy("scene_id", "line", "pixel").agg(F.sum(F.col("k") * F.col("value")).alias("value"))
