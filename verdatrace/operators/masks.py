"""Predicates and masks: scene classes, dilation, dates, orbits, gates, truth kinds."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scene classes that are usable, and those that are grown before masking.
VALID_SCL = (4, 5, 6, 7)
DILATED_SCL = (3, 8, 9, 10, 1)


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets (row, column) within a radius."""
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]


def dilate(pixels: DataFrame, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """All pixels within a disc of the given ones, by ``keys``; only the given pixels are multiplied."""
    if radius <= 0:
        return pixels.select(*keys, "row", "col").distinct()
    offsets = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in disc(radius)))
    near = pixels.select(*keys, "row", "col").distinct().withColumn("o", F.explode(offsets))
    return near.select(*keys, (F.col("row") + F.col("o.y")).alias("row"), (F.col("col") + F.col("o.x")).alias("col")).distinct()


def _near_dense(obs: DataFrame, bad: Column, radius: int, scene: str) -> DataFrame:
    """``obs`` with ``_near``, for scenes without gaps: one pass along rows, one along columns.

    A disc is a stack of row segments, so the rows' running maxima of each
    segment length are looked up at the rows above and below.  Nothing is
    multiplied, however cloudy the scene.
    """
    reach = {y: max(x for yy, x in disc(radius) if yy == y) for y in range(radius + 1)}
    along, down = W.partitionBy(scene, "row").orderBy("col"), W.partitionBy(scene, "col").orderBy("row")
    widths = sorted(set(reach.values()))
    flagged = obs.withColumn("_bad", bad.cast("int")).select("*", *(F.max("_bad").over(along.rangeBetween(-w, w)).alias(f"_w{w}") for w in widths))
    # Rows up to the farthest at which a segment of this length, or a longer one, still lies in the disc.
    tall = {w: max(y for y, x in reach.items() if x >= w) for w in widths}
    near = reduce(lambda a, b: F.greatest(a, b), [F.max(f"_w{w}").over(down.rangeBetween(-tall[w], tall[w])) for w in widths] + [F.lit(0)])
    return flagged.withColumn("_near", near == 1).drop("_bad", *(f"_w{w}" for w in widths))


def scl_valid(obs: DataFrame, valid: tuple[int, ...] = VALID_SCL, grown: tuple[int, ...] = DILATED_SCL, radius: int = 3, scene: str = "scene_id", dense: bool = False) -> DataFrame:
    """``obs`` with ``valid``: a usable class that no grown class of the same scene lies near.

    Without ``dense`` only the bad pixels are multiplied and joined, which suits
    scattered observations and clear skies; ``dense`` is for whole rasters.
    """
    if dense and radius > 0:
        near = _near_dense(obs, F.coalesce(F.col("scl").isin(*grown), F.lit(False)), radius, scene)
        return near.withColumn("valid", F.coalesce(F.col("scl").isin(*valid), F.lit(False)) & ~F.col("_near")).drop("_near")
    usable = F.coalesce(F.col("scl").isin(*valid), F.lit(False))
    if radius <= 0:
        return obs.withColumn("valid", usable)
    shadow = dilate(obs.where(F.col("scl").isin(*grown)), radius, (scene,)).withColumn("_near", F.lit(True))
    return obs.join(shadow, [scene, "row", "col"], "left").withColumn("valid", usable & F.col("_near").isNull()).drop("_near")


def cloud_fraction(obs: DataFrame, valid: tuple[int, ...] = VALID_SCL, scene: str = "scene_id") -> DataFrame:
    """Share of pixels without a usable class, by scene; nothing is grown."""
    return obs.groupBy(scene).agg((1 - F.avg(F.coalesce(F.col("scl").isin(*valid), F.lit(False)).cast("double"))).alias("cloud_fraction"))


def in_window(obs: DataFrame, start: date, end: date) -> DataFrame:
    """Observations from the first to the last day, both included."""
    return obs.where(F.col("acq_date").between(F.lit(start), F.lit(end)))


def screen_scenes(obs: DataFrame, max_cloud: float, scene: str = "scene_id") -> DataFrame:
    """Observations of scenes that are clear enough; classes are looked at before bands are read."""
    if max_cloud >= 1.0:
        return obs
    clear = cloud_fraction(obs, scene=scene).where(F.col("cloud_fraction") <= max_cloud)
    return obs.join(clear.select(scene), scene, "left_semi")


def cloud_free_days(obs: DataFrame, threshold: float = 0.6, scene: str = "scene_id") -> DataFrame:
    """How many scenes are at most so cloudy."""
    return cloud_fraction(obs, scene=scene).agg(F.count_if(F.col("cloud_fraction") <= threshold).alias("days"))


def by_orbit(obs: DataFrame, state: str) -> DataFrame:
    """Passes of one direction, whatever its case; without directions ValueError."""
    if "orbit_state" not in obs.columns:
        raise ValueError("the passes have no orbit directions")
    return obs.where(F.lower("orbit_state") == state.lower())


def all_gates(names: list[str] | tuple[str, ...]) -> Column:
    """Whether all gates are open; a missing gate is shut."""
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce(F.col(name), F.lit(False))
    return out


def rejections(pixels: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """Pixels that each gate shuts out: ``gate``, ``pixels``."""
    counted = pixels.agg(*(F.count_if(~F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names))
    return counted.unpivot([], list(names), "gate", "pixels")


def truth_kind(truth_pixels: DataFrame, truth_patches: DataFrame, kind: str) -> DataFrame:
    """Truth pixels of ``clearing``, ``fire``, ``crop`` (any kind that begins so) or ``decoy`` (fire and crop)."""
    k = F.col("kind")
    wanted = {"crop": k.startswith("crop"), "decoy": k.startswith("crop") | (k == "fire")}.get(kind, k == kind)
    return truth_pixels.join(truth_patches.where(wanted).select("patch_id"), "patch_id", "left_semi")
