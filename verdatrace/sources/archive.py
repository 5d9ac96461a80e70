"""Loads from archives and catalogues: listings page by page, resampling, solar days, both sensors on one grid.

Nothing here opens a network connection.  ``fetch(prefix, token)`` gives the XML
of one listing page; pixels come from :func:`verdatrace.sources.scenes.read_rasters`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdatrace.functions.indices import linear_to_db, zone_and_band
from verdatrace.model import Grid, Scene
from verdatrace.sources.listings import covers, latest_per_date, list_prefixes, optical_scenes, overpass_bands, radar_scenes, seed_scenes
from verdatrace.sources.scenes import assemble_optical, assemble_radar

Fetch = Callable[[str, "str | None"], str]

# First part of the keys of both archives.
OPTICAL_ROOT, RADAR_ROOT = "sentinel-s2-l2a-cogs", "GRD"


def listing_pages(prefixes: DataFrame, fetch: Fetch) -> DataFrame:
    """All pages below each ``prefix``: ``root, xml``; prefixes are listed in parallel, the pages of one in turn.

    A page that cannot be fetched fails the listing: a part of it would pass for the whole.
    """
    import pandas as pd

    def run(batches):
        from xml.etree import ElementTree

        for pdf in batches:
            for root in pdf["prefix"]:
                token = None
                while True:
                    try:
                        xml = fetch(root, token)
                        tree = ElementTree.fromstring(xml)
                    except Exception as e:
                        raise LookupError(f"cannot list {root}: {e}") from e
                    yield pd.DataFrame({"root": [root], "xml": [xml]})
                    token = tree.findtext("{*}NextContinuationToken")
                    if tree.findtext("{*}IsTruncated") != "true" or not token:
                        break

    return prefixes.select("prefix").mapInPandas(run, "root string, xml string")


def _listed(spark: SparkSession, prefixes: list[str], fetch: Fetch) -> DataFrame:
    made = spark.createDataFrame([(p,) for p in prefixes], "prefix string").repartition(max(1, len(prefixes)))
    return list_prefixes(listing_pages(made, fetch)).where("prefix IS NOT NULL").select("prefix")


def list_tile(spark: SparkSession, tile: str, start: date, end: date, fetch: Fetch) -> DataFrame:
    """Latest optical scenes of a tile within the dates; none at all raises LookupError."""
    place = "/".join((OPTICAL_ROOT, *zone_and_band(tile)))
    months = range(start.year * 12 + start.month - 1, end.year * 12 + end.month)
    found = latest_per_date(optical_scenes(_listed(spark, [f"{place}/{m // 12}/{m % 12 + 1}/" for m in months], fetch)), start, end)
    if found.isEmpty():
        raise LookupError(f"no scenes of tile {tile} between {start} and {end}")
    return found


def list_days(spark: SparkSession, start: date, days: int, fetch: Fetch, mode: str = "IW", pols: str = "DV") -> DataFrame:
    """Radar scenes of consecutive days in one mode and polarisation."""
    on = [start + timedelta(days=k) for k in range(days)]
    return radar_scenes(_listed(spark, [f"{RADAR_ROOT}/{d.year}/{d.month}/{d.day}/{mode}/{pols}/" for d in on], fetch))


def orbits_over(scenes: DataFrame, footprints: DataFrame, lon: float, lat: float, start: date) -> DataFrame:
    """Scenes of the repeat cycle from ``start`` whose footprint (``scene_id, footprint``) holds a place, earliest first.

    Their relative orbits are those that see the place.  Scenes without a
    footprint are left out; LookupError if none remains.
    """
    seeds = seed_scenes(scenes, overpass_bands(lon), start)
    if seeds.isEmpty():
        raise LookupError(f"no scenes at the hours of the overpasses in the cycle from {start}")
    hits = seeds.join(footprints.select("scene_id", "footprint"), "scene_id").where(covers("footprint", F.lit(lon), F.lit(lat))).drop("footprint")
    if hits.isEmpty():
        raise LookupError(f"no scene covers {lat:.4f}, {lon:.4f} in the cycle from {start}")
    return hits.orderBy("start_time")


def resample(pixels: DataFrame, source: Grid, target: Grid, method: str = "nearest", keys: tuple[str, ...] = ("scene_id", "asset"), value: str = "raw", nodata: float = 0) -> DataFrame:
    """Pixels of ``source`` on ``target``, both in one projection: ``keys, row, col, value``.

    ``nearest`` takes the source pixel under a target centre; ``bilinear``
    weighs the four centres around it, without those that have no data, and
    rounds nothing.  Target pixels without data have no row.  Only the window of
    the source that the target needs is read; a source pixel is copied to the
    few target pixels that it reaches, never joined to the whole target.
    """
    if source.crs != target.crs:
        raise ValueError("both grids must be in one projection")
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"no such method: {method}")
    # Target index t lies at source place scale * t + shift, pixel centres being whole numbers.
    axes = {
        "col": (target.a / source.a, (target.c + target.a / 2 - source.c) / source.a - 0.5, target.width),
        "row": (target.e / source.e, (target.f + target.e / 2 - source.f) / source.e - 0.5, target.height),
    }
    reach = 0.5 if method == "nearest" else 1.0
    has = pixels.where((F.col(value) != F.lit(nodata)) & F.col(value).isNotNull())
    for axis, (scale, shift, size) in axes.items():
        has = has.where(F.col(axis).between(shift - reach, scale * (size - 1) + shift + reach))

    def reached(axis: str) -> Column:
        """Target indexes that use a source index, with its weight at each."""
        scale, shift, size = axes[axis]
        low = F.greatest(F.ceil((F.col(axis) - reach - shift) / scale), F.lit(0))
        high = F.least(F.floor((F.col(axis) + reach - shift) / scale), F.lit(size - 1))
        away = lambda t: t * scale + shift - F.col(axis)
        if method == "nearest":
            weight, used = lambda t: F.lit(1.0), lambda t: (away(t) >= -0.5) & (away(t) < 0.5)
        else:
            weight, used = lambda t: 1 - F.abs(away(t)), lambda t: F.abs(away(t)) < 1
        ts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.filter(ts, used), lambda t: F.struct(t.alias("t"), weight(t).alias("w")))

    spread = has.select(*keys, F.col(value).alias("_v"), reached("row").alias("_r"), F.explode(reached("col")).alias("_c")).select(*keys, "_v", "_c", F.explode("_r").alias("_r"))
    placed = spread.select(*keys, F.col("_r.t").cast("int").alias("row"), F.col("_c.t").cast("int").alias("col"), "_v", (F.col("_r.w") * F.col("_c.w")).alias("_w"))
    if method == "nearest":
        return placed.select(*keys, "row", "col", F.col("_v").alias(value))
    return placed.groupBy(*keys, "row", "col").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias(value))


def solar_day(moment: Column, lon: float) -> Column:
    """Date of a moment in UTC by the sun at a longitude."""
    days = F.floor((F.unix_timestamp(moment) + F.lit(round(lon * 240))) / 86_400).cast("int")
    return F.date_add(F.to_date(F.lit("1970-01-01")), days)  # whatever the zone of the session


def with_days(items: DataFrame, lon: float) -> DataFrame:
    """Items (``id, properties``) as a scene index ``scene_id, moment, acq_date, orbit_state`` by solar day."""
    p = F.col("properties")
    state = F.lower(p["sat:orbit_state"]) if "sat:orbit_state" in items.select("properties.*").columns else F.lit(None).cast("string")
    made = items.select(F.col("id").alias("scene_id"), F.to_timestamp(p["datetime"]).alias("moment"), F.coalesce(state, F.lit("unknown")).alias("orbit_state"))
    return made.withColumn("acq_date", solar_day(F.col("moment"), lon))


def solar_day_cube(pixels: DataFrame, index: DataFrame, value: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Pixels ``scene_id, asset, row, col, raw`` and their index, merged by solar day.

    The earliest scene of a day that has data at a pixel gives its value, the
    name and the orbit of a day are those of its earliest scene.  Scenes without
    a moment are left out.
    """
    index = index.where("acq_date IS NOT NULL")
    first = F.struct("moment", "scene_id")
    days = index.groupBy("acq_date").agg(F.min_by(F.struct("scene_id", "orbit_state"), first).alias("d")).select("d.scene_id", "acq_date", "d.orbit_state")
    dated = pixels.where((F.col(value) != 0) & F.col(value).isNotNull()).join(index.select("scene_id", "moment", "acq_date"), "scene_id")
    merged = dated.groupBy("acq_date", "asset", "row", "col").agg(F.min_by(value, first).alias(value))
    return merged.join(days.select("scene_id", "acq_date"), "acq_date").select("scene_id", "asset", "row", "col", value), days


def optical_cube(pixels: DataFrame, items: DataFrame, lon: float) -> DataFrame:
    """Optical observations of a catalogue's items, one scene a solar day."""
    return assemble_optical(*solar_day_cube(pixels, with_days(items, lon)))


def radar_cube(pixels: DataFrame, items: DataFrame, lon: float) -> DataFrame:
    """Radar observations in decibels from linear power of assets ``vv`` and ``vh``, one scene a solar day."""
    merged, days = solar_day_cube(pixels, with_days(items, lon))
    return assemble_radar(merged.select("scene_id", F.lower("asset").alias("pol"), "row", "col", linear_to_db("raw").alias("db")), days)


def both_sensors(optical: DataFrame, optical_grid: Grid, radar: DataFrame, radar_grid: Grid) -> Scene:
    """A scene of both sensors; grids of different shape raise ValueError."""
    if optical_grid.shape != radar_grid.shape:
        raise ValueError(f"optical is {optical_grid.shape}, radar {radar_grid.shape}: load both at one resolution over one area")
    return Scene(optical_grid, optical, radar)
