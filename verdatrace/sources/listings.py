"""Scene indexes from archive listings: parsing, de-duplication, orbits, repeat-pass search.

Listings are DataFrames with one prefix or page a row; nothing here opens a
network connection.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of the scene names, the orbit cycle, offsets by mission, and days between repeats.
OPTICAL_NAME = r"(S2[ABC])_(\d{2}[A-Z]{3})_(\d{8})_(\d+)_L2A"
RADAR_NAME = r"(S1[ABC])_(\w{2})_(GRD[HM])_1S(\w{2})_(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{6})_(\w{6})_(\w{4})"
CYCLE, ORBIT_OFFSETS, DEFAULT_OFFSET, REPEAT_DAYS = 175, {"S1A": 73, "S1B": 27, "S1C": 73}, 73, 12
TILE_NAME = r"^T?0?(\d{1,2})([A-Z])([A-Z]{2})$"


def list_prefixes(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Common prefixes of listing pages in the XML of an object store: ``prefix``, and ``next_token`` of the page."""
    strip = F.regexp_replace(xml, r'\sxmlns="[^"]*"', "")
    found = pages.select(F.xpath(strip, F.lit("//CommonPrefixes/Prefix/text()")).alias("p"), F.nullif(F.xpath_string(strip, F.lit("//NextContinuationToken")), F.lit("")).alias("next_token"))
    return found.select(F.explode_outer("p").alias("prefix"), "next_token")


def tile_parts(tile: str | Column = "tile") -> list[Column]:
    """``zone``, ``band`` and ``square`` of a tile name; missing where it is none."""
    t = F.upper(F.trim(F.col(tile) if isinstance(tile, str) else tile))
    return [F.when(t.rlike(TILE_NAME), F.regexp_extract(t, TILE_NAME, k)).alias(n) for k, n in ((1, "zone"), (2, "band"), (3, "square"))]


def optical_scenes(prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Parsed optical scenes: ``scene_id, mission, tile, acq_date, sequence``; other prefixes are left out."""
    part = lambda k: F.regexp_extract(prefix, OPTICAL_NAME, k)
    return prefixes.where(F.col(prefix).rlike(OPTICAL_NAME)).select(part(0).alias("scene_id"), part(1).alias("mission"), part(2).alias("tile"), F.to_date(part(3), "yyyyMMdd").alias("acq_date"), part(4).cast("int").alias("sequence"))


def latest_per_date(scenes: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Within the dates, the scene with the highest sequence of each tile and day."""
    if start is not None and end is not None:
        scenes = scenes.where(F.col("acq_date").between(F.lit(start), F.lit(end)))
    best = scenes.groupBy("tile", "acq_date").agg(F.max_by(F.struct("scene_id", "mission", "sequence"), F.struct("sequence", "scene_id")).alias("b"))
    return best.select("b.scene_id", "b.mission", "tile", "acq_date", "b.sequence")


def relative_orbit(absolute: Column, mission: Column) -> Column:
    """Relative orbit, 1 to 175, from the absolute one."""
    offset = F.coalesce(F.create_map(*(F.lit(x) for k, v in ORBIT_OFFSETS.items() for x in (k, v)))[mission], F.lit(DEFAULT_OFFSET))
    return F.pmod(absolute - offset, F.lit(CYCLE)) + 1


def radar_scenes(prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Parsed radar scenes with start time and orbits; other prefixes are left out."""
    part = lambda k: F.regexp_extract(prefix, RADAR_NAME, k)
    made = prefixes.where(F.col(prefix).rlike(RADAR_NAME)).select(part(0).alias("scene_id"), part(1).alias("mission"), part(2).alias("mode"), part(4).alias("pols"), F.to_timestamp_ntz(part(5), F.lit("yyyyMMdd'T'HHmmss")).alias("start_time"), part(7).cast("int").alias("absolute_orbit"))
    return made.withColumns({"acq_date": F.to_date("start_time"), "relative_orbit": relative_orbit(F.col("absolute_orbit"), F.col("mission")), "orbit_state": F.when(F.hour("start_time") < 12, "ascending").otherwise("descending")})


def overpass_bands(lon: float, width_hours: float = 2.0) -> list[tuple[int, int]]:
    """Hours of UTC in which a sun-synchronous radar passes a longitude: around 18 and 6 o'clock local time."""
    centres = [(local - lon / 15) % 24 for local in (18.0, 6.0)]
    return [tuple(math.floor((c + s * width_hours / 2) % 24) for s in (-1, 1)) for c in centres]


def in_bands(hour: Column, bands: list[tuple[int, int]]) -> Column:
    """Whether an hour is in any band; a band may wrap midnight."""
    out = F.lit(False)
    for low, high in bands:
        out = out | (hour.between(low, high) if low <= high else (hour >= low) | (hour <= high))
    return out


def covers(footprint: Column | str, lon: Column, lat: Column) -> Column:
    """Whether a point lies in the outer ring of any polygon of a GeoJSON footprint: an odd number of edges lies east of it."""
    text = F.col(footprint) if isinstance(footprint, str) else footprint
    shape = F.coalesce(F.get_json_object(text, "$.footprint"), F.get_json_object(text, "$.geometry"), text)
    at, ring = F.get_json_object(shape, "$.coordinates"), "array<array<array<double>>>"
    polygons = F.when(F.get_json_object(shape, "$.type") == "Polygon", F.array(F.from_json(at, ring))).otherwise(F.from_json(at, f"array<{ring}>"))

    def east(a: Column, b: Column) -> Column:
        across = (a[1] > lat) != (b[1] > lat)
        return across & (lon < (b[0] - a[0]) * (lat - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0])

    def inside(outer: Column) -> Column:
        edges = F.zip_with(outer, F.slice(outer, F.lit(2), F.size(outer)), lambda a, b: F.when(b.isNotNull(), east(a, b)).otherwise(F.lit(False)))
        return F.size(F.filter(edges, lambda x: x)) % 2 == 1

    return F.when(text.isNotNull(), F.exists(polygons, lambda rings: inside(rings[0])))


def seed_scenes(scenes: DataFrame, bands: list[tuple[int, int]], start: date, days: int = REPEAT_DAYS) -> DataFrame:
    """Scenes of one repeat cycle from a day on, in the hours that can see the place."""
    return scenes.where(F.datediff("acq_date", F.lit(start)).between(0, days - 1) & in_bands(F.hour("start_time"), bands))


def repeat_passes(scenes: DataFrame, anchor: date, start: date, end: date, orbit: int) -> DataFrame:
    """Scenes on the orbit, whole repeat cycles away from the anchor; of the slices of a day the earliest."""
    on = (F.col("relative_orbit") == orbit) & F.col("acq_date").between(F.lit(start), F.lit(end)) & (F.pmod(F.datediff("acq_date", F.lit(anchor)), F.lit(REPEAT_DAYS)) == 0)
    kept = [c for c in scenes.columns if c != "acq_date"]
    best = scenes.where(on).groupBy("acq_date").agg(F.min_by(F.struct(*kept), F.struct("start_time", "scene_id")).alias("b"))
    return best.select("acq_date", *(f"b.{c}" for c in kept))


# Public catalogues: name, address, optical and radar collection, whether addresses of assets must be signed, remarks.
CATALOGUES = [
    ("earth-search", "https://earth-search.aws.element84.com/v1", "sentinel-2-l2a", "sentinel-1-grd", False, "open to all; radar is detected in ground range, not corrected for terrain"),
    ("planetary-computer", "https://planetarycomputer.microsoft.com/api/stac/v1", "sentinel-2-l2a", "sentinel-1-rtc", True, "radar is corrected for terrain, which hills need"),
    ("cdse", "https://catalogue.dataspace.copernicus.eu/stac", "SENTINEL-2", "SENTINEL-1", False, "the agency's own archive; asks for a free account"),
]


def catalogues(spark) -> DataFrame:
    """Known catalogues, one row each."""
    return spark.createDataFrame(CATALOGUES, "catalogue string, url string, optical_collection string, radar_collection string, requires_signing boolean, notes string")


def stac_items(items: DataFrame, collection: str, bbox: tuple[float, float, float, float], start: date, end: date, max_cloud: float | None = None, orbit_state: str | None = None) -> DataFrame:
    """Catalogue items (``id, collection, bbox, properties`` as read from JSON) that match; the filters push down."""
    w, s, e, n = bbox
    b, p = F.col("bbox"), "properties"
    found = items.where((F.col("collection") == collection) & (b[0] <= e) & (b[2] >= w) & (b[1] <= n) & (b[3] >= s) & F.to_date(F.substring(f"{p}.datetime", 1, 10)).between(F.lit(start), F.lit(end)))
    if max_cloud is not None:
        found = found.where(F.col(f"{p}.`eo:cloud_cover`") < 100 * max_cloud)
    if orbit_state is not None:
        found = found.where(F.lower(F.col(f"{p}.`sat:orbit_state`")) == orbit_state.lower())
    if found.isEmpty():
        raise LookupError("no items match")
    return found


def tile_for(lon: float, lat: float) -> str:
    """Name of the 100 km tile of a place, such as ``55JGG``, between 80 degrees south and 84 north."""
    from verdatrace.model import utm_forward

    if not -80 <= lat <= 84:
        raise ValueError("tiles reach from 80 degrees south to 84 north")
    zone = int((lon + 180) // 6) % 60 + 1
    band = "CDEFGHJKLMNPQRSTUVWX"[min(int((lat + 80) // 8), 19)]
    if band == "V" and zone == 31 and lon >= 3:
        zone = 32
    if band == "X" and 31 < zone < 37 and zone % 2 == 0:  # the even zones around Svalbard are left out
        zone += 1 if (lon - (6 * zone - 186)) >= 3 else -1
    east, north = utm_forward(lon, lat, zone, lat < 0)
    column = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")[zone % 3][int(east // 100_000) - 1]
    row = "ABCDEFGHJKLMNPQRSTUV"[(int(north // 100_000) + (0 if zone % 2 else 5)) % 20]
    return f"{zone:02d}{band}{column}{row}"


def grid_for_aoi(tile: str, lon: float, lat: float, size: int, resolution: float, crs: str | None = None):
    """A square grid around a place, its origin on a whole multiple of the resolution of the tile's zone."""
    from verdatrace.functions.indices import zone_and_band
    from verdatrace.model import Grid, utm_forward

    zone, band, _ = zone_and_band(tile)
    south = band < "N"
    crs = crs or f"EPSG:{'327' if south else '326'}{int(zone):02d}"
    east, north = utm_forward(lon, lat, int(crs[-2:]), crs[-5:-2] == "327")
    half = size * resolution / 2
    return Grid.from_origin(crs, math.floor((east - half) / resolution) * resolution, math.ceil((north + half) / resolution) * resolution, resolution, size, size)


def grid_from_centres(xs: list[float], ys: list[float], crs: str):
    """The grid whose pixel centres these are: half a pixel out from the first, north up."""
    from verdatrace.model import Grid

    dx, dy = abs(xs[1] - xs[0]), abs(ys[1] - ys[0])
    return Grid(crs, dx, 0.0, min(xs) - dx / 2, 0.0, -dy, max(ys) + dy / 2, len(xs), len(ys))
