"""Grids, areas, periods, parameters and table schemas."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import asdict, dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Reflectance bands in canonical order.
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")

_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType()}


def _schema(fields: str) -> T.StructType:
    """A flat schema from ``name TYPE`` pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


OPTICAL = _schema("scene_id STRING, obs_id BIGINT, acq_date DATE, row INT, col INT, " + ", ".join(f"{b} DOUBLE" for b in BANDS) + ", scl INT")
RADAR = _schema("scene_id STRING, obs_id BIGINT, acq_date DATE, orbit_state STRING, row INT, col INT, vv_db DOUBLE, vh_db DOUBLE")
TRUTH_PIXELS = _schema("row INT, col INT, patch_id INT")
TRUTH_PATCHES = _schema("patch_id INT, name STRING, kind STRING, event_date DATE, reclear_date DATE, recovery_tau_years DOUBLE, recovery_target DOUBLE, requested_area_ha DOUBLE, area_ha DOUBLE, pixels BIGINT")


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """``df`` reduced to the expected columns, in order and cast; a missing one raises ValueError."""
    missing = [f.name for f in expected if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(df[f.name].cast(f.dataType) for f in expected))


@dataclass(frozen=True)
class Grid:
    """North-up raster geometry: x = c + a * column, y = f + e * row."""

    crs: str
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    width: int
    height: int

    @classmethod
    def from_origin(cls, crs: str, west: float, north: float, resolution: float, width: int, height: int) -> Grid:
        return cls(crs, resolution, 0.0, west, 0.0, -resolution, north, width, height)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def resolution(self) -> float:
        return abs(self.a)

    @property
    def pixel_area_m2(self) -> float:
        return abs(self.a * self.e)

    @property
    def pixel_area_ha(self) -> float:
        return self.pixel_area_m2 / 10_000

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        return self.c, self.f + self.e * self.height, self.c + self.a * self.width, self.f

    def area_ha(self, pixels: float) -> float:
        return pixels * self.pixel_area_ha

    def pixels_for_ha(self, hectares: float) -> int:
        """Pixels that come nearest to an area, one at least."""
        return max(1, round(hectares / self.pixel_area_ha))

    def finer(self, native: float) -> tuple[Grid, int]:
        """The same extent at about the native resolution, and how many times finer that is."""
        factor = max(1, round(self.resolution / native))
        if factor == 1:
            return self, 1
        return Grid(self.crs, self.a / factor, self.b, self.c, self.d, self.e / factor, self.f, self.width * factor, self.height * factor), factor


@dataclass(frozen=True)
class AOI:
    """An area of interest in degrees."""

    name: str
    west: float
    south: float
    east: float
    north: float
    crs: str = "EPSG:32755"

    def __post_init__(self) -> None:
        if self.west >= self.east or self.south >= self.north:
            raise ValueError("west must be below east, and south below north")

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return self.west, self.south, self.east, self.north

    @property
    def centroid(self) -> tuple[float, float]:
        return (self.west + self.east) / 2, (self.south + self.north) / 2


def _date(value: Any) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


@dataclass(frozen=True)
class Periods:
    """The windows before and after an event, and the whole record."""

    pre_start: date
    pre_end: date
    post_start: date
    post_end: date
    series_start: date
    series_end: date

    def __post_init__(self) -> None:
        for name in self.__dataclass_fields__:
            object.__setattr__(self, name, _date(getattr(self, name)))
        if not (self.pre_start < self.pre_end <= self.post_start < self.post_end):
            raise ValueError("the windows must follow each other; they may share a day")
        if self.series_start > self.pre_start or self.series_end < self.post_end:
            raise ValueError("the series must span both windows")

    @property
    def event_window(self) -> tuple[date, date]:
        return self.pre_end, self.post_start

    @property
    def default_event(self) -> date:
        """Middle of the gap between the windows."""
        return self.pre_end + (self.post_start - self.pre_end) // 2

    def phenology_offset_days(self) -> int:
        """Days of the year between the middles of both windows, the shorter way round."""
        doy = [(s + (e - s) // 2).timetuple().tm_yday for s, e in ((self.pre_start, self.pre_end), (self.post_start, self.post_end))]
        apart = abs(doy[0] - doy[1])
        return min(apart, 365 - apart)

    def check_phenology(self, tolerance_days: int = 21) -> int:
        apart = self.phenology_offset_days()
        if apart > tolerance_days:
            warnings.warn(f"the windows are {apart} days of the year apart; seasonal change will read as loss", stacklevel=2)
        return apart


@dataclass(frozen=True)
class DetectionConfig:
    """Parameters of detection and fusion. The defaults."""

    min_pre_ndvi: float = 0.40
    min_pre_nbr: float = 0.18
    min_pre_ndvi_persistent: float = 0.35
    pre_percentile: float = 10.0
    max_pre_seasonal_amplitude: float | None = None
    pre_amplitude_months: int = 24
    min_pre_ndvi_absolute: float = 0.15
    adaptive_woody_quantile: float | None = None
    adaptive_change_mad: float | None = None
    adaptive_change_floor: float = 0.6
    dnbr_threshold: float = 0.20
    dndvi_threshold: float = 0.15
    min_clear_observations: int = 3
    max_cloud_cover: float = 0.6
    dilation_pixels: int = 3
    vh_drop_db: float = 2.0
    min_pre_vh_db: float = -20.0
    speckle_window: int = 5
    adaptive_vh_mad: float | None = None
    min_s1_observations: int = 3
    min_mapping_unit_ha: float = 0.5
    opening_iterations: int = 1
    confirm_overlap: float = 0.30
    fill_holes: bool = True


@dataclass(frozen=True)
class RegrowthConfig:
    """Parameters of the recovery analysis. The defaults."""

    season_months: int = 3
    min_seasons_post: int = 4
    recovered_fraction: float = 0.80
    stalled_fraction: float = 0.30
    stalled_slope_per_year: float = 0.01
    deseasonalise: bool = True
    cultivated_amplitude: float = 0.30
    recent_years: float = 2.0
    reclear_drop: float = 0.15
    min_recovery_for_reclear: float = 0.10


@dataclass(frozen=True)
class PipelineConfig:
    """Everything that one area needs."""

    aoi: AOI
    periods: Periods
    detection: DetectionConfig = field(default_factory=DetectionConfig)
    regrowth: RegrowthConfig = field(default_factory=RegrowthConfig)
    resolution: float = 10.0

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(asdict(self), indent=indent, default=str)

    @classmethod
    def from_json(cls, text: str) -> PipelineConfig:
        d = json.loads(text)
        return cls(AOI(**d["aoi"]), Periods(**d["periods"]), DetectionConfig(**d.get("detection", {})), RegrowthConfig(**d.get("regrowth", {})), float(d.get("resolution", 10.0)))


def demo_config() -> PipelineConfig:
    """A five-kilometre area with one before and one after year. Fixed values."""
    return PipelineConfig(
        AOI("Demonstration area", 149.10, -30.95, 149.16, -30.90, "EPSG:32755"),
        Periods(date(2019, 3, 1), date(2019, 11, 30), date(2020, 3, 1), date(2020, 11, 30), date(2019, 1, 1), date(2025, 12, 31)),
    )


def flatten(value: dict, prefix: str = "") -> list[tuple[str, Any]]:
    """Leaves of a nested dict with dotted keys, in order."""
    out: list[tuple[str, Any]] = []
    for k, v in value.items():
        out += flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", v)]
    return out


@dataclass
class Scene:
    """Observations on one grid, with the truth where it is known; ``dense`` if every scene has all pixels."""

    grid: Grid
    optical: DataFrame
    radar: DataFrame | None = None
    truth_pixels: DataFrame | None = None
    truth_patches: DataFrame | None = None
    dense: bool = False


def utm_forward(lon: float, lat: float, zone: int, south: bool) -> tuple[float, float]:
    """Easting and northing on WGS 84, by the usual series for the transverse Mercator."""
    f, k0, a = 1 / 298.257223563, 0.9996, 6378137.0
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    lam, phi, c = math.radians(lon - (6 * zone - 183)), math.radians(lat), 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    east = eta + sum(x * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, x in enumerate(alpha, 1))
    north = xi + sum(x * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, x in enumerate(alpha, 1))
    return 500_000 + k0 * big_a * east, (10_000_000 if south else 0) + k0 * big_a * north
