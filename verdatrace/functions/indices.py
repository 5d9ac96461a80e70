"""Column expressions: spectral and radar indices, units, and small conversions.

Missing values are NULL throughout, never NaN: Spark sorts NaN above all numbers.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdatrace.model import BANDS, Grid

#: Denominators nearer to zero than this make a ratio undefined.
EPSILON = 1e-6

# Tasselled cap coefficients for blue, green, red, nir, swir1, swir2.
TASSELLED_CAP = {
    "tc_brightness": (0.3510, 0.3813, 0.3437, 0.7196, 0.2396, 0.1949),
    "tc_greenness": (-0.3599, -0.3533, -0.4734, 0.6633, 0.0087, -0.2856),
    "tc_wetness": (0.2578, 0.2305, 0.0883, 0.1071, -0.7611, -0.5308),
}
# Reporting size classes in hectares, lower limit included.
SIZE_CLASSES = (("<0.5 ha", 0.0, 0.5), ("0.5-2 ha", 0.5, 2.0), ("2-10 ha", 2.0, 10.0), ("10-50 ha", 10.0, 50.0), (">50 ha", 50.0, float("inf")))
# Names of the scene classification codes 0 to 11.
SCL_NAMES = (
    "no data", "saturated / defective", "dark area / topographic shadow", "cloud shadow", "vegetation", "not vegetated",
    "water", "unclassified", "cloud, medium probability", "cloud, high probability", "thin cirrus", "snow / ice",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x) -> Column:
    """A double with NaN turned to NULL."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x), x)


def normalised_difference(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.abs(a + b) >= EPSILON, (a - b) / (a + b))


def ndvi(red="red", nir="nir") -> Column:
    return normalised_difference(nir, red)


def nbr(nir="nir", swir2="swir2") -> Column:
    return normalised_difference(nir, swir2)


def ndmi(nir="nir", swir1="swir1") -> Column:
    return normalised_difference(nir, swir1)


def ndwi(green="green", nir="nir") -> Column:
    return normalised_difference(green, nir)


def tasselled_cap(name: str) -> Column:
    """Brightness, greenness or wetness of the six bands."""
    return reduce(lambda x, y: x + y, (F.lit(k) * F.col(b) for k, b in zip(TASSELLED_CAP[name], BANDS, strict=True)))


def disturbance_index(brightness, greenness, wetness) -> Column:
    """Brightness less greenness and wetness, all as z-scores."""
    return _c(brightness) - (_c(greenness) + _c(wetness))


def linear_to_db(x) -> Column:
    x = _c(x)
    return F.when(x > 0, 10 * F.log10(x))


def db_to_linear(x) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 10)


def rvi(vv="vv_linear", vh="vh_linear") -> Column:
    """Radar vegetation index from linear power."""
    vv, vh = _c(vv), _c(vh)
    return F.when(F.abs(vv + vh) >= EPSILON, 4 * vh / (vv + vh))


def rvi_db(vv_db="vv_db", vh_db="vh_db") -> Column:
    return rvi(db_to_linear(vv_db), db_to_linear(vh_db))


def cross_ratio(vh_db="vh_db", vv_db="vv_db") -> Column:
    return _c(vh_db) - _c(vv_db)


_NAMED = {"ndvi": ndvi, "nbr": nbr, "ndmi": ndmi, "ndwi": ndwi} | {k: (lambda k=k: tasselled_cap(k)) for k in TASSELLED_CAP}


def index(name: str, valid: Column | None = None) -> Column:
    """A named index over band columns, missing where not ``valid``; unknown names raise KeyError."""
    made = _NAMED[name]()
    return made if valid is None else F.when(valid, made)


def reflectance(raw, scale: float = 10_000.0) -> Column:
    """Stored integers to reflectance; zero is no data."""
    raw = _c(raw)
    return F.when(raw > 0, raw / scale)


def month_shift(day, months) -> Column:
    """First day of the month so many months away."""
    return F.trunc(F.add_months(_c(day), months), "MM")


def phenology_offset(pre_start, pre_end, post_start, post_end) -> Column:
    """Days of the year between the middles of two windows, the shorter way round."""
    doy = [F.dayofyear(F.date_add(_c(s), F.floor(F.datediff(_c(e), _c(s)) / 2).cast("int"))) for s, e in ((pre_start, pre_end), (post_start, post_end))]
    apart = F.abs(doy[0] - doy[1])
    return F.least(apart, 365 - apart)


def recovery_curve(years, asymptote, trough, tau) -> Column:
    """Saturating exponential from the trough to the asymptote."""
    a = _c(asymptote)
    return a + (_c(trough) - a) * F.exp(-_c(years) / F.greatest(_c(tau), F.lit(1e-3)))


def area_ha(pixels, grid: Grid) -> Column:
    return _c(pixels) * F.lit(grid.pixel_area_ha)


def pixels_for_ha(hectares, grid: Grid) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.bround(_c(hectares) / F.lit(grid.pixel_area_ha)).cast("bigint"))


def centre_x(grid: Grid, col="col") -> Column:
    return F.lit(grid.c) + F.lit(grid.a) * (_c(col) + 0.5)


def centre_y(grid: Grid, row="row") -> Column:
    return F.lit(grid.f) + F.lit(grid.e) * (_c(row) + 0.5)


def size_class(area) -> Column:
    area = _c(area)
    out = F.when(F.lit(False), "")
    for name, low, high in SIZE_CLASSES:
        out = out.when((area >= low) & (area < high if high != float("inf") else F.lit(True)), name)
    return out


def scl_name(code) -> Column:
    return F.get(F.array(*(F.lit(x) for x in SCL_NAMES)), _c(code))


def stretch(value, low, high) -> Column:
    """Value between two limits on a scale from 0 to 1, cut off at both ends."""
    value, low, high = _c(value), _c(low), _c(high)
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))


def relative_luminance(colour) -> Column:
    """Luminance of a ``#rrggbb`` colour for contrast, 0 to 1."""
    colour = _c(colour)
    parts = []
    for at, weight in ((2, 0.2126), (4, 0.7152), (6, 0.0722)):
        v = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        parts.append(weight * F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))
    return reduce(lambda x, y: x + y, parts)


def darkens(ramp) -> Column:
    """Whether each colour of an array is darker than the one before; one colour alone is."""
    levels = F.transform(_c(ramp), relative_luminance)
    falls = F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: b.isNull() | (b < a))
    return F.forall(falls, lambda x: x)


def zone_and_band(tile: str) -> tuple[str, str, str]:
    """Zone, latitude band and square of a tile name such as ``55JGG`` or ``T55JGG``."""
    m = re.fullmatch(r"T?(\d{1,2})([A-Z])([A-Z]{2})", tile.strip().upper())
    if not m:
        raise ValueError(f"no tile name: {tile!r}")
    return m[1].lstrip("0"), m[2], m[3]
