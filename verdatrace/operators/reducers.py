"""Temporal reducers: one row a pixel from its observations.

All take columns ``row, col`` and group by them once; statistics over different
windows share the pass through FILTER-like conditions.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.functions.indices import index
from verdatrace.model import BANDS, DetectionConfig, Grid
from verdatrace.operators.masks import in_window, scl_valid, screen_scenes

PIXEL = ("row", "col")


def median(value: Column, where: Column | None = None) -> Column:
    """Exact median of the values where the condition holds."""
    return F.percentile(value if where is None else F.when(where, value), F.lit(0.5))


def percentile(value: Column, q: float, where: Column | None = None) -> Column:
    """Exact interpolated percentile, ``q`` from 0 to 100."""
    return F.percentile(value if where is None else F.when(where, value), F.lit(q / 100))


def masked_median(obs: DataFrame, values: list[str], keys=PIXEL) -> DataFrame:
    return obs.groupBy(*keys).agg(*(median(F.col(v), F.col("valid")).alias(v) for v in values))


def masked_mean(obs: DataFrame, values: list[str], keys=PIXEL) -> DataFrame:
    return obs.groupBy(*keys).agg(*(F.avg(F.when(F.col("valid"), F.col(v))).alias(v) for v in values))


def observation_count(obs: DataFrame, keys=PIXEL) -> DataFrame:
    return obs.groupBy(*keys).agg(F.count_if("valid").alias("n_obs"))


def array_median(values: Column) -> Column:
    """Median of the present numbers of an array, missing if there are none."""
    return array_percentile(F.array_sort(F.array_compact(values)), 0.5)


def array_percentile(ascending: Column, q: float) -> Column:
    """Interpolated percentile of an ascending array without gaps, ``q`` from 0 to 1."""
    at = (F.size(ascending) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(ascending, low), F.get(ascending, F.ceil(at).cast("int"))
    return F.when(F.size(ascending) > 0, a + (b - a) * (at - low))


def gather(obs: DataFrame, keys: tuple[str, ...], fields: list[str | Column], groups: dict[str, Column]) -> DataFrame:
    """One row a key with an array of its valid observations for each group: ``<group>all``.

    Observations are dealt by key as plain rows first: the arrays are then built
    where they stay, instead of being built in parts and sent.
    """
    kept = [F.collect_list(F.when(F.col("valid") & F.coalesce(when, F.lit(False)), F.struct(*fields))).alias(f"{name}all") for name, when in groups.items()]
    return obs.repartition(*keys).groupBy(*keys).agg(*kept)


def with_medoid(df: DataFrame, prefix: str = "", bands: tuple[str, ...] = BANDS, tie: tuple[str, ...] = ("acq_date", "obs_id")) -> DataFrame:
    """``<prefix>n_obs`` and the bands of the medoid of ``<prefix>all``.

    The medoid is the observation nearest to the medians of all bands.  A
    candidate has all bands; ties go to the earliest, then to the least values
    of the bands, so the choice never depends on the order of rows.
    """
    every = F.col(f"{prefix}all")
    centre = F.array(*(array_median(_field(every, b)) for b in bands))

    def distance(o: Column) -> Column:
        parts = [(o[b] - F.col(f"_{prefix}centre")[k]) * (o[b] - F.col(f"_{prefix}centre")[k]) for k, b in enumerate(bands)]
        return F.round(reduce(lambda x, y: x + y, parts), 11)

    whole = F.filter(every, lambda o: reduce(lambda x, y: x & y, (o[b].isNotNull() for b in bands)))
    best = F.array_min(F.transform(whole, lambda o: F.struct(distance(o).alias("_d"), *(o[t].alias(t) for t in tie), *(o[b].alias(b) for b in bands))))
    made = df.withColumns({f"_{prefix}centre": centre}).withColumns({f"{prefix}n_obs": F.size(every).cast("bigint"), f"_{prefix}best": best})
    return made.withColumns({f"{prefix}{b}": F.col(f"_{prefix}best")[b] for b in bands}).drop(f"_{prefix}centre", f"_{prefix}best")


def _field(items: Column, name: str) -> Column:
    return F.transform(items, lambda o: o[name])


def medoid(obs: DataFrame, bands: tuple[str, ...] = BANDS, keys=PIXEL, tie: tuple[str, ...] = ("acq_date", "obs_id")) -> DataFrame:
    """One row a pixel: ``n_obs`` and the bands of its medoid."""
    return with_medoid(gather(obs, tuple(keys), [*tie, *bands], {"": F.lit(True)}), "", bands, tie).select(*keys, "n_obs", *bands)


def optical_composite(obs: DataFrame, start: date, end: date, max_cloud: float = 1.0, dilation: int = 3, reducer: str = "medoid") -> DataFrame:
    """One row a pixel: bands and ``n_obs``, the observations of a valid scene class."""
    masked = scl_valid(screen_scenes(in_window(obs, start, end), max_cloud), radius=dilation)
    if reducer == "medoid":
        return medoid(masked)
    if reducer == "median":
        return masked.groupBy(*PIXEL).agg(F.count_if("valid").alias("n_obs"), *(median(F.col(b), F.col("valid")).alias(b) for b in BANDS))
    raise ValueError(f"no reducer {reducer!r}")


def radar_medians(obs: DataFrame, keys=PIXEL, where: Column | None = None) -> DataFrame:
    """Medians in decibels of passes with both polarisations, and ``n_obs``."""
    both = F.col("vv_db").isNotNull() & F.col("vh_db").isNotNull()
    both = both if where is None else both & where
    return obs.groupBy(*keys).agg(F.count_if(both).alias("n_obs"), median(F.col("vv_db"), both).alias("vv_db"), median(F.col("vh_db"), both).alias("vh_db"))


def radar_composite(obs: DataFrame, start: date, end: date, speckle_window: int = 5, grid: Grid | None = None) -> DataFrame:
    """Median of the window's passes, then the boxcar mean of both polarisations, up to the edges of ``grid``."""
    from verdatrace.operators.spatial import boxcar

    return boxcar(radar_medians(in_window(obs, start, end)), ["vv_db", "vh_db"], speckle_window, grid)


def index_percentiles(obs: DataFrame, name: str, qs: list[float], keys=PIXEL) -> DataFrame:
    """Percentiles of a masked index through time, all in one pass: columns ``p10`` and so on."""
    v = index(name, F.col("valid"))
    made = obs.groupBy(*keys).agg(F.percentile(v, F.array(*(F.lit(q / 100) for q in qs))).alias("_p"))
    return made.select(*keys, *(F.col("_p")[i].alias(f"p{q:g}") for i, q in enumerate(qs)))


def seasonal_amplitude(obs: DataFrame, start: date, end: date, config: DetectionConfig) -> DataFrame:
    """90th less 10th percentile of NDVI by pixel over a cloud-screened window."""
    masked = scl_valid(screen_scenes(in_window(obs, start, end), config.max_cloud_cover), radius=config.dilation_pixels)
    return index_percentiles(masked, "ndvi", [10, 90]).select(*PIXEL, (F.col("p90") - F.col("p10")).alias("amplitude"))
