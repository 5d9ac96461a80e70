"""Detectors: optical, radar, and seasonal persistence.

A detection is a per-pixel table with one BOOLEAN column a gate, and two
one-row tables, of the offsets and of the thresholds that were used.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.functions.indices import index, nbr, ndvi, ndwi, rvi_db
from verdatrace.model import BANDS, DetectionConfig, Grid, Periods
from verdatrace.operators.masks import all_gates, rejections, scl_valid, screen_scenes
from verdatrace.operators.reducers import PIXEL, array_percentile, gather, median, with_medoid
from verdatrace.operators.robust import change_thresholds, offsets, with_numbers, woody_thresholds
from verdatrace.operators.spatial import boxcar
from verdatrace.storage import settle

OPTICAL_GATES = ("observations_pre", "observations_post", "woody_before", "persistently_woody", "not_water", "steady_through_the_year", "nbr_drop", "ndvi_drop")
RADAR_GATES = ("observations_pre", "observations_post", "structure_before", "vh_drop")
PERSISTENCE_GATES = ("seasons_observed", "still_down")


@dataclass(frozen=True)
class Change:
    """Pixels with ``mask`` and gates, and the numbers behind them.

    ``independent`` evidence may detect what the optical detector missed; other
    evidence only answers for pixels that it flagged.
    """

    pixels: DataFrame
    offsets: DataFrame
    thresholds: DataFrame
    gates: tuple[str, ...]
    independent: bool = True
    source: str = ""

    def rejection_summary(self) -> DataFrame:
        return rejections(self.pixels, self.gates)

    def mask(self) -> DataFrame:
        return self.pixels.where("mask").select(*PIXEL)

    def persisted(self) -> Change:
        return replace(self, pixels=self.pixels.persist())


def months_before(day: date, months: int) -> date:
    """First day of the month so many months before (after, if negative)."""
    total = day.year * 12 + day.month - 1 - months
    return date(total // 12, total % 12 + 1, 1)


def _between(start: date, end: date) -> Column:
    return F.col("acq_date").between(F.lit(start), F.lit(end))


def detect_optical(obs: DataFrame, periods: Periods, config: DetectionConfig | None = None, check_phenology: bool = True, masked: DataFrame | None = None, dense: bool = False) -> Change:
    """Loss of canopy between two windows: enough views, woody, persistently so, no water, steady, and both drops.

    All statistics of a pixel, of both windows, come from one grouping of its
    observations, whose result is written to the shared folder.  ``masked`` may hand in observations with ``valid`` already
    made, for callers that run several detections.
    """
    config = config or DetectionConfig()
    if check_phenology:
        periods.check_phenology()
    swing_start = max(months_before(periods.pre_end, config.pre_amplitude_months), periods.series_start)
    pre, post, swing = _between(periods.pre_start, periods.pre_end), _between(periods.post_start, periods.post_end), _between(swing_start, periods.pre_end)
    wants_swing = config.max_pre_seasonal_amplitude is not None
    if masked is None:
        masked = scl_valid(screen_scenes(obs.where(pre | post | swing if wants_swing else pre | post), config.max_cloud_cover), radius=config.dilation_pixels, dense=dense)
    with_index = masked.withColumns({"_ndvi": index("ndvi"), "_nbr": index("nbr")})
    px = gather(with_index, PIXEL, ["acq_date", "obs_id", *BANDS, "_ndvi", "_nbr"], {"pre_": pre, "post_": post} | ({"swing_": swing} if wants_swing else {}))
    px = with_medoid(with_medoid(px, "pre_"), "post_")
    ordered = lambda of, name: F.array_sort(F.array_compact(F.transform(of, lambda o: o[name])))
    px = px.withColumns({"_v": ordered("pre_all", "_ndvi"), "_n": ordered("pre_all", "_nbr")} | ({"_s": ordered("swing_all", "_ndvi")} if wants_swing else {}))
    typical = ["pre_ndvi_persistent", "pre_ndvi_typical", "pre_nbr_typical"]
    px = px.withColumns({
        "pre_ndvi_persistent": array_percentile(F.col("_v"), config.pre_percentile / 100), "pre_ndvi_typical": array_percentile(F.col("_v"), 0.5), "pre_nbr_typical": array_percentile(F.col("_n"), 0.5),
        "pre_amplitude": array_percentile(F.col("_s"), 0.9) - array_percentile(F.col("_s"), 0.1) if wants_swing else F.lit(None).cast("double"),
    })
    px = px.select(
        *PIXEL, "pre_n_obs", "post_n_obs", *typical, "pre_amplitude",
        ndvi("pre_red", "pre_nir").alias("pre_ndvi"), nbr("pre_nir", "pre_swir2").alias("pre_nbr"),
        ndvi("post_red", "post_nir").alias("post_ndvi"), nbr("post_nir", "post_swir2").alias("post_nbr"),
        (F.col("pre_n_obs") >= config.min_clear_observations).alias("observations_pre"),
        (F.col("post_n_obs") >= config.min_clear_observations).alias("observations_post"),
        F.coalesce(ndwi("pre_green", "pre_nir") < 0, F.lit(False)).alias("not_water"),
        (F.coalesce(F.col("pre_amplitude") <= config.max_pre_seasonal_amplitude, F.lit(False)) if wants_swing else F.lit(True)).alias("steady_through_the_year"),
    )
    # Offsets and limits each look at all pixels again; one row a pixel is written so that observations are reduced once.
    px = settle(px, "pixels")
    stable = F.col("observations_pre") & F.col("observations_post") & F.col("not_water")
    woody = woody_thresholds(px, config, stable & F.col("steady_through_the_year"), "pre_ndvi_typical", "pre_nbr_typical", "pre_ndvi_persistent")
    moved = offsets(px, {"dnbr": (F.col("pre_nbr") - F.col("post_nbr"), stable, config.dnbr_threshold), "dndvi": (F.col("pre_ndvi") - F.col("post_ndvi"), stable, config.dndvi_threshold)})
    numbers = woody.crossJoin(F.broadcast(moved.select(F.col("dnbr").alias("_o_nbr"), F.col("dndvi").alias("_o_ndvi"))))
    px = with_numbers(px, numbers).select(
        *px.columns,
        (F.col("pre_nbr") - F.col("post_nbr") - F.col("_o_nbr")).alias("dnbr"),
        (F.col("pre_ndvi") - F.col("post_ndvi") - F.col("_o_ndvi")).alias("dndvi"),
        F.coalesce((F.col("pre_ndvi_typical") >= F.col("min_pre_ndvi")) & (F.col("pre_nbr_typical") >= F.col("min_pre_nbr")), F.lit(False)).alias("woody_before"),
        F.coalesce(F.col("pre_ndvi_persistent") >= F.col("min_pre_ndvi_persistent"), F.lit(False)).alias("persistently_woody"),
    )
    population = F.col("woody_before") & F.col("persistently_woody") & F.col("steady_through_the_year") & stable
    limits = change_thresholds(px, {"dnbr_threshold": (F.col("dnbr"), population, config.dnbr_threshold, config.adaptive_change_mad), "dndvi_threshold": (F.col("dndvi"), population, config.dndvi_threshold, config.adaptive_change_mad)}, config.adaptive_change_floor)
    px = with_numbers(px, limits)
    px = px.withColumns({"nbr_drop": F.coalesce(F.col("dnbr") >= F.col("dnbr_threshold"), F.lit(False)), "ndvi_drop": F.coalesce(F.col("dndvi") >= F.col("dndvi_threshold"), F.lit(False))})
    score = F.least(F.col("dnbr") / F.greatest(F.col("dnbr_threshold"), F.lit(1e-6)), F.col("dndvi") / F.greatest(F.col("dndvi_threshold"), F.lit(1e-6)))
    both = F.col("dnbr").isNotNull() & F.col("dndvi").isNotNull()
    px = px.withColumns({"mask": all_gates(OPTICAL_GATES), "score": F.when(both, score).otherwise(F.lit(0.0))}).drop("dnbr_threshold", "dndvi_threshold")
    return Change(px, moved, woody.crossJoin(F.broadcast(limits)), OPTICAL_GATES, source="optical")


def detect_radar(obs: DataFrame, periods: Periods, config: DetectionConfig | None = None, stable: DataFrame | None = None, grid: Grid | None = None) -> Change:
    """Loss of structure: a drop in cross-polarised backscatter that the scene as a whole does not show.

    Medians of both windows, over all passes and by orbit direction, come from
    one grouping, and one boxcar pass smooths them all.  Directions with two
    passes on either side get a column ``drop_<direction>``; ``orbit_agreement``
    tells whether all of them fell (missing with fewer than two).  ``stable``
    may name the pixels of the stable population, ``grid`` the raster up to
    whose edges the boxcar goes.
    """
    config = config or DetectionConfig()
    pre, post = _between(periods.pre_start, periods.pre_end), _between(periods.post_start, periods.post_end)
    both = F.col("vv_db").isNotNull() & F.col("vh_db").isNotNull()
    obs = obs.where(pre | post)
    states: list[str] = []
    if "orbit_state" in obs.columns:
        passes = obs.groupBy(F.lower("orbit_state").alias("s")).agg(F.count_distinct(F.when(pre, F.col("scene_id"))).alias("a"), F.count_distinct(F.when(post, F.col("scene_id"))).alias("b"))
        states = sorted(r["s"] for r in passes.where("s IS NOT NULL AND a >= 2 AND b >= 2").collect())
    aggs, smooth = [F.count_if(pre & both).alias("pre_n_obs"), F.count_if(post & both).alias("post_n_obs")], []
    for name, when in (("pre", pre), ("post", post)):
        for v in ("vv_db", "vh_db"):
            aggs.append(median(F.col(v), when & both).alias(f"{name}_{v}"))
            smooth.append(f"{name}_{v}")
        for s in states:
            aggs.append(median(F.col("vh_db"), when & both & (F.lower("orbit_state") == s)).alias(f"{name}_vh_{s}"))
            smooth.append(f"{name}_vh_{s}")
    px = settle(boxcar(obs.groupBy(*PIXEL).agg(*aggs), smooth, config.speckle_window, grid), "pixels")
    had = F.coalesce(F.col("pre_vh_db") >= config.min_pre_vh_db, F.lit(False))
    if stable is not None:
        px = px.join(stable.select(*PIXEL).distinct().withColumn("_stable", F.lit(True)), list(PIXEL), "left")
        population = F.coalesce(F.col("_stable"), F.lit(False))
    else:
        population = had
    drop = {"vh_db": F.col("pre_vh_db") - F.col("post_vh_db"), "vv_db": F.col("pre_vv_db") - F.col("post_vv_db"), "rvi": rvi_db("pre_vv_db", "pre_vh_db") - rvi_db("post_vv_db", "post_vh_db")} | {f"orbit_{s}": F.col(f"pre_vh_{s}") - F.col(f"post_vh_{s}") for s in states}
    moved = offsets(px, {k: (v, population, None if k == "rvi" else config.vh_drop_db) for k, v in drop.items()})
    renamed = moved.select(*(F.col(k).alias(f"_o_{k}") for k in drop))
    names = {"vh_db": "vh_drop_db", "vv_db": "vv_drop_db", "rvi": "rvi_drop"} | {f"orbit_{s}": f"drop_{s}" for s in states}
    enough = [(F.col(f"{w}_n_obs") >= config.min_s1_observations).alias(f"observations_{w}") for w in ("pre", "post")]
    px = with_numbers(px, renamed).select(*PIXEL, "pre_n_obs", "post_n_obs", "pre_vv_db", "pre_vh_db", "post_vv_db", "post_vh_db", *((drop[k] - F.col(f"_o_{k}")).alias(names[k]) for k in drop), *enough, had.alias("structure_before"))
    limits = change_thresholds(px, {"vh_drop_threshold": (F.col("vh_drop_db"), F.col("observations_pre") & F.col("observations_post") & F.col("structure_before"), config.vh_drop_db, config.adaptive_vh_mad)}, config.adaptive_change_floor)
    fell = F.coalesce(F.col("vh_drop_db") >= F.col("vh_drop_threshold"), F.lit(False))
    px = with_numbers(px, limits).withColumn("vh_drop", fell).drop("vh_drop_threshold")
    agreement = F.lit(None).cast("boolean")
    if len(states) >= 2:
        agreement = F.lit(True)
        for s in states:
            agreement = agreement & F.coalesce(F.col(f"drop_{s}") > 0, F.lit(False))
    px = px.withColumns({"mask": all_gates(RADAR_GATES), "orbit_agreement": agreement})
    return Change(px, moved, limits, RADAR_GATES, source="radar")


def seasonal_windows(start: date, count: int, months: int = 3, skip_months: int = 3) -> list[tuple[date, date]]:
    """Consecutive windows of whole months after a gap, from the first day of a month on."""
    edges = [months_before(start, -(skip_months + k * months)) for k in range(count + 1)]
    return [(a, b - timedelta(days=1)) for a, b in zip(edges, edges[1:], strict=False)]


def detect_persistence(obs: DataFrame, optical: Change, periods: Periods, config: DetectionConfig | None = None, seasons: int = 4, season_months: int = 3, skip_months: int = 3, min_seasons_below: int | None = None, min_seasons_observed: int = 2, tolerance: float = 0.6, masked: DataFrame | None = None, dense: bool = False) -> Change:
    """Whether the drop was still there in later seasons, each against its own offset.

    Observations meet their windows in one join with the few windows, and each
    (pixel, window) is reduced once.
    """
    config = config or DetectionConfig()
    needed = max(1, seasons - 1) if min_seasons_below is None else min_seasons_below
    windows = [w for w in seasonal_windows(periods.post_start, seasons, season_months, skip_months) if w[0] <= periods.series_end]
    spark = obs.sparkSession
    dim = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(windows)], "season int, w_start date, w_end date")
    if masked is None:
        last = max((b for _, b in windows), default=periods.post_start)
        masked = scl_valid(screen_scenes(obs.where(_between(periods.post_start, last)), config.max_cloud_cover), radius=config.dilation_pixels, dense=dense)
    tagged = masked.join(F.broadcast(dim), F.col("acq_date").between(F.col("w_start"), F.col("w_end")))
    level = optical.thresholds.select((F.col("dnbr_threshold") * tolerance).alias("_level"), F.col("dnbr_threshold").alias("_limit"))
    seen = with_medoid(gather(tagged, (*PIXEL, "season"), ["acq_date", "obs_id", *BANDS], {"": F.lit(True)})).where("n_obs >= 1")
    seen = with_numbers(seen.join(optical.pixels.select(*PIXEL, "pre_nbr"), list(PIXEL)), level).select(*PIXEL, "season", (F.col("pre_nbr") - nbr()).alias("drop"), "_level", "_limit")
    seen = settle(seen, "seasons")
    # One offset a season, refined once, as for a pair of windows.
    start = seen.groupBy("season").agg(median(F.col("drop")).alias("_m"), F.count("drop").alias("_n"))
    both = seen.join(F.broadcast(start), "season")
    refined = both.groupBy("season").agg(F.first("_m").alias("_m"), F.first("_n").alias("_n"), F.count(F.when(F.col("drop") < F.col("_m") + F.col("_limit"), F.col("drop"))).alias("_k"), median(F.when(F.col("drop") < F.col("_m") + F.col("_limit"), F.col("drop"))).alias("_r"))
    shift = refined.select("season", F.coalesce(F.when(F.col("_k") >= F.greatest(F.lit(32.0), 0.05 * F.col("_n")), F.col("_r")).otherwise(F.col("_m")), F.lit(0.0)).alias("offset"))
    judged = seen.join(F.broadcast(shift), "season").withColumn("drop", F.col("drop") - F.col("offset"))
    counted = judged.groupBy(*PIXEL).agg(F.count("*").alias("seasons_seen"), F.count_if(F.col("drop") >= F.col("_level")).alias("seasons_below"), F.max_by("drop", F.when(F.col("drop").isNotNull(), F.col("season"))).alias("persistent_dnbr"))
    px = optical.pixels.select(*PIXEL).join(counted, list(PIXEL), "left").select(*PIXEL, F.coalesce("seasons_seen", F.lit(0)).alias("seasons_seen"), F.coalesce("seasons_below", F.lit(0)).alias("seasons_below"), "persistent_dnbr")
    px = px.withColumns({"seasons_observed": F.col("seasons_seen") >= min_seasons_observed, "still_down": F.col("seasons_below") >= F.least(F.lit(needed), F.greatest(F.col("seasons_seen"), F.lit(1)))})
    px = px.withColumn("mask", all_gates(PERSISTENCE_GATES))
    return Change(px, shift, level.select(F.col("_level").alias("level")), PERSISTENCE_GATES, independent=False, source="persistence")
