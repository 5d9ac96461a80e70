"""Whole analyses: detect, fuse, date, regrow and validate; all epochs; the survey."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdatrace.functions.indices import index
from verdatrace.model import Periods, PipelineConfig, Scene
from verdatrace.operators import assess, recovery, timing
from verdatrace.operators.detect import Change, detect_optical, detect_persistence, detect_radar
from verdatrace.operators.masks import scl_valid, screen_scenes
from verdatrace.operators.patches import ClearingMap, fuse
from verdatrace.operators.reducers import PIXEL, median
from verdatrace.operators.survey import advice, compare_years, with_empty_years, year_statistics
from verdatrace.storage import settle


@dataclass
class Result:
    """Tables of one analysis; ``seconds`` has the time of each step, when steps were timed."""

    optical: Change
    evidence: Change
    clearing: ClearingMap
    timing: DataFrame
    fits: DataFrame
    recovery: DataFrame
    accuracy: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def summary(self) -> dict:
        """Small aggregates only, collected for reports."""
        rows = lambda df: [r.asDict() for r in df.collect()]
        return {
            "thresholds": rows(self.optical.thresholds)[0] | rows(self.evidence.thresholds)[0], "offsets": rows(self.optical.offsets),
            "rejections": {"optical": rows(self.optical.rejection_summary()), "evidence": rows(self.evidence.rejection_summary())},
            "tiers": rows(self.clearing.summary()), "classes": rows(recovery.class_summary(self.recovery)), "accuracy": {k: rows(v) for k, v in self.accuracy.items()}, "seconds": self.seconds,
        }


def settled(change: Change, tag: str) -> Change:
    """Detections feed several later steps: written once, read again."""
    return Change(settle(change.pixels, tag), settle(change.offsets, f"{tag}-offsets"), settle(change.thresholds, f"{tag}-limits"), change.gates, change.independent, change.source)


def anomaly_series(scene: Scene, clearing: ClearingMap, tiers: tuple[str, ...], periods: Periods, config: PipelineConfig, reference: DataFrame | None) -> DataFrame:
    """Anomalies of NDVI, NBR and VH of the patches: ``patch_id, track, acq_date, value``.

    One pass over the observations of each sensor: patch means and the
    landscape's median are aggregates of the same tagged rows.
    """
    patches = clearing.patch_pixels.join(clearing.of_tiers(*tiers).select("patch_id"), "patch_id", "left_semi").select(*PIXEL, "patch_id")
    every = clearing.patch_pixels.select(*PIXEL, F.lit(True).alias("_in"))
    if reference is not None:
        reference = reference.select(*PIXEL).distinct().withColumn("_ref", F.lit(True))
    within = F.col("acq_date").between(F.lit(periods.series_start), F.lit(periods.series_end))
    optical = scl_valid(scene.optical.where(within), radius=config.detection.dilation_pixels, dense=scene.dense)
    sources = [optical.select(*PIXEL, "acq_date", "scene_id", *(index(n, F.col("valid")).alias(n) for n in ("ndvi", "nbr")))]
    if scene.radar is not None:
        sources.append(scene.radar.where(within).select(*PIXEL, "acq_date", "scene_id", F.col("vh_db").alias("vh")))
    out = None
    for obs in sources:
        tracks = [c for c in obs.columns if c not in (*PIXEL, "acq_date", "scene_id")]
        tagged = obs.join(patches, list(PIXEL), "left")
        tagged = tagged.join(reference, list(PIXEL), "left") if reference is not None else tagged.join(every, list(PIXEL), "left").withColumn("_ref", F.col("_in").isNull())
        level = tagged.groupBy("acq_date", "scene_id").agg(*(F.coalesce(median(F.col(t), F.coalesce("_ref", F.lit(False))), F.lit(0.0)).alias(f"_l_{t}") for t in tracks))
        means = tagged.where("patch_id IS NOT NULL").groupBy("patch_id", "acq_date", "scene_id").agg(*(F.avg(t).alias(t) for t in tracks))
        both = means.join(level, ["acq_date", "scene_id"]).select("patch_id", "acq_date", *((F.col(t) - F.col(f"_l_{t}")).alias(t) for t in tracks))
        long = both.unpivot(["patch_id", "acq_date"], tracks, "track", "value")
        out = long if out is None else out.unionByName(long)
    return out


def run(scene: Scene, config: PipelineConfig, tiers: tuple[str, ...] = ("confirmed",), validate: bool = True) -> Result:
    """All steps in order; each step's tables are written before the next needs them, and timed so."""
    seconds: dict[str, float] = {}

    def step(name: str, make):
        began = time.time()
        made = make()
        seconds[name] = round(time.time() - began, 2)
        return made

    p, c = config.periods, config.detection
    optical = step("detect_optical", lambda: settled(detect_optical(scene.optical, p, c, dense=scene.dense), "optical"))
    if scene.radar is not None:
        evidence = step("detect_radar", lambda: settled(detect_radar(scene.radar, p, c, grid=scene.grid), "radar"))
    else:
        evidence = step("detect_persistence", lambda: settled(detect_persistence(scene.optical, optical, p, c, dense=scene.dense), "persistence"))

    def fused() -> ClearingMap:
        made = fuse(optical, evidence, scene.grid, c)
        return ClearingMap(settle(made.patch_pixels, "patch-pixels"), settle(made.patches, "patches"), scene.grid)

    clearing = step("fuse", fused)
    dates = step("estimate_event_dates", lambda: settle(timing.estimate(scene.optical, scene.radar, optical, evidence if scene.radar is not None else None, clearing.patch_pixels, p, c, dense=scene.dense), "dates"))
    events = clearing.patches.select("patch_id").join(dates.select("patch_id", "first_detection_date"), "patch_id", "left").select("patch_id", F.coalesce("first_detection_date", F.lit(p.default_event)).alias("event_date"))
    undisturbed = optical.pixels.where("woody_before AND persistently_woody").join(clearing.patch_pixels, list(PIXEL), "left_anti")

    def regrown() -> tuple[DataFrame, DataFrame]:
        fits, records = recovery.analyse(anomaly_series(scene, clearing, tiers, p, config, undisturbed), clearing.of_tiers(*tiers), events, config.regrowth)
        return fits, settle(records, "records")

    fits, records = step("analyse_regrowth", regrown)
    result = Result(optical, evidence, clearing, dates, fits, records, seconds=seconds)
    if validate and scene.truth_pixels is not None and scene.truth_patches is not None:
        result.accuracy = step("validate", lambda: {k: settle(v, k) for k, v in validation(result, scene, timing.estimate(scene.optical, scene.radar, optical, evidence if scene.radar is not None else None, scene.truth_pixels.join(scene.truth_patches.where("kind = 'clearing'").select("patch_id"), "patch_id", "left_semi"), p, c, dense=scene.dense)).items()})
    return result


def validation(result: Result, scene: Scene, dates: DataFrame | None = None) -> dict[str, DataFrame]:
    """All sections of the accuracy assessment; ``dates`` are those of the truth's own patches."""
    truth, kinds, grid, clearing = scene.truth_pixels, scene.truth_patches, scene.grid, result.clearing
    cleared = kinds.where("kind = 'clearing' AND pixels > 0")
    reference = truth.join(cleared.select("patch_id"), "patch_id", "left_semi")
    pixel = None
    for label, mask in (("confirmed tier", clearing.mask("confirmed")), ("any tier", clearing.mask()), ("optical alone", result.optical.mask()), (f"{result.evidence.source} alone", result.evidence.mask())):
        one = assess.confusion(mask, reference, grid, label)
        pixel = one if pixel is None else pixel.unionAll(one)
    matches = assess.match_patches(clearing, truth, cleared)
    # Everything without a truth patch is stable background.
    names = F.when(F.col("kind") == "fire", "fire scar").when(F.col("kind") == "crop", "cropping").when(F.col("kind") == "crop_fallow", "cropped then fallowed")
    tagged = truth.join(kinds.select("patch_id", names.alias("kind")), "patch_id").where("kind IS NOT NULL").select(*PIXEL, "kind")
    ground = result.optical.pixels.select(*PIXEL).join(truth, list(PIXEL), "left_anti").withColumn("kind", F.lit("stable background"))
    out = {"pixel": pixel, "matches": matches, "size_classes": assess.size_class_recall(matches), "decoys": assess.decoys(clearing, tagged.unionByName(ground)), "area": assess.area_bias(clearing, cleared)}
    if dates is not None:
        late = timing.with_latency(dates, kinds)
        out |= {"latency": late, "latency_summary": assess.latency_summary(late)}
    return out


def scan_epochs(scene: Scene, config: PipelineConfig, first_year: int, last_year: int, start: tuple[int, int] = (3, 1), end: tuple[int, int] = (9, 30)) -> DataFrame:
    """Detection and fusion for every two consecutive years: one row an epoch, a failed one with its ``error``.

    The masked observations are written once and all epochs read them.
    """
    c = config.detection
    masked = settle(scl_valid(screen_scenes(scene.optical, c.max_cloud_cover), radius=c.dilation_pixels, dense=scene.dense), "masked")
    spark, out = scene.optical.sparkSession, []
    schema = "epoch string, woody_fraction double, dnbr_threshold double, confirmed_patches bigint, confirmed_ha double, review_ha double, largest_patch_ha double, median_patch_ha double, error string"
    for year in range(first_year, last_year):
        name = f"{year}-{year + 1}"
        try:
            p = Periods(date(year, *start), date(year, *end), date(year + 1, *start), date(year + 1, *end), config.periods.series_start, config.periods.series_end)
            optical = settled(detect_optical(scene.optical, p, c, check_phenology=False, masked=masked), "optical")
            evidence = detect_radar(scene.radar, p, c, grid=scene.grid) if scene.radar is not None else detect_persistence(scene.optical, optical, p, c, masked=masked)
            clearing = fuse(optical, settled(evidence, "evidence"), scene.grid, c)
            woody = optical.pixels.agg(F.round(F.avg((F.col("woody_before") & F.col("persistently_woody") & F.col("steady_through_the_year")).cast("double")), 4).alias("woody_fraction"))
            of = F.col("tier") == "confirmed"
            tiers = clearing.patches.agg(F.count_if(of).alias("confirmed_patches"), F.round(F.coalesce(F.sum(F.when(of, F.col("area_ha"))), F.lit(0.0)), 2).alias("confirmed_ha"), F.round(F.coalesce(F.sum(F.when(~of, F.col("area_ha"))), F.lit(0.0)), 2).alias("review_ha"), F.round(F.coalesce(F.max(F.when(of, F.col("area_ha"))), F.lit(0.0)), 2).alias("largest_patch_ha"), F.round(F.coalesce(median(F.col("area_ha"), of), F.lit(0.0)), 2).alias("median_patch_ha"))
            out.append(settle(woody.crossJoin(optical.thresholds.select(F.round("dnbr_threshold", 4).alias("dnbr_threshold"))).crossJoin(tiers).select(F.lit(name).alias("epoch"), "woody_fraction", "dnbr_threshold", "confirmed_patches", "confirmed_ha", "review_ha", "largest_patch_ha", "median_patch_ha", F.lit(None).cast("string").alias("error")), "epoch"))
        except Exception as e:  # a short or clouded epoch does not end the scan
            out.append(spark.createDataFrame([(name, *[None] * 7, str(e)[:120])], schema))
    whole = spark.createDataFrame([], schema)
    for one in out:
        whole = whole.unionByName(one)
    return whole


def survey(scene: Scene, config: PipelineConfig, first_year: int, last_year: int) -> dict[str, DataFrame]:
    """Years, pairs of years and advice for an area."""
    stats = settle(with_empty_years(year_statistics(scl_valid(scene.optical, radius=config.detection.dilation_pixels, dense=scene.dense), config.detection), first_year, last_year), "years")
    return {"years": stats, "pairs": compare_years(stats), "advice": advice(stats)}
