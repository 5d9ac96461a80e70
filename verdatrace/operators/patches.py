"""Fusion of two lines of evidence into tiered patches with attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.functions.indices import centre_x, centre_y
from verdatrace.model import DetectionConfig, Grid
from verdatrace.operators.detect import Change
from verdatrace.operators.reducers import PIXEL
from verdatrace.operators.spatial import clean_components

# Names of the tiers by code; a higher code is a stronger claim.
TIERS = {0: "none", 1: "s1_only", 2: "s2_only", 3: "confirmed"}
#: Tiers of a summary, in order.
SUMMARY_TIERS = ("confirmed", "s2_only", "s1_only")

_OPTICAL_STATS = {"mean_dnbr": "dnbr", "max_dnbr": "dnbr", "mean_dndvi": "dndvi", "pre_ndvi": "pre_ndvi", "pre_nbr": "pre_nbr", "pre_ndvi_persistent": "pre_ndvi_persistent", "post_ndvi": "post_ndvi"}
_RADAR_STATS = {"mean_vh_drop_db": "vh_drop_db", "max_vh_drop_db": "vh_drop_db", "mean_vv_drop_db": "vv_drop_db", "pre_vh_db": "pre_vh_db", "post_vh_db": "post_vh_db"}
_PERSISTENCE_STATS = {"persistent_dnbr": "persistent_dnbr", "seasons_below": "seasons_below", "seasons_observed": "seasons_seen"}


@dataclass(frozen=True)
class ClearingMap:
    """Patch pixels with their tiers, and one record a patch."""

    patch_pixels: DataFrame
    patches: DataFrame
    grid: Grid

    def of_tiers(self, *tiers: str) -> DataFrame:
        """Records of the tiers, of all without any."""
        return self.patches.where(F.col("tier").isin(*tiers)) if tiers else self.patches

    def mask(self, *tiers: str) -> DataFrame:
        codes = [k for k, v in TIERS.items() if v in tiers] if tiers else [1, 2, 3]
        return self.patch_pixels.where(F.col("tier_code").isin(*codes)).select(*PIXEL)

    def area_ha(self, *tiers: str) -> DataFrame:
        return self.of_tiers(*tiers).agg(F.coalesce(F.sum("area_ha"), F.lit(0.0)).alias("area_ha"))

    def summary(self) -> DataFrame:
        """Patches and area of every tier, none left out: ``tier, patches, area_ha``."""
        dim = self.patches.sparkSession.createDataFrame([(k, t) for k, t in enumerate(SUMMARY_TIERS)], "rank int, tier string")
        counted = self.patches.groupBy("tier").agg(F.count("*").alias("n"), F.sum("area_ha").alias("a"))
        return dim.join(counted, "tier", "left").select("rank", "tier", F.coalesce("n", F.lit(0)).alias("patches"), F.round(F.coalesce("a", F.lit(0.0)), 2).alias("area_ha")).orderBy("rank").drop("rank")


def union_mask(optical: Change, evidence: Change) -> DataFrame:
    """Pixels of either, if the evidence stands by itself; else those of the optical detector."""
    own = optical.mask()
    return own.unionAll(evidence.mask()).distinct() if evidence.independent else own


def tier_code(optical: Column, evidence: Column, both: Column, confirm_overlap: float) -> Column:
    """Code from the shares of a patch that each detector, and both together, flagged."""
    return F.when(both >= confirm_overlap, 3).when(optical >= evidence, 2).otherwise(1)


def fuse(optical: Change, evidence: Change, grid: Grid, config: DetectionConfig | None = None, patch_pixels: DataFrame | None = None) -> ClearingMap:
    """Clean the union, label it, and give each patch its tier and attributes."""
    config = config or DetectionConfig()
    if patch_pixels is None:
        patch_pixels = clean_components(union_mask(optical, evidence), grid, config.opening_iterations, config.fill_holes, config.min_mapping_unit_ha)
    stats = dict(_RADAR_STATS) if evidence.source == "radar" else dict(_PERSISTENCE_STATS) if evidence.source == "persistence" else {}
    left = optical.pixels.select(*PIXEL, F.col("mask").alias("_s2"), *dict.fromkeys(_OPTICAL_STATS.values()))
    right = evidence.pixels.select(*PIXEL, F.col("mask").alias("_s1"), *(F.col(c).alias(f"_e_{c}") for c in dict.fromkeys(stats.values())))
    px = patch_pixels.join(left, list(PIXEL), "left").join(right, list(PIXEL), "left")
    s2, s1 = (F.coalesce(F.col(c), F.lit(False)) for c in ("_s2", "_s1"))
    share = lambda c: F.avg(c.cast("double"))
    stat = lambda name, c: F.round(F.max(c) if name.startswith("max_") else F.avg(c), 4).alias(name)
    made = px.groupBy("patch_id").agg(
        F.count("*").alias("n_pixels"), share(s2).alias("_a"), share(s1).alias("_b"), share(s2 & s1).alias("_c"),
        *(stat(k, F.col(c)) for k, c in _OPTICAL_STATS.items()),
        F.round(F.avg(centre_x(grid)), 1).alias("centroid_x"), F.round(F.avg(centre_y(grid)), 1).alias("centroid_y"),
        *(stat(k, F.col(f"_e_{c}")) for k, c in stats.items()),
    )
    made = made.withColumn("tier_code", tier_code(F.col("_a"), F.col("_b"), F.col("_c"), config.confirm_overlap))
    names = F.create_map(*(F.lit(x) for k, v in TIERS.items() for x in (k, v)))
    patches = made.select("patch_id", names[F.col("tier_code")].alias("tier"), "tier_code", F.round(F.col("n_pixels") * F.lit(grid.pixel_area_ha), 3).alias("area_ha"), "n_pixels", F.round("_a", 3).alias("s2_fraction"), F.round("_b", 3).alias("s1_fraction"), F.round("_c", 3).alias("agreement_fraction"), *_OPTICAL_STATS, "centroid_x", "centroid_y", *stats)
    return ClearingMap(patch_pixels.join(patches.select("patch_id", "tier_code"), "patch_id"), patches, grid)
