"""The scene store: long observation tables as partitioned Parquet, with the grid beside them."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdatrace.model import OPTICAL, RADAR, Grid, Scene, check_schema

#: Pixels along a side of a tile; tiles and years are the partitions.
TILE = 256


def _tiled(df: DataFrame) -> DataFrame:
    return df.withColumns({"tile": F.concat_ws("_", F.floor(F.col("row") / TILE), F.floor(F.col("col") / TILE)), "year": F.year("acq_date")})


def save_scene(scene: Scene, path: str, mode: str = "errorifexists") -> None:
    """Write a scene; what it has not is left out, so that it reads back as absent."""
    spark = scene.optical.sparkSession
    _tiled(check_schema(scene.optical, OPTICAL)).repartition("tile", "year").write.mode(mode).partitionBy("tile", "year").parquet(f"{path}/optical")
    if scene.radar is not None:
        _tiled(check_schema(scene.radar, RADAR)).repartition("tile", "year").write.mode(mode).partitionBy("tile", "year").parquet(f"{path}/radar")
    if scene.truth_pixels is not None and scene.truth_patches is not None:
        scene.truth_pixels.write.mode(mode).parquet(f"{path}/truth_pixels")
        scene.truth_patches.write.mode(mode).parquet(f"{path}/truth_patches")
    meta = {"grid": asdict(scene.grid), "radar": scene.radar is not None, "truth": scene.truth_pixels is not None, "dense": scene.dense}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def load_scene(spark: SparkSession, path: str) -> Scene:
    """Read a scene back; filters on dates, rows and columns prune its partitions."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    part = lambda name, schema: spark.read.parquet(f"{path}/{name}").select(*(f.name for f in schema))
    truth = [spark.read.parquet(f"{path}/{n}") for n in ("truth_pixels", "truth_patches")] if meta["truth"] else [None, None]
    return Scene(Grid(**meta["grid"]), part("optical", OPTICAL), part("radar", RADAR) if meta["radar"] else None, *truth, dense=meta.get("dense", False))


def read_rasters(files: DataFrame, decode, schema: str) -> DataFrame:
    """Rows of decoded raster files (``path, content`` of the binary reader); a file that fails gives one row with ``error``.

    ``decode`` takes the bytes of a file and gives a pandas frame of ``schema``.
    """
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out, error = decode(content), None
                except Exception as e:  # one asset is lost, not the series
                    out, error = pd.DataFrame({n: [None] for n in names}), str(e)[:200]
                yield out[names].assign(path=path, error=error)

    return files.select("path", "content").mapInPandas(run, f"{schema}, path string, error string")


def assemble_optical(assets: DataFrame, index: DataFrame) -> DataFrame:
    """Observations from decoded band files: ``scene_id, asset, row, col, raw`` beside the scene index.

    Stored integers become reflectance, zero is missing, and an asset that
    failed stays missing for its scene alone.
    """
    from verdatrace.functions.indices import reflectance
    from verdatrace.model import BANDS

    wide = assets.where("error IS NULL" if "error" in assets.columns else "true").groupBy("scene_id", "row", "col").pivot("asset", [*BANDS, "scl"]).agg(F.first("raw"))
    joined = wide.join(index.select("scene_id", "acq_date"), "scene_id")
    return joined.select("scene_id", F.datediff("acq_date", F.to_date(F.lit("2015-01-01"))).cast("bigint").alias("obs_id"), "acq_date", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *(reflectance(b).alias(b) for b in BANDS), F.coalesce(F.col("scl").cast("int"), F.lit(0)).alias("scl"))


def assemble_radar(pixels: DataFrame, index: DataFrame) -> DataFrame:
    """Observations from calibrated pixels ``scene_id, pol, row, col, db`` beside the scene index with orbit directions."""
    wide = pixels.groupBy("scene_id", "row", "col").pivot("pol", ["vv", "vh"]).agg(F.first("db"))
    joined = wide.join(index.select("scene_id", "acq_date", "orbit_state"), "scene_id")
    return joined.select("scene_id", F.datediff("acq_date", F.to_date(F.lit("2015-01-01"))).cast("bigint").alias("obs_id"), "acq_date", "orbit_state", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("vv").alias("vv_db"), F.col("vh").alias("vh_db"))
