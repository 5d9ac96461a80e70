"""A deterministic raster scene over the ``lineitem`` table, for queries and tests.

A pixel is a part, an observation a line: 50 columns, and rows by the hundred
thousand parts.  Two clearings, a fire and a block of crop are planted on
1998-03-01.  The SQL runs unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdatrace.model import AOI, OPTICAL, RADAR, DetectionConfig, Grid, Periods, PipelineConfig, Scene

WIDTH = 50
EVENT = date(1998, 3, 1)
PERIODS = Periods(date(1995, 1, 1), date(1998, 2, 28), EVENT, date(2001, 12, 31), date(1995, 1, 1), date(2001, 12, 31))
#: Observations are scattered over dates, so scene classes are not grown over neighbours here.
CONFIG = DetectionConfig(dilation_pixels=0, max_cloud_cover=1.0, speckle_window=1, min_mapping_unit_ha=0.1)

#: Common table expressions ``optical`` and ``radar`` over ``lineitem``.
VIEWS = """
px AS (SELECT CAST(floor(l_partkey / 50.0) AS INT) AS r, CAST(l_partkey % 50 AS INT) AS c, CAST(l_shipdate AS DATE) AS d, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS k,
  CAST(round(100 * l_discount) AS INT) AS q, CAST(round(100 * l_tax) AS INT) AS t, CAST(l_quantity AS INT) AS n FROM lineitem),
lab AS (SELECT *, CASE WHEN (r-2)*(r-2)+(c-12)*(c-12) <= 25 THEN 1 WHEN (r-25)*(r-25)+(c-35)*(c-35) <= 36 THEN 2
  WHEN (r-14)*(r-14)+(c-25)*(c-25) <= 16 THEN 20 WHEN r >= 30 AND c < 10 THEN 30 ELSE 0 END AS truth_id FROM px),
st AS (SELECT *, CASE WHEN truth_id IN (1,2,20) AND d >= DATE '1998-03-01' THEN 1 ELSE 0 END AS hit, CASE WHEN truth_id = 1 AND d >= DATE '1998-03-01' THEN year(d) - 1998 ELSE 0 END AS age,
  CASE WHEN truth_id = 30 AND month(d) NOT IN (8,9,10) THEN 1 ELSE 0 END AS bare FROM lab),
optical AS (SELECT r, c, d, k, truth_id, year(d) * 100 + month(d) AS scene,
  CASE WHEN (q*7+t*3+n) % 11 = 0 THEN 9 WHEN (q+n) % 13 = 0 THEN 3 ELSE 4 END AS scl,
  CAST(30 + t AS DOUBLE)/1000 AS blue, CAST(60 + t AS DOUBLE)/1000 AS green,
  CASE WHEN hit+bare > 0 THEN CAST(200 + 2*t - 20*age AS DOUBLE)/1000 ELSE CAST(30 + t AS DOUBLE)/1000 END AS red,
  CASE WHEN hit+bare > 0 THEN CAST(280 + 2*q + 20*age AS DOUBLE)/1000 ELSE CAST(400 + 2*q AS DOUBLE)/1000 END AS nir,
  CASE WHEN hit+bare > 0 THEN CAST(340 + q AS DOUBLE)/1000 ELSE CAST(180 + n AS DOUBLE)/1000 END AS swir1,
  CASE WHEN hit+bare > 0 THEN CAST(330 - n - 30*age AS DOUBLE)/1000 ELSE CAST(160 + n AS DOUBLE)/2000 END AS swir2 FROM st),
radar AS (SELECT r, c, d, k, truth_id, year(d) * 100 + month(d) AS scene, CASE WHEN k % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state,
  CAST((CASE WHEN truth_id IN (1,2) AND hit = 1 THEN -19000 + 500*age WHEN truth_id = 30 THEN -17500 ELSE -14500 END) + 20*n AS DOUBLE)/1000 AS vh_db,
  CAST((CASE WHEN truth_id IN (1,2) AND hit = 1 THEN -12000 + 500*age WHEN truth_id = 30 THEN -10500 ELSE -8500 END) + 20*n AS DOUBLE)/1000 AS vv_db FROM st)
"""

#: Truth patches: id, name, kind and event date.
TRUTH = [(1, "recovers", "clearing", EVENT), (2, "stalls", "clearing", EVENT), (20, "fire", "fire", EVENT), (30, "crop", "crop", None)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``optical`` or ``radar`` with the columns of the SQL."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return spark.sql(f"WITH {VIEWS.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM {name}", lineitem=lines)


def _observations(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"r": "row", "c": "col", "d": "acq_date", "k": "obs_id"}).withColumn("scene_id", F.col("scene").cast("string"))


def scene(spark: SparkSession, sf_dir: str) -> Scene:
    """The scene with its truth."""
    optical, radar = (_observations(view(spark, sf_dir, v)) for v in ("optical", "radar"))
    height = (spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_partkey")).first()[0] or 0) // WIDTH + 1
    pixels = radar.where("truth_id > 0").select("row", "col", F.col("truth_id").alias("patch_id")).distinct()
    dim = spark.createDataFrame(TRUTH, "patch_id int, name string, kind string, event_date date")
    grid = Grid.from_origin("EPSG:32755", 0.0, 10.0 * height, 10.0, WIDTH, int(height))
    patches = dim.join(pixels.groupBy("patch_id").agg(F.count("*").alias("pixels")), "patch_id").withColumn("area_ha", F.col("pixels") * F.lit(grid.pixel_area_ha))
    return Scene(grid, optical.select(*(f.name for f in OPTICAL), "truth_id"), radar.select(*(f.name for f in RADAR), "truth_id"), pixels, patches)


def config() -> PipelineConfig:
    return PipelineConfig(AOI("fixture", 149.10, -30.95, 149.16, -30.90), PERIODS, CONFIG)
