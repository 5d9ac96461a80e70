import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from verdatrace.model import DetectionConfig, Periods, PipelineConfig, demo_config
from verdatrace.plans import pipeline, report
from verdatrace.sources import calibration, listings, scenes, sinks, synthetic
from verdatrace.streaming import monitor


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """A small scene of two years with real detections, stored and read back."""
    path = str(tmp_path_factory.mktemp("scene"))
    made = synthetic.generate(spark, size=96, seed=7, start=date(2019, 1, 1), end=date(2020, 12, 31), optical_days=10)
    scenes.save_scene(made, path, mode="overwrite")
    return scenes.load_scene(spark, path)


@pytest.fixture(scope="module")
def config():
    p = Periods(date(2019, 3, 1), date(2019, 11, 30), date(2020, 3, 1), date(2020, 11, 30), date(2019, 1, 1), date(2020, 12, 31))
    return PipelineConfig(demo_config().aoi, p, DetectionConfig(min_mapping_unit_ha=0.1))


@pytest.fixture(scope="module")
def result(scene, config):
    return pipeline.run(scene, config)


def test_areas_and_reproducible(spark, scene):
    for r in scene.truth_patches.collect():
        wanted = r["requested_area_ha"] * (96 / 320) ** 2
        assert abs(r["area_ha"] - wanted) <= max(0.15 * wanted, 0.02)
    again = synthetic.generate(spark, size=96, seed=7, start=date(2019, 1, 1), end=date(2019, 1, 1))
    first = scene.optical.where("acq_date = '2019-01-01'").agg(F.sum("nir")).first()[0]
    assert first == pytest.approx(again.optical.agg(F.sum("nir")).first()[0])


def test_both_sensors_see_clearing_and_only_one_fire(scene):
    clear = scene.optical.where("scl IN (4, 5)").join(scene.truth_pixels, ["row", "col"])
    after = F.col("acq_date") >= "2020-03-15"
    ndvi = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red"))
    drop = {r["patch_id"]: r["a"] - r["b"] for r in clear.groupBy("patch_id").agg(F.avg(F.when(F.col("acq_date") < "2019-12-01", ndvi)).alias("a"), F.avg(F.when(after, ndvi)).alias("b")).collect()}
    vh = {r["patch_id"]: r["a"] - r["b"] for r in scene.radar.join(scene.truth_pixels, ["row", "col"]).groupBy("patch_id").agg(F.avg(F.when(F.col("acq_date") < "2019-12-01", F.col("vh_db"))).alias("a"), F.avg(F.when(after, F.col("vh_db"))).alias("b")).collect()}
    assert drop[1] > 0.15 and drop[20] > 0.15
    assert vh[1] > 2 and vh[20] < 1.5


def test_end_to_end_accuracy(result):
    px = {r["label"]: r for r in result.accuracy["pixel"].collect()}
    assert px["confirmed tier"]["precision"] > 0.9 and px["confirmed tier"]["recall"] > 0.7
    for r in result.accuracy["decoys"].collect():
        assert r["confirmed_fraction"] < 0.05, r
    assert set(result.seconds) == {"detect_optical", "detect_radar", "fuse", "estimate_event_dates", "analyse_regrowth", "validate"}


def test_summary_and_report(result):
    s = result.summary()
    json.dumps(s, default=str)
    html = report.page("a <b>", s, [r.asDict() for r in result.accuracy["latency"].collect()])
    assert "a &lt;b&gt;" in html and "<svg" in html
    assert report.spread_labels([0.0, 0.01, 0.5], 0.1) == [0.0, 0.1, 0.5]


def test_vectors(result, scene, tmp_path):
    import sqlite3

    rows = [r.asDict() for r in sinks.vectors(result.clearing.patches, result.clearing.patch_pixels, scene.grid).collect()]
    assert rows == sorted(rows, key=lambda r: -r["area_ha"]) and all(r["wkt"].startswith("POLYGON") for r in rows)
    path = sinks.write_geopackage(rows, tmp_path / "a.gpkg", "clearing", 32755)
    assert sqlite3.connect(path).execute("SELECT count(*) FROM clearing").fetchone()[0] == len(rows)


def test_optical_only_scene_reads_back_without_radar(spark, scene, tmp_path):
    from dataclasses import replace

    scenes.save_scene(replace(scene, optical=scene.optical.where("acq_date < '2019-02-01'"), radar=None, truth_pixels=None), str(tmp_path / "s"))
    back = scenes.load_scene(spark, str(tmp_path / "s"))
    assert back.radar is None and back.truth_pixels is None and back.grid == scene.grid


def test_epochs_and_survey(scene, config):
    bad = pipeline.scan_epochs(scene, config, 2018, 2020)
    rows = {r["epoch"]: r for r in bad.collect()}
    assert rows["2018-2019"]["error"] and rows["2019-2020"]["error"] is None and rows["2019-2020"]["confirmed_patches"] >= 1
    made = pipeline.survey(scene, config, 2018, 2020)
    assert {r["year"]: r["clear_scenes"] for r in made["years"].collect()}[2018] == 0
    assert made["pairs"].count() == 2 and made["advice"].count() == 1


def test_csv_has_all_keys(tmp_path):
    p = sinks.write_csv([{"a": 1}, {"b": 2, "a": 3}], tmp_path / "x.csv")
    assert p.read_text().splitlines()[0] == "a,b"
    assert sinks.write_csv([], tmp_path / "y.csv").read_text() == ""


def test_orbit_and_listing(spark):
    name = "GRD/2023/6/11/IW/DV/S1A_IW_GRDH_1SDV_20230611T192312_20230611T192337_048942_05E2F2_9D57/"
    r = listings.radar_scenes(spark.createDataFrame([(name,), ("junk/",)], "prefix string")).collect()
    assert len(r) == 1 and r[0]["relative_orbit"] == 45 and r[0]["orbit_state"] == "descending"
    xml = '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><CommonPrefixes><Prefix>a/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>b/</Prefix></CommonPrefixes><NextContinuationToken>t</NextContinuationToken></ListBucketResult>'
    got = listings.list_prefixes(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(x["prefix"], x["next_token"]) for x in got] == [("a/", "t"), ("b/", "t")]
    box = '{"footprint": {"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,2],[0,2],[0,0]]]}}'
    assert spark.createDataFrame([(box,)], "f string").select(listings.covers("f", F.lit(1.0), F.lit(1.0)), listings.covers("f", F.lit(3.0), F.lit(1.0))).first()[:] == (True, False)


def test_calibration(spark):
    cal = "<c><calibrationVector><line>0</line><pixel>0 10 20</pixel><gamma>300 310 320</gamma></calibrationVector><calibrationVector><line>100</line><pixel>0 10 20</pixel><gamma>400 410 420</gamma></calibrationVector></c>"
    old = "<n><noiseVector><line>0</line><pixel>0 10</pixel><noiseLut>3000 3100</noiseLut></noiseVector></n>"
    new = "<n><noiseRangeVector><line>0</line><pixel>0 10</pixel><noiseRangeLut>3000 3100</noiseRangeLut></noiseRangeVector></n>"
    lut = calibration.calibration_lut(spark.createDataFrame([("s", cal)], "scene_id string, xml string"))
    assert lut.count() == 6 and lut.where("line = 0 AND pixel = 0").first()["value"] == 300
    noise = calibration.noise_lut(spark.createDataFrame([("a", old), ("b", new), ("c", "<n/>")], "scene_id string, xml string"))
    assert {(r["scene_id"], r["value"]) for r in noise.where("pixel = 0").collect()} == {("a", 3000.0), ("b", 3000.0)}
    at = calibration.interpolate_lut(lut, spark.createDataFrame([("s", 50.0, 5.0), ("s", 500.0, 20.0)], "scene_id string, line double, pixel double"))
    assert {r["pixel"]: r["value"] for r in at.collect()} == {5.0: pytest.approx(355), 20.0: pytest.approx(420)}
    px = spark.createDataFrame([(0, 0, 100.0, 10.0, 0.0), (0, 1, 10.0, 10.0, 200.0)], "row int, col int, dn double, gain double, noise double")
    assert {r["col"]: r["db"] for r in calibration.calibrate(px).collect()} == {0: pytest.approx(20), 1: None}


def test_failed_file_loses_itself_only(spark):
    import pandas as pd

    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: r for r in scenes.read_rasters(files, lambda b: pd.DataFrame({"v": [int(b)]}), "v int").collect()}
    assert got["a"]["v"] == 1 and got["a"]["error"] is None and got["b"]["error"]


def test_stream_of_observations(spark, scene, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    some = scene.radar.where("acq_date < '2019-12-31'")
    some.coalesce(2).write.parquet(src)
    px = scene.truth_pixels.where("patch_id = 1")
    stream = monitor.patch_windows(monitor.read_observations(spark, src, some.schema), px, "vh_db")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() >= 1 and got.where("patch_id = 1").count() == got.count()
    levels = spark.createDataFrame([(1, 0.0)], "patch_id int, level double")
    assert monitor.alerts(got, levels).count() == got.count()
