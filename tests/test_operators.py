import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdatrace.functions import indices as ix
from verdatrace.model import DetectionConfig, Grid, RegrowthConfig
from verdatrace.operators import assess, masks, patches, recovery, reducers, robust, spatial, survey, timing

D = date(2020, 1, 1)


def mask_df(spark, cells):
    return spark.createDataFrame(sorted(cells), "row int, col int")


def cells(df):
    return {(r["row"], r["col"]) for r in df.collect()}


def square(r, c, n):
    return {(y, x) for y in range(r, r + n) for x in range(c, c + n)}


def test_one_cloud_pixel(spark):
    obs = spark.createDataFrame([("s", y, x, 9 if (y, x) == (4, 4) else 4) for y in range(9) for x in range(9)], "scene_id string, row int, col int, scl int")
    assert masks.scl_valid(obs, radius=0).where("valid").count() == 80
    assert masks.scl_valid(obs, radius=2).where("valid").count() == 81 - 13


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_dense_dilation_equals_sparse(spark, radius):
    rng = random.Random(radius)
    obs = spark.createDataFrame([(s, y, x, rng.choice([4, 4, 4, 4, 4, 4, 4, 4, 4, 9, 3, 0])) for s in "ab" for y in range(15) for x in range(17)], "scene_id string, row int, col int, scl int")
    pick = lambda df: sorted(tuple(r) for r in df.select("scene_id", "row", "col", "valid").collect())
    assert pick(masks.scl_valid(obs, radius=radius, dense=True)) == pick(masks.scl_valid(obs, radius=radius))


def test_masked_median(spark):
    obs = spark.createDataFrame([(0, 0, 1.0, True), (0, 0, 100.0, False), (0, 0, 3.0, True), (0, 1, 5.0, False)], "row int, col int, v double, valid boolean")
    got = {(r["row"], r["col"]): r["v"] for r in reducers.masked_median(obs, ["v"]).collect()}
    assert got == {(0, 0): 2.0, (0, 1): None}


def test_medoid_needs_all_bands_and_breaks_ties(spark):
    rows = [(0, 0, date(2020, 1, k), k, True, *([0.1 * k] * 6)) for k in (1, 2, 3)] + [(0, 0, date(2020, 1, 4), 4, True, None, *([0.2] * 5)), (0, 1, D, 1, False, *([0.3] * 6))]
    obs = spark.createDataFrame(rows, "row int, col int, acq_date date, obs_id bigint, valid boolean, blue double, green double, red double, nir double, swir1 double, swir2 double")
    got = {(r["row"], r["col"]): r for r in reducers.medoid(obs).collect()}
    assert got[0, 0]["n_obs"] == 4 and got[0, 0]["red"] == pytest.approx(0.2)
    assert got[0, 1]["n_obs"] == 0 and got[0, 1]["red"] is None


def test_boxcar_hole_and_brute_force(spark):
    hole = spark.createDataFrame([(y, x, None if (y, x) == (2, 2) else 2.0) for y in range(5) for x in range(5)], "row int, col int, v double")
    assert {r["v"] for r in spatial.boxcar(hole, ["v"], 3).collect()} == {2.0}
    rng = np.random.default_rng(3)
    a = rng.random((7, 9))
    a[rng.random((7, 9)) < 0.3] = np.nan
    df = spark.createDataFrame([(y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(7) for x in range(9)], "row int, col int, v double")
    padded = np.pad(a, 2, mode="edge")
    for r in spatial.boxcar(df, ["v"], 5).collect():
        part = padded[r["row"] : r["row"] + 5, r["col"] : r["col"] + 5]
        want = np.nanmean(part) if np.isfinite(part).any() else None
        assert r["v"] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("window, share", [(5, 0.0), (5, 0.4), (5, 0.85), (3, 0.6), (4, 0.6)])
def test_boxcar_of_pixels_without_rows(spark, window, share):
    rng = np.random.default_rng(4)
    a = rng.random((11, 13))
    a[rng.random(a.shape) < share] = np.nan
    a[:2], a[:, 11:] = np.nan, np.nan
    have = [(y, x, float(a[y, x]), f"{y}.{x}") for y in range(11) for x in range(13) if np.isfinite(a[y, x])]
    grid = Grid.from_origin("EPSG:32755", 0.0, 110.0, 10.0, 13, 11)
    got = spatial.boxcar(spark.createDataFrame(have, "row int, col int, v double, name string"), ["v"], window, grid).collect()
    assert sorted((r["row"], r["col"], r["name"]) for r in got) == sorted((y, x, n) for y, x, _, n in have)
    padded = np.pad(a, (window // 2, window - 1 - window // 2), mode="edge")
    for r in got:
        assert r["v"] == pytest.approx(np.nanmean(padded[r["row"] : r["row"] + window, r["col"] : r["col"] + window]))


def label(mask):
    out, seen = [], set()
    for p in sorted(mask):
        if p not in seen:
            group, work = set(), [p]
            while work:
                q = work.pop()
                if q in mask and q not in group:
                    group.add(q)
                    work += [(q[0] + 1, q[1]), (q[0] - 1, q[1]), (q[0], q[1] + 1), (q[0], q[1] - 1)]
            seen |= group
            out.append(group)
    return out


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_against_flood_fill(spark, local):
    rng = random.Random(5)
    m = {(y, x) for y in range(20) for x in range(20) if rng.random() < 0.55}
    want = {p: k + 1 for k, g in enumerate(label(m)) for p in g}
    got = {(r["row"], r["col"]): r["patch_id"] for r in spatial.components(mask_df(spark, m), local).collect()}
    assert got == want


def test_sieve(spark):
    assert cells(spatial.sieve(mask_df(spark, square(0, 0, 2) | square(5, 5, 6)), 10)) == square(5, 5, 6)


def test_clean_mask(spark):
    grid = Grid.from_origin("EPSG:32755", 0, 400, 10, 40, 40)
    m = (square(5, 5, 20) - square(12, 12, 2)) | {(15, x) for x in range(25, 35)}
    got = cells(spatial.clean(mask_df(spark, m), grid))
    assert square(12, 12, 2) <= got and not any(x > 25 for _, x in got)
    both = m | square(30, 30, 8) | square(0, 0, 4)
    once = {(r["row"], r["col"], r["patch_id"]) for r in spatial.clean_components(mask_df(spark, both), grid).collect()}
    twice = {(r["row"], r["col"], r["patch_id"]) for r in spatial.components(spatial.clean(mask_df(spark, both), grid)).collect()}
    assert once == twice and {p for *_, p in once} == {1, 2}


def test_fill_holes_only_inside(spark):
    grid = Grid.from_origin("EPSG:32755", 0, 100, 10, 10, 10)
    ring = square(2, 2, 5) - square(3, 3, 3)
    assert cells(spatial.fill_holes(mask_df(spark, ring), grid)) == square(2, 2, 5)
    open_ring = ring - {(2, 4)}
    assert cells(spatial.fill_holes(mask_df(spark, open_ring), grid)) == open_ring
    assert cells(spatial.fill_holes(spark.createDataFrame([], "row int, col int"), grid)) == set()


def test_outline_and_perimeter(spark):
    grid = Grid.from_origin("EPSG:32755", 0, 100, 10, 10, 10)
    px = mask_df(spark, square(2, 2, 3) - {(3, 3)}).withColumn("patch_id", F.lit(1))
    r = spatial.perimeter(px, grid).first()
    assert r["perimeter_m"] == 160
    wkt = spatial.outlines(px, grid).first()["wkt"]
    assert wkt.count("(") == 3 and wkt.startswith("POLYGON ((")


def test_block_mean_in_power(spark):
    df = spark.createDataFrame([(y, x, None if (y, x) == (3, 3) else float(4 if y < 2 and x < 2 else 1)) for y in range(4) for x in range(4)], "row int, col int, v double")
    got = {(r["row"], r["col"]): r["v"] for r in spatial.block_mean_power(df, ["v"], 2).collect()}
    assert got[0, 0] == 4.0 and got[1, 1] == 1.0


def offset_of(spark, values, population=None, threshold=None):
    df = spark.createDataFrame([(v, p) for v, p in zip(values, population or [True] * len(values), strict=True)], "v double, p boolean")
    return robust.offsets(df, {"o": (F.col("v"), F.col("p") if population else None, threshold)}).first()["o"]


def test_robust_offset(spark):
    assert offset_of(spark, [0.05] * 900 + [0.9] * 100, threshold=0.2) == pytest.approx(0.05)
    assert offset_of(spark, [0.3] * 500, [k < 4 for k in range(500)]) == pytest.approx(0.3)
    assert offset_of(spark, [None] * 10) == 0.0


def test_adaptive_radar_threshold(spark):
    noise = np.random.default_rng(1).laplace(0, 0.62, 5000)
    df = spark.createDataFrame([(float(x),) for x in noise], "v double")
    got = robust.change_thresholds(df, {"t": (F.col("v"), F.lit(True), 2.0, 5.0)}, 0.6).first()["t"]
    assert got > 2.0
    few = robust.change_thresholds(df.limit(10), {"t": (F.col("v"), F.lit(True), 2.0, 5.0)}, 0.6).first()["t"]
    assert few == 2.0


def test_z_scores(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, True), (40.0, False)], "v double, s boolean")
    got = [r["v"] for r in robust.z_scores(df, ["v"], F.col("s")).collect()]
    assert got[1] == pytest.approx(0) and got[3] > 10
    flat = robust.z_scores(df.withColumn("v", F.lit(1.0)), ["v"], F.col("s")).first()["v"]
    assert flat is None


def test_gates_and_rejections(spark):
    df = spark.createDataFrame([(True, None), (True, True), (False, True)], "a boolean, b boolean")
    assert df.where(masks.all_gates(["a", "b"])).count() == 1
    assert {(r["gate"], r["pixels"]) for r in masks.rejections(df, ["a", "b"]).collect()} == {("a", 1), ("b", 1)}


def test_orbits(spark):
    with pytest.raises(ValueError):
        masks.by_orbit(spark.range(1), "ascending")


def test_crossing(spark):
    days = [(1, date(2020, 1, k), str(k), v, 1.0) for k, v in enumerate([0.6, 0.1, 0.6, 0.1, 0.1, 0.1], 1)]
    s = spark.createDataFrame(days, "patch_id int, acq_date date, scene_id string, mean double, clear_fraction double")
    levels = spark.createDataFrame([(1, 0.6, 0.1), (2, 0.1, 0.6)], "patch_id int, baseline double, floor double")
    assert timing.first_crossing(s, levels).collect()[0]["detected"] == date(2020, 1, 4)
    last = timing.first_crossing(s.where("acq_date >= '2020-01-06' OR acq_date <= '2020-01-03'"), levels).collect()
    assert last[0]["detected"] == date(2020, 1, 6)  # near the end fewer followers suffice


def quarters(values, start=(2018, 2)):
    out = []
    for k, v in enumerate(values):
        m = start[1] - 1 + 3 * k
        out.append((1, "nbr", date(start[0] + m // 12, m % 12 + 1, 15), float(v) if v is not None else None, 1))
    return out


def season_df(spark, values, start=(2018, 2)):
    return spark.createDataFrame(quarters(values, start), "patch_id int, track string, season_date date, value double, n bigint")


EVENT = date(2020, 3, 1)


def events(spark):
    return spark.createDataFrame([(1, EVENT)], "patch_id int, event_date date")


def test_seasons(spark):
    s = spark.createDataFrame([(1, "n", date.fromordinal(date(2020, 1, 5).toordinal() + 20 * k), float(k)) for k in range(6)], "patch_id int, track string, acq_date date, value double")
    got = recovery.seasonalise(s).orderBy("season_date").collect()
    assert len(got) == 2 and sum(r["n"] for r in got) == 6 and got[0]["season_date"] == date(2020, 2, 15)


@pytest.mark.parametrize(("a", "r"), [(0.32, 0.02), (-15.0, -19.5)])
def test_known_recovery(spark, a, r):
    pre = [a] * 9
    ages = [(d[2] - EVENT).days / 365.25 for d in quarters([0] * 28, (2020, 5))]
    values = [*pre, *(a + (r - a) * np.exp(-t / 2.5) for t in ages)]
    fits = recovery.fit_curves(recovery.recovery_metrics(recovery.trajectories(season_df(spark, values), events(spark)))).first()
    assert fits["tau_years"] == pytest.approx(2.5, rel=0.1) and fits["rmse"] < (1e-3 if a > 0 else 1e-2)
    assert (fits["r80p"] is None) == (a < 0)
    grid = recovery.fit_grid(recovery.recovery_metrics(recovery.trajectories(season_df(spark, values), events(spark)))).first()
    assert grid["tau_years"] == pytest.approx(2.5, rel=0.1)


def test_reclearing(spark):
    rise = [0.05 + 0.3 * (1 - np.exp(-k / 6)) for k in range(24)]
    again = [v - (0.22 if k >= 14 else 0) for k, v in enumerate(rise)]
    of = lambda v: recovery.trajectories(season_df(spark, [0.4] * 9 + v), events(spark))
    got = recovery.reclearing(of(again)).collect()
    assert len(got) == 1 and got[0]["reclear_date"] == quarters([0] * 40)[9 + 14][2]
    assert recovery.reclearing(of(rise)).count() == 0


def test_classes(spark):
    df = spark.createDataFrame([(0.95, 0.02), (0.55, 0.03), (0.15, 0.001), (0.15, 0.05), (None, None)], "recovery_fraction double, recent_slope_per_year double")
    df = df.withColumns({"seasonal_amplitude": F.lit(None).cast("double"), "reclear_date": F.lit(None).cast("date")})
    assert [r[0] for r in df.select(recovery.classify()).collect()] == ["recovered", "recovering", "stalled", "recovering", "unknown"]
    both = df.withColumns({"seasonal_amplitude": F.lit(0.5), "reclear_date": F.lit(EVENT)}).select(recovery.classify()).first()[0]
    assert both == "cultivated"


def test_too_few_seasons(spark):
    m = recovery.recovery_metrics(recovery.trajectories(season_df(spark, [0.4] * 9 + [0.1, 0.2]), events(spark)), RegrowthConfig()).first()
    assert m["n_seasons"] == 2 and m["recovery_fraction"] is None and m["trough"] is None


def test_patch_means_of_absent_patch(spark):
    obs = spark.createDataFrame([(0, 0, D, "s", 1.0), (0, 1, D, "s", None), (1, 0, D, "s", 3.0), (1, 1, D, "s", 4.0)], "row int, col int, acq_date date, scene_id string, v double")
    px = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 2)], "row int, col int, patch_id int")
    ids = spark.createDataFrame([(1,), (2,), (99,)], "patch_id int")
    got = {r["patch_id"]: r["value"] for r in recovery.patch_means(obs, px, "v", ids).collect()}
    assert got == {1: 1.0, 2: 3.5, 99: None}


def test_year_pair_not_comparable(spark):
    cols = "year int, clear_scenes bigint, ndvi_median double, woody_fraction double"
    pair = survey.compare_years(spark.createDataFrame([(2019, 40, 0.516, 0.3), (2020, 40, 0.642, 0.3)], cols)).first()
    assert not pair["comparable"] and "greener" in pair["notes"][0]
    gap = survey.compare_years(spark.createDataFrame([(2019, 0, None, None), (2020, 40, 0.6, 0.3)], cols)).first()
    assert not gap["comparable"] and gap["notes"] == ["coverage: no clear scene in one year"]
    assert survey.best_pair(survey.compare_years(spark.createDataFrame([(2019, 0, None, None), (2020, 40, 0.6, 0.3)], cols))).count() == 0


def test_confusion(spark):
    grid = Grid.from_origin("EPSG:32755", 0, 10, 10, 4, 1)
    r = assess.confusion(mask_df(spark, {(0, 0), (0, 1)}), mask_df(spark, {(0, 0), (0, 2)}), grid).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1) and r["precision"] == r["recall"] == r["f1"] == 0.5 and r["iou"] == pytest.approx(1 / 3)
    empty = spark.createDataFrame([], "row int, col int")
    assert assess.confusion(empty, empty, grid).first()["precision"] is None


def test_tiers(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.5), (0.9, 0.1, 0.1), (0.1, 0.9, 0.1), (0.5, 0.5, 0.2)], "a double, b double, c double")
    assert [r[0] for r in df.select(patches.tier_code(F.col("a"), F.col("b"), F.col("c"), DetectionConfig().confirm_overlap)).collect()] == [3, 2, 1, 2]


def test_bright_pass_does_not_move_the_median(spark):
    obs = spark.createDataFrame([(0, 0, v, v) for v in (-15.0, -15.0, -15.0, -15.0, -4.0)], "row int, col int, vv_db double, vh_db double")
    assert reducers.radar_medians(obs).first()["vh_db"] == -15


def test_stretch_and_names(spark):
    assert spark.range(1).select(ix.stretch(F.lit(3.0), F.lit(1.0), F.lit(2.0))).first()[0] == 1.0
    assert spark.range(1).select(ix.scl_name(F.lit(11))).first()[0] == "snow / ice"
