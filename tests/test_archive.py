import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from verdatrace.model import Grid
from verdatrace.sources import archive


@pytest.fixture
def page():
    """A page of a listing; not a function of this module, which workers cannot import."""

    def made(prefixes, token=None):
        more = f"<IsTruncated>true</IsTruncated><NextContinuationToken>{token}</NextContinuationToken>" if token else "<IsTruncated>false</IsTruncated>"
        return f'<ListBucketResult xmlns="urn:x">{"".join(f"<CommonPrefixes><Prefix>{p}</Prefix></CommonPrefixes>" for p in prefixes)}{more}</ListBucketResult>'

    return made


def test_listing_follows_tokens_to_the_end(spark, page):
    def fetch(prefix, token):
        names = {"2020/1/": ["S2A_55JGG_20200105_0_L2A", "S2A_55JGG_20200105_1_L2A"], "2020/2/": ["S2B_55JGG_20200210_0_L2A"]}
        of = names.get(prefix[-7:], [])
        at = int(token or 0)
        return page([f"{prefix}{n}/" for n in of[at : at + 1]], at + 1 if at + 1 < len(of) else None)

    got = {(r["scene_id"], r["acq_date"]) for r in archive.list_tile(spark, "55JGG", date(2020, 1, 1), date(2020, 2, 28), fetch).collect()}
    assert got == {("S2A_55JGG_20200105_1_L2A", date(2020, 1, 5)), ("S2B_55JGG_20200210_0_L2A", date(2020, 2, 10))}
    with pytest.raises(LookupError):
        archive.list_tile(spark, "55JGG", date(2021, 1, 1), date(2021, 1, 31), fetch)


def test_listing_that_breaks_off_is_an_error(spark, page):
    def fetch(prefix, token):
        if token:
            raise OSError("gone")
        return page(["a/"], "next")

    with pytest.raises(Exception, match="cannot list p/"):
        archive.listing_pages(spark.createDataFrame([("p/",)], "prefix string"), fetch).collect()


def test_orbits_over_a_place(spark, page):
    near, far = ("S1A_IW_GRDH_1SDV_2023061{0}T192312_2023061{0}T192337_04894{0}_05E2F2_9D5{0}".format(k) for k in (1, 2))
    noon = "S1A_IW_GRDH_1SDV_20230611T120000_20230611T120025_048950_05E2F2_9D57"

    def fetch(prefix, token):
        return page([f"{prefix}{n}/" for n in (near, far, noon) if f"/{int(n[23:25])}/IW" in prefix])

    scenes = archive.list_days(spark, date(2023, 6, 11), 12, fetch)
    assert scenes.count() == 3
    box = lambda w: f'{{"type": "Polygon", "coordinates": [[[{w},-32],[{w + 2},-32],[{w + 2},-30],[{w},-30],[{w},-32]]]}}'
    prints = spark.createDataFrame([(near, box(148)), (far, box(10)), (noon, box(148))], "scene_id string, footprint string")
    assert [r["scene_id"] for r in archive.orbits_over(scenes, prints, 149.1, -31.0, date(2023, 6, 11)).collect()] == [near]
    with pytest.raises(LookupError):
        archive.orbits_over(scenes, prints, 149.1, 50.0, date(2023, 6, 11))


def _brute(values, source, target, method):
    out = {}
    for r in range(target.height):
        for c in range(target.width):
            x, y = target.c + target.a * (c + 0.5), target.f + target.e * (r + 0.5)
            u, v = (x - source.c) / source.a, (y - source.f) / source.e
            if method == "nearest":
                got = values.get((math.floor(v), math.floor(u)), 0)
                if got:
                    out[r, c] = got
                continue
            u, v, total, weights = u - 0.5, v - 0.5, 0.0, 0.0
            for i in (math.floor(v), math.floor(v) + 1):
                for j in (math.floor(u), math.floor(u) + 1):
                    w = (1 - abs(v - i)) * (1 - abs(u - j))
                    if w > 0 and values.get((i, j), 0):
                        total, weights = total + w * values[i, j], weights + w
            if weights:
                out[r, c] = total / weights
    return out


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
@pytest.mark.parametrize("target", [
    Grid.from_origin("E", 140, 960, 10, 12, 8), Grid.from_origin("E", 140, 960, 20, 6, 4),
    Grid.from_origin("E", 105, 1003, 30, 7, 7), Grid.from_origin("E", 0, 1200, 16, 30, 40),
])
def test_resample_against_brute_force(spark, method, target):
    source, rng = Grid.from_origin("E", 100, 1000, 20, 9, 11), random.Random(3)
    values = {(r, c): rng.choice([0, 100, 250, 900]) for r in range(11) for c in range(9)}
    px = spark.createDataFrame([("s", "red", r, c, v) for (r, c), v in values.items()], "scene_id string, asset string, row int, col int, raw int")
    got = {(r["row"], r["col"]): r["raw"] for r in archive.resample(px, source, target, method).collect()}
    wanted = _brute(values, source, target, method)
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k]) for k in wanted)


def test_resample_refuses_other_projections_and_methods(spark):
    px = spark.createDataFrame([], "scene_id string, asset string, row int, col int, raw int")
    a, b = Grid.from_origin("E", 0, 0, 10, 2, 2), Grid.from_origin("F", 0, 0, 10, 2, 2)
    with pytest.raises(ValueError):
        archive.resample(px, a, b)
    with pytest.raises(ValueError):
        archive.resample(px, a, a, "cubic")
    assert archive.resample(px, a, a).count() == 0


ITEMS = "id string, properties struct<datetime:string,`sat:orbit_state`:string>"


def test_cube_by_solar_day(spark):
    # 23:30 and 00:10 UTC are one morning at 149 degrees east.
    items = spark.createDataFrame([("b", ("2020-01-02T00:10:00Z", "ascending")), ("a", ("2020-01-01T23:30:00Z", "Descending")), ("c", ("2020-01-05T00:00:00Z", None)), ("d", (None, None))], ITEMS)
    days = {r["scene_id"]: r["acq_date"] for r in archive.with_days(items, 149.0).collect()}
    assert days == {"a": date(2020, 1, 2), "b": date(2020, 1, 2), "c": date(2020, 1, 5), "d": None}
    px = spark.createDataFrame([("a", "vv", 0, 0, 0.0), ("b", "vv", 0, 0, 0.1), ("a", "vv", 0, 1, 1.0), ("b", "vv", 0, 1, 10.0), ("c", "vh", 0, 0, 0.01), ("d", "vv", 0, 0, 1.0)], "scene_id string, asset string, row int, col int, raw double")
    got = {(r["scene_id"], r["col"]): (r["acq_date"], r["orbit_state"], r["vv_db"], r["vh_db"]) for r in archive.radar_cube(px, items, 149.0).collect()}
    assert got == {
        ("a", 0): (date(2020, 1, 2), "descending", pytest.approx(-10), None), ("a", 1): (date(2020, 1, 2), "descending", pytest.approx(0), None),
        ("c", 0): (date(2020, 1, 5), "unknown", None, pytest.approx(-20)),
    }


def test_optical_cube_and_both_sensors(spark):
    items = spark.createDataFrame([("a", ("2020-01-01T23:30:00Z",))], "id string, properties struct<datetime:string>")
    px = spark.createDataFrame([("a", k, 0, 0, v) for k, v in (("red", 500), ("nir", 4000), ("scl", 4))], "scene_id string, asset string, row int, col int, raw int")
    one = archive.optical_cube(px, items, 149.0).select("acq_date", F.round("red", 4), F.round("nir", 4), "blue", "scl").first()
    assert one[:] == (date(2020, 1, 2), 0.05, 0.4, None, 4)
    a, b = Grid.from_origin("E", 0, 0, 10, 2, 2), Grid.from_origin("E", 0, 0, 20, 1, 1)
    with pytest.raises(ValueError):
        archive.both_sensors(px, a, px, b)
    assert archive.both_sensors(px, a, px, a).grid == a


def test_ramps_that_darken(spark):
    from verdatrace.functions.indices import darkens

    ramps = [(["#ffffff", "#8899aa", "#000000"], True), (["#000000", "#ffffff", "#000000"], False), (["#777777", "#777777"], False), (["#123456"], True), (None, None)]
    got = spark.createDataFrame(ramps, "ramp array<string>, wanted boolean").select("wanted", darkens("ramp").alias("got")).collect()
    assert [r["got"] for r in got] == [r["wanted"] for r in got]
