from datetime import date

import pytest
from pyspark.sql import functions as F

from verdatrace.functions import indices as ix
from verdatrace.model import AOI, Grid, Periods, PipelineConfig, demo_config, flatten, utm_forward


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_zero_denominator_and_missing(spark):
    assert one(spark, ix.ndvi(), red=0.0, nir=0.0) is None
    assert one(spark, ix.ndvi(), red=None, nir=0.4) is None
    assert one(spark, ix.number("a"), a=float("nan")) is None
    assert one(spark, ix.ndvi(), red=0.1, nir=0.3) == pytest.approx(0.5)


def test_decibels(spark):
    assert one(spark, ix.linear_to_db(F.lit(0.01))) == pytest.approx(-20)
    assert one(spark, ix.linear_to_db(F.lit(0.0))) is None
    assert one(spark, ix.linear_to_db(ix.db_to_linear(F.lit(-13.5)))) == pytest.approx(-13.5)


def test_unknown_index():
    with pytest.raises(KeyError):
        ix.index("nonsense")


def test_size_classes(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.2, 0.5, 2.0, 25.0, 400.0)], "a double").select(ix.size_class("a")).collect()]
    assert got == ["<0.5 ha", "0.5-2 ha", "2-10 ha", "10-50 ha", ">50 ha"]


def test_grid():
    g = Grid.from_origin("EPSG:32755", 0, 2560, 10, 512, 256)
    assert g.pixel_area_ha == pytest.approx(0.01) and g.pixels_for_ha(0.5) == 50 and g.bounds == (0, 0, 5120, 2560)
    assert g.finer(10)[1] == 1 and g.finer(5)[0].shape == (512, 1024)


def test_bad_periods_and_areas():
    with pytest.raises(ValueError):
        AOI("a", 2, 0, 1, 1)
    with pytest.raises(ValueError):
        Periods(date(2019, 1, 1), date(2019, 6, 1), date(2019, 5, 1), date(2019, 9, 1), date(2019, 1, 1), date(2020, 1, 1))
    with pytest.raises(ValueError):
        Periods(date(2019, 1, 1), date(2019, 6, 1), date(2019, 7, 1), date(2019, 9, 1), date(2019, 1, 1), date(2019, 8, 1))


def test_phenology_wraps():
    p = Periods(date(2018, 12, 20), date(2018, 12, 31), date(2020, 1, 1), date(2020, 1, 15), date(2018, 1, 1), date(2020, 12, 31))
    assert p.phenology_offset_days() < 21
    q = demo_config().periods
    assert q.phenology_offset_days() <= 1 and q.default_event == date(2020, 1, 15)


def test_config_round_trip():
    c = demo_config()
    assert PipelineConfig.from_json(c.to_json()) == c
    assert ("a.b", 1) in flatten({"a": {"b": 1}, "c": 2})


def test_tiles():
    assert ix.zone_and_band("T55JGG") == ("55", "J", "GG") and ix.zone_and_band("05QKB")[0] == "5"
    with pytest.raises(ValueError):
        ix.zone_and_band("nonsense")


def test_utm_is_near_known_point():
    east, north = utm_forward(149.0, -30.0, 55, True)
    assert 690_000 < east < 700_000 and 6_670_000 < north < 6_690_000
    assert utm_forward(147.0, 0.0, 55, False) == pytest.approx((500_000, 0))


def test_luminance_ramp(spark):
    got = [r[0] for r in spark.createDataFrame([("#000000",), ("#808080",), ("#ffffff",)], "c string").select(ix.relative_luminance("c")).collect()]
    assert got == sorted(got) and got[0] == 0 and got[2] == pytest.approx(1)
