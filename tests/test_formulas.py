"""Formula values from public calculators and tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isobarn.functions import air, codes, meteo, solar
from isobarn.operators import derive


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: meteo.relative_humidity(20, 15), 72.93877),
        (lambda: meteo.relative_humidity(5, 15), 100.0),
        (lambda: F.lit(meteo.wind_factor(120, 130)), 1.008896),
        (lambda: F.lit(meteo.wind_factor(98, 80)), 0.9769196),
        (lambda: meteo.wet_bulb(10, 50), 5.10125),
        (lambda: meteo.vapour_pressure_deficit(25, 13.8), 1.5898033),
        (lambda: meteo.vapour_pressure_deficit(25, 26), 0.0),
        (lambda: meteo.sea_level_pressure(15, 980, 1000), 1101.9026),
        (lambda: meteo.surface_pressure(15, 1101.9026, 1000), 980.0),
        (lambda: meteo.air_density(15, 0, 1013.25), 1.225),
        (lambda: meteo.cloud_cover_at_level(95, 1000), 32.740467),
        (lambda: meteo.cloud_cover_at_level(95, 500), 59.17517),
        (lambda: meteo.dew_point(20, 72.93877), 15.0),
        (lambda: meteo.elevation_from_pressures(1101.9026, 980, 15), 1000.0),
        (lambda: air.european_index(17.5, "nitrogen_dioxide"), 30.0),
        (lambda: air.european_index(175, "nitrogen_dioxide"), 110.0),
        (lambda: meteo.wind_direction(0, 0), 270.0),
        (lambda: meteo.wind_direction(-1, 0), 90.0),
        (lambda: meteo.wind_direction(1, 0), 270.0),
        (lambda: meteo.wind_direction(0, 1), 180.0),
        (lambda: meteo.wind_direction(0, -1), 360.0),
    ],
)
def test_golden(one, column, want):
    assert one(column()) == pytest.approx(want, rel=2e-3, abs=1e-6)


def test_missing_stays_missing(one):
    null = F.lit(None).cast("double")
    assert one(air.european_index(-1, "nitrogen_dioxide")) is None
    assert one(meteo.relative_humidity(null, 1)) is None
    assert one(meteo.clamp(null, 0, 1)) is None
    assert one(air.overall(F.lit(1.0), null)) is None
    assert one(codes.weather_code(null, 1, 0)) is None


def test_round_trips(one):
    for speed, direction in ((3.0, 10.0), (7.5, 200.0), (1.0, 359.0)):
        u, v = meteo.u_wind(speed, direction), meteo.v_wind(speed, direction)
        assert one(meteo.wind_speed(u, v)) == pytest.approx(speed)
        assert one(meteo.wind_direction(u, v)) == pytest.approx(direction)
    assert one(meteo.altitude_of_pressure(meteo.pressure_of_altitude(1500))) == pytest.approx(1500, abs=0.5)


@pytest.mark.parametrize("args, want", [((10, 0, 0), 0), ((30, 0, 0), 1), ((60, 0, 0), 2), ((90, 0, 0), 3), ((90, 0.3, 0), 51), ((90, 3, 0), 63), ((90, 9, 0), 65), ((90, 1, 0.5), 73)])
def test_weather_code(one, args, want):
    assert one(codes.weather_code(*args)) == want


def test_code_corrections(one):
    assert one(codes.correct_code(F.lit(73), 3, 1)) == 63
    assert one(codes.correct_code(F.lit(63), -3, 1)) == 73
    assert one(codes.correct_code(F.lit(63), 5, 0)) == 3
    assert one(codes.cut_code_at_freezing(F.lit(71), 0.5)) == 61


def test_sun_distance(one):
    for day, want in (("2010-01-04", 0.98328), ("2010-07-04", 1.0167135)):
        assert one(solar.sun_distance(F.lit(f"{day} 00:00:00").cast("timestamp"))) == pytest.approx(want, abs=2e-5)


def test_sunrise(spark):
    midnight = dt.datetime.fromtimestamp(1636182000, dt.UTC)
    table = spark.createDataFrame([(midnight, 34.05223, -118.24368)], "m timestamp, lat double, lon double")
    # the day starts at 07:00 UTC, which is local midnight; its noon is counted from UTC midnight
    table = table.withColumn("m", F.date_trunc("day", "m"))
    got = solar.sunrise_sunset(table, "m", "lat", "lon").select(F.unix_seconds("sunrise").alias("a"), F.unix_seconds("sunset").alias("b")).first()
    assert got.a == pytest.approx(1636208261, abs=30) and got.b == pytest.approx(1636246534, abs=30)


def test_polar_days(spark):
    table = spark.sql("SELECT timestamp'2024-06-21 00:00:00' AS m, lat, 0.0D AS lon FROM VALUES (80.0D), (-80.0D) AS t(lat)")
    got = {r.lat: r for r in solar.sunrise_sunset(table, "m", "lat", "lon").collect()}
    assert got[80.0].daylight_duration == 86400 and (got[80.0].sunset - got[80.0].sunrise).total_seconds() == 86400
    assert got[-80.0].daylight_duration == 0 and got[-80.0].sunset == got[-80.0].sunrise


def test_radiation_is_consistent(spark):
    hours = spark.sql("SELECT explode(sequence(timestamp'2024-05-01 01:00:00', timestamp'2024-05-02 00:00:00', interval 1 hour)) AS t, 47.0D AS lat, 8.0D AS lon")
    hourly = solar.potential_radiation(hours, "t", "lat", "lon", 3600).agg(F.avg("potential_radiation")).first()[0]
    daily = solar.potential_radiation(hours.where("t = timestamp'2024-05-01 23:00:00'"), "t", "lat", "lon", 3600)
    assert 380 < hourly < 460 and daily.first().potential_radiation == 0
    flat = solar.tilted_irradiance(hours.withColumns({"a": F.lit(200.0), "b": F.lit(80.0)}), "a", "b", "t", "lat", "lon", 3600, 0.0, 0.0)
    noon = flat.where("hour(t) = 12").first().global_tilted_irradiance
    assert noon == pytest.approx(280, rel=1e-3)  # a flat panel sees the horizontal radiation


def test_derivation_graph(spark):
    wide = spark.sql("SELECT 3.0D AS wind_u_component_10m, 4.0D AS wind_v_component_10m, 20.0D AS temperature_2m, 15.0D AS dew_point_2m")
    got = derive.derive(wide, ["wind_speed_10m", "apparent_temperature", "relative_humidity_2m"]).first()
    assert got.wind_speed_10m == 5.0 and got.relative_humidity_2m == pytest.approx(72.94, abs=0.01)
    with pytest.raises(ValueError, match="no rule"):
        derive.derive(wide, ["snow_depth"])
    derive.register_rule("double_wind", ["wind_speed_10m"], lambda x: x * 2)
    assert derive.derive(wide, ["double_wind"]).first().double_wind == 10.0
