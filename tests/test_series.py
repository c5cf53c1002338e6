"""Gap filling, resampling, blending and aggregation on small literal series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobarn.functions import solar
from isobarn.operators import aggregate, bias, combine, fill, requests, resample

N = None


@pytest.fixture(scope="module")
def series(spark):
    def make(values, step=3600):
        start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
        rows = [(1, start + dt.timedelta(seconds=step * i), v if v is None else float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "location_id bigint, valid_time timestamp, value double")

    return make


def got(df):
    return [r.value for r in df.orderBy("valid_time").collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None and y is None) or x == pytest.approx(y, abs=1e-4), (a, b)


@pytest.mark.parametrize(
    "kernel, values, want",
    [
        (lambda d: fill.fill_backwards(d), [0, 1, N, N, N, 5], [0, 1, 5, 5, 5, 5]),
        (lambda d: fill.fill_backwards(d, True), [N, N, 1.5, N, N, 1.5], [0.5] * 6),
        (lambda d: fill.fill_backwards(d, True), [N, N, N, 1.5, N, N, 1.5], [N, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5]),
        (lambda d: fill.fill_linear(d), [0, 1, N, N, N, 5], [0, 1, 2, 3, 4, 5]),
        (lambda d: fill.fill_degrees(d), [355, N, 20, N, N, N], [355, 7.5, 20, N, N, N]),
        (lambda d: fill.fill_hermite(d), [0, 1, 2, N, 4, 5], [0, 1, 2, 3, 4, 5]),
        (lambda d: resample.deaverage(d), [1, 2, 3], [1, 3, 5]),
        (lambda d: resample.deaverage(d), [1, 2, N, 3.25], [1, 3, N, 4.5]),
        (lambda d: resample.deaccumulate(d), [N, 1, 2, 3, 3.1, 3.3, 3.9], [N, 1, 1, 1, 0.1, 0.2, 0.6]),
        (lambda d: resample.deaccumulate(d), [5, N, 9], [5, N, 2]),
        (lambda d: aggregate.block_aggregate(d, 2, "mean"), [1, 2, 3, 4, 5, 6], [1.5, 3.5, 5.5]),
        (lambda d: aggregate.block_aggregate(d, 3, "mean"), [1, 2, 3, 4, 5, 6], [2, 5]),
        (lambda d: aggregate.block_aggregate(d, 3, "min"), [1, 2, 3, 4, N, N], [1, N]),
        (lambda d: aggregate.block_aggregate(d, 2, "max"), [1, 2, 3, 4, N, N], [2, 4, N]),
        (lambda d: resample.upsample_linear(d, 3600, 1800), [0, 2, 4], [0, 1, 2, 3, 4, 4]),
        (lambda d: resample.upsample_degrees(d, 3600, 1800), [350, 10], [350, 0, 10, 10]),
        (lambda d: resample.upsample_backwards(d, 3600, 1800, True), [2, 4], [1, 1, 2, 2]),
        (lambda d: resample.downsample(d, 3600, 7200, "sum"), [1, 2, 3, 4, 5], [N, 5, 9]),
        (lambda d: resample.sliding_mean(d, 2), [1, 3, 5, 7], [2, 4]),
        (lambda d: resample.trailing_mean(d, 1), [1, 3, 5], [1, 2, 4]),
    ],
)
def test_golden(series, kernel, values, want):
    close(got(kernel(series(values))), want)


def test_blending(series):
    high, low = series([0, 0, 0, 0, N, N, N, N, N]), series([N, N, 0, 0, 2, 2, 2, 2, 2])
    close(got(combine.fill_from_lower_priority(high, low, False)), [0, 0, 0, 0, 2, 2, 2, 2, 2])
    high, low = series([0, 0, 0, 0, 0, N, N, N, N]), series([3] * 9)
    close(got(combine.fill_from_lower_priority(high, low)), [0, 0, 0.75, 1.5, 2.25, 3, 3, 3, 3])
    close(got(combine.fill_from_lower_priority(low, low)), [3] * 9)


def test_filling_keeps_valid_values(series):
    values = [3, N, N, 7, 8, N, 2, N]
    for kernel in (fill.fill_linear, fill.fill_degrees, fill.fill_hermite, fill.fill_backwards):
        assert all(a == pytest.approx(b) for a, b in zip(got(kernel(series(values))), values) if b is not None)


@pytest.mark.parametrize(
    "values, bounds, want",
    [
        ([0, 1, N, 3, N, 5, N, 0], None, [0, 1, 1.875, 3, 4.4375, 5, 2.625, 0]),
        ([0, 1, N, N, 3, N, N, 5, N, N, 0], None, [0, 1, 1.5185186, 2.2592592, 3, 3.925926, 4.851852, 5, 3.6666665, 1.5555556, 0]),
        ([0, 1, N, N, 3, N, N, 5, N, N, 0], (1, 3), [0, 1, 1.5185186, 2.2592592, 3, 3, 3, 5, 3, 1.5555556, 0]),
        ([N, 1, N, N, 3, N, N, 5, N, N, 0], None, [N, 1, 1.5185186, 2.2592592, 3, 3.925926, 4.851852, 5, 3.6666665, 1.5555556, 0]),
        ([N, 1, N, 3, N, 5, N, 0, N, N, 10, N, N, 5], None, [N, 1, 1.875, 3, 4.4375, 5, 0.7013891, 0, 2.8194444, 7.2430553, 10, 9.259259, 6.8518515, 5]),
        ([N, N], None, [N, N]),
        ([N, 2, N, N], None, [N, 2, N, N]),
    ],
)
def test_cubic_filling(series, values, bounds, want):
    close(got(fill.fill_hermite(series(values), bounds)), want)


@pytest.mark.parametrize(
    "hour, preserving, values, want",
    [
        (12, True, [N, N, N, 320.9375, N, N, 246.95312, N, N, 2.578125, N, N, 0, N, N, 0], [N, 316.5745, 327.14203, 319.096, 355.45486, 253.89552, 131.50894, 33.647484, 6.0189605, 0.35008436, 0, 0, 0, 0, 0, 0]),
        (12, False, [N, N, N, 304.3659, N, N, 101.99449, N, N, 0, N, N, 0, N, N, 0], [N, 293.12817, 279.38104, 304.3659, 142.60036, 101.0161, 101.99449, 69.3253, 34.452053, 0, 0, 0, 0, 0, 0, 0]),
        (14, False, [321.95593, N, 247.148], [321.95593, 268.21445, 247.148]),
        (14, False, [321.95593, N], [321.95593, N]),
    ],
)
def test_solar_filling(spark, hour, preserving, values, want):
    start = dt.datetime(2022, 8, 16, hour, tzinfo=dt.UTC)
    rows = [(1, start + dt.timedelta(hours=i), v if v is None else float(v), 51.5, -23.0) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "location_id bigint, valid_time timestamp, value double, lat double, lon double")
    found = got(fill.fill_solar(solar.clear_sky_radiation(table, "valid_time", "lat", "lon", 3600), "clear_sky_radiation", 3600, preserving))
    for x, y in zip(found, want):
        assert (x is None and y is None) or x == pytest.approx(y, rel=3e-3, abs=3e-3)


def test_solar_filling_keeps_the_mean(series):
    light = [0, 0, 100, 300, 500, 600, 500, 300, 100, 0, 0, 0.0]
    values = [0, N, N, 100, N, N, 400, N, N, 150, 0, 0]
    table = series(values).withColumn("light", F.element_at(F.array(*[F.lit(float(x)) for x in light]), F.hour("valid_time") + 1))
    out = got(fill.fill_solar(table, "light"))
    assert None not in out and sum(out[4:7]) == pytest.approx(1200) and sum(out[7:10]) == pytest.approx(450) and out[9] == 0


def test_scan_backfill(series):
    heights = [(0.5, 0.55), (0.3, 0.35), (0.1, 0.05), (0.0, 0.0), (0.2, 0.2)]
    column = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in heights]), F.hour("valid_time") + 1)
    table = series([550, 350, 0, 0, N]).withColumns({"scan": F.lit(0.0), "mean": column(0), "now": column(1)})
    close(got(fill.backfill_scan_time(table, "scan", "mean", "now", 0.004)), [500, 300, 100, 0, N])


def test_sections(spark):
    rows = [(1, 0, 1, "accum", 1.0), (1, 0, 2, "accum", 3.0), (1, 0, 4, "accum", 7.0), (1, 4, 5, "accum", 2.0), (1, 4, 4, "accum", 9.0), (2, 0, 3, "avg", 2.0), (2, 0, 6, "avg", 3.0)]
    steps = spark.createDataFrame(rows, "run int, step_start int, step_end int, step_type string, value double")
    out = {(r.run, r.step_start, r.step_end): r.value for r in resample.deaccumulate_sections(steps, ["run"]).collect()}
    assert out == {(1, 0, 1): 1.0, (1, 1, 2): 2.0, (1, 2, 4): 4.0, (1, 4, 5): 2.0, (2, 0, 3): 2.0, (2, 3, 6): 4.0}


def test_strict_days(series):
    df = series([1.0] * 24 + [2.0] * 23)
    rows = {str(r.day): r["sum"] for r in aggregate.daily(df, ["sum"]).collect()}
    assert rows == {"2024-01-01": 24.0, "2024-01-02": None}


def test_ensemble_quantile_rule(spark):
    df = spark.range(51).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("value"))
    r = aggregate.ensemble_quantiles(df, ["k"]).first()
    assert (r["min"], r["max"], r["mean"]) == (0, 50, 25) and r.median == pytest.approx(25.5) and r.p25 == pytest.approx(12.75)


def test_seasonal_parts(spark):
    place = bias.season(F.timestamp_seconds(F.lit(int(31557600 / 6 * 0.75))), 6)
    r = spark.range(1).select(place[0].alias("s"), place[1].alias("f")).first()
    assert r.s == 0 and r.f == pytest.approx(0.75)


def test_daily_normals_of_a_constant(spark):
    days = spark.sql("SELECT 1 AS k, explode(sequence(date'2020-01-01', date'2029-12-31', interval 1 day)) AS date, 10.0D AS value")
    out = bias.daily_normals(days, [2022, 2027], 5, ["k"])
    assert out.count() == 730 and out.where("abs(normal - 10) > 1e-9").count() == 0
    wet = bias.daily_normals_keep_dry_days(days, [2022], 5, ["k"])
    assert wet.count() == 365 and wet.agg(F.avg("normal")).first()[0] == pytest.approx(10, rel=1e-6)


def test_quantile_mapping_of_equal_series_is_identity(spark):
    days = spark.sql("SELECT 1L AS location_id, explode(sequence(timestamp'1990-01-01', timestamp'2009-12-31', interval 5 day)) AS valid_time")
    series = days.withColumn("value", 10 + 5 * F.sin(F.unix_seconds("valid_time") / 5e6) + F.pmod(F.unix_seconds("valid_time") / 432000, F.lit(7)) / 10)
    for detrend in (False, True):
        out = bias.quantile_delta_mapping(series, series, "add", detrend)
        joined = out.alias("a").join(series.alias("b"), ["location_id", "valid_time"])
        assert joined.count() == series.count()
        assert joined.where("a.value IS NULL OR abs(a.value - b.value) > 0.2").count() == 0


def test_units(spark):
    df = spark.createDataFrame([("°C", 10.0), ("m/s", 10.0), ("mm", 25.4), ("m", 1.0)], "unit string, value double")
    out = {r.unit: r.value for r in requests.convert_units(df, "fahrenheit", "kn", length="imperial").collect()}
    assert out["°F"] == 50 and out["kn"] == pytest.approx(19.4384) and out["inch"] == pytest.approx(1) and out["ft"] == pytest.approx(3.28084, rel=1e-5)


def test_steps_ahead(spark):
    a, b = requests.steps_ahead(F.lit("2024-02-03 12:24:00").cast("timestamp"), 4, 3600)
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (r.a.hour, r.b.hour) == (13, 17)


def test_requests_errors(spark):
    places = spark.createDataFrame([(1, 95.0, 0.0, 1), (2, None, 0.0, 2), (3, 1.0, 1.0, 3)], "id int, lat double, lon double, position int")
    assert requests.validate_places(places).where("reason IS NULL").count() == 1
    with pytest.raises(ValueError, match="3 places with 2"):
        requests.expand_requests(places, spark.range(2).withColumnRenamed("id", "position"))
    with pytest.raises(ValueError, match="over 2"):
        requests.limit_places(places, 2)


def test_month_and_week_axis(spark):
    p = spark.sql("SELECT 1 AS id, timestamp'2024-01-10 00:00:00' AS start, timestamp'2024-04-01 00:00:00' AS stop")
    assert [r.valid_time.month for r in requests.time_spine(p, "month").collect()] == [2, 3]
    assert all(r.valid_time.weekday() == 0 for r in requests.time_spine(p, "week").collect())


def test_solar_upsampling_follows_the_sun(spark):
    axis = "SELECT 1L AS location_id, explode(sequence(timestamp'2024-05-01 01:00:00', timestamp'2024-05-02 00:00:00', interval {} minute)) AS valid_time, 47.0D AS lat, 8.0D AS lon"
    share = lambda dt: solar.potential_radiation(spark.sql(axis.format(dt // 60)), "valid_time", "lat", "lon", dt).withColumn("sun", F.col("potential_radiation") / solar.SOLAR_CONSTANT)
    low = share(3600).select("location_id", "valid_time", "sun", (F.col("potential_radiation") * 0.6).alias("value"))
    high = share(900).select("location_id", "valid_time", "sun")
    out = resample.upsample_solar(low, "sun", high, "sun", 3600, 900)
    joined = out.join(high.withColumnRenamed("sun", "want"), ["location_id", "valid_time"])
    assert joined.count() == out.count() > 85
    assert joined.where(f"value IS NULL OR abs(value - 0.6 * want * {solar.SOLAR_CONSTANT}) > 1").count() == 0
    assert out.where("value < 0").count() == 0


def test_solar_upsampling_broadcasts_nothing(spark):
    """The table of the new steps is larger than a plan takes it for: it comes of an explode."""
    low = spark.sql("SELECT explode(sequence(1L, 3L)) AS location_id").selectExpr("location_id", "explode(sequence(timestamp'2024-05-01 01:00:00', timestamp'2024-05-03 00:00:00', interval 1 hour)) AS valid_time")
    low = low.withColumns({"value": F.when(F.hour("valid_time") % 5 > 0, F.hour("valid_time") * 20.0), "sun": F.hour("valid_time") / 24, "name": F.concat(F.lit("p"), "location_id")})
    high = low.select("location_id", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("j"), "valid_time").selectExpr("location_id", "timestamp_seconds(unix_seconds(valid_time) + j * 1200) AS valid_time", "0.5D AS sun")
    out = resample.upsample_solar(low, "sun", high.where("location_id < 3"), "sun", 3600, 1200, by=["location_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    rows = out.collect()
    assert len(rows) == 2 * 48 * 3 and {(r.location_id, r.name) for r in rows} == {(1, "p1"), (2, "p2")}
    # missing old steps stay missing, five of them in a day
    assert sum(r.value is None for r in rows) == 2 * 2 * 3 * 5


def _drops(spark, places=3):
    """Every fourth day of ten years with gaps; the last place has no value."""
    days = spark.range(places).selectExpr("id AS location_id", "explode(sequence(timestamp'1991-03-01', timestamp'2001-02-01', interval 4 day)) AS valid_time")
    h = F.pmod(F.xxhash64("location_id", "valid_time"), F.lit(1000)) / 10
    return days.withColumn("value", F.when((F.col("location_id") < places - 1) & (h > 5), h + F.col("location_id")))


def test_quantile_mapping_deals_its_rows_once(spark):
    """Distributions are made where the series are: tables of bins were twenty times as much as the rows."""
    reference, control = _drops(spark, 3), _drops(spark, 4).withColumns({"value": F.col("value") * 1.2 + 3, "model": F.concat(F.lit("m"), "location_id")})
    for detrend in (False, True):
        out = bias.quantile_delta_mapping(reference, control, "add", detrend, ["location_id"], n=20, years=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
        rows = out.collect()
        # series without a value in the reference have no distribution, missing values stay missing
        given = {(r.location_id, r.valid_time): r.value for r in control.where("location_id < 2").collect()}
        assert {(r.location_id, r.valid_time): r.value is None for r in rows} == {k: v is None for k, v in given.items()} and len(rows) == len(given)
        assert {(r.location_id, r.model) for r in rows} == {(0, "m0"), (1, "m1")} and out.columns == control.columns


@pytest.mark.parametrize("seasons, years, least", [(4, 2, None), (3, None, None), (4, 3, 0.0)])
def test_distributions_of_a_series_are_those_of_the_tables(spark, seasons, years, least):
    series = _drops(spark, 2)
    ranges = bias.value_range_bins(series, 20, least, ["location_id"])
    table = bias.sliding_cdf(series, ranges, seasons, years, 20, ["location_id"]) if years else bias.seasonal_cdf(series, ranges, seasons, 20, ["location_id"])
    want = {(r["block"] if years else 0, r.season, r.bin): r.cdf for r in table.where("location_id = 0").collect()}
    rows = series.where("location_id = 0").select(F.unix_seconds("valid_time").alias("s"), "value").orderBy("s").collect()
    curves = bias._curves_of(np.array([N if r.value is None else r.value for r in rows], float), np.array([r.s for r in rows]), 20, least, seasons, years)
    found = {k: v for k, v in np.ndenumerate(curves.shares) if not np.isnan(v)}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)
