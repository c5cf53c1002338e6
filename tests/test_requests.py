"""Requests: what is read, places without a height, sun outputs against the functions of the sun, sections and spellings."""

import calendar

import pytest
from pyspark.sql import functions as F

from isobarn.functions import solar
from isobarn.operators import derive, facade, grids
from isobarn.plans import datasets
from isobarn.plans import tables as T
from isobarn.sources import catalog, storage

GRID = grids.Grid("m", 4, 2, -135.0, -45.0, 90.0, 90.0)
START = 1704067200


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """200 days of hourly values at 8 cells, in chunks of 14 days."""
    path = str(tmp_path_factory.mktemp("store") / "t")
    rows = spark.range(8 * 24 * 200).select(
        F.lit("m").alias("domain"), F.explode(F.array(F.lit("temperature_2m"), F.lit("shortwave_radiation"))).alias("variable"), (F.col("id") % 8).alias("location_id"),
        F.timestamp_seconds(F.lit(START) + F.floor(F.col("id") / 8) * 3600).alias("valid_time"), (F.col("id") % 30).cast("double").alias("value"),
    )
    storage.write_series(rows, path)
    return path


def _places(spark, *more):
    rows = [(1, 10.0, 20.0, 5.0, 0, "2024-02-01", "2024-02-03"), (2, -30.0, 100.0, 5.0, 3600, "2024-05-01", "2024-05-02"), *more]
    columns = "place_id long, lat double, lon double, elevation double, utc_offset_seconds int, a string, b string"
    return spark.createDataFrame(rows, columns).selectExpr("place_id", "lat", "lon", "elevation", "utc_offset_seconds", "timestamp(a) AS start", "timestamp(b) AS stop")


def _scans(df):
    """Files read and partition filters of each scan of a stored table, after the query has run."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            open_.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            found.append((node.metrics().get("numFiles").get().value(), node.partitionFilters().mkString(" ")))
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def test_requests_read_only_the_chunks_of_their_ranges(spark, stored):
    series = storage.read_series(spark, stored, domain="m", keep_chunks=True).drop("domain", "lead_day", "member")
    found = facade.forecast(_places(spark), {"m": series}, {"m": GRID}, facade.Request(["temperature_2m"]), available=["temperature_2m"])["hourly"]
    assert found.count() == 72
    found.collect()
    scans = [x for x in _scans(found) if "time_chunk" in x[1]]
    assert scans and all("dynamicpruning" in filters and files == 2 for files, filters in scans)
    every = len(spark.read.parquet(stored).where("variable = 'temperature_2m'").inputFiles())
    assert every >= 14  # of both variables there are twice as many


def test_places_without_a_height_stay(spark, stored):
    series = storage.read_series(spark, stored, domain="m").drop("domain", "lead_day", "member")
    cell = {r.place_id: r.cell_id for r in grids.locate(_places(spark), GRID).collect()}
    for cells in ("nearest", "land", "sea"):
        for heights in ([(cell[1], 105.0), (cell[2], None)], [(cell[1], 105.0)]):
            table = spark.createDataFrame(heights, "cell_id long, elevation double").join(GRID.cells(spark), "cell_id")
            found = facade.forecast(_places(spark), {"m": series}, {"m": GRID}, facade.Request(["temperature_2m"], cells=cells), heights={"m": table}, available=["temperature_2m"])["hourly"]
            rows = {(r.place_id, r.valid_time.isoformat()): r.temperature_2m for r in found.collect()}
            assert {k for k, _ in rows} == {1, 2}
            plain = facade.forecast(_places(spark), {"m": series}, {"m": GRID}, facade.Request(["temperature_2m"]), available=["temperature_2m"])["hourly"]
            for r in plain.collect():
                lapse = 0.65 if r.place_id == 1 else 0.0
                assert abs(rows[r.place_id, r.valid_time.isoformat()] - r.temperature_2m - lapse) < 1e-9


NAMES = [
    "is_day", "sunshine_duration", "direct_radiation", "diffuse_radiation", "direct_normal_irradiance", "global_tilted_irradiance", "terrestrial_radiation", "terrestrial_radiation_instant", "shortwave_radiation_instant",
    "direct_radiation_instant", "diffuse_radiation_instant", "direct_normal_irradiance_instant", "global_tilted_irradiance_instant", "shortwave_radiation_clear_sky", "shortwave_radiation_clear_sky_instant",
]


def test_sun_outputs_are_those_of_the_functions(spark, stored):
    series = storage.read_series(spark, stored, domain="m").drop("domain", "lead_day", "member")
    request = facade.Request(NAMES, daily=["sunshine_duration_sum", "shortwave_radiation_sum"], tilt=30.0, azimuth=-20.0)
    found = facade.forecast(_places(spark), {"m": series}, {"m": GRID}, request, available=["shortwave_radiation"])
    hourly = {(r.place_id, r.valid_time): r.asDict() for r in found["hourly"].collect()}
    assert len(hourly) == 72 and all(v is not None for r in hourly.values() for v in r.values())
    cells = grids.locate(_places(spark), GRID).select("place_id", F.col("cell_id").alias("location_id"))
    lat, lon = GRID.coordinates(F.col("location_id"))
    t = series.where("variable = 'shortwave_radiation'").join(cells, "location_id").select("place_id", "valid_time", F.col("value").alias("s"), lat.alias("lat"), lon.alias("lon"))
    t = solar.is_day(t, "valid_time", "lat", "lon")
    t = solar.diffuse_radiation(t, "s", "valid_time", "lat", "lon", 3600).withColumn("d", F.greatest(F.col("s") - F.col("diffuse_radiation"), F.lit(0.0)))
    t = solar.instant_factor(solar.sunshine_duration(t, "d", "valid_time", "lat", "lon", 3600), "valid_time", "lat", "lon", 3600)
    t = solar.tilted_irradiance(solar.direct_normal(t, "d", "valid_time", "lat", "lon", 3600), "d", "diffuse_radiation", "valid_time", "lat", "lon", 3600, 30.0, -20.0)
    t = solar.clear_sky_radiation(solar.potential_radiation(t, "valid_time", "lat", "lon", 3600), "valid_time", "lat", "lon", 3600)
    for r in t.collect():
        got = hourly.get((r.place_id, r.valid_time))
        if got is None:
            continue
        f = r.instant_factor
        want = {
            "is_day": r.is_day, "sunshine_duration": r.sunshine_duration, "direct_radiation": r.d, "diffuse_radiation": r.diffuse_radiation, "direct_normal_irradiance": r.direct_normal_irradiance, "global_tilted_irradiance": r.global_tilted_irradiance,
            "terrestrial_radiation": r.potential_radiation, "terrestrial_radiation_instant": r.potential_radiation_instant, "shortwave_radiation_instant": r.s * f, "direct_radiation_instant": r.d * f, "diffuse_radiation_instant": r.diffuse_radiation * f,
            "direct_normal_irradiance_instant": r.direct_normal_irradiance * f, "global_tilted_irradiance_instant": r.global_tilted_irradiance * f, "shortwave_radiation_clear_sky": r.clear_sky_radiation, "shortwave_radiation_clear_sky_instant": r.clear_sky_radiation * f,
        }
        assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == {k: got[k] for k in want}
    days = [r for r in found["daily"].collect() if r.sunshine_duration_sum is not None]
    assert len(days) == 2 and all(r.sunshine_duration_sum == pytest.approx(sum(v["sunshine_duration"] for (p, d), v in hourly.items() if p == r.place_id and d.date() == r.day)) for r in days)


def test_sections_and_spellings(spark, stored):
    series = storage.read_series(spark, stored, domain="m").drop("domain", "lead_day", "member")
    request = facade.Request(["temperature_2m"], minutely_15=["temperature_2m", "shortwave_radiation"], current=["temperature_2m"], now="2024-02-01T10:30:00")
    found = facade.forecast(_places(spark), {"m": series}, {"m": GRID}, request, available=["temperature_2m", "shortwave_radiation"])
    assert set(found) == {"hourly", "minutely_15", "current"}
    hours = {(r.place_id, r.valid_time.isoformat()): r.temperature_2m for r in found["hourly"].collect()}
    now = {r.place_id: (r.valid_time.isoformat(), r.temperature_2m) for r in found["current"].collect()}
    assert now == {1: ("2024-02-01T10:00:00", hours[1, "2024-02-01T10:00:00"]), 2: ("2024-02-01T10:00:00", now[2][1])}
    fine = {(r.place_id, r.valid_time.isoformat()): r.temperature_2m for r in found["minutely_15"].collect()}
    assert len(fine) == 4 * 72 and all(abs(fine[k] - v) < 1e-9 for k, v in hours.items())
    wind = spark.createDataFrame([(0, "wind_speed_10m", 3.0), (0, "cloud_cover", 40.0)], "location_id long, variable string, value double").withColumn("valid_time", F.lit("2024-02-01T01:00:00").cast("timestamp"))
    places = _places(spark).where("place_id = 1").withColumns({"lat": F.lit(-45.0), "lon": F.lit(-135.0)})
    old = facade.forecast(places, {"w": wind}, {"w": GRID}, facade.Request(["windspeed_10m", "cloudcover"]), available=["wind_speed_10m", "cloud_cover"])["hourly"]
    assert [(r.windspeed_10m, r.cloudcover) for r in old.collect()] == [(3.0, 40.0)]


def test_dataset_rules_come_first_and_unknown_names_are_errors(spark):
    assert derive.inputs_of(["relative_humidity_500hPa"], "pressure_levels") > derive.inputs_of(["relative_humidity_500hPa"])
    with pytest.raises(ValueError, match="unknown variable"):
        catalog.variable("no_such_thing")
    assert "temperature_2m" in catalog.variables_of("dwd_icon") and not catalog.variables_of("mine")
    # every name that a source field stands for, and every raw input of a rule, is in the table of variables
    assert all(catalog.known(r[2]) for r in catalog.mapping_rows())


def _vectors(spark, path, ids):
    """Suppliers, and members of vectors with these numbers: a folder of tables as the queries read them."""
    spark.range(60).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey", "id * 10.0D AS s_acctbal").write.parquet(f"{path}/supplier.parquet")
    rows = [(i, [float(i % 97 + m) for m in range(5)], i % 10) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_members_of_all_times_are_read(spark, tmp_path):
    """Vectors are hours from 2024 on; over 87,672 of them lie beyond 2033."""
    ids = [*range(40), *range(87_660, 87_690), *range(700_000, 700_010)]
    found = datasets.forecast_members(spark, _vectors(spark, tmp_path, ids)).collect()
    cells = {r.place_id: r.cell_id for r in grids.locate(T.places(spark, str(tmp_path)), datasets.GRID).collect()}
    want = {(p, START + i * 3600): tuple(float(i % 97 + m) for m in range(4)) for p, c in cells.items() for i in ids if i % 10 == c}
    got = {(r.place_id, calendar.timegm(r.valid_time.timetuple())): (r.temperature_2m, r.temperature_2m_member01, r.temperature_2m_member02, r.temperature_2m_member03) for r in found}
    assert got == want and len(found) == len(want) and max(t for _, t in want) > START + 700_000 * 3600


@pytest.mark.parametrize("members", [False, True])
def test_rows_of_places_are_not_shuffled(spark, stored, monkeypatch, members):
    """Few cells and many places: the cells' rows go to the places, whose rows stay where they are made, in order; where there is too much
    to send, the rows are the same."""
    series = storage.read_series(spark, stored, domain="m").drop("domain", "lead_day", "member")
    if members:
        series = series.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("value", F.col("value") + F.col("member"))
    days = "date_add(date'2024-02-01', CAST(id % 40 AS INT))"
    places = spark.range(300).selectExpr("(id * 7) % 300 AS place_id", "id % 160 - 80.0D AS lat", "id * 11 % 360 - 180.0D AS lon", "IF(id % 9 = 0, NULL, id * 3.0D) AS elevation", "0 AS utc_offset_seconds", f"timestamp({days}) AS start", f"timestamp(date_add({days}, 2)) AS stop")
    heights = GRID.cells(spark).withColumn("elevation", F.col("cell_id") * 100.0).where("cell_id <> 3")
    request = facade.Request(["temperature_2m", "shortwave_radiation", "is_day"], members=2)
    run = lambda: facade.forecast(places, {"m": series}, {"m": GRID}, request, heights={"m": heights}, available=["temperature_2m", "shortwave_radiation"])["hourly"]
    monkeypatch.setattr(facade, "PLACE_ROWS", 2_000)
    found = run()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "rangepartitioning(place_id" in plan and "valid_time" not in plan.split("rangepartitioning")[1].split("\n")[0]
    assert found.rdd.getNumPartitions() > 4
    rows = found.collect()
    assert len(rows) == 300 * 48 * (2 if members else 1)
    keys = [(r.place_id, r.member, r.valid_time) if members else (r.place_id, r.valid_time) for r in rows]
    assert keys == sorted(keys)
    monkeypatch.setattr(facade, "MOST_SENT", 0)
    assert rows == run().collect()
