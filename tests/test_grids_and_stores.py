"""Grids, routing, storage and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isobarn.operators import combine, grids
from isobarn.sources import storage
from isobarn.sources.versioned import Store
from isobarn.streaming import streams


def test_global_grid(spark):
    grid = grids.Grid("g", 768, 384, -180.0, -90.0, 360 / 768, 180 / 384)
    p = spark.createDataFrame([(89.90001, 179.80002)], "lat double, lon double")
    cell = grids.locate(p, grid).first().cell_id
    assert cell == 294911
    lat, lon = grid.coordinates(F.lit(cell))
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert (r.lat, r.lon) == pytest.approx((89.53125, 179.53125))


@pytest.mark.parametrize(
    "projection",
    [
        grids.Projection("lambert", {"lon0": 10.0, "lat0": 50.0, "lat1": 45.0, "lat2": 55.0}),
        grids.Projection("lambert", {"lon0": -97.5, "lat0": 38.5, "lat1": 38.5, "lat2": 38.5}),
        grids.Projection("lambert_area", {"lon": -2.5, "lat": 54.9}),
        grids.Projection("stereographic", {"lat": 90.0, "lon": 249.0}),
        grids.Projection("rotated", {"lat": -36.0885, "lon": 245.305}),
    ],
)
def test_projections_invert(spark, projection):
    lat0, lon0 = (60.0, -100.0) if projection.params.get("lon", projection.params.get("lon0")) in (249.0, 245.305, -97.5) else (52.0, 5.0)
    x, y = projection.forward(F.lit(lat0), F.lit(lon0))
    lat, lon = projection.inverse(x, y)
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert (r.lat, r.lon) == pytest.approx((lat0, lon0), abs=1e-6)


def test_gaussian_rows(spark):
    rows = grids.octahedral_rows(spark, 320)
    assert rows.agg(F.sum("nx")).first()[0] == 421120
    last = rows.orderBy(F.desc("y")).first()
    assert last.first + last.nx == 421120
    p = spark.createDataFrame([(1, 52.0, 13.4), (2, -89.9, 359.9), (3, 0.0, 0.0)], "id int, lat double, lon double")
    found = grids.locate_gaussian(p, rows, 320, "id")
    assert found.count() == 3 and found.where("cell_id >= 0 AND cell_id < 421120").count() == 3
    same = grids.rows_from_counts(spark, [20 + 4 * y for y in range(320)])
    assert same.exceptAll(rows).count() == 0


def test_terrain_and_sea(spark):
    grid = grids.Grid("g", 10, 10, 0.0, 0.0, 0.1, 0.1)
    cells = grid.cells(spark).withColumn("elevation", F.when(F.col("x") == 0, -999.0).when(F.col("x") == 2, 1000.0).otherwise(F.lit(50.0)))
    p = spark.createDataFrame([(1, 0.5, 0.1, 1010.0), (2, 0.5, 0.1, 60.0), (3, 0.5, 0.5, 800.0)], "id int, lat double, lon double, elevation double")
    best = {r.id: r.cell_elevation for r in grids.best_terrain_cell(p, cells, grid, "id").collect()}
    assert best == {1: 1000.0, 2: 50.0, 3: 50.0}
    sea = {r.id: r.sea for r in grids.nearest_sea_cell(p, cells, grid, "id").collect()}
    assert sea == {1: True, 2: True, 3: False}
    assert grids.drop_open_sea(cells).count() == 100
    with pytest.raises(ValueError, match="not a box"):
        grids.filter_bounding_box(cells, grid, 5, 0, 1, 2)
    assert grids.filter_bounding_box(cells, grid, 0.0, 0.0, 0.3, 0.2).count() == 6
    assert grids.box_is_covered(spark, grid, 0.0, 0.0, 0.9, 0.9).first().covered


def test_regions(spark):
    regions = spark.createDataFrame([(40.0, 60.0, 0.0, 20.0, 1, ["a", "b"]), (-90.0, 90.0, -180.0, 180.0, 9, ["w"])], "south double, north double, west double, east double, rank int, domains array<string>")
    p = spark.createDataFrame([(1, 50.0, 10.0), (2, 0.0, 0.0)], "id int, lat double, lon double")
    got = sorted((r.id, r.priority, r.domain) for r in combine.route_models(p, regions, "id").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "w")]
    inside = grids.in_region(F.col("lat"), F.col("lon"), (0, 0, 10, 10), [(0, 0), (0, 10), (10, 0)])
    q = spark.createDataFrame([(8.0, 8.0), (1.0, 1.0), (20.0, 1.0)], "lat double, lon double")
    assert [r.x for r in q.select(inside.alias("x")).collect()] == [True, False, False]


def _series(spark, values, run=None):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [("d", "v", 1, 0, 0, start + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, storage.SCHEMA)
    return df if run is None else df.withColumn("run_time", F.lit(run).cast("timestamp"))


def test_store_round_trip_and_upsert(spark, tmp_path):
    path = str(tmp_path / "s")
    storage.write_series(_series(spark, range(48)), path)
    own = storage.read_series(spark, path, "d", ["v"], "2024-01-01 10:00:00", "2024-01-01 20:00:00")
    assert sorted(r.value for r in own.collect()) == list(range(10, 20))
    assert "time_chunk" in own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    merged = storage.merge_series(_series(spark, [1, 2, 3]), _series(spark, [9, None]))
    assert [r.value for r in merged.orderBy("valid_time").collect()] == [9, 2, 3]
    again = storage.merge_series(merged, _series(spark, [9, None]))
    assert storage.verify_compaction(merged, again).count() == 0


def test_runs(spark):
    run = _series(spark, range(72), "2024-01-01 00:00:00")
    assert storage.by_lead_day(run).groupBy("lead_day").count().orderBy("lead_day").collect() == [(1, 48), (2, 24)]
    with pytest.raises(ValueError, match="no run"):
        storage.read_run(run, "2023-01-01 00:00:00")
    meta = storage.build_run_metadata(run).first()
    assert meta.n_times == 72 and meta.step_seconds == 3600
    kept = storage.full_run(run.withColumn("variable", F.when(F.col("value") < 1, "t_850hPa").when(F.col("value") < 2, "t_875hPa").when(F.col("value") < 3, "u_500m").otherwise("t_2m")))
    assert kept.count() == 70


def test_manifests(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    remote = spark.createDataFrame([("a", 1, t), ("b", 2, t), ("c.json", 5, t), ("d", 1, t)], "path string, size bigint, modified timestamp")
    local = spark.createDataFrame([("a", 1, t), ("b", 1, t), ("c.json", 4, t)], "path string, size bigint, modified timestamp")
    assert sorted(r.path for r in storage.select_changed_files(remote, local).collect()) == ["b", "d"]
    files = spark.createDataFrame([("static/x",), ("v/year_2023.om",), ("v/year_2024.om",), ("v/chunk_1408.om",), ("v/chunk_2.om",)], "path string")
    got = sorted(r.path for r in storage.select_files_in_range(files, 1704067200, 1704153600).collect())
    assert got == ["static/x", "v/chunk_1408.om", "v/year_2024.om"]  # chunk 1408 ends on 4 January


def test_sinks(spark, tmp_path):
    result = spark.createDataFrame([(1, "t0", 1.5), (1, "t1", float("nan")), (2, "t0", None)], "place_id int, time string, temperature double")
    docs = [r.value for r in storage.json_documents(result, ["place_id"], "hourly", {"temperature": "°C"}, "time").orderBy("value").collect()]
    assert docs[0] == '{"place_id":1,"hourly_units":{"temperature":"°C"},"hourly":{"time":["t0","t1"],"temperature":[1.5,null]}}'
    storage.write_csv(result, {"temperature": "°C"}, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part*")))
    assert "temperature (°C)" in text and "NaN" in text


def test_ingestion(spark):
    raw = spark.createDataFrame([("d", "TMP", 273.15), ("d", "OTHER", 1.0), ("d", "TMP", float("nan"))], "domain string, variable string, value double")
    mapping = spark.createDataFrame([("d", "TMP", "temperature_2m", 1.0, -273.15)], "domain string, source_variable string, variable string, multiply double, add double")
    got = storage.ingest_fields(raw, mapping).collect()
    assert sorted((r.variable, r.value) for r in got if r.value is not None) == [("temperature_2m", 0.0)] and len(got) == 2
    flipped = grids.normalise_orientation(spark.createDataFrame([(0, 0), (3, 1)], "x int, y int"), 4, 2, True, True, True)
    assert sorted((r.x, r.y) for r in flipped.collect()) == [(2, 0), (2, 1)]
    days = spark.sql("SELECT 1L AS location_id, date, 1.0D AS value FROM VALUES (date'2024-02-28'), (date'2023-02-28') AS t(date)")
    assert sorted(str(r.date) for r in storage.fill_missing_calendar_days(days).collect()) == ["2023-02-28", "2024-02-28", "2024-02-29"]


def test_stream_deaccumulate_and_upsert(spark, tmp_path):
    run = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    schema = "cell_id bigint, run_time timestamp, step_start int, step_end int, step_type string, value double"
    source = tmp_path / "in"
    for i, rows in enumerate([[(1, run, 0, 1, "accum", 1.0), (1, run, 0, 2, "accum", 3.0)], [(1, run, 0, 2, "accum", 99.0), (1, run, 0, 4, "accum", 7.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = streams.stream_deaccumulate(streams.stream_fields(spark, str(source), schema), ["cell_id"])
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.step_end, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1.0), (2, 2.0), (4, 4.0)]  # the late second step is dropped

    rows = _series(spark, [1, 2, 3])
    batch = streams.upsert_batch(str(tmp_path / "store"))
    for i in (0, 0, 1):  # a repeated batch does no harm
        batch(rows if i == 0 else _series(spark, [9, None]), i)
    stored = Store(spark, str(tmp_path / "store")).read().orderBy("valid_time")
    assert [r.value for r in stored.collect()] == [9, 2, 3]


def test_lead_days_and_other_columns_survive(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [("d", "v", 1, 0, lead, start, float(lead)) for lead in range(4)]
    batch = streams.upsert_batch(str(tmp_path / "leads"))
    batch(spark.createDataFrame(rows, storage.SCHEMA), 0)
    batch(spark.createDataFrame([("d", "v", 1, 0, 2, start, 9.0), ("d", "v", 1, 0, 3, start, None)], storage.SCHEMA), 1)
    assert sorted((r.lead_day, r.value) for r in Store(spark, str(tmp_path / "leads")).read().collect()) == [(0, 0.0), (1, 1.0), (2, 9.0), (3, 3.0)]
    more = spark.createDataFrame([(1, start, 1.0, "old")], "location_id bigint, valid_time timestamp, value double, note string")
    new = spark.createDataFrame([(1, start, None, "new")], "location_id bigint, valid_time timestamp, value double, note string")
    assert [tuple(r) for r in storage.merge_series(more, new).select("value", "note").collect()] == [(1.0, "new")]


def test_commits_touch_only_their_chunks(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda days, value: spark.createDataFrame([("d", v, i, dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=d), value) for v in ("a=b/c", "7") for i in range(3) for d in days], "domain string, variable string, location_id bigint, valid_time timestamp, value double")
    every = range(0, 400, 5)
    assert store.upsert(rows(every, 1.0), batch="one") == 1
    before = {(r.variable, r.time_chunk): r.v for r in store.current().collect()}
    opened = []
    plain = Store._open
    monkeypatch.setattr(Store, "_open", lambda self, chunks: opened.extend((r.variable, r.time_chunk) for r in chunks.collect()) or plain(self, chunks))
    assert store.upsert(rows([0, 395], 2.0).where("variable = '7' AND location_id < 2"), batch="two") == 2
    touched = set(opened)
    assert len(touched) == 2 and {v for v, _ in touched} == {"7"}  # two chunks of one variable, far apart
    after = {(r.variable, r.time_chunk): r.v for r in store.current().collect()}
    assert {k for k in after if after[k] != before[k]} == touched
    assert store.upsert(rows([0], 9.0), batch="two") == -1  # it was committed before
    want = {(v, i, d): 2.0 if v == "7" and i < 2 and d in (0, 395) else 1.0 for v in ("a=b/c", "7") for i in range(3) for d in every}
    got = lambda: {(r.variable, r.location_id, (r.valid_time - dt.datetime(2024, 1, 1)).days): r.value for r in store.read().collect()}
    assert got() == want
    # a batch that breaks off leaves nothing that is read, and what it has written goes
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("broken")))
        with pytest.raises(RuntimeError):
            store.upsert(rows([0], 9.0), batch="three")
    assert got() == want
    folders = lambda: {p for p in (tmp_path / "s" / "data").rglob("time_chunk=*") if p.is_dir()}
    assert len(folders()) == len(before) + 4
    store.vacuum()
    assert len(folders()) == len(before) and got() == want and store.has("two") and len(list((tmp_path / "s" / "log").glob("*.json"))) == 1
    # of two writers one begins anew
    taken = []
    plain_commit = Store._commit

    def late(self, number, lines):
        if not taken:
            taken.append(number)
            plain_commit(self, number, [{"number": number, "batch": "other"}])
        return plain_commit(self, number, lines)

    monkeypatch.setattr(Store, "_commit", late)
    assert store.upsert(rows([395], 3.0), batch="four") == taken[0] + 1
    assert got() == want | {(v, i, 395): 3.0 for v in ("a=b/c", "7") for i in range(3)}


def test_small_tables_are_checked(spark):
    from isobarn.operators.series import bounded

    assert bounded(spark.range(10), 10, "a table").count() == 10
    with pytest.raises(ValueError, match="over 9 rows"):
        bounded(spark.range(10), 9, "a table")


def test_runs_of_one_domain_stay(spark, tmp_path):
    rows = spark.range(2).select(F.lit("d").alias("domain"), F.timestamp_seconds(F.col("id") * 86400).alias("run_time"), F.lit(5).cast("bigint").alias("n_times"), F.timestamp_seconds(F.col("id")).alias("end"))
    publish = streams.publish_run_metadata(str(tmp_path / "p"), 5)
    for i in (0, 1, 1):
        publish(rows.where(f"day(run_time) = {i + 1}"), i)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stream_aggregates_equal_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    _series(spark, range(30)).write.parquet(path)
    stream = streams.stream_resample(streams.stream_fields(spark, path), 10800, ["location_id"])
    stream.writeStream.format("memory").queryName("resampled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.valid_time.hour + 24 * (r.valid_time.day - 1): r.value for r in spark.table("resampled").collect()}
    assert got[3] == 2.0 and got[0] == 0.0


def test_streamed_run_counts_are_exact(spark, tmp_path):
    rows = spark.range(60).select(F.lit("d").alias("domain"), F.timestamp_seconds(F.col("id") * 21600).alias("run_time"), F.explode(F.sequence(F.lit(1), 360 + F.col("id"))).alias("step"))
    rows = rows.select("domain", "run_time", F.timestamp_seconds(F.col("step") * 3600).alias("valid_time"))
    found = streams.stream_run_metadata(rows.union(rows))
    assert sorted(r.n_times for r in found.collect()) == list(range(360, 420))
    streams.publish_run_metadata(str(tmp_path / "runs"), 380)(found, 0)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 40
