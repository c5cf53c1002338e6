"""Grids, cells and routing (J, F, S) on the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isobarn.operators import combine as C
from isobarn.operators import grids
from isobarn.plans import tables as T
from isobarn.sources import storage as S

LAMBERT = grids.Projection("lambert", {"lon0": 10.0, "lat0": 50.0, "lat1": 45.0, "lat2": 55.0})
PROJECTED = grids.Grid("europe", 400, 300, -2000000.0, -1500000.0, 10000.0, 10000.0, LAMBERT)
ROTATED = grids.Projection("rotated", {"lat": -36.0885, "lon": 245.305})
LINES = 320


def located_places(spark, sf_dir):
    return grids.locate(T.places(spark, sf_dir), T.WORLD).select("place_id", "cell_id")


def projected_places(spark, sf_dir):
    p = T.places(spark, sf_dir).withColumns({"lat": 40 + F.pmod(F.col("lat"), F.lit(20.0)), "lon": F.pmod(F.col("lon"), F.lit(25.0)) - 2})
    found = grids.locate(p, PROJECTED)
    lat, lon = PROJECTED.coordinates(F.col("cell_id"))
    return T.tidy(found.select("place_id", "cell_id", lat.alias("cell_lat"), lon.alias("cell_lon"), PROJECTED.true_north(F.col("cell_id")).alias("north")), 4)


def rotated_coordinates(spark, sf_dir):
    p = T.places(spark, sf_dir)
    x, y = ROTATED.forward(F.col("lat"), F.col("lon"))
    p = p.withColumns({"rx": x, "ry": y})
    lat, lon = ROTATED.inverse(F.col("rx"), F.col("ry"))
    return T.tidy(p.select("place_id", "rx", "ry", lat.alias("back_lat"), lon.alias("back_lon")), 4)


def gaussian_places(spark, sf_dir):
    rows = grids.octahedral_rows(spark, LINES)
    p = T.places(spark, sf_dir).withColumn("lon", F.pmod(F.col("lon"), F.lit(360.0)))
    return grids.locate_gaussian(p, rows, LINES, "place_id").select("place_id", "cell_id")


def nearest_cells(spark, sf_dir):
    cells = T.cells(spark).withColumn("elevation", F.when(F.col("cell_id") % 7 > 0, F.col("elevation")))
    return T.tidy(grids.nearest_cell(T.places(spark, sf_dir), cells, T.WORLD).select("place_id", "cell_id", "cell_elevation"))


def terrain_cells(spark, sf_dir):
    fine = grids.Grid("fine", 720, 360, -179.75, -89.75, 0.5, 0.5)
    cells = fine.cells(spark).withColumn("elevation", F.when(F.col("cell_id") % 4 == 0, -999.0).otherwise((F.col("cell_id") * 31 % 3000).cast("double")))
    p = T.places(spark, sf_dir).withColumn("elevation", F.col("elevation") % 2500 + 0.37)
    return T.tidy(grids.best_terrain_cell(p, cells, fine, "place_id", 1))


def sea_cells(spark, sf_dir):
    return grids.nearest_sea_cell(T.places(spark, sf_dir), T.cells(spark), T.WORLD, "place_id")


def bilinear_elevation(spark, sf_dir):
    cells = T.cells(spark).withColumn("elevation", F.when(F.col("elevation") > -999, F.col("elevation")))
    return T.tidy(grids.bilinear_at(T.places(spark, sf_dir).drop("elevation"), cells, T.WORLD, "place_id", "elevation"))


def box_events(spark, sf_dir):
    """Mean event value by cell of a box: users live in cells."""
    box = grids.filter_bounding_box(T.cells(spark), T.WORLD, -40.0, -100.0, 55.0, 120.0)
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") * 17 % 2592).alias("cell_id"), "value")
    return T.tidy(e.join(box, "cell_id").groupBy("cell_id").agg(F.avg("value").alias("value")))


def coastal_events(spark, sf_dir):
    cells = T.cells(spark).withColumn("elevation", F.when(F.col("x") < 40, -999.0).otherwise(F.col("elevation")))
    near = grids.drop_open_sea(cells)
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") * 17 % 2592).alias("cell_id"), "value")
    return T.tidy(e.join(near, "cell_id").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")))


def static_table(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    # no height of the table reaches 9,000 m, from where on they are an error
    elevation = s.select(F.lit("d").alias("domain"), F.col("s_suppkey").alias("cell_id"), (F.abs("s_acctbal") * 0.8).alias("elevation"))
    mask = s.where("s_nationkey > 3").select(F.lit("d").alias("domain"), F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 10 / 10).alias("landmask"))
    return T.tidy(grids.build_static_table(elevation, mask))


def remapped_cells(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell_id")).agg(F.avg("value").alias("value"))
    mapping = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_cell"), (F.col("c_custkey") % 300).alias("source_cell"))
    return T.tidy(grids.remap_cells(e, mapping))


def routed_models(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    regions = n.select(
        (F.col("n_nationkey") * 6 - 80).cast("double").alias("south"), (F.col("n_nationkey") * 6 - 40).cast("double").alias("north"),
        (F.col("n_nationkey") * 14 - 180).cast("double").alias("west"), (F.col("n_nationkey") * 14 - 60).cast("double").alias("east"),
        F.col("n_nationkey").alias("rank"), F.array("n_name", F.concat(F.lit("global_"), F.col("n_regionkey").cast("string"))).alias("domains"),
    )
    return C.route_models(T.places(spark, sf_dir), regions, "place_id")


def routed_satellites(spark, sf_dir):
    return C.route_satellite(T.places(spark, sf_dir)).select("place_id", "satellite")


def resolved_elevation(spark, sf_dir):
    p = T.places(spark, sf_dir).select("place_id", F.when(F.col("place_id") % 3 > 0, F.col("elevation")).alias("elevation"))
    m = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("place_id"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("elevation")).groupBy("place_id", "rank").agg(F.max("elevation").alias("elevation"))
    return T.tidy(C.priority_resolve_elevation(p, m, "place_id"))


def region_flags(spark, sf_dir):
    inside = grids.in_region(F.col("lat"), F.col("lon"), (-60.0, -120.0, 70.0, 100.0), [(-60.0, -120.0), (70.0, -120.0), (-60.0, 40.0)])
    return T.places(spark, sf_dir).select("place_id", inside.alias("inside"))


def normalised_orientation(spark, sf_dir):
    raw = T.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 72).alias("x"), (F.col("l_partkey") % 36).alias("y")).agg(F.sum("l_quantity").alias("value"))
    return T.tidy(grids.normalise_orientation(raw, 72, 36, True, True, True))


def ingested_fields(spark, sf_dir):
    raw = T.table(spark, sf_dir, "events").select(F.lit("d").alias("domain"), F.col("event_type").alias("variable"), F.col("user_id").alias("location_id"), "ts", "value")
    mapping = spark.createDataFrame([("d", "view", "temperature_2m", 1.0, -273.15), ("d", "click", "precipitation", 3600.0, 0.0), ("d", "error", "cloud_cover", None, None)], "domain string, source_variable string, variable string, multiply double, add double")
    found = S.ingest_fields(raw, mapping)
    return T.tidy(found.groupBy("variable", "location_id").agg(F.sum("value").alias("total")))


def exported_points(spark, sf_dir):
    h = T.hourly(spark, sf_dir)
    cells = T.places(spark, sf_dir).withColumnRenamed("place_id", "cell_id")
    return T.tidy(S.wide_export(h, cells, {"view": "degC", "click": "mm"}))


def json_documents(spark, sf_dir):
    h = T.hourly(spark, sf_dir).where("variable = 'view'").select("location_id", F.date_format("valid_time", "yyyy-MM-dd'T'HH:mm").alias("time"), F.col("value").alias("view"))
    docs = S.json_documents(T.tidy(h), ["location_id"], "hourly", {"view": "°C"}, "time")
    return docs.select(F.get_json_object("value", "$.location_id").cast("bigint").alias("location_id"), F.size(F.from_json(F.get_json_object("value", "$.hourly.view"), "array<double>")).cast("bigint").alias("n"), F.get_json_object("value", "$.hourly.time[0]").alias("first"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_r = T.r
_RND = lambda x: f"(sign({x}) * floor(abs({x}) + 0.5))"
_N, _FF, _RHO0, _LAM0 = LAMBERT._cone()
_NEAR = """near AS (SELECT p.*, x + a AS nx, y + b AS ny, a = 0 AND b = 0 AS centre FROM loc p, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)
  WHERE x + a BETWEEN 0 AND {nx} - 1 AND y + b BETWEEN 0 AND {ny} - 1)"""
_LOC = f"loc AS (SELECT *, CAST({_RND('(lon + 177.5) / 5')} AS BIGINT) AS x, CAST({_RND('(lat + 87.5) / 5')} AS BIGINT) AS y FROM places)"
_XY = f"""loc AS (SELECT *, least(greatest(x0, 0), 71) AS x, least(greatest(y0, 0), 35) AS y FROM (SELECT *, CAST({_RND('(lon + 177.5) / 5')} AS BIGINT) AS x0, CAST({_RND('(lat + 87.5) / 5')} AS BIGINT) AS y0 FROM places) WHERE x0 BETWEEN -1 AND 73 AND y0 BETWEEN -1 AND 36)"""
_TILT, _TURN = math.radians(90 - 36.0885), math.radians(245.305)

ORACLE = {
    "located_places": f"WITH {T.PLACES}, {_XY} SELECT place_id, y * 72 + x AS cell_id FROM loc",
    "projected_places": f"""WITH {T.PLACES}, p AS (SELECT place_id, 40 + (lat - floor(lat / 20) * 20) AS lat, lon - floor(lon / 25) * 25 - 2 AS lon FROM places),
      f AS (SELECT place_id, {_FF!r} / power(tan(pi() / 4 + radians(lat) / 2), {_N!r}) AS rho, {_N!r} * (radians(lon) - {_LAM0!r}) AS th FROM p),
      c AS (SELECT place_id, CAST({_RND('(6371229.0 * rho * sin(th) + 2000000) / 10000')} AS BIGINT) AS x, CAST({_RND(f'(6371229.0 * ({_RHO0!r} - rho * cos(th)) + 1500000) / 10000')} AS BIGINT) AS y FROM f),
      i AS (SELECT *, (x * 10000.0 - 2000000) / 6371229.0 AS px, {_RHO0!r} - (y * 10000.0 - 1500000) / 6371229.0 AS py FROM c WHERE x BETWEEN 0 AND 399 AND y BETWEEN 0 AND 299),
      n AS (SELECT (6371229.0 * q * sin({_N!r} * -{_LAM0!r}) + 2000000) / 10000 AS qx, (6371229.0 * ({_RHO0!r} - q * cos({_N!r} * -{_LAM0!r})) + 1500000) / 10000 AS qy FROM (SELECT {_FF!r} / power(tan(pi() / 4 + radians(90.0) / 2), {_N!r}) AS q))
      SELECT place_id, y * 400 + x AS cell_id, {_r(f'degrees(2 * atan(power({_FF!r} / sqrt(px * px + py * py), {1 / _N!r})) - pi() / 2)', 4)} AS cell_lat, {_r(f'degrees({_LAM0!r} + atan2(px, py) / {_N!r})', 4)} AS cell_lon,
      {_r('degrees(atan2(qx - x, qy - y))', 4)} AS north FROM i, n""",
    "rotated_coordinates": f"""WITH {T.PLACES}, a AS (SELECT *, cos(radians(lon) - {_TURN!r}) * cos(radians(lat)) AS x, sin(radians(lon) - {_TURN!r}) * cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM places)
      SELECT place_id, {_r(f'-degrees(atan2(y, {math.cos(_TILT)!r} * x + {math.sin(_TILT)!r} * z))', 4)} AS rx, {_r(f'-degrees(asin({-math.sin(_TILT)!r} * x + {math.cos(_TILT)!r} * z))', 4)} AS ry,
      {_r('lat', 4)} AS back_lat, {_r('lon', 4)} AS back_lon FROM a""",
    "gaussian_places": f"""WITH {T.PLACES}, p AS (SELECT place_id, lat, lon - floor(lon / 360) * 360 AS lon, 180 / 640.5 AS dy FROM places),
      u AS (SELECT *, greatest(0, least(638, CAST(trunc(319 - (lat - dy / 2) / dy) AS BIGINT))) AS y0 FROM p), c AS (SELECT *, y0 + k AS y FROM u, (SELECT unnest([0, 1]) AS k)),
      n AS (SELECT *, CASE WHEN y < 320 THEN 20 + 4 * y ELSE (639 - y) * 4 + 20 END AS nx, CASE WHEN y < 320 THEN 2 * y * y + 18 * y ELSE 421120 - (2 * (640 - y) * (640 - y) + 18 * (640 - y)) END AS f, (319 - y) * dy + dy / 2 AS la FROM c),
      d AS (SELECT *, {_RND('lon / (360.0 / nx)')} AS x FROM n), e AS (SELECT *, power(la - lat, 2) + power(x * (360.0 / nx) - lon, 2) AS far FROM d)
      SELECT place_id, CAST(arg_min(f + x % nx, [far, -y]) AS BIGINT) AS cell_id FROM e GROUP BY place_id""",
    "nearest_cells": f"WITH {T.PLACES}, {T.CELLS}, {_XY} SELECT place_id, y * 72 + x AS cell_id, {_r('c.elevation')} AS cell_elevation FROM loc JOIN (SELECT cell_id, elevation FROM cells WHERE cell_id % 7 > 0) c ON c.cell_id = loc.y * 72 + loc.x",
    "terrain_cells": f"""WITH {T.PLACES}, loc AS (SELECT place_id, lat, lon, elevation % 2500 + 0.37 AS e, CAST({_RND('(lon + 179.75) / 0.5')} AS BIGINT) AS x, CAST({_RND('(lat + 89.75) / 0.5')} AS BIGINT) AS y FROM places), {_NEAR.format(nx=720, ny=360)},
      s AS (SELECT *, ny * 720 + nx AS cell, CASE WHEN (ny * 720 + nx) % 4 = 0 THEN -999.0 ELSE CAST((ny * 720 + nx) * 31 % 3000 AS DOUBLE) END AS h, sqrt(power(ny * 0.5 - 89.75 - lat, 2) + power(nx * 0.5 - 179.75 - lon, 2)) * 111 AS km FROM near),
      g AS (SELECT place_id, max(cell) FILTER (centre) AS c, max(h) FILTER (centre) AS ch, max(abs(h - e)) FILTER (centre) AS off, min(abs(h - e) + km * 30) FILTER (h > -999 AND km < 50) AS sc,
        arg_min(cell, abs(h - e) + km * 30) FILTER (h > -999 AND km < 50) AS b, arg_min(h, abs(h - e) + km * 30) FILTER (h > -999 AND km < 50) AS bh FROM s GROUP BY place_id)
      SELECT place_id, CASE WHEN off > 100 AND sc < off AND sc <= 1500 THEN b ELSE c END AS cell_id, {_r('CASE WHEN off > 100 AND sc < off AND sc <= 1500 THEN bh ELSE ch END')} AS cell_elevation FROM g""",
    "sea_cells": f"""WITH {T.PLACES}, {_XY}, {_NEAR.format(nx=72, ny=36)},
      s AS (SELECT *, ny * 72 + nx AS cell, (ny * 72 + nx) % 4 = 0 AS sea, CASE WHEN centre THEN -1 ELSE power(ny * 5 - 87.5 - lat, 2) + power(nx * 5 - 177.5 - lon, 2) END AS far FROM near)
      SELECT place_id, coalesce(arg_min(cell, [far, cell]) FILTER (sea), max(cell) FILTER (centre)) AS cell_id, coalesce(bool_or(sea), false) AS sea FROM s GROUP BY place_id""",
    "bilinear_elevation": f"""WITH {T.PLACES}, {T.CELLS}, f AS (SELECT place_id, (lon + 177.5) / 5 AS fx, (lat + 87.5) / 5 AS fy FROM places), k AS (SELECT *, fx - floor(fx) AS sx, fy - floor(fy) AS sy FROM f, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
      w AS (SELECT place_id, CAST(floor(fx) AS BIGINT) + a AS x, CAST(floor(fy) AS BIGINT) + b AS y, CASE WHEN a = 1 THEN sx ELSE 1 - sx END * CASE WHEN b = 1 THEN sy ELSE 1 - sy END AS w FROM k),
      j AS (SELECT w.place_id, w.w, CASE WHEN c.elevation > -999 THEN c.elevation END AS v FROM w LEFT JOIN cells c ON c.x = w.x AND c.y = w.y)
      SELECT place_id, {_r('sum(w * v) / sum(w) FILTER (v IS NOT NULL)')} AS elevation FROM j GROUP BY place_id""",
    "box_events": f"WITH {T.CELLS} SELECT cell_id, {_r('avg(value)')} AS value FROM events JOIN cells ON cell_id = user_id * 17 % 2592 WHERE x >= {round(77.5 / 5 + 1e-9)} AND x < {math.floor(297.5 / 5 + 0.5)} AND y >= {math.floor(47.5 / 5 + 0.5)} AND y < {math.floor(142.5 / 5 + 0.5)} GROUP BY cell_id",
    "coastal_events": f"WITH {T.CELLS} SELECT cell_id, count(*) AS n FROM events JOIN cells c ON cell_id = user_id * 17 % 2592 WHERE EXISTS (SELECT 1 FROM cells d WHERE d.x >= 40 AND d.elevation > -999 AND abs(d.x - c.x) <= 1 AND abs(d.y - c.y) <= 1) GROUP BY cell_id",
    "static_table": f"""SELECT 'd' AS domain, s_suppkey AS cell_id, {_r('CASE WHEN s_nationkey > 3 AND s_suppkey % 10 >= 5 THEN abs(s_acctbal) * 0.8 ELSE -999 END')} AS elevation FROM supplier""",
    "remapped_cells": f"WITH e AS (SELECT user_id, avg(value) AS v FROM events GROUP BY ALL) SELECT c_custkey AS cell_id, {_r('v')} AS value FROM customer LEFT JOIN e ON user_id = c_custkey % 300",
    "routed_models": f"""WITH {T.PLACES}, m AS (SELECT place_id, arg_min([n_name, 'global_' || n_regionkey], n_nationkey) AS d FROM places JOIN nation ON lat >= n_nationkey * 6 - 80 AND lat <= n_nationkey * 6 - 40 AND lon >= n_nationkey * 14 - 180 AND lon < n_nationkey * 14 - 60 GROUP BY place_id)
      SELECT place_id, CAST(i AS INTEGER) AS priority, d[i + 1] AS domain FROM m, (SELECT unnest([0, 1]) AS i)""",
    "routed_satellites": f"WITH {T.PLACES} SELECT place_id, CASE WHEN lon >= -20 AND lon < 60 THEN 'mtg_0deg' WHEN lon >= -60 AND lon < 50 THEN 'msg_0deg' WHEN lon >= 50 AND lon < 90 THEN 'msg_iodc' WHEN lon >= 90 AND lon < 180.1 THEN 'himawari' END AS satellite FROM places",
    "resolved_elevation": f"""WITH {T.PLACES}, r AS (SELECT l_suppkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, arg_min(q, l_linenumber) AS q FROM r GROUP BY ALL)
      SELECT place_id, {_r('CASE WHEN place_id % 3 > 0 THEN elevation ELSE q END')} AS elevation FROM places LEFT JOIN m ON l_suppkey = place_id""",
    "region_flags": f"""WITH {T.PLACES}, s AS (SELECT place_id, lat >= -60 AND lat <= 70 AND lon >= -120 AND lon <= 100 AS box, (lon + 120) * 130 AS a, (lon + 120) * -130 - (lat - 70) * 160 AS b, (lat + 60) * 160 AS c FROM places)
      SELECT place_id, box AND NOT ((a >= 0 AND b >= 0 AND c >= 0) OR (a <= 0 AND b <= 0 AND c <= 0)) AS inside FROM s""",
    "normalised_orientation": f"""WITH g AS (SELECT l_orderkey % 72 AS x, l_partkey % 36 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
      SELECT (CASE WHEN y % 2 = 1 THEN 71 - x ELSE x END + 36) % 72 AS x, 35 - y AS y, {_r('v')} AS value FROM g""",
    "ingested_fields": f"""WITH m AS (SELECT user_id AS location_id, CASE event_type WHEN 'view' THEN 'temperature_2m' WHEN 'click' THEN 'precipitation' ELSE 'cloud_cover' END AS variable, CASE event_type WHEN 'view' THEN value - 273.15 WHEN 'click' THEN value * 3600 ELSE value END AS v
      FROM events WHERE event_type IN ('view', 'click', 'error')) SELECT variable, location_id, {_r('sum(v)')} AS total FROM m GROUP BY ALL""",
    "exported_points": f"""WITH {T.HOURLY}, {T.PLACES} SELECT location_id, {_r('lat')} AS latitude, {_r('lon')} AS longitude, {_r('elevation')} AS elevation, valid_time AS time, {_r("max(value) FILTER (variable = 'view')")} AS view_degC, {_r("max(value) FILTER (variable = 'click')")} AS click_mm
      FROM hourly JOIN places ON place_id = location_id WHERE variable IN ('view', 'click') GROUP BY location_id, lat, lon, elevation, valid_time""",
    "json_documents": f"WITH {T.HOURLY} SELECT location_id, count(*) AS n, strftime(min(valid_time), '%Y-%m-%dT%H:%M') AS first FROM hourly WHERE variable = 'view' GROUP BY ALL",
}
