"""Derivation rules, datasets' corrections, static fields and request helpers (D34 to D62, J, F, O, B3) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobarn.functions import solar
from isobarn.operators import aggregate as A
from isobarn.operators import bias as B
from isobarn.operators import combine as C
from isobarn.operators import derive as D
from isobarn.operators import facade, grids, resample
from isobarn.operators import requests as Q
from isobarn.plans import tables as T
from isobarn.sources import storage as S

KEYS = ["place_id", "line", "part"]
REGION = grids.Grid("region", 120, 60, -60.0, -30.0, 1.0, 1.0)


def corrected_phases(spark, sf_dir):
    w = T.weather(spark, sf_dir).withColumns({"swe": F.col("precipitation") / 2, "code": F.element_at(F.array(*[F.lit(x) for x in (61, 63, 65, 71, 73, 75, 3)]), (F.col("part") % 7 + 1).cast("int")), "own": (F.col("part") % 900).cast("double")})
    found = D.phase_corrected(w, "temperature_2m", "own", "elevation", "precipitation", "swe", "code")
    return T.tidy(found.select(*KEYS, "swe", "code"))


def alias_outputs(spark, sf_dir):
    """Soil layers, waves and currents, temperatures of other heights, and radiation from a diffuse share."""
    w = T.weather(spark, sf_dir).select(*KEYS, F.col("cape").alias("soil_temperature_0_to_7cm"), F.col("cloud_cover").alias("soil_temperature_28_to_100cm"), (F.col("cloud_cover") / 200).alias("soil_moisture_7_to_28cm"), (F.col("wind_u_component_10m") + 0.25).alias("ocean_current_u"), (F.col("wind_v_component_10m") + 0.25).alias("ocean_current_v"), F.col("temperature_2m").alias("temperature_150m"), F.col("dew_point_2m").alias("temperature_100m"), F.col("shortwave_radiation"), (F.col("part") % 10 / 10).alias("diffuse_fraction"), F.col("cape").alias("direct_radiation_spread"), F.col("cloud_cover").alias("diffuse_radiation_spread"))
    outputs = ["soil_temperature_6cm", "soil_temperature_54cm", "soil_moisture_9_to_27cm", "ocean_current_velocity", "ocean_current_direction", "temperature_120m", "temperature_80m", "direct_radiation", "shortwave_radiation_spread"]
    return T.tidy(D.derive(w, outputs).select(*KEYS, *outputs))


def outputs_by_dataset(spark, sf_dir):
    """The same inputs under the rules of daily climate data, of pressure levels, and without a dataset."""
    w = T.weather(spark, sf_dir)
    t, h = F.col("temperature_2m"), F.col("relative_humidity_2m")
    w = w.select(*KEYS, (t + 4).alias("temperature_2m_max"), (t - 4).alias("temperature_2m_min"), h.alias("relative_humidity_2m_mean"), F.col("precipitation").alias("precipitation_sum"), (F.col("precipitation") / 3).alias("snowfall_water_equivalent_sum"), (h / 200).alias("soil_moisture_0_to_10cm_mean"), t.alias("temperature_2m"), t.alias("temperature_850hPa"), (h / 20).alias("specific_humidity_850hPa"))
    climate = ["vapour_pressure_deficit_max", "growing_degree_days_base_0_limit_50", "snowfall_sum", "rain_sum", "soil_moisture_0_to_100cm_mean"]
    found = D.derive(D.derive(w, climate, "daily_climate"), ["relative_humidity_850hPa"], "pressure_levels")
    plain = D.resolve("growing_degree_days_base_0_limit_50", {"temperature_2m"})
    return T.tidy(found.select(*KEYS, *climate, "relative_humidity_850hPa", plain.alias("hourly_growth")))


def scaled_domains(spark, sf_dir):
    """Archive factors of the domains that have any, and showers of 0 where none are stored."""
    domain = F.element_at(F.array(*[F.lit(x) for x in ("jma_gsm", "meteofrance_arpege_europe", "ncep_gfs025", "other")]), (F.col("location_id") % 4 + 1).cast("int"))
    names = F.create_map(*[F.lit(x) for p in {"view": "shortwave_radiation", "click": "geopotential_height_500hPa", "purchase": "precipitation", "error": "temperature_2m", "signup": "cape"}.items() for x in p])
    h = T.hourly(spark, sf_dir).withColumns({"domain": domain, "variable": names[F.col("variable")]})
    return T.tidy(D.zero_showers(D.scale_fixes(h)).groupBy("domain", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def symbols_to_codes(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 34).cast("int").alias("symbol"))
    return D.symbol_to_code(e).groupBy("symbol", "weather_code").agg(F.count(F.lit(1)).alias("n"))


def interval_means(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    return T.tidy(w.select(*KEYS, solar.to_interval_mean(F.col("shortwave_radiation"), F.col("part") % 40 / 20).alias("mean")))


def registered(spark, sf_dir):
    """A rule and an aggregation of a user's own."""
    D.register_rule("heat_excess", ["temperature_2m", "wind_speed_10m"], lambda t, s: t - s / 2, "°C")
    A.register_aggregation("heat_excess_max", "heat_excess", "max")
    w = T.weather(spark, sf_dir).withColumns({c: F.round(F.col(c) + 0.25, 2) for c in ("wind_u_component_10m", "wind_v_component_10m")})
    w = D.derive(w.withColumn("valid_time", F.col("valid_time").cast("timestamp")), ["heat_excess"])
    long = w.select((F.col("part") % 50).alias("location_id"), "valid_time", F.lit("heat_excess").alias("variable"), F.col("heat_excess").alias("value"))
    return T.tidy(A.daily_summary(long, ["heat_excess_max"], None, by=["location_id"]))


def mixed_derivations(spark, sf_dir):
    """Siblings mixed before and after a derivation."""
    high, low = T.model(spark, sf_dir, True), T.model(spark, sf_dir, False)
    squared = lambda d: d.withColumn("value", F.col("value") * F.col("value") + 1)
    by = ["location_id", "variable"]
    first = C.mix_before_derivation([[high, low]], squared, True, by).withColumn("mixed", F.lit("before"))
    return T.tidy(first.unionByName(C.mix_before_derivation([[high, low]], squared, False, by).withColumn("mixed", F.lit("after"))))


def attached_static(spark, sf_dir):
    h = T.hourly(spark, sf_dir).withColumns({"domain": F.lit("world"), "location_id": F.col("location_id") * 17 % 2592})
    cells = T.cells(spark).withColumn("soil_type", (F.col("cell_id") % 9).cast("int"))
    found = C.attach_static(h, cells, ["elevation", "soil_type"])
    return T.tidy(found.groupBy("location_id", "elevation", "soil_type").agg(F.avg("value").alias("value")))


def covered_boxes(spark, sf_dir):
    n = F.col("n_nationkey")
    boxes = T.table(spark, sf_dir, "nation").select(n, *[x.cast("double").alias(c) for c, x in {"south": n * 4 - 60, "north": n * 4 - 50, "west": n * 5 - 90, "east": n * 5 - 70}.items()])
    return grids.require_full_cover(boxes, REGION).select("n_nationkey")


def ordered_places(spark, sf_dir):
    """The first places by id, in the order of a request."""
    p = Q.limit_places(T.places(spark, sf_dir), 50, reject=False)
    spine = Q.time_spine(p.withColumns({"start": F.lit("2024-01-05").cast("timestamp"), "stop": F.lit("2024-01-06").cast("timestamp")}), 10800)
    return T.tidy(Q.order_result(spine, "place_id", ["lat", "elevation"]))


def widened_ranges(spark, sf_dir):
    p = Q.time_range_for(T.places(spark, sf_dir), F.lit("2024-02-03 12:24:00").cast("timestamp"), past_days=1, forecast_days=2)
    kinds = [resample.expand_for_resampling(p, k, dt).select("place_id", F.lit(k).alias("kind"), "start", "stop") for k, dt in (("instant", 3600), ("linear", 3600), ("hermite", 10800), ("solar", 21600))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


def requested_ranges(spark, sf_dir):
    """Dates, single runs, and steps from the next, the current and the first step of the day."""
    p, now = T.places(spark, sf_dir), F.lit("2024-02-03 12:24:00").cast("timestamp")
    found = {"dates": Q.date_range_for(p, "2024-01-05", "2024-01-07"), "run": Q.run_range_for(p, "2024-01-05 06:00:00", 10, 10800), "next": Q.step_range_for(p, now, 4), "current": Q.step_range_for(p, now, 8, 900, 2, "current"), "midnight": Q.step_range_for(p, now, 24, 3600, 0, "midnight")}
    parts = [x.select("place_id", F.lit(n).alias("kind"), "start", "stop") for n, x in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


def selected_datasets(spark, sf_dir):
    """Rows of datasets by the names of requests and of ensemble requests."""
    domain = F.element_at(F.array(*[F.lit(x) for x in ("dwd_icon", "dwd_icon_eps", "ncep_gefs05", "gfs05", "other")]), (F.col("location_id") % 5 + 1).cast("int"))
    h = T.hourly(spark, sf_dir).withColumn("domain", domain)
    one = Q.select_datasets(h, "dwd_icon, gfs05").withColumn("kind", F.lit("plain"))
    return one.unionByName(Q.select_datasets(h, ["icon_global", "gfs05"], True).withColumn("kind", F.lit("ensemble"))).groupBy("kind", "domain").agg(F.count(F.lit(1)).alias("n"))


def json_with_sections(spark, sf_dir):
    """Hourly and daily sections in one document a place, with the decimals of their units."""
    h = T.hourly(spark, sf_dir).where("variable = 'view'").select("location_id", F.date_format("valid_time", "yyyy-MM-dd'T'HH:mm").alias("time"), (F.col("value") + 0.0001).alias("view"))
    d = T.hourly(spark, sf_dir).where("variable = 'click'").groupBy("location_id", F.date_format("valid_time", "yyyy-MM-dd").alias("time")).agg(F.max("value").alias("click_max"))
    docs = S.json_sections({"hourly": (h, {"view": "°C"}), "daily": (d, {"click_max": "mm"})}, ["location_id"], {"hourly": "time", "daily": "time"})
    at = lambda path, kind: F.from_json(F.get_json_object("value", path), kind)
    return docs.select(F.get_json_object("value", "$.location_id").cast("bigint").alias("location_id"), F.size(at("$.hourly.view", "array<double>")).cast("bigint").alias("hours"), F.round(F.array_max(at("$.hourly.view", "array<double>")), 1).alias("most"), F.size(at("$.daily.click_max", "array<double>")).cast("bigint").alias("days"), F.get_json_object("value", "$.daily_units.click_max").alias("unit"))


def placed_steps(spark, sf_dir):
    """Hours with events on the regular axis of their place."""
    h = T.hourly(spark, sf_dir).where("variable = 'view'").select("location_id", "valid_time", "value")
    spine = T.regular(spark, sf_dir).select("location_id", "valid_time")
    return T.tidy(resample.place_irregular_steps(h, spine, ["location_id"]))


def bias_between_cells(spark, sf_dir):
    """Seasonal means of places between four cells, and the bias by them."""
    own = T.daily_long(spark, sf_dir).select("location_id", F.col("date").cast("timestamp").alias("valid_time"), "value")
    weights = B.seasonal_weighted_means(own, 4, ["location_id"]).withColumnRenamed("location_id", "cell_id")
    shares = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("w")) for k, s in enumerate((0.1, 0.2, 0.3, 0.4))])
    corners = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), F.explode(shares).alias("c")).select("place_id", (F.col("place_id") + F.col("c.k") * 7).alias("cell_id"), "c.w")
    return T.tidy(B.interpolated_weights(weights, corners, "place_id"))


def elevation_request(spark, sf_dir):
    """Heights of places from a height model with fewer columns toward the poles."""
    rows = 60
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 7 % 170 - 85 + 0.31).cast("double").alias("lat"), (F.col("c_custkey") * 13 % 360 - 180 + 0.31).cast("double").alias("lon"))
    band = F.floor("lat")
    polar = F.abs(F.when(band < 0, band + 1).otherwise(band))
    columns = F.when(polar >= 85, rows // 10).when(polar >= 80, rows // 5).when(polar >= 70, rows // 3).when(polar >= 60, rows // 2).when(polar >= 50, rows * 2 // 3).otherwise(rows)
    model = c.where("k % 3 > 0").groupBy(band.cast("int").alias("lat_band"), F.floor((F.col("lat") - band) * rows).cast("int").alias("row"), F.floor((F.col("lon") + 180) * columns).cast("long").alias("col")).agg(F.max("k").cast("double").alias("height"))
    return T.tidy(facade.elevation(c.select(F.col("k").alias("place_id"), "lat", "lon"), model, rows))


def flood_request(spark, sf_dir):
    members = T.members(spark, sf_dir).withColumnRenamed("location_id", "place_id")
    whole = facade.flood(members).withColumn("kind", F.lit("statistics")).select("place_id", "valid_time", "kind", "min", "max", "mean")
    each = facade.flood(members, statistics=False).groupBy("place_id", "valid_time").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return T.tidy(whole.unionByName(each.withColumn("kind", F.lit("members")).select(*whole.columns)))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_r = T.r
_K = "place_id, line, part"
_CLAMP = lambda x, a, b: f"least(greatest({x}, {a}), {b})"
_TET = lambda t: f"(0.6108 * exp(17.27 * ({t}) / (({t}) + 237.3)))"
_SEASON = """s AS (SELECT location_id, value, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) % 31557600 AS s FROM daily_long), w AS (SELECT location_id, value, s // 7889400 AS season, 1 - s % 7889400 / 7889400 AS w FROM s
  UNION ALL SELECT location_id, value, (s // 7889400 + 1) % 4, s % 7889400 / 7889400 FROM s), m AS (SELECT location_id, season, CASE WHEN sum(w) > 0.001 THEN sum(value * w) / sum(w) END AS mean FROM w GROUP BY ALL)"""
_BAND = "CASE WHEN p >= 85 THEN 6 WHEN p >= 80 THEN 12 WHEN p >= 70 THEN 20 WHEN p >= 60 THEN 30 WHEN p >= 50 THEN 40 ELSE 60 END"
ORACLE = {
    "corrected_phases": f"""WITH {T.WEATHER}, x AS (SELECT *, abs(part % 900 - elevation) > 100 AS far, [61, 63, 65, 71, 73, 75, 3][part % 7 + 1] AS code0 FROM weather)
      SELECT {_K}, {_r('CASE WHEN far THEN CASE WHEN temperature_2m <= 0 THEN precipitation ELSE 0 END ELSE precipitation / 2 END')} AS swe, CAST(CASE WHEN NOT far THEN code0
        WHEN temperature_2m > 0 THEN CASE code0 WHEN 71 THEN 61 WHEN 73 THEN 63 WHEN 75 THEN 65 ELSE code0 END WHEN temperature_2m < 0 THEN CASE code0 WHEN 61 THEN 71 WHEN 63 THEN 73 WHEN 65 THEN 75 ELSE code0 END ELSE code0 END AS INTEGER) AS code FROM x""",
    "alias_outputs": f"""WITH {T.WEATHER}, x AS (SELECT *, wind_u_component_10m + 0.25 AS u, wind_v_component_10m + 0.25 AS v FROM weather)
      SELECT {_K}, {_r('cape')} AS soil_temperature_6cm, {_r('cloud_cover')} AS soil_temperature_54cm, {_r('cloud_cover / 200')} AS soil_moisture_9_to_27cm, {_r('sqrt(u * u + v * v)')} AS ocean_current_velocity, {_r('degrees(atan2(-u, -v)) + 180')} AS ocean_current_direction,
      {_r('temperature_2m')} AS temperature_120m, {_r('dew_point_2m')} AS temperature_80m, {_r('shortwave_radiation * (1 - part % 10 / 10)')} AS direct_radiation, {_r('sqrt(cape * cape + cloud_cover * cloud_cover)')} AS shortwave_radiation_spread FROM x""",
    "outputs_by_dataset": f"""WITH {T.WEATHER}, x AS (SELECT *, temperature_2m AS t, relative_humidity_2m AS rh, temperature_2m + 273.15 AS k, relative_humidity_2m / 20000 AS q FROM weather),
      y AS (SELECT *, q * 85000 / (0.622 + 0.378 * q) AS e, exp(9.550426 - 5723.265 / k + 3.53068 * ln(k) - 0.00728332 * k) AS ice,
        exp(54.842763 - 6763.22 / k - 4.21 * ln(k) + 0.000367 * k + tanh(0.0415 * (k - 218.8)) * (53.878 - 1331.22 / k - 9.44523 * ln(k) + 0.014025 * k)) AS wat,
        CASE WHEN k <= 250.16 THEN 0 WHEN k >= 273.16 THEN 1 ELSE ((k - 250.16) / 23.0) ** 2 END AS liq FROM x)
      SELECT {_K}, {_r(f"({_TET('t - 4')} + {_TET('t + 4')}) / 2 * (1 - rh / 100)")} AS vapour_pressure_deficit_max, {_r(_CLAMP('t', 0, 50))} AS growing_degree_days_base_0_limit_50, {_r('precipitation / 3 * 0.7')} AS snowfall_sum,
      {_r('greatest(precipitation - precipitation / 3, 0)')} AS rain_sum, {_r('rh / 200')} AS soil_moisture_0_to_100cm_mean, {_r(_CLAMP('100 * e / (liq * wat + (1 - liq) * ice)', 0, 100))} AS relative_humidity_850hPa, {_r(_CLAMP('t', 0, 50) + ' / 24')} AS hourly_growth FROM y""",
    "scaled_domains": f"""WITH {T.HOURLY}, d AS (SELECT ['jma_gsm', 'meteofrance_arpege_europe', 'ncep_gfs025', 'other'][location_id % 4 + 1] AS domain, CASE variable WHEN 'view' THEN 'shortwave_radiation' WHEN 'click' THEN 'geopotential_height_500hPa' WHEN 'purchase' THEN 'precipitation' WHEN 'error' THEN 'temperature_2m' ELSE 'cape' END AS variable, value FROM hourly),
      f AS (SELECT domain, variable, value * CASE WHEN domain = 'jma_gsm' AND variable = 'geopotential_height_500hPa' THEN 9.80665 WHEN domain = 'meteofrance_arpege_europe' AND variable = 'shortwave_radiation' THEN 10000000.0 / 12960000.0 ELSE 1 END AS value FROM d)
      SELECT domain, variable, count(*) AS n, {_r('avg(value)')} AS mean FROM (SELECT * FROM f UNION ALL SELECT domain, 'showers', 0 FROM f WHERE domain = 'ncep_gfs025' AND variable = 'precipitation') GROUP BY ALL""",
    "symbols_to_codes": f"""WITH e AS (SELECT CAST(event_id % 34 AS INTEGER) AS symbol FROM events) SELECT symbol, CASE WHEN symbol BETWEEN 1 AND 32 THEN CAST({D.SYMBOLS}[symbol] AS INTEGER) END AS weather_code, count(*) AS n FROM e GROUP BY ALL""",
    "interval_means": f"WITH {T.WEATHER} SELECT {_K}, {_r('CASE WHEN part % 40 / 20 < 0.05 THEN shortwave_radiation ELSE shortwave_radiation / (part % 40 / 20) END')} AS mean FROM weather",
    "registered": f"""WITH {T.WEATHER}, x AS (SELECT part % 50 AS location_id, CAST(valid_time AS DATE) AS day, temperature_2m - sqrt(round(wind_u_component_10m + 0.25, 2) ** 2 + round(wind_v_component_10m + 0.25, 2) ** 2) / 2 AS h FROM weather)
      SELECT location_id, day, {_r('max(h)')} AS heat_excess_max FROM x GROUP BY ALL""",
    "mixed_derivations": f"""WITH {T.MODELS}, j AS (SELECT location_id, variable, valid_time, coalesce(high.value, low.value) AS v FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time))
      SELECT location_id, variable, valid_time, {_r('v * v + 1')} AS value, mixed FROM j, (SELECT unnest(['before', 'after']) AS mixed)""",
    "attached_static": f"""WITH {T.HOURLY}, {T.CELLS}, h AS (SELECT location_id * 17 % 2592 AS location_id, value FROM hourly)
      SELECT location_id, {_r('elevation')} AS elevation, CAST(location_id % 9 AS INTEGER) AS soil_type, {_r('avg(value)')} AS value FROM h JOIN cells ON cell_id = location_id GROUP BY location_id, elevation""",
    "covered_boxes": "SELECT n_nationkey FROM nation WHERE n_nationkey * 5 - 90 >= -60 AND n_nationkey * 5 - 70 <= 59 AND n_nationkey * 4 - 60 >= -30 AND n_nationkey * 4 - 50 <= 29",
    "ordered_places": f"""WITH {T.PLACES}, p AS (SELECT * FROM places ORDER BY place_id LIMIT 50)
      SELECT place_id, TIMESTAMP '2024-01-05' + to_hours(CAST(3 * h AS INTEGER)) AS valid_time, {_r('lat')} AS lat, {_r('elevation')} AS elevation FROM p, (SELECT unnest(range(8)) AS h)""",
    "widened_ranges": f"""WITH {T.PLACES}, b AS (SELECT place_id, (1706963040 + utc_offset_seconds) // 86400 * 86400 - utc_offset_seconds AS d FROM places)
      SELECT place_id, kind, to_timestamp(d - 86400 - pad)::TIMESTAMP AS start, to_timestamp(d + 172800 + pad)::TIMESTAMP AS stop FROM b, (VALUES ('instant', 0), ('linear', 3600), ('hermite', 21600), ('solar', 43200)) AS k(kind, pad)""",
    "requested_ranges": f"""WITH {T.PLACES}, d AS (SELECT place_id, 1704412800 - utc_offset_seconds AS s FROM places), k(kind, a, b) AS (VALUES ('run', 1704434400, 1704434400 + 108000), ('next', 1706965200, 1706965200 + 14400), ('current', 1706962500 - 1800, 1706962500 + 7200), ('midnight', 1706918400, 1706918400 + 86400))
      SELECT place_id, 'dates' AS kind, to_timestamp(s)::TIMESTAMP AS start, to_timestamp(s + 3 * 86400)::TIMESTAMP AS stop FROM d UNION ALL SELECT place_id, kind, to_timestamp(a)::TIMESTAMP, to_timestamp(b)::TIMESTAMP FROM places, k""",
    "selected_datasets": f"""WITH {T.HOURLY}, h AS (SELECT ['dwd_icon', 'dwd_icon_eps', 'ncep_gefs05', 'gfs05', 'other'][location_id % 5 + 1] AS domain FROM hourly)
      SELECT CASE WHEN domain IN ('dwd_icon', 'gfs05') THEN 'plain' ELSE 'ensemble' END AS kind, domain, count(*) AS n FROM h WHERE domain IN ('dwd_icon', 'gfs05', 'dwd_icon_eps', 'ncep_gefs05') GROUP BY ALL""",
    "json_with_sections": f"""WITH {T.HOURLY}, v AS (SELECT location_id, count(*) AS hours, round(max(round(value + 0.0001, 1)), 1) AS most FROM hourly WHERE variable = 'view' GROUP BY ALL), c AS (SELECT location_id, count(DISTINCT CAST(valid_time AS DATE)) AS days FROM hourly WHERE variable = 'click' GROUP BY ALL)
      SELECT location_id, coalesce(hours, -1) AS hours, most, coalesce(days, -1) AS days, CASE WHEN days IS NOT NULL THEN 'mm' END AS unit FROM v FULL OUTER JOIN c USING (location_id)""",
    "placed_steps": f"WITH {T.REGULAR}, {T.HOURLY} SELECT r.location_id, r.valid_time, {_r('h.value')} AS value FROM regular r LEFT JOIN (SELECT * FROM hourly WHERE variable = 'view') h USING (location_id, valid_time)",
    "bias_between_cells": f"""WITH {T.DAILY}, {_SEASON}, c AS (SELECT s_suppkey AS place_id, s_suppkey + k * 7 AS cell_id, w FROM supplier, (VALUES (0, 0.1::DOUBLE), (1, 0.2::DOUBLE), (2, 0.3::DOUBLE), (3, 0.4::DOUBLE)) AS v(k, w))
      SELECT place_id, season, {_r('sum(c.w * mean) / sum(c.w) FILTER (mean IS NOT NULL)')} AS mean FROM c JOIN m ON location_id = cell_id GROUP BY ALL""",
    "elevation_request": f"""WITH c AS (SELECT c_custkey AS k, CAST(c_custkey * 7 % 170 - 85 + 0.31 AS DOUBLE) AS lat, CAST(c_custkey * 13 % 360 - 180 + 0.31 AS DOUBLE) AS lon FROM customer),
      b AS (SELECT *, floor(lat) AS b, abs(CASE WHEN floor(lat) < 0 THEN floor(lat) + 1 ELSE floor(lat) END) AS p FROM c), d AS (SELECT *, floor((lat - b) * 60) AS y, floor((lon + 180) * {_BAND}) AS x FROM b),
      m AS (SELECT b, y, x, CAST(max(k) AS DOUBLE) AS h FROM d WHERE k % 3 > 0 GROUP BY ALL)
      SELECT k AS place_id, {_r('lat')} AS lat, {_r('lon')} AS lon, {_r('h')} AS elevation FROM d LEFT JOIN m USING (b, y, x)""",
    "flood_request": f"""WITH {T.MEMBERS} SELECT location_id AS place_id, valid_time, kind, {_r('min(value)')} AS min, {_r('max(value)')} AS max, {_r('avg(value)')} AS mean FROM members, (SELECT unnest(['statistics', 'members']) AS kind) GROUP BY ALL""",
}
