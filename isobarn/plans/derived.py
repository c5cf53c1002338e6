"""Derived variables (D) on the driver's tables: weather formulas, codes, air quality and solar geometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isobarn.functions import air, codes, meteo, solar
from isobarn.operators import derive as D
from isobarn.plans import tables as T

KEYS = ["place_id", "line", "part"]


def wind(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    u, v = F.round(F.col("wind_u_component_10m") + 0.25, 2), F.round(F.col("wind_v_component_10m") + 0.25, 2)
    w = w.select(*KEYS, u.alias("u"), v.alias("v"))
    speed, direction = meteo.wind_speed(F.col("u"), F.col("v")), meteo.wind_direction(F.col("u"), F.col("v"))
    return T.tidy(w.withColumns({"speed": speed, "direction": direction}).withColumns({"u_back": meteo.u_wind(F.col("speed"), F.col("direction")), "v_back": meteo.v_wind(F.col("speed"), F.col("direction")), "speed_80m": meteo.wind_at_height(F.col("speed"), 10, 80), "speed_spread": meteo.speed_spread(F.col("u"), F.col("v"), 0.5, 1.5), "direction_spread": meteo.direction_spread(F.col("u"), F.col("v"), 0.5, 1.5), "turned": meteo.true_north(F.col("direction"), 12.5)}))


def humidity(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    t, rh, d, p = (F.col(c) for c in ("temperature_2m", "relative_humidity_2m", "dew_point_2m", "pressure_msl"))
    return T.tidy(w.select(*KEYS, meteo.relative_humidity(t, d).alias("rh"), meteo.dew_point(t, rh).alias("dew"), meteo.dew_point_daily(t + 4, t - 4, rh).alias("dew_daily"), meteo.humidity_from_specific(rh / 20, t, p).alias("rh_specific"), meteo.wet_bulb(t, rh).alias("wet_bulb"), meteo.vapour_pressure_deficit(t, d).alias("deficit"), meteo.vapour_pressure_deficit_daily(t + 4, t - 4, rh_mean=rh).alias("deficit_daily"), meteo.apparent_temperature(t, rh, 3.0, F.col("shortwave_radiation")).alias("apparent"), meteo.leaf_wetness(t, d, F.col("precipitation")).alias("wetness"), meteo.leaf_wetness_daily(t + 4, t - 4, rh, F.col("precipitation")).alias("wetness_daily")))


def pressure_and_density(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    t, rh, p, h = (F.col(c) for c in ("temperature_2m", "relative_humidity_2m", "pressure_msl", "elevation"))
    w = w.withColumn("sp", meteo.surface_pressure(t, p, h))
    sp = F.col("sp")
    return T.tidy(w.select(*KEYS, "sp", meteo.sea_level_pressure(t, sp, h).alias("msl"), meteo.elevation_from_pressures(p, sp, t).alias("height"), meteo.altitude_of_pressure(p).alias("altitude"), meteo.pressure_of_altitude(h).alias("pressure_at"), meteo.air_density(t, rh, sp).alias("density"), meteo.vertical_velocity(F.col("precipitation") / 10, t, 850.0).alias("vertical_velocity"), D.model_height(p, sp, t, F.col("cloud_cover") / 100).alias("model_height")), 4)


def evapotranspiration(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    t, rh, d, s, h = (F.col(c) for c in ("temperature_2m", "relative_humidity_2m", "dew_point_2m", "shortwave_radiation", "elevation"))
    hourly = meteo.reference_evapotranspiration(t, 3.0, d, s, h, s * 1.4, 3600)
    daily = meteo.reference_evapotranspiration_daily(t + 5, t - 5, t, 3.0, F.when(F.col("line") != 3, s / 40), h, s / 20, rh)
    return T.tidy(w.select(*KEYS, hourly.alias("et0"), daily.alias("et0_daily"), meteo.evapotranspiration(-s).alias("evapotranspiration")))


def precipitation_phases(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    w = w.withColumns({"swe": meteo.snowfall_water_equivalent(F.col("precipitation"), F.col("temperature_2m")), "line_height": F.col("cape")})
    by_line = meteo.snowfall_water_equivalent(F.col("precipitation"), F.col("temperature_2m"), F.col("elevation"), F.col("line_height"))
    return T.tidy(w.select(*KEYS, "swe", by_line.alias("swe_by_line"), meteo.snowfall(F.col("swe")).alias("snow"), meteo.rain(F.col("precipitation"), F.col("swe"), F.lit(0.5)).alias("rain"), meteo.total_precipitation(F.col("precipitation"), F.col("swe"), 0.1).alias("total"), meteo.snow_from_frozen_percent(F.col("precipitation"), F.col("relative_humidity_2m") * 1.5 - 20).alias("frozen"), meteo.water_equivalent_from_snow(F.col("cloud_cover") / 20, 12.0, F.col("precipitation"), F.col("elevation"), F.col("line_height")).alias("we"), meteo.snow_depth_from_water(F.col("cloud_cover"), 250.0).alias("depth"), meteo.snow_water_from_depth(F.col("cloud_cover") / 100, 250.0).alias("water"), meteo.snowfall_height(F.col("line_height"), F.col("elevation"), F.col("temperature_2m") - 20).alias("snow_height")))


def clouds(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    rh, c = F.col("relative_humidity_2m"), F.col("cloud_cover")
    group = meteo.cloud_cover_of_group({1000: rh, 925: rh + 2, 850: rh + 5})
    return T.tidy(w.select(*KEYS, meteo.cloud_cover_at_level(rh, 850.0).alias("cover_850"), group.alias("cover_low"), meteo.cloud_cover_total(c, c / 2, 100 - c).alias("total")))


def weather_codes(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    c, p, e, t = (F.col(x) for x in ("cloud_cover", "precipitation", "cape", "temperature_2m"))
    code = codes.weather_code(c, p, F.when(t < 0, p * 0.7).otherwise(F.lit(0.0)), F.col("lat"), visibility=F.col("elevation") * 4)
    storm = codes.thunderstorm_probability(c, p, e, F.col("lat"), showers=p / 2, gusts=F.col("line") * 4.0, inhibition=F.col("relative_humidity_2m") * 2)
    w = w.select(*KEYS, "temperature_2m", "precipitation", code.alias("code"), storm.alias("storm"))
    fixed = w.withColumns({"corrected": codes.correct_code(F.col("code"), F.col("temperature_2m") - 2, F.col("precipitation") - 1), "cut": codes.cut_code_at_freezing(F.col("code"), F.col("temperature_2m"))})
    return T.tidy(fixed.drop("temperature_2m", "precipitation"))


def air_quality(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    x = F.col("cape") / 10 - 4
    eu = {p: air.european_index(x, p) for p in air.EUROPE}
    us = {f"us_{n}": air.us_index(x, n) for n in ("pm2_5_24h", "pm10_24h", "nitrogen_dioxide", "carbon_monoxide_8h")}
    return T.tidy(w.select(*KEYS, *[c.alias(f"eu_{n}") for n, c in eu.items()], *[c.alias(n) for n, c in us.items()], air.us_ozone(x, x / 2).alias("us_ozone"), air.us_sulphur_dioxide(x, x * 2).alias("us_so2"), air.overall(*eu.values()).alias("overall")))


def soil_and_growth(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    m = F.col("relative_humidity_2m") / 200
    return T.tidy(w.select(*KEYS, meteo.soil_moisture_index(m, F.col("part") % 9).alias("index"), meteo.soil_0_to_100cm(m, m / 2, m / 3).alias("soil_0_100"), meteo.growing_degree(F.col("temperature_2m"), 5.0, 30.0).alias("growing")))


def derived_outputs(spark, sf_dir):
    outputs = ["wind_speed_10m", "wind_direction_10m", "wind_speed_80m", "relative_humidity_2m", "apparent_temperature", "surface_pressure", "air_density", "snowfall", "rain", "weather_code", "diffuse_radiation", "vapour_pressure_deficit"]
    w = T.weather(spark, sf_dir).drop("relative_humidity_2m").withColumns({c: F.round(F.col(c) + 0.25, 2) for c in ("wind_u_component_10m", "wind_v_component_10m")})
    return T.tidy(D.derive(w, outputs).select(*KEYS, *outputs))


def _sun_hours(spark, sf_dir):
    """Every place and hour of a day each, polar days and nights included."""
    p = T.places(spark, sf_dir).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return p.withColumn("valid_time", F.timestamp_seconds(F.lit(1704067200) + (F.col("place_id") * 17 % 366) * 86400 + F.col("hour") * 3600)).select("place_id", "lat", "lon", "elevation", "hour", "valid_time")


def sun_position(spark, sf_dir):
    s = solar.with_sun_position(_sun_hours(spark, sf_dir), solar.epoch(F.col("valid_time")))
    return T.tidy(s.withColumn("distance", solar.sun_distance(F.col("valid_time"))).select("place_id", "hour", "sun_declination", "sun_equation_of_time", "distance"))


def radiation(spark, sf_dir):
    s = solar.with_sun_position(_sun_hours(spark, sf_dir), solar.epoch(F.col("valid_time")))  # once, for all that follow
    s = solar.potential_radiation(s, "valid_time", "lat", "lon", 3600)
    s = solar.clear_sky_radiation(s, "valid_time", "lat", "lon", 3600)
    s = solar.instant_factor(s, "valid_time", "lat", "lon", 3600)
    s = s.withColumn("direct", F.col("potential_radiation") * 0.5)
    s = solar.direct_normal(s, "direct", "valid_time", "lat", "lon", 3600)
    s = solar.sunshine_duration(s, "direct", "valid_time", "lat", "lon", 3600)
    s = s.withColumn("shortwave", F.col("potential_radiation") * 0.7)
    s = solar.diffuse_radiation(s, "shortwave", "valid_time", "lat", "lon", 3600)
    return T.tidy(s.drop("lat", "lon", "elevation", "valid_time", "direct", "shortwave", "sun_declination", "sun_equation_of_time"), 3)


def tilted_radiation(spark, sf_dir):
    s = _sun_hours(spark, sf_dir).withColumns({"direct": F.lit(300.0), "diffuse": F.lit(120.0)})
    fixed = solar.tilted_irradiance(s, "direct", "diffuse", "valid_time", "lat", "lon", 3600, 30.0, -45.0).withColumnRenamed("global_tilted_irradiance", "fixed")
    flat = solar.tilted_irradiance(fixed, "direct", "diffuse", "valid_time", "lat", "lon", 3600, 0.0, 0.0).withColumnRenamed("global_tilted_irradiance", "flat")
    both = solar.tilted_irradiance(flat, "direct", "diffuse", "valid_time", "lat", "lon", 3600, None, None)
    return T.tidy(both.select("place_id", "hour", "fixed", "flat", "global_tilted_irradiance"), 3)


def sunrise_sunset(spark, sf_dir):
    p = T.places(spark, sf_dir).withColumn("midnight", F.timestamp_seconds(F.lit(1704067200) + (F.col("place_id") * 17 % 366) * 86400))
    return T.tidy(solar.sunrise_sunset(p, "midnight", "lat", "lon").select("place_id", "sunrise", "sunset", "daylight_duration"), 2)


def is_day(spark, sf_dir):
    return solar.is_day(_sun_hours(spark, sf_dir), "valid_time", "lat", "lon").select("place_id", "hour", "is_day")


def ephemeris_lookup(spark, sf_dir):
    """Sun positions between the knots of a century's table."""
    table = solar.build_ephemeris(spark, "1950-01-01 00:00:00", "2049-12-31 00:00:00")
    s = solar.attach_ephemeris(_sun_hours(spark, sf_dir), table, "valid_time")
    return T.tidy(s.select("place_id", "hour", "sun_declination", "sun_equation_of_time"), 5)


def moon(spark, sf_dir):
    p = T.places(spark, sf_dir).withColumn("midnight", F.timestamp_seconds(F.lit(1704067200) + (F.col("place_id") * 17 % 366) * 86400))
    found = solar.moon_events(p, "place_id", "midnight", "lat", "lon")
    return T.tidy(found.withColumn("phase", solar.moon_phase(F.col("midnight"))))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_r = T.r
_K = "place_id, line, part"
_MAG = lambda t: f"(17.625 * ({t}) / (243.04 + ({t})))"
_TET = lambda t: f"(0.6108 * exp(17.27 * ({t}) / (({t}) + 237.3)))"
_BAR = lambda t, h: f"power(1 - 0.0065 * {h} / ({t} + 273.15 + 0.0065 * {h}), -5.25578129287)"
_CLAMP = lambda x, a, b: f"least(greatest({x}, {a}), {b})"
_UV = f"{T.WEATHER}, x AS (SELECT {_K}, round(wind_u_component_10m + 0.25, 2) AS u, round(wind_v_component_10m + 0.25, 2) AS v FROM weather), s AS (SELECT *, sqrt(u * u + v * v) AS speed, degrees(atan2(u, v)) + 180 AS direction FROM x)"
_F80 = math.log(67.8 * 80 - 5.42) / math.log(67.8 * 10 - 5.42)
_F2 = math.log(67.8 * 2 - 5.42) / math.log(67.8 * 10 - 5.42)


def _position_sql(x: str, points: list) -> str:
    out = "NULL"
    for i in range(len(points) - 1, 0, -1):
        a, b = points[i - 1], points[i]
        if b is None:
            continue
        inside = "NULL" if a is None else f"({i - 1} + ({x} - {a}) / {float(b - a)})"
        out = f"CASE WHEN {x} < {b} THEN {inside} ELSE {out if i < len(points) - 1 else inside} END"
    return f"CASE WHEN {x} >= {next(p for p in points if p is not None)} THEN {out} END"


def _us_sql(place: str) -> str:
    return f"CASE WHEN {place} <= 4 THEN {place} * 50 ELSE {place} * 100 - 200 END"


def _class_sql(x: str, classes: list, least: float) -> str:
    cases = " ".join(f"WHEN {x} < {b} THEN {c}" if b is not None else f"ELSE {c}" for b, c in classes)
    return f"CASE WHEN {x} >= {least} THEN CASE {cases} END END"


_SUN = """sunh AS (SELECT place_id, lat, lon, unnest(range(24)) AS hour FROM places),
sunt AS (SELECT *, CAST(1704067200 + (place_id * 17 % 366) * 86400 + hour * 3600 AS DOUBLE) AS s FROM sunh)"""


def _position_cte(source: str, seconds: str) -> str:
    return f"""q1 AS (SELECT *, ({seconds} - 946728000.0) / 3155760000.0 AS t FROM {source}),
q2 AS (SELECT *, radians(280.46646 + 36000.76983 * t + 0.0003032 * t * t) AS l0, radians(357.52911 + 35999.05029 * t - 0.0001537 * t * t) AS m, 0.016708634 - 0.000042037 * t AS e, radians(125.04 - 1934.136 * t) AS o FROM q1),
q3 AS (SELECT *, l0 + radians((1.914602 - 0.004817 * t) * sin(m) + (0.019993 - 0.000101 * t) * sin(2 * m) + 0.000289 * sin(3 * m) - 0.00569 - 0.00478 * sin(o)) AS lg, radians(23.439291 - 0.0130042 * t + 0.00256 * cos(o)) AS tilt FROM q2),
q4 AS (SELECT *, power(tan(tilt / 2), 2) AS y FROM q3),
sun AS (SELECT *, degrees(asin(sin(tilt) * sin(lg))) AS decl, 4 * degrees(y * sin(2 * l0) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l0) - 0.5 * y * y * sin(4 * l0) - 1.25 * e * e * sin(2 * m)) AS eqt FROM q4)"""


_DIST = "(1 - 0.01672 * cos(radians(360 / 365.256363 * (s % 31557600 / 86400 - 3))))"
_GEO = f"""{_position_cte('sunt', 's')},
g1 AS (SELECT *, sin(radians(lat)) * sin(radians(decl)) AS a, cos(radians(lat)) * cos(radians(decl)) AS b, radians(15 * (s % 86400 / 3600 - 12 + eqt / 60) + lon) + pi() AS hh, radians(15) AS w, power({_DIST}, 2) AS r2 FROM sun),
g2 AS (SELECT *, hh - floor(hh / (2 * pi())) * 2 * pi() - pi() AS h, CASE WHEN -a / b > 1 OR -a / b < -1 THEN pi() ELSE acos(least(greatest(-a / b, -1), 1)) END AS rise FROM g1)"""
_CUT = lambda name, cut: f"{name} AS (SELECT *, greatest(-(rise{cut}), h - w) AS lo, least(rise{cut}, h) AS hi FROM {{src}})"

_DEC = "acos(least(greatest(b / cos(radians(lat)), -1), 1)) * sign(a * sign(lat))"


def _tilted(slope: str, panel: str) -> str:
    facing = f"greatest(cos(zen) * cos({slope}) + sin(zen) * sin({slope}) * cos(azi - pi() - ({panel})), 0)"
    return f"CASE WHEN hi > lo THEN CASE WHEN z <= 0.0001 THEN 300 ELSE 300 / z END * {facing} + (1 + cos({slope})) / 2 * 120 + 420 * 0.2 * (1 - (1 + cos({slope})) / 2) ELSE 0 END"


_KNOT = lambda c: "b.{0} + f * ((c.{0} - a.{0}) / 2 + f * (a.{0} - 2.5 * b.{0} + 2 * c.{0} - d.{0} / 2 + f * ((d.{0} - a.{0}) / 2 + 1.5 * (b.{0} - c.{0}))))".format(c)
ORACLE = {
    "ephemeris_lookup": f"""WITH {T.PLACES}, {_SUN}, ks AS (SELECT k, CAST(-631152000 + k * 1728000 AS DOUBLE) AS s FROM (SELECT unnest(range(1827)) AS k)), {_position_cte('ks', 's')}, kk AS (SELECT k, decl, eqt FROM sun),
      j AS (SELECT place_id, hour, (s + 631152000) / 1728000 - floor((s + 631152000) / 1728000) AS f, CAST(floor((s + 631152000) / 1728000) AS BIGINT) % 1827 AS k FROM sunt)
      SELECT place_id, CAST(hour AS INTEGER) AS hour, {_r(_KNOT('decl'), 5)} AS sun_declination, {_r(_KNOT('eqt'), 5)} AS sun_equation_of_time
      FROM j JOIN kk b ON b.k = j.k JOIN kk a ON a.k = (j.k + 1826) % 1827 JOIN kk c ON c.k = (j.k + 1) % 1827 JOIN kk d ON d.k = (j.k + 2) % 1827""",
    "tilted_radiation": f"""WITH {T.PLACES}, {_SUN}, {_GEO}, g3 AS (SELECT *, greatest(-(CASE WHEN rise = pi() THEN rise ELSE rise - radians(3) END), h - w) AS lo, least(CASE WHEN rise = pi() THEN rise ELSE rise - radians(3) END, h) AS hi, {_DEC} AS dec FROM g2),
      g4 AS (SELECT *, greatest(hi - lo, 0.001) AS wd FROM g3), g5 AS (SELECT *, least(greatest((b * (sin(hi) - sin(lo)) + a * (hi - lo)) / wd, -1), 1) AS z,
        atan2(-(cos(dec) * (cos(lo) - cos(hi))) / wd, cos(radians(lat)) * sin(dec) - sin(radians(lat)) * cos(dec) * (sin(hi) - sin(lo)) / wd) AS azi FROM g4), g6 AS (SELECT *, acos(z) AS zen FROM g5)
      SELECT place_id, CAST(hour AS INTEGER) AS hour, {_r(_tilted('radians(30)', 'radians(-45)'), 3)} AS fixed, {_r(_tilted('radians(0)', 'radians(0)'), 3)} AS flat, {_r(_tilted('zen', 'azi - pi()'), 3)} AS global_tilted_irradiance FROM g6""",
    "moon": f"""WITH {T.PLACES}, p AS (SELECT place_id, lat, lon, CAST(1704067200 + (place_id * 17 % 366) * 86400 AS DOUBLE) AS m0 FROM places), t AS (SELECT *, (m0 + 3600 * hour - 946728000) / 86400 AS d FROM p, (SELECT unnest(range(-1, 26)) AS hour)),
      u AS (SELECT *, 218.316 + 13.176396 * d AS l, radians(134.963 + 13.064993 * d) AS m, radians(93.272 + 13.229350 * d) AS fm, radians(297.850 + 12.190749 * d) AS el, radians(357.529 + 0.98560028 * d) AS ms FROM t),
      v AS (SELECT *, radians(l + 6.289 * sin(m) + 1.274 * sin(2 * el - m) + 0.658 * sin(2 * el) + 0.214 * sin(2 * m) - 0.186 * sin(ms)) AS lo, radians(5.128 * sin(fm)) AS la, radians(23.4393 - 3.563e-7 * d) AS ob FROM u),
      w AS (SELECT *, atan2(sin(lo) * cos(ob) - tan(la) * sin(ob), cos(lo)) AS ra, asin(sin(la) * cos(ob) + cos(la) * sin(ob) * sin(lo)) AS dec, radians(280.46061837 + 360.98564736629 * d + lon) AS st FROM v),
      x AS (SELECT place_id, m0, hour, asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(st - ra)) AS hh FROM w), y AS (SELECT *, degrees(hh) - 0.9507 * cos(hh) AS y1 FROM x),
      z AS (SELECT *, lag(y1) OVER o AS y0, lead(y1) OVER o AS y2 FROM y WINDOW o AS (PARTITION BY place_id ORDER BY hour)), c AS (SELECT *, y1 / (y1 - y2) AS ln, (y0 - 2 * y1 + y2) / 2 AS bend FROM z WHERE hour BETWEEN 0 AND 23 AND y1 * y2 <= 0 AND y1 <> y2),
      e AS (SELECT place_id, y2 > y1 AS up, to_timestamp(round(m0 + 3600 * (hour + least(greatest(ln - bend * ln * (ln - 1) / ((y2 - y1) + bend * (2 * ln - 1)), 0), 1))))::TIMESTAMP AS at_ FROM c)
      SELECT p.place_id, to_timestamp(m0)::TIMESTAMP AS midnight, min(at_) FILTER (up) AS moonrise, min(at_) FILTER (NOT up) AS moonset,
      {_r('(m0 - 947182440) / (29.530588853 * 86400) - floor((m0 - 947182440) / (29.530588853 * 86400))')} AS phase FROM p LEFT JOIN e USING (place_id) GROUP BY p.place_id, m0""",
    "wind": f"""WITH {_UV} SELECT {_K}, {_r('u')} AS u, {_r('v')} AS v, {_r('speed')} AS speed, {_r('direction')} AS direction, {_r('-speed * sin(radians(direction))')} AS u_back, {_r('-speed * cos(radians(direction))')} AS v_back,
      {_r(f'speed * {_F80!r}')} AS speed_80m, {_r('sqrt((u * 0.5) ** 2 + (v * 1.5) ** 2) / speed')} AS speed_spread, {_r('degrees(sqrt((v * 0.5) ** 2 + (u * 1.5) ** 2) / (u * u + v * v))')} AS direction_spread,
      {_r('(direction - 12.5 + 360) % 360')} AS turned FROM s""",
    "humidity": f"""WITH {T.WEATHER}, x AS (SELECT *, temperature_2m AS t, relative_humidity_2m AS rh, dew_point_2m AS d, ln(relative_humidity_2m / 100) + {_MAG('temperature_2m')} AS z,
        ln(relative_humidity_2m / 100) + ({_MAG('temperature_2m - 4')} + {_MAG('temperature_2m + 4')}) / 2 AS zd, relative_humidity_2m / 20000 AS q, temperature_2m + 273.15 AS k FROM weather),
      y AS (SELECT *, q * pressure_msl * 100 / (0.622 + 0.378 * q) AS e, exp(9.550426 - 5723.265 / k + 3.53068 * ln(k) - 0.00728332 * k) AS ice,
        exp(54.842763 - 6763.22 / k - 4.21 * ln(k) + 0.000367 * k + tanh(0.0415 * (k - 218.8)) * (53.878 - 1331.22 / k - 9.44523 * ln(k) + 0.014025 * k)) AS wat,
        CASE WHEN k <= 250.16 THEN 0 WHEN k >= 273.16 THEN 1 ELSE ((k - 250.16) / 23.0) ** 2 END AS liq,
        {_TET('t')} - {_TET('d')} AS vp, ({_TET('t - 4')} + {_TET('t + 4')}) / 2 * (1 - rh / 100) AS vpd FROM x)
      SELECT {_K}, {_r(_CLAMP(f"100 * exp({_MAG('d')} - {_MAG('t')})", 0, 100))} AS rh, {_r('243.04 * z / (17.625 - z)')} AS dew, {_r('243.04 * zd / (17.625 - zd)')} AS dew_daily,
      {_r(_CLAMP('100 * e / (liq * wat + (1 - liq) * ice)', 0, 100))} AS rh_specific,
      {_r('least(t, t * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t + rh) - atan(rh - 1.676331) + 0.00391838 * power(rh, 1.5) * atan(0.023101 * rh) - 4.686035)')} AS wet_bulb,
      {_r('greatest(vp, 0)')} AS deficit, {_r('vpd')} AS deficit_daily,
      {_r('t + 0.348 * (rh / 100 * 6.105 * exp(17.27 * t / (237.7 + t))) - 0.7 * 2.25 + 0.7 * greatest(0.1 * (shortwave_radiation - 550), 0) / 12.25 - 4.25')} AS apparent,
      {_r(f"CASE WHEN precipitation > 1 THEN least(80 + precipitation * 2, 100) ELSE {_CLAMP('(t - 5) / 10', 0, 1)} * {_CLAMP('1 - (greatest(vp, 0) - 0.1) * 1.25', 0, 1)} * 100 END")} AS wetness,
      {_r(f"CASE WHEN precipitation > 1 THEN least(80 + precipitation * 2, 100) ELSE {_CLAMP('(t - 5) / 10', 0, 1)} * {_CLAMP('1 - (vpd - 0.1) * 1.25', 0, 1)} * 100 END")} AS wetness_daily FROM y""",
    "pressure_and_density": f"""WITH {T.WEATHER}, x AS (SELECT *, temperature_2m AS t, pressure_msl AS p, elevation AS h, pressure_msl / {_BAR('temperature_2m', 'elevation')} AS sp FROM weather),
      y AS (SELECT *, power(sp / p, 0.1902666690786014) AS r, relative_humidity_2m / 100 * 610.5 * exp(17.27 * t / (237.7 + t)) AS e FROM x)
      SELECT {_K}, {_r('sp', 4)} AS sp, {_r(f"sp * {_BAR('t', 'h')}", 4)} AS msl, {_r('153.846 * (t + 273.15) * (1 - r) / r', 4)} AS height, {_r('-1e5 / 2.25577 * (power(p / 1013.25, 1 / 5.25588) - 1)', 4)} AS altitude,
      {_r('1013.25 * power(1 - 2.25577e-5 * h, 5.25588)', 4)} AS pressure_at, {_r('(sp * 100 - e) / (287.058 * (t + 273.15)) + e / (461.495 * (t + 273.15))', 4)} AS density,
      {_r('-(precipitation / 10) / (85000.0 / (287.058 * (t + 273.15)) * 9.80665)', 4)} AS vertical_velocity,
      {_r('CASE WHEN cloud_cover / 100 < 0.5 THEN -999 ELSE 153.846 * (t + 273.15) * (1 - r) / r END', 4)} AS model_height FROM y""",
    "evapotranspiration": f"""WITH {T.WEATHER}, x AS (SELECT *, temperature_2m AS t, shortwave_radiation AS s, elevation AS h, relative_humidity_2m AS rh, {3.0 * _F2!r} AS u2, 0.000665 * 101.3 * power((293 - 0.0065 * elevation) / 293, 5.26) AS g,
        4098 * {_TET('temperature_2m')} / power(temperature_2m + 237.3, 2) AS sl, {_TET('dew_point_2m')} AS ea, {_CLAMP(f"100 * exp({_MAG('dew_point_2m')} - {_MAG('temperature_2m')})", 0, 100)} AS rhd,
        ({_TET('temperature_2m - 5')} + {_TET('temperature_2m + 5')}) / 2 AS es FROM weather),
      y AS (SELECT *, CASE WHEN s * 1.4 <= 0 THEN 0.8 - 0.4 * rhd / 100 ELSE least(s / ((0.75 + 0.00002 * h) * s * 1.4), 1) END AS c,
        CASE WHEN line <> 3 THEN s / 40 ELSE 0.16 * sqrt(10.0) * s / 20 END AS rs, rh / 100 * es AS ead FROM x),
      z AS (SELECT *, s * 0.77 * 0.0864 / 24 - 0.20429166e-9 * power(t + 273.16, 4) * (0.34 - 0.14 * sqrt(ea)) * (1.35 * c - 0.35) AS rn,
        rs * 0.77 - 0.20429166e-9 * (power(t + 5 + 273.16, 4) + power(t - 5 + 273.16, 4)) / 2 * (0.34 - 0.14 * sqrt(ead)) * (1.35 * (CASE WHEN s / 20 <= 0 THEN 0.8 - 0.4 * {_CLAMP('rh', 0, 100)} / 100 ELSE least(rs / ((0.75 + 0.00002 * h) * s / 20), 1) END) - 0.35) AS rnd FROM y)
      SELECT {_K}, {_r(f"greatest((0.408 * sl * (rn - CASE WHEN s <= 0 THEN 0.5 * rn ELSE 0.1 * rn END) + g * 37 / (t + 273) * u2 * ({_TET('t')} - ea)) / (sl + g * (1 + 0.34 * u2)), 0)")} AS et0,
      {_r('greatest((0.408 * sl * rnd + g * 900 / (t + 273) * u2 * (es - ead)) / (sl + g * (1 + 0.34 * u2)), 0)')} AS et0_daily, {_r('greatest(s * 3600 / 2.5e6, 0)')} AS evapotranspiration FROM z""",
    "precipitation_phases": f"""WITH {T.WEATHER}, x AS (SELECT *, precipitation AS p, CASE WHEN temperature_2m < 0 THEN precipitation ELSE 0 END AS swe FROM weather)
      SELECT {_K}, {_r('swe')} AS swe, {_r('CASE WHEN cape <= elevation THEN p ELSE 0 END')} AS swe_by_line, {_r('swe * 0.7')} AS snow, {_r('greatest(p - swe - 0.5, 0)')} AS rain, {_r('p + swe + 0.1')} AS total,
      {_r(f"p * {_CLAMP('relative_humidity_2m * 1.5 - 20', 0, 100)} / 100")} AS frozen, {_r('CASE WHEN elevation > cape + 200 THEN p ELSE least(cloud_cover / 20 * 10 / 12, p) END')} AS we,
      {_r('cloud_cover / 250')} AS depth, {_r('cloud_cover * 2.5')} AS water, {_r('CASE WHEN cape <= elevation AND temperature_2m - 20 < 0 THEN elevation + (temperature_2m - 20) / 0.007 ELSE cape END')} AS snow_height FROM x""",
    "clouds": f"""WITH {T.WEATHER} SELECT {_K}, """
    + ", ".join(f"{_r(e)} AS {n}" for e, n in (
        ("100 * greatest(1 - sqrt(greatest(1 - relative_humidity_2m / 100, 0) / (1 - (0.7 + 0.2 * exp(1 - power(1013.25 / 850, 4))))), 0)", "cover_850"),
        ("greatest(" + ", ".join(f"100 * greatest(1 - sqrt(greatest(1 - (relative_humidity_2m + {d}) / 100, 0) / (1 - (0.7 + 0.2 * exp(1 - power(1013.25 / {p}, 4))))), 0)" for p, d in ((1000, 0), (925, 2), (850, 5))) + ", 0)", "cover_low"),
        ("least(cloud_cover * 0.9 + cloud_cover / 2 * 0.6 + (100 - cloud_cover) * 0.3, 100)", "total"),
    ))
    + " FROM weather",
    "weather_codes": f"""WITH {T.WEATHER}, x AS (SELECT *, precipitation AS p, temperature_2m AS t, CASE WHEN temperature_2m < 0 THEN precipitation * 0.7 ELSE 0 END AS sn, least(abs(lat), 30) / 30 AS tr, relative_humidity_2m * 2 AS cin, line * 4.0 AS gust FROM weather),
      y AS (SELECT *, CAST(coalesce({_class_sql('sn', codes.SNOW, 0.01)}, {_class_sql('p', codes.DRIZZLE_AND_RAIN, 0.01)}, CASE WHEN elevation * 4 <= 1000 THEN 45 END, {_class_sql('cloud_cover', codes.CLOUDS, 0)}) AS INTEGER) AS code,
        0.25 * {_CLAMP('(cape - 300) / (2200 + 1500 * (1 - tr))', 0, 1)} + 0.15 * CASE WHEN cin <= 15 THEN 1 ELSE {_CLAMP('1 - (cin - 15) / 135', 0, 1)} END
        + CASE WHEN p > 0 THEN 0.25 * {_CLAMP('p / 2 / (2 + 3 * (1 - tr))', 0, 1)} ELSE 0.15 * {_CLAMP('p / ((2 + 3 * (1 - tr)) * 1.6)', 0, 1)} END + 0.075 * {_CLAMP('(gust - 5) / 13', 0, 1)} AS sc,
        0.25 + 0.15 + 0.075 + CASE WHEN p > 0 THEN 0.25 ELSE 0.15 END AS wt FROM x),
      z AS (SELECT *, CASE WHEN p / 2 > 0.1 AND cape > 300 AND cin < 50 THEN least(sc / wt * 130, 100) ELSE sc / wt * 100 END * CASE WHEN p <= 0 THEN 0.7 ELSE 1 END * CASE WHEN cin > 100 THEN 0.3 ELSE 1 END
        * CASE WHEN cloud_cover >= 60 THEN 1 ELSE 0.6 + 0.4 * (cloud_cover - 30) / 30 END * (0.8 + 0.2 * tr) AS st FROM y)
      SELECT {_K}, code, {_r(f"CASE WHEN cape <= 10 OR cloud_cover < 30 OR cin > 250 THEN 0 ELSE {_CLAMP('st', 0, 100)} END")} AS storm,
      CAST(CASE WHEN p - 1 <= 0 AND code IN ({', '.join(map(str, codes.PRECIPITATION_CODES))}) THEN 3 WHEN t - 2 >= 2 THEN CASE code WHEN 71 THEN 61 WHEN 73 THEN 63 WHEN 75 THEN 65 ELSE code END
        WHEN t - 2 < -1 THEN CASE code WHEN 61 THEN 71 WHEN 63 THEN 73 WHEN 65 THEN 75 ELSE code END ELSE code END AS INTEGER) AS corrected,
      CAST(CASE WHEN t > 0 THEN CASE code WHEN 71 THEN 61 WHEN 73 THEN 63 WHEN 75 THEN 65 ELSE code END WHEN t < 0 THEN CASE code WHEN 61 THEN 71 WHEN 63 THEN 73 WHEN 65 THEN 75 ELSE code END ELSE code END AS INTEGER) AS cut FROM z""",
    "air_quality": f"""WITH {T.WEATHER}, x AS (SELECT *, cape / 10 - 4 AS v FROM weather), y AS (SELECT *, {', '.join(f"{_position_sql('v', b)} * 20 AS e_{n}" for n, b in air.EUROPE.items())},
        {_position_sql('v', air.UNITED_STATES['ozone'])} AS o1, {_position_sql('(v / 2)', air.UNITED_STATES['ozone_8h'])} AS o8, {_position_sql('v', air.UNITED_STATES['sulphur_dioxide'])} AS s1, {_position_sql('(v * 2)', air.UNITED_STATES['sulphur_dioxide_24h'])} AS s24,
        {', '.join(f"{_position_sql('v', air.UNITED_STATES[n])} AS p_{n}" for n in ('pm2_5_24h', 'pm10_24h', 'nitrogen_dioxide', 'carbon_monoxide_8h'))} FROM x)
      SELECT {_K}, {', '.join(f"{_r(f'e_{n}')} AS eu_{n}" for n in air.EUROPE)}, {', '.join(f"{_r(_us_sql(f'p_{n}'))} AS us_{n}" for n in ('pm2_5_24h', 'pm10_24h', 'nitrogen_dioxide', 'carbon_monoxide_8h'))},
      {_r(_us_sql('greatest(o1, o8)'))} AS us_ozone, {_r(_us_sql('coalesce(s1, s24)'))} AS us_so2, CASE WHEN e_pm10 IS NOT NULL THEN {_r('greatest(e_nitrogen_dioxide, e_ozone, e_sulphur_dioxide, e_pm2_5, e_pm10)')} END AS overall FROM y""",
    "soil_and_growth": f"""WITH {T.WEATHER}, x AS (SELECT *, relative_humidity_2m / 200 AS m, {meteo.FIELD_CAPACITY}[part % 9] AS fc, {meteo.WILTING_POINT}[part % 9] AS wp FROM weather)
      SELECT {_K}, {_r('CASE WHEN part % 9 BETWEEN 1 AND 7 THEN (m - wp) / (fc - wp) END')} AS index, {_r('m * 0.07 + m / 2 * 0.21 + m / 3 * 0.72')} AS soil_0_100, {_r(f"{_CLAMP('temperature_2m - 5', 0, 25)} / 24")} AS growing FROM x""",
    "sun_position": f"WITH {T.PLACES}, {_SUN}, {_position_cte('sunt', 's')} SELECT place_id, hour, {_r('decl')} AS sun_declination, {_r('eqt')} AS sun_equation_of_time, {_r(_DIST)} AS distance FROM sun",
    "radiation": f"""WITH {T.PLACES}, {_SUN}, {_GEO}, {_CUT('g3', '').format(src='g2')},
      g4 AS (SELECT *, CASE WHEN hi > lo THEN greatest((b * (sin(hi) - sin(lo)) + a * (hi - lo)) / w, 0) ELSE 0 END AS mean, (b * (sin(hi) - sin(lo)) + a * (hi - lo)) / greatest(hi - lo, 0.001) AS lit, a + b * cos(h) AS now, (lo + hi) / 2 AS mid, (hi - lo) / 2 AS half,
        greatest(-(CASE WHEN rise = pi() THEN rise ELSE rise - radians(3) END), h - w) AS lo3, least(CASE WHEN rise = pi() THEN rise ELSE rise - radians(3) END, h) AS hi3 FROM g3),
      g5 AS (SELECT *, 1367.7 * mean / r2 AS pr, a + b * cos(mid - half * 0.77459667) AS m1, a + b * cos(mid) AS m2, a + b * cos(mid + half * 0.77459667) AS m3, (b * (sin(hi3) - sin(lo3)) + a * (hi3 - lo3)) / greatest(hi3 - lo3, 0.001) AS lit3 FROM g4),
      g6 AS (SELECT *, pr * 0.5 AS dr, pr * 0.7 AS sw, CASE WHEN hi > lo THEN lit ELSE 0 END AS z FROM g5),
      g7 AS (SELECT *, sw / least(z * 1367.7, 0.95 * 1367.7) AS k, acos(least(greatest(z, -1), 1)) AS i, dr / CASE WHEN lit <= 0.0001 THEN 1 ELSE lit END AS dn, 3600 * (hi - lo) / w AS day FROM g6)
      SELECT place_id, hour, {_r('pr', 3)} AS potential_radiation, {_r('1367.7 * greatest(now, 0) / r2', 3)} AS potential_radiation_instant,
      {_r("CASE WHEN hi > lo AND NOT (a < 0 AND -a / b >= 1) THEN 1098 * half * (5 / 9 * (CASE WHEN m1 < 0.005 THEN 0 ELSE m1 * exp(-0.057 / m1) END + CASE WHEN m3 < 0.005 THEN 0 ELSE m3 * exp(-0.057 / m3) END) + 8 / 9 * CASE WHEN m2 < 0.005 THEN 0 ELSE m2 * exp(-0.057 / m2) END) / (r2 * w) ELSE 0 END", 3)} AS clear_sky_radiation,
      {_r('CASE WHEN mean > 0 AND now > 0 THEN now / mean ELSE 0 END', 3)} AS instant_factor,
      {_r('CASE WHEN dr <= 0 OR hi3 <= lo3 THEN 0 ELSE dr / greatest(lit3, sin(radians(3))) END', 3)} AS direct_normal_irradiance, {_r('CASE WHEN dr <= 0 OR now <= 0 THEN 0 ELSE dr / greatest(now, sin(radians(3))) END', 3)} AS direct_normal_irradiance_instant,
      {_r('CASE WHEN dr <= 0 OR hi <= lo THEN 0 ELSE least(greatest(dn - 60, 0) / 120 * day, day) END', 3)} AS sunshine_duration,
      {_r('CASE WHEN z <= 5 / 1367.7 THEN sw ELSE least((0.718 + 1.58 * k + 0.991 * i - 5.084 * k * k - 2.11 * k * i - 1.16 * i * i + 2.918 * k * k * k + 1.307 * k * k * i + 0.762 * k * i * i + 0.432 * i * i * i) * sw, sw) END', 3)} AS diffuse_radiation FROM g7""",
    "sunrise_sunset": f"""WITH {T.PLACES}, d AS (SELECT *, CAST(1704067200 + (place_id * 17 % 366) * 86400 AS DOUBLE) AS m0, 12 - lon / 15 AS noon FROM places), {_position_cte('d', '(m0 + floor(noon * 3600))')},
      a AS (SELECT *, -(sin(radians(0.83333)) + sin(radians(lat)) * sin(radians(decl))) / (cos(radians(lat)) * cos(radians(decl))) AS arg FROM sun),
      b AS (SELECT *, degrees(acos(least(greatest(arg, -1), 1))) / 15 AS half FROM a)
      SELECT place_id, to_timestamp(CASE WHEN arg > 1 OR arg < -1 THEN m0 ELSE m0 + trunc((noon - half - eqt / 60) * 3600) END)::TIMESTAMP AS sunrise,
      to_timestamp(CASE WHEN arg > 1 THEN m0 WHEN arg < -1 THEN m0 + 86400 ELSE m0 + trunc((noon + half - eqt / 60) * 3600) END)::TIMESTAMP AS sunset,
      {_r('CASE WHEN arg > 1 THEN 0 WHEN arg < -1 THEN 86400 ELSE half * 7200 END', 2)} AS daylight_duration FROM b""",
    "derived_outputs": f"""WITH {_UV.replace('SELECT ' + _K + ',', 'SELECT *,')}, d AS (SELECT *, {_CLAMP(f"100 * exp({_MAG('dew_point_2m')} - {_MAG('temperature_2m')})", 0, 100)} AS rh, pressure_msl / {_BAR('temperature_2m', 'elevation')} AS sp,
        CASE WHEN temperature_2m < 0 THEN precipitation ELSE 0 END AS swe FROM s),
      e AS (SELECT *, rh / 100 * 610.5 * exp(17.27 * temperature_2m / (237.7 + temperature_2m)) AS vp FROM d)
      SELECT {_K}, {_r('speed')} AS wind_speed_10m, {_r('direction')} AS wind_direction_10m, {_r(f'speed * {_F80!r}')} AS wind_speed_80m, {_r('rh')} AS relative_humidity_2m,
      {_r('temperature_2m + 0.348 * vp / 100 - 0.7 * speed * 0.75 + 0.7 * greatest(0.1 * (shortwave_radiation - 550), 0) / (speed * 0.75 + 10) - 4.25')} AS apparent_temperature,
      {_r('sp')} AS surface_pressure, {_r('(sp * 100 - vp) / (287.058 * (temperature_2m + 273.15)) + vp / (461.495 * (temperature_2m + 273.15))')} AS air_density,
      {_r('swe * 0.7')} AS snowfall, {_r('greatest(precipitation - swe, 0)')} AS rain,
      CAST(coalesce({_class_sql('swe * 0.7', codes.SNOW, 0.01)}, {_class_sql('precipitation', codes.DRIZZLE_AND_RAIN, 0.01)}, {_class_sql('cloud_cover', codes.CLOUDS, 0)}) AS INTEGER) AS weather_code,
      {_r('greatest(shortwave_radiation - direct_radiation, 0)')} AS diffuse_radiation, {_r(f"greatest({_TET('temperature_2m')} - {_TET('dew_point_2m')}, 0)")} AS vapour_pressure_deficit FROM e""",
    "is_day": f"""WITH {T.PLACES}, {_SUN}, l AS (SELECT *, floor(lon / 15 * 3600) AS sh FROM sunt), m AS (SELECT *, floor((s + sh) / 86400) * 86400 - sh AS m0, 12 - lon / 15 AS noon FROM l), {_position_cte('m', '(m0 + floor(noon * 3600))')},
      a AS (SELECT *, -(sin(radians(0.83333)) + sin(radians(lat)) * sin(radians(decl))) / (cos(radians(lat)) * cos(radians(decl))) AS arg FROM sun), b AS (SELECT *, degrees(acos(least(greatest(arg, -1), 1))) / 15 AS half FROM a)
      SELECT place_id, CAST(hour AS INTEGER) AS hour, CAST(CASE WHEN arg > 1 THEN 0 WHEN arg < -1 THEN 1 WHEN s > m0 + trunc((noon - half - eqt / 60) * 3600) AND s < m0 + trunc((noon + half - eqt / 60) * 3600) THEN 1 ELSE 0 END AS INTEGER) AS is_day FROM b""",
}
