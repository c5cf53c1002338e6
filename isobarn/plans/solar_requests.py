"""Requests for outputs of the sun and panels (Q1 with D43-D48, D54, D16) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobarn.operators import facade
from isobarn.plans import tables as T
from isobarn.plans.datasets import _RND, GRID, _models, _ranges
from isobarn.plans.derived import _DEC, _F2, _GEO, _MAG, _TET

NAMES = {"view": "temperature_2m", "click": "dew_point_2m", "purchase": "shortwave_radiation", "error": "wind_speed_10m"}
#: Values of events are small; radiation is so many times as large, dew points are below the temperature.
SCALED = {"shortwave_radiation": (8.0, 0.0), "dew_point_2m": (0.5, -5.0), "wind_speed_10m": (0.2, 0.0)}
OUTPUTS = [
    "is_day", "sunshine_duration", "direct_radiation", "diffuse_radiation", "direct_normal_irradiance", "global_tilted_irradiance", "terrestrial_radiation", "terrestrial_radiation_instant", "shortwave_radiation_instant", "direct_radiation_instant",
    "diffuse_radiation_instant", "direct_normal_irradiance_instant", "global_tilted_irradiance_instant", "shortwave_radiation_clear_sky", "et0_fao_evapotranspiration",
]
DAYS = ["sunshine_duration_sum", "et0_fao_evapotranspiration_sum", "shortwave_radiation_sum"]


def _found(spark, sf_dir, **sections):
    from isobarn.plans.datasets import NAMES as own

    back = F.create_map(*[F.lit(x) for k, v in own.items() if k in NAMES for x in (v, NAMES[k])])
    low = _models(spark, sf_dir)["low"].withColumn("variable", back[F.col("variable")]).where("variable IS NOT NULL")
    value = F.col("value")
    for name, (factor, shift) in SCALED.items():
        value = F.when(F.col("variable") == name, F.col("value") * factor + shift).otherwise(value)
    request = facade.Request(**sections, tilt=30.0, azimuth=-45.0, steps=1)
    return facade.forecast(_ranges(spark, sf_dir), {"low": low.withColumn("value", value)}, {"low": GRID}, request, available=list(NAMES.values()))


def forecast_solar(spark, sf_dir):
    """Hourly outputs that need the sun's place besides the model's variables; all radiation comes from the global one."""
    return T.tidy(_found(spark, sf_dir, hourly=OUTPUTS)["hourly"], 3)


def forecast_solar_daily(spark, sf_dir):
    return T.tidy(_found(spark, sf_dir, daily=DAYS)["daily"], 2)


QUERIES = {f.__name__: f for f in (forecast_solar, forecast_solar_daily)}

_r = T.r
_sum = lambda a, b: f"(b * (sin({b}) - sin({a})) + a * ({b} - {a}))"
_HALF = "(1 + cos(radians(30))) / 2"
_LIGHT = lambda m: f"CASE WHEN {m} < 0.005 THEN 0 ELSE {m} * exp(-0.057 / {m}) END"
_COLUMNS = ", ".join(f"max({'x' if v not in SCALED else f'x * {SCALED[v][0]!r} + {SCALED[v][1]!r}'}) FILTER (v = '{k}') AS {v}" for k, v in NAMES.items())
_BASE = f"""{T.MODELS}, {T.PLACES}, lo AS (SELECT location_id % 72 AS l, variable AS v, valid_time AS tm, avg(value) AS x FROM low GROUP BY ALL),
  c AS (SELECT place_id, elevation, utc_offset_seconds AS off, CAST(least(greatest({_RND('((lat + 75) / 30)')}, 0), 5) AS BIGINT) AS y, CAST(least(greatest({_RND('((lon + 165) / 30)')}, 0), 11) AS BIGINT) AS x FROM places),
  p AS (SELECT place_id, tm, any_value(off) AS off, any_value(elevation) AS elevation, any_value(c.y * 30.0 - 75) AS lat, any_value(c.x * 30.0 - 165) AS lon, {_COLUMNS.replace('x *', 'lo.x *').replace('max(x)', 'max(lo.x)')} FROM lo JOIN c ON lo.l = c.y * 12 + c.x
    WHERE v IN ({", ".join(f"'{k}'" for k in NAMES)}) GROUP BY place_id, tm),
  sunt AS (SELECT *, CAST(epoch(tm) AS DOUBLE) AS s FROM p), {_GEO},
  g3 AS (SELECT *, greatest(-rise, h - w) AS lo, least(rise, h) AS hi, a + b * cos(h) AS now, greatest(-(CASE WHEN rise = pi() THEN rise ELSE rise - radians(3) END), h - w) AS lo3, least(CASE WHEN rise = pi() THEN rise ELSE rise - radians(3) END, h) AS hi3, {_DEC} AS dec0 FROM g2),
  g4 AS (SELECT *, CASE WHEN lat = 0 THEN 0 ELSE dec0 END AS dec, CASE WHEN hi > lo THEN greatest({_sum('lo', 'hi')} / w, 0) ELSE 0 END AS mean, {_sum('lo', 'hi')} / greatest(hi - lo, 0.001) AS lit, {_sum('lo3', 'hi3')} / greatest(hi3 - lo3, 0.001) AS lit3, greatest(hi3 - lo3, 0.001) AS wd,
    (lo + hi) / 2 AS mid, (hi - lo) / 2 AS half, shortwave_radiation AS sw FROM g3),
  g5 AS (SELECT *, 1367.7 * mean / r2 AS pr, CASE WHEN mean > 0 AND now > 0 THEN now / mean ELSE 0 END AS f, CASE WHEN hi > lo THEN lit ELSE 0 END AS z, least(greatest(lit3, -1), 1) AS z3, a + b * cos(mid - half * 0.77459667) AS m1, a + b * cos(mid) AS m2, a + b * cos(mid + half * 0.77459667) AS m3,
    atan2(-(cos(dec) * (cos(lo3) - cos(hi3))) / wd, cos(radians(lat)) * sin(dec) - sin(radians(lat)) * cos(dec) * (sin(hi3) - sin(lo3)) / wd) AS azi FROM g4),
  g6 AS (SELECT *, acos(z3) AS zen, sw / greatest(least(z * 1367.7, 0.95 * 1367.7), 1) AS k, acos(least(greatest(z, -1), 1)) AS i FROM g5),
  g7 AS (SELECT *, CASE WHEN z <= 5 / 1367.7 THEN sw WHEN sw IS NOT NULL THEN least((0.718 + 1.58 * k + 0.991 * i - 5.084 * k * k - 2.11 * k * i - 1.16 * i * i + 2.918 * k * k * k + 1.307 * k * k * i + 0.762 * k * i * i + 0.432 * i * i * i) * sw, sw) END AS df FROM g6),
  g8 AS (SELECT *, CASE WHEN sw IS NOT NULL THEN greatest(sw - df, 0) END AS dr FROM g7),
  g9 AS (SELECT *, CASE WHEN dr IS NULL THEN NULL WHEN dr <= 0 OR hi3 <= lo3 THEN 0 ELSE dr / greatest(lit3, sin(radians(3))) END AS dni,
    CASE WHEN dr + df IS NULL THEN NULL WHEN dr + df <= 0 OR hi3 <= lo3 THEN 0 ELSE CASE WHEN z3 <= 0.0001 THEN dr ELSE dr / z3 END * greatest(cos(zen) * cos(radians(30)) + sin(zen) * sin(radians(30)) * cos(azi - pi() - radians(-45)), 0) + {_HALF} * df + (dr + df) * 0.2 * (1 - {_HALF}) END AS gti,
    CASE WHEN dr IS NULL THEN NULL WHEN dr <= 0 OR hi <= lo THEN 0 ELSE least(greatest(CASE WHEN lit <= 0.0001 THEN dr ELSE dr / lit END - 60, 0) / 120 * (3600 * (hi - lo) / w), 3600 * (hi - lo) / w) END AS sun,
    temperature_2m AS tt, {_TET('temperature_2m')} AS es, {_TET('dew_point_2m')} AS ea, 0.000665 * 101.3 * power((293 - 0.0065 * elevation) / 293, 5.26) AS gam, wind_speed_10m * {_F2!r} AS u2,
    CASE WHEN pr <= 0 THEN 0.8 - 0.4 * least(greatest(least(greatest(100 * exp({_MAG('dew_point_2m')} - {_MAG('temperature_2m')}), 0), 100), 0), 100) / 100 WHEN sw IS NOT NULL THEN least(sw / ((0.75 + 0.00002 * elevation) * pr), 1) END AS share FROM g8),
  g10 AS (SELECT *, 4098 * es / power(tt + 237.3, 2) AS sl, sw * 0.77 * 0.0864 / 24 - 0.20429166e-9 * power(tt + 273.16, 4) * (0.34 - 0.14 * sqrt(ea)) * (1.35 * share - 0.35) AS net FROM g9),
  g11 AS (SELECT *, (0.408 * sl * (net - CASE WHEN sw <= 0 THEN 0.5 * net ELSE 0.1 * net END) + gam * 37 / (tt + 273) * u2 * (es - ea)) / (sl + gam * (1 + 0.34 * u2)) AS et FROM g10),
  g12 AS (SELECT *, CASE WHEN et IS NOT NULL THEN greatest(et, 0) END AS et0 FROM g11)"""
_DAY_SQL = """dl AS (SELECT place_id, tm, lat, lon, s, floor(lon / 15 * 3600) AS sh FROM sunt), dm AS (SELECT *, floor((s + sh) / 86400) * 86400 - sh AS m0, 12 - lon / 15 AS noon FROM dl)"""


def _is_day() -> str:
    from isobarn.plans.derived import _position_cte

    cte = _position_cte("dm", "(m0 + floor(noon * 3600))")
    for a in ("q1", "q2", "q3", "q4"):
        cte = cte.replace(f"{a} AS", f"d{a} AS").replace(f"FROM {a}", f"FROM d{a}")
    cte = cte.replace("sun AS (", "dsun AS (")
    return f"""{_DAY_SQL}, {cte}, da AS (SELECT *, -(sin(radians(0.83333)) + sin(radians(lat)) * sin(radians(decl))) / (cos(radians(lat)) * cos(radians(decl))) AS arg FROM dsun), db AS (SELECT *, degrees(acos(least(greatest(arg, -1), 1))) / 15 AS half FROM da),
      dd AS (SELECT place_id, tm, CAST(CASE WHEN arg > 1 THEN 0 WHEN arg < -1 THEN 1 WHEN s > m0 + trunc((noon - half - eqt / 60) * 3600) AND s < m0 + trunc((noon + half - eqt / 60) * 3600) THEN 1 ELSE 0 END AS INTEGER) AS is_day FROM db)"""


ORACLE = {
    "forecast_solar": f"""WITH {_BASE}, {_is_day()}
      SELECT place_id, tm AS valid_time, is_day, {_r('sun', 3)} AS sunshine_duration, {_r('dr', 3)} AS direct_radiation, {_r('df', 3)} AS diffuse_radiation, {_r('dni', 3)} AS direct_normal_irradiance, {_r('gti', 3)} AS global_tilted_irradiance,
      {_r('pr', 3)} AS terrestrial_radiation, {_r('1367.7 * greatest(now, 0) / r2', 3)} AS terrestrial_radiation_instant, {_r('sw * f', 3)} AS shortwave_radiation_instant, {_r('dr * f', 3)} AS direct_radiation_instant, {_r('df * f', 3)} AS diffuse_radiation_instant,
      {_r('dni * f', 3)} AS direct_normal_irradiance_instant, {_r('gti * f', 3)} AS global_tilted_irradiance_instant,
      {_r(f"CASE WHEN hi > lo AND NOT (a < 0 AND -a / b >= 1) THEN 1098 * half * (5 / 9 * ({_LIGHT('m1')} + {_LIGHT('m3')}) + 8 / 9 * {_LIGHT('m2')}) / (r2 * w) ELSE 0 END", 3)} AS shortwave_radiation_clear_sky, {_r('et0', 3)} AS et0_fao_evapotranspiration
      FROM g12 JOIN dd USING (place_id, tm)""",
    "forecast_solar_daily": f"""WITH {_BASE}, q AS (SELECT *, CAST(tm + to_seconds(off) AS DATE) AS day FROM g12)
      SELECT place_id, day, {_r('CASE WHEN count(sun) = count(*) THEN sum(sun) END', 2)} AS sunshine_duration_sum, {_r('CASE WHEN count(et0) = count(*) THEN sum(et0) END', 2)} AS et0_fao_evapotranspiration_sum, {_r('CASE WHEN count(sw) = count(*) THEN round(sum(sw) * 0.0036, 2) END', 2)} AS shortwave_radiation_sum FROM q GROUP BY place_id, day""",
}
