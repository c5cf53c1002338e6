"""Radiation between and inside series: solar resampling, solar gap filling and scan times (W6, W11, W22) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobarn.functions import solar
from isobarn.operators import fill, resample
from isobarn.plans import tables as T
from isobarn.plans.derived import _CUT, _GEO
from isobarn.plans.solar_requests import _LIGHT

LOC = ["location_id"]


def _height(seconds):
    """A sun that rises at five and sets at nineteen, as a share of the solar constant."""
    return F.greatest(F.lit(0.0), (7 - F.abs(F.pmod(seconds, F.lit(86400)) / 3600 - 12)) / 8)


def upsample_solar(spark, sf_dir):
    own = fill.fill_linear(T.regular(spark, sf_dir), LOC)
    low = own.withColumns({"value": F.col("value") * _height(F.unix_seconds("valid_time")), "light": _height(F.unix_seconds("valid_time"))})
    fine = low.select("location_id", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("j"), "valid_time").select("location_id", F.timestamp_seconds(F.unix_seconds("valid_time") + F.col("j") * 1200).alias("valid_time"))
    high = fine.withColumn("fine_light", _height(F.unix_seconds("valid_time")))
    return T.tidy(resample.upsample_solar(low, "light", high, "fine_light", 3600, 1200, None, LOC).drop("light"))


def filled_radiation(spark, sf_dir):
    """Three-hourly means of a day's radiation at every place, filled to hours."""
    p = T.places(spark, sf_dir).select("place_id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("hour"))
    p = p.withColumn("valid_time", F.timestamp_seconds(F.lit(1704067200) + (F.col("place_id") * 17 % 366) * 86400 + F.col("hour") * 3600))
    clear = solar.clear_sky_radiation(p, "valid_time", "lat", "lon", 3600)
    held = F.when(F.col("hour") % 3 == 2, F.col("clear_sky_radiation") * (0.3 + F.col("place_id") % 7 / 10))
    return T.tidy(fill.fill_solar(clear.withColumn("value", held), "clear_sky_radiation", 3600, True, ["place_id"]).select("place_id", "hour", "value"), 3)


def scan_times(spark, sf_dir):
    """Events as scans: the sun's mean height over the hour and at scan time from the time of day."""
    h = T.regular(spark, sf_dir)
    s = F.unix_seconds("valid_time")
    h = h.withColumns({"scan": F.when(F.col("location_id") % 10 > 0, 0.25), "mean": _height(s - 1800) - 0.001, "now": _height(s - 900), "value": F.when(F.col("value") > 12, F.col("value")).when(F.col("value") > 6, 0.0)})
    return T.tidy(fill.backfill_scan_time(h, "scan", "mean", "now", 0.004, LOC).select("location_id", "valid_time", "value"))


QUERIES = {f.__name__: f for f in (upsample_solar, filled_radiation, scan_times)}

_r = T.r
_H = lambda s: f"greatest(0.0::DOUBLE, (7 - abs((({s}) % 86400) / 3600 - 12)) / 8)"
_NEIGHBOURS = """n AS (SELECT *, epoch(valid_time) AS s, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN epoch(valid_time) END IGNORE NULLS) OVER b AS t0,
    last_value(value IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN value IS NOT NULL THEN epoch(valid_time) END IGNORE NULLS) OVER a AS t1 FROM regular
  WINDOW b AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY location_id ORDER BY valid_time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_LOW = 5 / 1367.7
_MEAN = lambda x, a, b: f"list_avg({x}[{a} + 2:{b} + 1])"
_CLEAR = lambda mean, a, b: f"CASE WHEN {_MEAN('s', a, b)} > {_LOW!r} THEN least(({mean}) / {_MEAN('s', a, b)}, {1367.7 * 0.95!r}) END"
_CURVE = "greatest((1 - f(t)) * (1 - f(t)) * (kb + m) / 2 + 2 * f(t) * (1 - f(t)) * m + f(t) * f(t) * (m + kd) / 2, 0) * s[t + 1]".replace("f(t)", "((t - b) / width)")
_SKY = f"""sunt AS (SELECT place_id, lat, lon, hour, CAST(1704067200 + (place_id * 17 % 366) * 86400 + hour * 3600 AS DOUBLE) AS s FROM (SELECT place_id, lat, lon, unnest(range(72)) AS hour FROM places)), {_GEO}, {_CUT('g3', '').format(src='g2')},
      g4 AS (SELECT *, (lo + hi) / 2 AS mid, (hi - lo) / 2 AS half FROM g3), g5 AS (SELECT *, a + b * cos(mid - half * 0.77459667) AS m1, a + b * cos(mid) AS m2, a + b * cos(mid + half * 0.77459667) AS m3 FROM g4),
      sky AS (SELECT place_id, hour, CASE WHEN hi > lo AND NOT (a < 0 AND -a / b >= 1) THEN 1098 * half * (5 / 9 * ({_LIGHT('m1')} + {_LIGHT('m3')}) + 8 / 9 * {_LIGHT('m2')}) / (r2 * w) ELSE 0 END AS light FROM g5)"""
ORACLE = {
    "filled_radiation": f"""WITH RECURSIVE {T.PLACES}, {_SKY}, src AS MATERIALIZED (SELECT place_id, hour, light, CASE WHEN hour % 3 = 2 THEN light * (0.3 + place_id % 7 / 10) END AS value FROM sky),
      h AS (SELECT place_id, 0 AS n, list(value ORDER BY hour) AS x, list(light ORDER BY hour) AS s FROM src GROUP BY place_id UNION ALL
        SELECT place_id, n + 1, x[1:b + 1] || CASE WHEN m IS NULL THEN list_transform(range(b + 1, c), lambda t: 0.0::DOUBLE) || x[c + 1:c + 1] WHEN x[c + 1] > 5 THEN list_transform(found, lambda y: CASE WHEN list_sum(found) > 5 THEN y * (x[c + 1] * len(found) / list_sum(found)) ELSE 0.0 END) ELSE found END || x[c + 2:], s FROM (
          SELECT *, list_transform(range(b + 1, c + 1), lambda t: {_CURVE}) AS found FROM (
            SELECT place_id, n, x, s, b, c, width, m, coalesce(kb0, m) AS kb, coalesce(kd0, m) AS kd FROM (
              SELECT *, coalesce(kc, kb0, kd0) AS m FROM (SELECT place_id, n, x, s, b, c, width, kc, coalesce(kb1, kc) AS kb0, coalesce(kd1, kc) AS kd0 FROM (
                SELECT *, CASE WHEN x[c + 1] > 0 THEN {_CLEAR('x[c + 1]', 'b', 'c')} END AS kc, CASE WHEN b - width >= 0 THEN {_CLEAR(_MEAN('x', '(b - width)', 'b'), '(b - width)', 'b')} END AS kb1,
                  CASE WHEN c + width < 72 THEN {_CLEAR('x[c + width + 1]', 'c', '(c + width)')} END AS kd1 FROM (SELECT *, 3 * n - 1 AS b, 3 * n + 2 AS c, 3 AS width FROM h WHERE n < 24))))))),
      l AS (SELECT place_id, x FROM h WHERE n = 24)
      SELECT place_id, CAST(hour AS INTEGER) AS hour, {_r('x[hour + 1]', 3)} AS value FROM src JOIN l USING (place_id)""",
    "upsample_solar": f"""WITH {T.REGULAR}, {_NEIGHBOURS}, l AS (SELECT location_id, CAST(s AS BIGINT) AS s, {_H('CAST(s AS BIGINT)')} AS light, coalesce(value, v1 * ((s - t0) / (t1 - t0)) + v0 * (1 - (s - t0) / (t1 - t0))) * {_H('CAST(s AS BIGINT)')} AS v FROM n),
      k AS (SELECT *, CASE WHEN light > {_LOW!r} THEN least(v / light, {1367.7 * 0.95!r}) END AS k FROM l),
      m AS (SELECT *, coalesce(lag(k) OVER w, CASE WHEN lag(v) OVER w IS NULL THEN k END) AS a, k AS b, lead(k) OVER w AS c, lead(k, 2) OVER w AS d, lead(v) OVER w AS vc FROM k WINDOW w AS (PARTITION BY location_id ORDER BY s)),
      q AS (SELECT location_id, s, v, vc, coalesce(a, b, c, d) AS a, coalesce(b, a, c, d) AS b, coalesce(c, b, d, a) AS c, coalesce(d, c, b, a) AS d FROM m),
      j AS (SELECT *, s + j * 1200 AS t, (j + 1) / 3 AS f, {_H('s + j * 1200')} AS sun FROM q, (SELECT unnest([-1, 0, 1]) AS j)),
      x AS (SELECT *, (b + f * ((c - a) / 2 + f * (a - 2.5 * b + 2 * c - d / 2 + f * ((d - a) / 2 + 1.5 * (b - c))))) * sun AS bent, (b * (1 - f) + c * f) * sun AS line FROM j)
      SELECT location_id, to_timestamp(t)::TIMESTAMP AS valid_time, {_r('CASE WHEN v IS NULL THEN NULL WHEN sun = 0 THEN 0 WHEN bent < 0 AND v >= 0 AND coalesce(vc, 0) >= 0 THEN line ELSE bent END')} AS value FROM x""",
    "scan_times": f"""WITH {T.REGULAR}, h AS (SELECT location_id, valid_time, location_id % 10 > 0 AS scan, {_H('CAST(epoch(valid_time) AS BIGINT) - 1800')} - 0.001 AS m, {_H('CAST(epoch(valid_time) AS BIGINT) - 900')} AS n, CASE WHEN value > 12 THEN value WHEN value > 6 THEN 0 END AS v FROM regular),
      k AS (SELECT *, CASE WHEN NOT scan THEN NULL WHEN m <= 0 THEN 'dark' WHEN (v IS NULL OR v = 0) AND m > 0.004 THEN 'lost' WHEN v IS NULL THEN NULL WHEN m <= 0.004 OR n <= 0.004 OR n / m < 0.05 THEN 'dark' ELSE 'good' END AS kind FROM h),
      l AS (SELECT *, last_value(CASE WHEN kind IS NOT NULL THEN {{'kind': kind, 'k': CASE WHEN n <> 0 THEN v / n END}} END IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k)
      SELECT location_id, valid_time, {_r("CASE WHEN kind = 'dark' THEN 0 WHEN kind = 'good' THEN v / n * m WHEN kind = 'lost' AND p.kind = 'good' THEN p.k * m ELSE v END")} AS value FROM l""",
}
