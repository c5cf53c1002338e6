"""Ingestion chains of families (S20 with S21, W14, W15, D7, D43, D60, D61, A12) on events as fields; the SQL has its factors written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobarn.plans import tables as T
from isobarn.plans.derived import _GEO, _MAG
from isobarn.sources import catalog
from isobarn.sources.chains import ingest

FIELDS = {
    "ecmwf_ifs025": {"view": "2t", "click": "2d", "purchase": "tp", "error": "ssrd", "signup": "msl"},
    "ecmwf_ifs025_ensemble": {"view": "2t", "purchase": "tp"},
    "ncep_gfs025": {"view": "TMP:2 m above ground", "click": "PRATE:surface", "purchase": "DSWRF:surface", "error": "SNOD:surface"},
    "dwd_icon": {"view": "tot_prec", "click": "aswdir_s", "purchase": "aswdifd_s", "error": "h_snow"},
    "geosphere_arome_austria": {"view": "U10M", "click": "V10M", "purchase": "RR_ACC", "error": "GLOB", "signup": "TCC"},
    "eumetsat_lsa_saf_msg_15min": {"view": "DSSF", "click": "FRACTION_DIFFUSE"},
}


def _ingested(spark, sf_dir, domain: str):
    own = catalog.domain_of(domain)
    names = F.create_map(*[F.lit(x) for pair in FIELDS[domain].items() for x in pair])
    member = (F.col("event_id") % 3 if own.members > 1 else F.lit(0)).cast("int")
    e = T.table(spark, sf_dir, "events").where(F.col("event_type").isin(list(FIELDS[domain])))
    keys = [names[F.col("event_type")].alias("variable"), F.date_trunc("day", "ts").alias("run_time"), (F.col("user_id") * 37 % own.grid.nx).alias("x"), (F.col("user_id") * 11 % own.grid.ny).alias("y"), member.alias("member"), F.date_trunc("hour", "ts").alias("valid_time")]
    found = ingest(e.groupBy(*keys).agg(F.avg("value").alias("value")), domain)
    return T.tidy(found.withColumn("location_id", F.col("location_id").cast("bigint")), 4)


QUERIES = {f"ingested_chain_{d}": (lambda spark, sf_dir, d=d: _ingested(spark, sf_dir, d)) for d in FIELDS}

_r = T.r


def _sql(domain: str, nx: int, ny: int, turned: tuple[str, str], values: dict[str, tuple[str, str]], outputs: dict[str, str], members: bool = False, more: str = "") -> str:
    """values: event type -> (column, SQL of the value with v for the field, p for the one before in the series and n for its number).
    outputs: variable -> SQL over those columns."""
    own = " ".join(f"WHEN '{k}' THEN {x}" for k, (_, x) in values.items())
    wide = ", ".join(f"max(value) FILTER (event_type = '{k}') AS {c}" for k, (c, _) in values.items())
    rows = " UNION ALL ".join(f"SELECT location_id, member, run_time, valid_time, '{o}' AS variable, {x} AS value FROM q WHERE ({x}) IS NOT NULL" for o, x in outputs.items())
    base = f"""WITH e AS (SELECT user_id * 37 % {nx} AS x, user_id * 11 % {ny} AS y, event_type, {'CAST(event_id % 3 AS INTEGER)' if members else '0'} AS member, date_trunc('day', ts) AS run_time, date_trunc('hour', ts) AS valid_time, avg(value) AS v FROM events
        WHERE event_type IN ({', '.join(f"'{k}'" for k in values)}) GROUP BY ALL),
      s AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY x, y, event_type, member, run_time ORDER BY valid_time)),
      t AS (SELECT CAST({turned[1]} * {nx} + {turned[0]} AS BIGINT) AS location_id, member, run_time, valid_time, event_type, CASE event_type {own} END AS value FROM s),
      {'q0' if more else 'q'} AS (SELECT location_id, member, run_time, valid_time, {wide} FROM t GROUP BY ALL){more}, o AS ({rows})"""
    if not members:
        return f"{base} SELECT '{domain}' AS domain, location_id, member, run_time, valid_time, variable, {_r('value', 4)} AS value FROM o"
    return f"""{base}, a AS (SELECT * FROM o UNION ALL SELECT location_id, -1, run_time, valid_time, variable, avg(value) FROM o GROUP BY ALL UNION ALL SELECT location_id, -2, run_time, valid_time, variable, stddev_samp(value) FROM o GROUP BY ALL)
      SELECT '{domain}' AS domain, location_id, CAST(member AS INTEGER) AS member, run_time, valid_time, variable, {_r('value', 4)} AS value FROM a"""


_SAME = ("x", "y")
_HUMIDITY = f"least(greatest(100 * exp({_MAG('d')} - {_MAG('t')}), 0), 100)"
#: The satellite's grid is 0.05 degrees from 80 south and 80 west; steps are a quarter of an hour.
_SCAN = f""", sunt AS (SELECT *, -80 + (location_id // 3201) * 0.05 AS lat, -80 + (location_id % 3201) * 0.05 AS lon, CAST(epoch(valid_time) AS DOUBLE) AS s FROM q0), {_GEO.replace('radians(15) AS w', 'radians(3.75) AS w')},
      g3 AS (SELECT *, greatest(-rise, h - w) AS lo, least(rise, h) AS hi, a + b * cos(h) AS now FROM g2), g4 AS (SELECT *, CASE WHEN hi > lo THEN greatest((b * (sin(hi) - sin(lo)) + a * (hi - lo)) / w, 0) ELSE 0 END AS mean FROM g3),
      g5 AS (SELECT *, CASE WHEN mean > 0 AND now > 0 THEN now / mean ELSE 0 END AS f FROM g4), q AS (SELECT location_id, member, run_time, valid_time, CASE WHEN f < 0.05 THEN sw ELSE sw / f END AS sw, df FROM g5)"""
ORACLE = {
    "ingested_chain_ecmwf_ifs025": _sql("ecmwf_ifs025", 1440, 721, ("x", "(720 - y)"), {"view": ("t", "v - 273.15"), "click": ("d", "v - 273.15"), "purchase": ("tp", "(v - coalesce(p, 0)) * 1000"), "error": ("sw", "(v - coalesce(p, 0)) / 10800"), "signup": ("pr", "v * 0.01")},
        {"temperature_2m": "t", "dew_point_2m": "d", "precipitation": "tp", "shortwave_radiation": "sw", "pressure_msl": "pr", "relative_humidity_2m": _HUMIDITY.replace("least(", "CASE WHEN t IS NOT NULL AND d IS NOT NULL THEN least(", 1) + " END"}),
    "ingested_chain_ecmwf_ifs025_ensemble": _sql("ecmwf_ifs025_ensemble", 1440, 721, ("x", "(720 - y)"), {"view": ("t", "v - 273.15"), "purchase": ("tp", "(v - coalesce(p, 0)) * 1000")}, {"temperature_2m": "t", "precipitation": "tp"}, True),
    "ingested_chain_ncep_gfs025": _sql("ncep_gfs025", 1440, 721, ("((x + 720) % 1440)", "(720 - y)"), {"view": ("t", "v - 273.15"), "click": ("pr", "(v * n - coalesce(p, 0) * (n - 1)) * 3600"), "purchase": ("sw", "v * n - coalesce(p, 0) * (n - 1)"), "error": ("sn", "v")},
        {"temperature_2m": "t", "precipitation": "pr", "shortwave_radiation": "sw", "snow_depth": "sn"}),
    "ingested_chain_dwd_icon": _sql("dwd_icon", 2879, 1441, _SAME, {"view": ("pr", "v - coalesce(p, 0)"), "click": ("di", "v * n - coalesce(p, 0) * (n - 1)"), "purchase": ("df", "v * n - coalesce(p, 0) * (n - 1)"), "error": ("sn", "v")},
        {"precipitation": "pr", "direct_radiation": "di", "diffuse_radiation": "df", "snow_depth": "sn", "shortwave_radiation": "di + df"}),
    "ingested_chain_geosphere_arome_austria": _sql("geosphere_arome_austria", 594, 492, _SAME, {"view": ("u", "v"), "click": ("w", "v"), "purchase": ("pr", "v - coalesce(p, 0)"), "error": ("sw", "(v - coalesce(p, 0)) / 3600"), "signup": ("cc", "v * 100")},
        {"precipitation": "pr", "shortwave_radiation": "sw", "cloud_cover": "cc", "wind_speed_10m": "sqrt(u * u + w * w)", "wind_direction_10m": "degrees(atan2(u, w)) + 180"}),
    "ingested_chain_eumetsat_lsa_saf_msg_15min": _sql("eumetsat_lsa_saf_msg_15min", 3201, 3201, ("x", "(3200 - y)"), {"view": ("sw", "v"), "click": ("df", "v")}, {"shortwave_radiation": "sw", "direct_radiation": "sw * (1 - df)"}, more=_SCAN),
}
