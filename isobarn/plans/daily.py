"""Daily, block and ensemble aggregates (A) and the request helpers (F, O) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.operators import aggregate as A
from isobarn.operators import requests as Q
from isobarn.plans import tables as T
from isobarn.plans.derived import _position_cte

KEY = ["location_id", "variable"]


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, hourly means, local days, units, order: the first slice of the engine."""
    found = A.daily(T.hourly(spark, sf_dir), ["max", "min", "mean", "sum"], None, by=KEY)
    return T.tidy(found).orderBy("location_id", "variable", "day")


def daily_complete(spark, sf_dir):
    found = A.daily(T.regular(spark, sf_dir), ["max", "mean"], 24, by=["location_id"], offset=-7200)
    return T.tidy(found)


def daily_radiation_and_hours(spark, sf_dir):
    h = T.hourly(spark, sf_dir).withColumn("value", F.col("value") + 0.0007)  # no ties at two decimals
    return T.tidy(A.daily(h, ["radiation_sum", "precipitation_hours"], None, by=KEY))


def daily_dominant_direction(spark, sf_dir):
    w = T.weather(spark, sf_dir).withColumns({"speed": F.col("temperature_2m") + 20, "direction": (F.col("place_id") * 37 % 360).cast("double")})
    return T.tidy(A.daily_dominant_direction(w, "speed", "direction", ["part"]), 3)


def daily_dominant_direction_uv(spark, sf_dir):
    w = T.weather(spark, sf_dir)
    u, v = F.round(F.col("wind_u_component_10m") + 0.25, 2), F.round(F.col("wind_v_component_10m") + 0.25, 2)
    return T.tidy(A.daily_dominant_direction_uv(w.withColumns({"u": u, "v": v}), "u", "v", ["part"]), 3)


def daily_interval_extreme(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("own", F.when(F.col("event_type") == "click", F.col("value")))
    hi = A.daily_interval_extreme(e, "own", "value", ["user_id"], "max", time="ts")
    lo = A.daily_interval_extreme(e, "own", "value", ["user_id"], "min", time="ts")
    return T.tidy(hi.join(lo, ["user_id", "day"]))


def daily_named_outputs(spark, sf_dir):
    names = {"view": "temperature_2m", "click": "precipitation", "purchase": "shortwave_radiation", "error": "wind_speed_10m", "signup": "wind_gusts_10m"}
    h = T.hourly(spark, sf_dir).replace(names, subset=["variable"]).withColumn("value", F.col("value") + 0.0007)
    outputs = ["temperature_2m_max", "temperature_2m_mean", "precipitation_sum", "precipitation_hours", "shortwave_radiation_sum", "wind_speed_10m_max", "wind_gusts_10m_max", "growing_degree_days_base_0_limit_50"]
    return T.tidy(A.daily_summary(h, outputs, None, by=["location_id"]))


def daily_directions_and_layers(spark, sf_dir):
    """Directions by vector sums, statistics of discharge, soil layers and old spellings in one request."""
    e = T.table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("valid_time")).agg(F.avg("value").alias("v"), F.max("event_id").alias("k"))
    rows = F.array(*[F.struct(F.lit(n).alias("variable"), x.cast("double").alias("value")) for n, x in {"wind_speed_10m": F.col("v"), "wind_direction_10m": F.col("k") % 360, "river_discharge": F.col("v") * 2, "soil_moisture_7_to_28cm": F.col("v") / 100, "cloud_cover": F.col("k") % 101}.items()])
    long = e.select(F.col("user_id").alias("location_id"), "valid_time", F.explode(rows).alias("x")).select("location_id", "valid_time", "x.variable", "x.value")
    outputs = ["wind_direction_10m_dominant", "river_discharge_median", "river_discharge_p75", "soil_moisture_7_to_28cm_mean", "cloudcover_max", "windspeed_10m_mean"]
    return T.tidy(A.daily_summary(long, outputs, None, by=["location_id"]), 3)


def daily_sun_events(spark, sf_dir):
    """Sunrise, sunset and daylight of every place on a day of its own, by its offset."""
    days = T.places(spark, sf_dir).select("place_id", "lat", "lon", "utc_offset_seconds", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("place_id") * 17 % 366).cast("int")).alias("day"))
    found = A.daily_events(days, ["sunrise", "sunset", "daylight_duration", "moon_phase"], "place_id")
    return T.tidy(found.select("place_id", "day", "sunrise", "sunset", "daylight_duration", "moon_phase"), 2)


def weekly_anomalies(spark, sf_dir):
    """Weekly means of members against normals, and the odds of being above and below."""
    m = T.members(spark, sf_dir)
    view = A.period_view(m, "week", {"value": "mean"}, ["location_id", "member"])
    normals = view.groupBy("location_id", "week").agg((F.avg("value") - 0.02).alias("normal"))
    return T.tidy(A.period_anomaly(view, normals, ["location_id", "week"], "value", (0.0, 0.1)))


def weekly_outputs(spark, sf_dir):
    """Weekly outputs from others: snow from water, wind from components."""
    w = T.weather(spark, sf_dir).withColumn("valid_time", F.col("valid_time").cast("timestamp"))
    names = {"snowfall_water_equivalent_mean": "precipitation", "wind_u_component_10m_mean": "wind_u_component_10m", "wind_v_component_10m_mean": "wind_v_component_10m", "snow_depth_water_equivalent_mean": "cloud_cover", "snow_density_mean": "pressure_msl"}
    view = A.period_view(w.select((F.col("part") % 20).alias("location_id"), "valid_time", *[F.col(c).alias(n) for n, c in names.items()]), "week", {n: "mean" for n in names}, ["location_id"])
    outputs = ["snowfall_mean", "snow_depth_mean", "wind_speed_10m_mean"]
    return T.tidy(A.period_outputs(view, outputs).select("location_id", "week", *outputs))


def weekly_monthly_view(spark, sf_dir):
    d = T.daily_long(spark, sf_dir).withColumn("valid_time", F.col("date").cast("timestamp"))
    week = A.period_view(d, "week", {"value": "mean"}, ["location_id"]).select("location_id", F.lit("week").alias("period"), F.col("week").alias("start"), "value")
    month = A.period_view(d, "month", {"value": "sum"}, ["location_id"]).select("location_id", F.lit("month").alias("period"), F.col("month").alias("start"), "value")
    return T.tidy(week.unionByName(month))


def ensemble_mean_spread(spark, sf_dir):
    return T.tidy(A.ensemble_mean_spread(T.members(spark, sf_dir), ["location_id", "valid_time"]))


def ensemble_quantiles(spark, sf_dir):
    return T.tidy(A.ensemble_quantiles(T.members(spark, sf_dir), ["location_id", "valid_time"]))


def precipitation_probability(spark, sf_dir):
    return T.tidy(A.precipitation_probability(T.members(spark, sf_dir), 3600, ["location_id", "valid_time"]))


def block_aggregate(spark, sf_dir):
    d = T.daily_long(spark, sf_dir)
    own = A.block_aggregate(d, 7, "mean", False, ["location_id"], "date")
    back = A.block_aggregate(d, 7, "max", True, ["location_id"], "date").select("location_id", "block", F.col("value").alias("previous_max"))
    return T.tidy(own.join(back, ["location_id", "block"]))


def cumulative_count_below(spark, sf_dir):
    return T.tidy(A.cumulative_count_below(T.daily_long(spark, sf_dir), 30, ["location_id"], "date"))


def growing_degree_days(spark, sf_dir):
    return T.tidy(A.growing_degree_days(T.hourly(spark, sf_dir), 5.0, 30.0, KEY))


def coverage_report(spark, sf_dir):
    return A.coverage_report(T.regular(spark, sf_dir), 3600, 24, ["location_id"])


def converted_units(spark, sf_dir):
    units = F.create_map(*[F.lit(x) for p in {"view": "°C", "click": "m/s", "purchase": "mm", "error": "Pa", "signup": "m"}.items() for x in p])
    h = T.hourly(spark, sf_dir).withColumn("unit", units[F.col("variable")])
    return T.tidy(Q.round_to_unit(Q.convert_units(Q.pascal_to_hectopascal(h), "fahrenheit", "kn", length="imperial")), 3)


def corrected_elevation(spark, sf_dir):
    h = T.hourly(spark, sf_dir).withColumns({"cell_elevation": (F.col("location_id") * 11 % 900).cast("double"), "elevation": F.when(F.col("location_id") % 5 > 0, (F.col("location_id") * 7 % 500).cast("double"))})
    bounds = spark.createDataFrame([("view", 0.0, 15.0), ("click", None, 20.0)], "variable string, lower_bound double, upper_bound double")
    return T.tidy(Q.clamp_values(Q.correct_elevation(h, ["view", "click"]), bounds))


def parsed_names(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 5).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("_850hPa", "_2m", "_spread", "_2m_previous_day3", "_500hPa_member07")]), F.col("k").cast("int") + 1)
    found = Q.parse_variable_names(e.withColumn("variable", F.concat("event_type", suffix))).drop("event_type", "k")
    return found.fillna(-1, ["level", "height"])


def selected_variables(spark, sf_dir):
    h = Q.select_variables(T.hourly(spark, sf_dir), "view, click")
    return T.tidy(Q.drop_empty_series(h, KEY))


def local_time_ranges(spark, sf_dir):
    now = F.lit("2024-02-03 12:24:00").cast("timestamp")
    p = Q.time_range_for(T.places(spark, sf_dir), now, past_days=1, forecast_days=2)
    good = Q.validate_places(p).where("reason IS NULL").drop("reason")
    spine = Q.time_spine(good, 10800)
    return Q.format_time(spine, "iso8601", offset="utc_offset_seconds").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.min("valid_time").alias("first"), F.max("valid_time").alias("last"))


def aligned_runs(spark, sf_dir):
    r = T.runs(spark, sf_dir).select("location_id", "run_time").distinct().withColumn("utc_offset_seconds", F.lit(0))
    return Q.align_to_local_period(r, "week").select("location_id", "run_time")


def expanded_requests(spark, sf_dir):
    dates = spark.sql("SELECT date'2024-01-05' AS from_date, date'2024-01-07' AS to_date, 1 AS position")
    return T.tidy(Q.expand_requests(T.places(spark, sf_dir), dates).select("place_id", "from_date", "to_date"))


def query_cost(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("n_variables"), (F.col("o_orderkey") % 50).alias("n_days"))
    return T.tidy(Q.query_cost(o, "o_custkey"))


def selected_members(spark, sf_dir):
    m = T.members(spark, sf_dir).withColumn("variable", F.when(F.col("location_id") % 2 == 0, "a").otherwise("b"))
    return T.tidy(Q.select_members(m, ["b"], 5))


QUERIES = {
    f.__name__: f
    for f in (
        daily_summary, daily_complete, daily_radiation_and_hours, daily_dominant_direction, daily_dominant_direction_uv, daily_interval_extreme,
        daily_named_outputs, daily_directions_and_layers, daily_sun_events, weekly_anomalies, weekly_outputs, weekly_monthly_view, ensemble_mean_spread, ensemble_quantiles, precipitation_probability, block_aggregate,
        cumulative_count_below, growing_degree_days, coverage_report, converted_units, corrected_elevation, parsed_names, selected_variables,
        local_time_ranges, aligned_runs, expanded_requests, query_cost, selected_members,
    )
}

_r = T.r
ORACLE = {
    "daily_summary": f"WITH {T.HOURLY} SELECT location_id, variable, CAST(valid_time AS DATE) AS day, {_r('max(value)')} AS max, {_r('min(value)')} AS min, {_r('avg(value)')} AS mean, {_r('sum(value)')} AS sum FROM hourly GROUP BY ALL",
    "daily_complete": f"""WITH {T.REGULAR} SELECT location_id, CAST(valid_time - INTERVAL 2 HOUR AS DATE) AS day,
      CASE WHEN count(value) >= 24 THEN {_r('max(value)')} END AS max, CASE WHEN count(value) >= 24 THEN {_r('avg(value)')} END AS mean FROM regular GROUP BY ALL""",
    "daily_radiation_and_hours": f"""WITH {T.HOURLY} SELECT location_id, variable, CAST(valid_time AS DATE) AS day, {_r('round(sum(value + 0.0007) * 0.0036, 2)')} AS radiation_sum,
      CAST(count(*) FILTER (value + 0.0007 > 0.001) AS DOUBLE) AS precipitation_hours FROM hourly GROUP BY ALL""",
    "daily_dominant_direction": f"""WITH {T.WEATHER} SELECT part, CAST(valid_time AS DATE) AS day,
      {_r("degrees(atan2(sum(-(temperature_2m + 20) * sin(radians(CAST(place_id * 37 % 360 AS DOUBLE)))), sum(-(temperature_2m + 20) * cos(radians(CAST(place_id * 37 % 360 AS DOUBLE)))))) + 180", 3)} AS dominant_direction FROM weather GROUP BY ALL""",
    "daily_dominant_direction_uv": f"""WITH {T.WEATHER} SELECT part, CAST(valid_time AS DATE) AS day,
      {_r("degrees(atan2(sum(round(wind_u_component_10m + 0.25, 2)), sum(round(wind_v_component_10m + 0.25, 2)))) + 180", 3)} AS dominant_direction FROM weather GROUP BY ALL""",
    "daily_interval_extreme": f"""SELECT user_id, CAST(ts AS DATE) AS day, {_r("coalesce(max(value) FILTER (event_type = 'click'), max(value))")} AS max,
      {_r("coalesce(min(value) FILTER (event_type = 'click'), min(value))")} AS min FROM events GROUP BY ALL""",
    "daily_named_outputs": f"""WITH {T.HOURLY} SELECT location_id, CAST(valid_time AS DATE) AS day,
      {_r("max(value + 0.0007) FILTER (variable = 'view')")} AS temperature_2m_max, {_r("avg(value + 0.0007) FILTER (variable = 'view')")} AS temperature_2m_mean,
      {_r("sum(value + 0.0007) FILTER (variable = 'click')")} AS precipitation_sum, {_r("sum(CASE WHEN value + 0.0007 > 0.001 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (variable = 'click')")} AS precipitation_hours,
      {_r("round(sum(value + 0.0007) FILTER (variable = 'purchase') * 0.0036, 2)")} AS shortwave_radiation_sum, {_r("max(value + 0.0007) FILTER (variable = 'error')")} AS wind_speed_10m_max,
      {_r("max(value + 0.0007) FILTER (variable = 'signup')")} AS wind_gusts_10m_max, {_r("sum(least(greatest(value + 0.0007, 0), 50) / 24) FILTER (variable = 'view')")} AS growing_degree_days_base_0_limit_50
      FROM hourly GROUP BY ALL""",
    "daily_directions_and_layers": f"""WITH e AS (SELECT user_id AS location_id, date_trunc('hour', ts) AS t, avg(value) AS v, max(event_id) AS k FROM events GROUP BY ALL),
      d AS (SELECT location_id, CAST(t AS DATE) AS day, list(v * 2 ORDER BY v) AS q, sum(-v * sin(radians(CAST(k % 360 AS DOUBLE)))) AS ea, sum(-v * cos(radians(CAST(k % 360 AS DOUBLE)))) AS no, avg(v / 100) AS soil, max(k % 101) AS cloud, avg(v) AS speed FROM e GROUP BY ALL)
      SELECT location_id, day, {_r('degrees(atan2(ea, no)) + 180', 3)} AS wind_direction_10m_dominant, """
    + ", ".join(f"{_r(f'q[least(CAST(floor(len(q) * {x}) AS BIGINT), len(q) - 1) + 1] * (1 - (len(q) * {x} - floor(len(q) * {x}))) + q[least(CAST(floor(len(q) * {x}) AS BIGINT) + 1, len(q) - 1) + 1] * (len(q) * {x} - floor(len(q) * {x}))', 3)} AS river_discharge_{n}" for x, n in ((0.5, "median"), (0.75, "p75")))
    + f""", {_r('soil', 3)} AS soil_moisture_7_to_28cm_mean, {_r('cloud', 3)} AS cloudcover_max, {_r('speed', 3)} AS windspeed_10m_mean FROM d""",
    "daily_sun_events": f"""WITH {T.PLACES}, d AS (SELECT *, CAST(1704067200 + (place_id * 17 % 366) * 86400 - utc_offset_seconds AS DOUBLE) AS m0, 12 - lon / 15 AS noon FROM places), {_position_cte('d', '(m0 + floor(noon * 3600))')},
      a AS (SELECT *, -(sin(radians(0.83333)) + sin(radians(lat)) * sin(radians(decl))) / (cos(radians(lat)) * cos(radians(decl))) AS arg FROM sun), b AS (SELECT *, degrees(acos(least(greatest(arg, -1), 1))) / 15 AS half FROM a)
      SELECT place_id, DATE '2024-01-01' + CAST(place_id * 17 % 366 AS INTEGER) AS day, to_timestamp(CASE WHEN arg > 1 OR arg < -1 THEN m0 ELSE m0 + trunc((noon - half - eqt / 60) * 3600) END)::TIMESTAMP AS sunrise,
      to_timestamp(CASE WHEN arg > 1 THEN m0 WHEN arg < -1 THEN m0 + 86400 ELSE m0 + trunc((noon + half - eqt / 60) * 3600) END)::TIMESTAMP AS sunset, {_r('CASE WHEN arg > 1 THEN 0 WHEN arg < -1 THEN 86400 ELSE half * 7200 END', 2)} AS daylight_duration,
      {_r('(m0 + 43200 - 947182440) / (29.530588853 * 86400) - floor((m0 + 43200 - 947182440) / (29.530588853 * 86400))', 2)} AS moon_phase FROM b""",
    "weekly_anomalies": f"""WITH {T.MEMBERS}, v AS (SELECT location_id, member, date_trunc('week', valid_time)::TIMESTAMP AS week, avg(value) AS x FROM members GROUP BY ALL), n AS (SELECT location_id, week, avg(x) - 0.02 AS n FROM v GROUP BY ALL), o AS (SELECT *, x - n AS o FROM v JOIN n USING (location_id, week))
      SELECT location_id, week, {_r('avg(x)')} AS value_mean, {_r('avg(o)')} AS value_anomaly, {_r('100.0 * count(*) FILTER (o > 0) / count(*)')} AS value_anomaly_gt0, {_r('100.0 * count(*) FILTER (o < 0) / count(*)')} AS value_anomaly_lt0,
      {_r('100.0 * count(*) FILTER (o > 0.1) / count(*)')} AS value_anomaly_gt0_1, {_r('100.0 * count(*) FILTER (o < -0.1) / count(*)')} AS value_anomaly_ltm0_1 FROM o GROUP BY ALL""",
    "weekly_outputs": f"""WITH {T.WEATHER}, w AS (SELECT part % 20 AS location_id, date_trunc('week', valid_time)::TIMESTAMP AS week, avg(precipitation) AS p, avg(wind_u_component_10m) AS u, avg(wind_v_component_10m) AS v, avg(cloud_cover) AS c, avg(pressure_msl) AS d FROM weather GROUP BY ALL)
      SELECT location_id, week, {_r('p * 0.7')} AS snowfall_mean, {_r('c / d')} AS snow_depth_mean, {_r('sqrt(u * u + v * v)')} AS wind_speed_10m_mean FROM w""",
    "weekly_monthly_view": f"""WITH {T.DAILY} SELECT location_id, 'week' AS period, date_trunc('week', date)::TIMESTAMP AS start, {_r('avg(value)')} AS value FROM daily_long GROUP BY ALL
      UNION ALL SELECT location_id, 'month', date_trunc('month', date)::TIMESTAMP, {_r('sum(value)')} FROM daily_long GROUP BY ALL""",
    "ensemble_mean_spread": f"WITH {T.MEMBERS} SELECT location_id, valid_time, {_r('avg(value)')} AS mean, {_r('stddev_samp(value)')} AS spread FROM members GROUP BY ALL",
    "ensemble_quantiles": f"""WITH {T.MEMBERS}, s AS (SELECT location_id, valid_time, list(value ORDER BY value) AS v, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM members GROUP BY ALL)
      SELECT location_id, valid_time, {_r('lo')} AS min, {_r('hi')} AS max, {_r('m')} AS mean, """
    + ", ".join(
        f"{_r(f'v[least(CAST(floor(len(v) * {q}) AS BIGINT), len(v) - 1) + 1] * (1 - (len(v) * {q} - floor(len(v) * {q}))) + v[least(CAST(floor(len(v) * {q}) AS BIGINT) + 1, len(v) - 1) + 1] * (len(v) * {q} - floor(len(v) * {q}))')} AS {n}"
        for q, n in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"))
    )
    + " FROM s",
    "precipitation_probability": f"WITH {T.MEMBERS} SELECT location_id, valid_time, {_r('100.0 * count(*) FILTER (value >= 0.1) / count(*)')} AS precipitation_probability FROM members GROUP BY ALL HAVING count(*) > 1",
    "block_aggregate": f"""WITH {T.DAILY}, n AS (SELECT *, (row_number() OVER (PARTITION BY location_id ORDER BY date) - 1) // 7 AS block FROM daily_long),
      b AS (SELECT location_id, block, min(date) AS date, avg(value) AS value, max(value) AS hi FROM n GROUP BY ALL)
      SELECT location_id, CAST(block AS BIGINT) AS block, date, {_r('value')} AS value, {_r('lag(hi) OVER (PARTITION BY location_id ORDER BY block)')} AS previous_max FROM b""",
    "cumulative_count_below": f"WITH {T.DAILY} SELECT location_id, date, {_r('value')} AS value, CAST(sum(CASE WHEN value < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY location_id ORDER BY date) AS BIGINT) AS count_below FROM daily_long",
    "growing_degree_days": f"WITH {T.HOURLY} SELECT location_id, variable, CAST(valid_time AS DATE) AS day, {_r('sum(least(greatest(value - 5, 0), 25) / 24)')} AS growing_degree_days FROM hourly GROUP BY ALL",
    "coverage_report": f"WITH {T.REGULAR} SELECT location_id, CAST(floor(epoch(valid_time) / 86400) AS BIGINT) AS time_chunk, count(DISTINCT valid_time) FILTER (value IS NOT NULL) AS present, CAST(24 AS BIGINT) AS expected FROM regular GROUP BY ALL",
    "converted_units": f"""WITH {T.HOURLY} SELECT location_id, variable, valid_time,
      {_r("CASE variable WHEN 'view' THEN round(value * 1.8 + 32, 1) WHEN 'click' THEN round(value * 1.94384, 1) WHEN 'purchase' THEN round(value * (1 / 25.4), 3) WHEN 'error' THEN round(value / 100, 1) ELSE round(value * 3.280839895, 0) END", 3)} AS value,
      CASE variable WHEN 'view' THEN '°F' WHEN 'click' THEN 'kn' WHEN 'purchase' THEN 'inch' WHEN 'error' THEN 'hPa' ELSE 'ft' END AS unit FROM hourly""",
    "corrected_elevation": f"""WITH {T.HOURLY}, h AS (SELECT *, CAST(location_id * 11 % 900 AS DOUBLE) AS cell_elevation, CASE WHEN location_id % 5 > 0 THEN CAST(location_id * 7 % 500 AS DOUBLE) END AS elevation FROM hourly),
      c AS (SELECT *, CASE WHEN variable IN ('view', 'click') AND elevation IS NOT NULL THEN value + (cell_elevation - elevation) * 0.0065 ELSE value END AS v FROM h)
      SELECT location_id, variable, valid_time, {_r("CASE variable WHEN 'view' THEN least(greatest(v, 0), 15) WHEN 'click' THEN least(v, 20) ELSE v END")} AS value, {_r('cell_elevation')} AS cell_elevation, {_r('elevation')} AS elevation FROM c""",
    "parsed_names": """WITH e AS (SELECT event_type, event_id % 5 AS k, count(*) AS n FROM events GROUP BY ALL)
      SELECT n, event_type || ['_850hPa', '_2m', '_spread', '_2m_previous_day3', '_500hPa_member07'][k + 1] AS variable, event_type AS base,
      CASE k WHEN 0 THEN 850 WHEN 4 THEN 500 ELSE -1 END AS level, CASE WHEN k IN (1, 3) THEN 2 ELSE -1 END AS height, CASE k WHEN 2 THEN 'spread' ELSE 'value' END AS statistic,
      CASE k WHEN 3 THEN 3 ELSE 0 END AS lead_day, CASE k WHEN 4 THEN 7 ELSE 0 END AS member FROM e""",
    "selected_variables": f"WITH {T.HOURLY} SELECT location_id, variable, valid_time, {_r('value')} AS value FROM hourly WHERE variable IN ('view', 'click')",
    "local_time_ranges": f"""WITH {T.PLACES}, b AS (SELECT place_id, utc_offset_seconds AS o, (1706963040 + utc_offset_seconds) // 86400 * 86400 - utc_offset_seconds AS d FROM places),
      t AS (SELECT place_id, o, unnest(range(CAST(ceil((d - 86400) / 10800.0) AS BIGINT) * 10800, d + 2 * 86400, 10800)) AS s FROM b)
      SELECT place_id, count(*) AS n, strftime(to_timestamp(min(s) + o)::TIMESTAMP, '%Y-%m-%dT%H:%M') AS first, strftime(to_timestamp(max(s) + o)::TIMESTAMP, '%Y-%m-%dT%H:%M') AS last FROM t GROUP BY place_id, o""",
    "aligned_runs": f"WITH {T.RUNS} SELECT DISTINCT location_id, run_time FROM runs WHERE run_time = date_trunc('week', run_time)",
    "expanded_requests": f"WITH {T.PLACES} SELECT place_id, DATE '2024-01-05' AS from_date, DATE '2024-01-07' AS to_date FROM places",
    "query_cost": f"SELECT o_custkey, {_r('sum(greatest(1.0::DOUBLE, (o_orderkey % 40) / 10.0::DOUBLE, (o_orderkey % 40) / 10.0::DOUBLE * (o_orderkey % 50) / 14))')} AS cost FROM orders GROUP BY ALL",
    "selected_members": f"""WITH {T.MEMBERS} SELECT location_id, valid_time, CAST(member AS INTEGER) AS member, {_r('value')} AS value, CASE WHEN location_id % 2 = 0 THEN 'a' ELSE 'b' END AS variable
      FROM members WHERE (member = 0 OR location_id % 2 = 0) AND member < 5""",
}
