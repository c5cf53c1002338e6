"""Daily, weekly, monthly, block and ensemble aggregates of the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.functions import meteo, solar
from isobarn.functions.meteo import growing_degree
from isobarn.operators.requests import resolve_alias
from isobarn.operators.series import keys, ordered, seconds


def local_day(time: str | Column = "valid_time", offset: str | int = 0) -> Column:
    """The date at a fixed offset in seconds, the same for the whole series."""
    shift = F.col(offset) if isinstance(offset, str) else F.lit(offset)
    return F.to_date(F.timestamp_seconds(seconds(time) + shift))


def _complete(found: Column, value: str, steps: int | None) -> Column:
    """Null unless all steps are there: rows without null, and `steps` of them if given."""
    fine = F.count(value) == F.count(F.lit(1))
    return F.when(fine if steps is None else fine & (F.count(value) >= steps), found)


def daily(df: DataFrame, kinds: list[str], steps: int | None = 24, dt: int = 3600, by: list[str] | None = None, offset: str | int = 0, time: str = "valid_time", value: str = "value") -> DataFrame:
    """One row a series and local day with a column for each kind, in one pass with partial aggregation.

    Kinds: max, min, mean, sum, radiation_sum (MJ/m² of W/m²), precipitation_hours. steps: how many a day must have;
    None accepts days as they are, but a null still makes its day null.
    """
    v = F.col(value)
    rules = {
        "max": F.max(v),
        "min": F.min(v),
        "mean": F.avg(v),
        "sum": F.sum(v),
        "radiation_sum": F.round(F.sum(v) * (dt / 1e6), 2),
        "precipitation_hours": F.sum(F.when(v > 0.001, dt / 3600).otherwise(F.lit(0.0))),
    }
    return df.groupBy(*keys(df, by), local_day(time, offset).alias("day")).agg(*[_complete(rules[k], value, steps).alias(k) for k in kinds])


def daily_dominant_direction(df: DataFrame, speed: str, direction: str, by: list[str], offset: str | int = 0, time: str = "valid_time") -> DataFrame:
    """Direction of the vector sum of a day."""
    east = F.sum(-F.col(speed) * F.sin(F.radians(direction)))
    north = F.sum(-F.col(speed) * F.cos(F.radians(direction)))
    return df.groupBy(*by, local_day(time, offset).alias("day")).agg((F.degrees(F.atan2(east, north)) + 180).alias("dominant_direction"))


def daily_dominant_direction_uv(df: DataFrame, u: str, v: str, by: list[str], offset: str | int = 0, time: str = "valid_time") -> DataFrame:
    return df.groupBy(*by, local_day(time, offset).alias("day")).agg((F.degrees(F.atan2(F.sum(u), F.sum(v))) + 180).alias("dominant_direction"))


def daily_interval_extreme(df: DataFrame, own: str, hourly: str, by: list[str], kind: str = "max", offset: str | int = 0, time: str = "valid_time") -> DataFrame:
    """Extreme of the model's own interval extremes where there are any, else of the hourly values."""
    f = F.max if kind == "max" else F.min
    return df.groupBy(*by, local_day(time, offset).alias("day")).agg(F.coalesce(f(own), f(hourly)).alias(kind))


# fixed values: variables of daily outputs by the aggregates they have
_EXTREMES = "apparent_temperature cape cloud_cover dew_point_2m precipitation_probability pressure_msl relative_humidity_2m surface_pressure temperature_2m visibility wet_bulb_temperature_2m wind_gusts_10m wind_speed_10m wind_speed_100m wind_speed_200m sea_surface_temperature snow_depth soil_temperature_0_to_7cm soil_moisture_0_to_7cm wave_height".split()
_SUMS = "precipitation rain showers snowfall snowfall_water_equivalent et0_fao_evapotranspiration sunshine_duration".split()
_MAXIMA = "updraft uv_index uv_index_clear_sky vapour_pressure_deficit wind_wave_height swell_wave_height wave_period wind_wave_period wind_wave_peak_period swell_wave_period swell_wave_peak_period".split()
_LAYERS = "0_to_100cm 0_to_10cm 0_to_7cm 7_to_28cm 28_to_100cm 100_to_255cm".split()
#: Daily outputs: name -> (variable, kind). Old spellings are resolved (see requests.ALIASES). More are added with register_aggregation.
DAILY: dict[str, tuple[str, str]] = {
    **{f"{v}_{k}": (v, k) for v in _EXTREMES for k in ("max", "min", "mean")},
    **{f"{v}_sum": (v, "sum") for v in _SUMS},
    **{f"{v}_max": (v, "max") for v in _MAXIMA},
    **{f"{v}_{layer}_mean": (f"{v}_{layer}", "mean") for v in ("soil_moisture", "soil_temperature", "soil_moisture_index") for layer in _LAYERS},
    **{f"{v}_{k}": (v, f"members_{k}") for v in ("river_discharge",) for k in ("max", "min", "mean", "median", "p25", "p75")},
    "river_discharge": ("river_discharge", "mean"),
    "shortwave_radiation_sum": ("shortwave_radiation", "radiation_sum"),
    "direct_radiation_sum": ("direct_radiation", "radiation_sum"),
    "precipitation_hours": ("precipitation", "precipitation_hours"),
    "et0_fao_evapotranspiration": ("et0_fao_evapotranspiration", "sum"),
    "weather_code": ("weather_code", "max"),
    "leaf_wetness_probability_mean": ("leaf_wetness_probability", "mean"),
    "growing_degree_days_base_0_limit_50": ("temperature_2m", "growing_degree_days"),
}
#: Daily directions: name -> (weight, direction): the direction of the vector sum.
DOMINANT: dict[str, tuple[str, str]] = {f"wind_direction_{z}m_dominant": (f"wind_speed_{z}m", f"wind_direction_{z}m") for z in (10, 100, 200)} | {f"{w}_direction_dominant": (f"{w}_height", f"{w}_direction") for w in ("wave", "wind_wave", "swell_wave")}
#: Daily events of a place, which need no series.
EVENTS = ["sunrise", "sunset", "daylight_duration", "moonrise", "moonset", "moon_phase"]


def daily_inputs(outputs: list[str]) -> list[str]:
    """Variables that daily outputs need."""
    names = [resolve_alias(o) for o in outputs if o not in EVENTS]
    return sorted({v for n in names for v in (DOMINANT[n] if n in DOMINANT else DAILY[n][:1])})


def daily_events(days: DataFrame, outputs: list[str], key: str, offset: str = "utc_offset_seconds") -> DataFrame:
    """Adds sunrise, sunset, daylight_duration, moonrise, moonset and moon_phase to days of places. days: key, day, lat, lon, offset."""
    out = days.withColumn("_midnight", F.timestamp_seconds(seconds(F.col("day").cast("timestamp")) - F.col(offset)))
    if {"sunrise", "sunset", "daylight_duration"} & set(outputs):
        out = solar.sunrise_sunset(out, "_midnight", "lat", "lon")
    if {"moonrise", "moonset"} & set(outputs):
        moons = solar.moon_events(out.select(key, "_midnight", "lat", "lon"), key, "_midnight", "lat", "lon")
        out = out.join(moons, [key, "_midnight"], "left")
    if "moon_phase" in outputs:
        out = out.withColumn("moon_phase", solar.moon_phase(F.timestamp_seconds(seconds("_midnight") + 43200)))
    return out.select(*days.columns, *[o for o in outputs if o in EVENTS])


def register_aggregation(output: str, variable: str, kind: str) -> None:
    DAILY[output] = (variable, kind)


def daily_summary(df: DataFrame, outputs: list[str], steps: int | None = 24, dt: int = 3600, by: list[str] | None = None, offset: str | int = 0, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Named daily outputs of the long table in one grouped pass over the variables they need.

    Directions are weighted by their speed or height, which takes the two side by side first. Statistics over members (of
    river discharge) are those of all values of a day.
    """
    by = [k for k in keys(df, by) if k != "variable"]
    wanted = {o: resolve_alias(o) for o in outputs}
    df = df.where(F.col("variable").isin(daily_inputs(outputs)))
    directions = {o: DOMINANT[n] for o, n in wanted.items() if n in DOMINANT}
    if directions:
        more = [k for k in ("member",) if k in df.columns and k not in by]
        pairs = df.groupBy(*by, *more, time).agg(*[F.max(F.when(F.col("variable") == v, F.col(value))).alias(v) for v in sorted({v for p in directions.values() for v in p})])
        parts = [F.struct(F.lit(f"{side}:{o}").alias("variable"), (-F.col(s) * rule(F.radians(d))).alias(value)) for o, (s, d) in directions.items() for side, rule in (("east", F.sin), ("north", F.cos))]
        pairs = pairs.select(*by, time, F.explode(F.array(*parts)).alias("_p")).select(*by, time, "_p.variable", F.col(f"_p.{value}").alias(value)).where(F.col(value).isNotNull())
        df = df.select(*by, time, "variable", value).unionByName(pairs)
    columns = []
    for output, name in wanted.items():
        if output in directions:
            east, north = (F.sum(F.when(F.col("variable") == f"{side}:{output}", F.col(value))) for side in ("east", "north"))
            columns.append((F.degrees(F.atan2(east, north)) + 180).alias(output))
            continue
        variable, kind = DAILY[name]
        own = F.when(F.col("variable") == variable, F.col(value))
        rule = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}.get(kind.removeprefix("members_"))
        if rule:
            found = rule(own)
        elif kind.startswith("members_"):
            found = quantile_at(F.sort_array(F.collect_list(own)), {"median": 0.5, "p25": 0.25, "p75": 0.75}[kind.removeprefix("members_")])
        elif kind == "radiation_sum":
            found = F.round(F.sum(own) * (dt / 1e6), 2)
        elif kind == "precipitation_hours":
            found = F.sum(F.when(own > 0.001, dt / 3600).when(own.isNotNull(), F.lit(0.0)))
        else:
            found = F.sum(growing_degree(own))
        rows = F.count(F.when(F.col("variable") == variable, 1))
        columns.append(F.when((F.count(own) == rows) & (rows >= (steps or 1)), found).alias(output))
    return df.groupBy(*by, local_day(time, offset).alias("day")).agg(*columns)


def period_view(df: DataFrame, period: str, kinds: dict[str, str], by: list[str], time: str = "valid_time") -> DataFrame:
    """Weekly (Monday) or monthly values; kinds: column -> mean, sum, max or min."""
    rule = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    return df.groupBy(*by, F.date_trunc(period, F.col(time)).alias(period)).agg(*[rule[k](c).alias(c) for c, k in kinds.items()])


def period_anomaly(view: DataFrame, normals: DataFrame, by: list[str], column: str, thresholds: tuple[float, ...] = (0.0,)) -> DataFrame:
    """by, <column>_mean, <column>_anomaly against normals (by, normal), and the percent of members whose anomaly is above each
    threshold (_gt<n>) and below its negative (_ltm<n>; _lt0 for zero). view: by, one row for each member."""
    joined = view.join(normals.select(*by, "normal"), by)
    off = F.col(column) - F.col("normal")
    name = lambda t: f"{t:g}".replace(".", "_")
    share = lambda c: F.avg(F.when(c, 100.0).when(c.isNotNull(), 0.0))
    odds = [x for t in thresholds for x in (share(off > t).alias(f"{column}_anomaly_gt{name(t)}"), share(off < -t).alias(f"{column}_anomaly_lt{'m' if t else ''}{name(t)}"))]
    return joined.groupBy(*by).agg(F.avg(column).alias(f"{column}_mean"), F.avg(off).alias(f"{column}_anomaly"), *odds)


def period_outputs(wide: DataFrame, outputs: list[str]) -> DataFrame:
    """Weekly and monthly outputs that a wide table lacks, from those it has: snowfall and snow depth from water, wind from components."""
    out = wide
    for name in outputs:
        if name in wide.columns:
            continue
        base, kind = name.rsplit("_", 1)
        height = base.rsplit("_", 1)[-1]
        col = lambda x, k=kind: F.col(f"{x}_{k}")
        if base == "snowfall":
            found = meteo.snowfall(col("snowfall_water_equivalent"))
        elif base == "snow_depth":
            found = meteo.snow_depth_from_water(col("snow_depth_water_equivalent"), F.col("snow_density_mean"))
        elif base.startswith("wind_speed_"):
            found = meteo.wind_speed(col(f"wind_u_component_{height}"), col(f"wind_v_component_{height}"))
        elif base.startswith("wind_direction_"):
            found = meteo.wind_direction(col(f"wind_u_component_{height}"), col(f"wind_v_component_{height}"))
        else:
            raise ValueError(f"no rule gives {name}")
        out = out.withColumn(name, found)
    return out


def block_aggregate(df: DataFrame, n: float, kind: str, previous: bool = False, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Blocks of n rows (may be fractional); null if a value is missing. previous: the block's value is the last one's."""
    by = keys(df, by)
    block = F.floor((F.row_number().over(ordered(by, time)) - 1) / n)
    rule = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[kind]
    found = df.withColumn("block", block).groupBy(*by, "block").agg(F.min(time).alias(time), _complete(rule(F.col(value)), value, None).alias(value))
    return found.withColumn(value, F.lag(value).over(Window.partitionBy(*by).orderBy("block"))) if previous else found


def cumulative_count_below(df: DataFrame, limit: float, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    w = ordered(keys(df, by), time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("count_below", F.sum(F.when(F.col(value) < limit, 1).otherwise(0)).over(w))


def growing_degree_days(df: DataFrame, base: float = 0.0, limit: float = 50.0, by: list[str] | None = None, offset: str | int = 0, time: str = "valid_time", value: str = "value") -> DataFrame:
    return df.groupBy(*keys(df, by), local_day(time, offset).alias("day")).agg(F.sum(growing_degree(F.col(value), base, limit)).alias("growing_degree_days"))


def coverage_report(df: DataFrame, dt: int, chunk_steps: int, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Steps present and expected by series and time chunk."""
    chunk = F.floor(seconds(time) / (dt * chunk_steps))
    found = df.groupBy(*keys(df, by), chunk.alias("time_chunk")).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(time))).alias("present"))
    return found.withColumn("expected", F.lit(chunk_steps).cast("bigint"))


# ensembles ---------------------------------------------------------------------------------------------------------


def ensemble_mean_spread(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and sample standard deviation over the members."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"))


def precipitation_probability(df: DataFrame, dt: int, by: list[str], threshold: float = 0.1, value: str = "value") -> DataFrame:
    """Percent of members with at least the threshold for each hour of the step; needs two members."""
    enough = F.avg(F.when(F.col(value) >= threshold * dt / 3600, 100.0).otherwise(F.lit(0.0)))
    return df.groupBy(*by).agg(enough.alias("precipitation_probability"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")


def quantile_at(sorted_values: Column, q: float) -> Column:
    """Value at position n * q of a sorted array, on the line to the next; the ends hold beyond."""
    n = F.size(sorted_values)
    place = n * F.lit(q)
    low = F.floor(place).cast("int")
    at = lambda i: F.get(sorted_values, F.least(i, n - 1))
    return at(low) * (1 - (place - low)) + at(low + 1) * (place - low)


def ensemble_quantiles(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """min, max, mean, median, p25 and p75 over the members of one step."""
    grouped = df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_v"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return grouped.select(*by, "min", "max", "mean", quantile_at(F.col("_v"), 0.5).alias("median"), quantile_at(F.col("_v"), 0.25).alias("p25"), quantile_at(F.col("_v"), 0.75).alias("p75"))
