"""Requests: places with time ranges, variable names, units and the output form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.operators.series import bounded, keys, seconds

# fixed values: alias names of variables
ALIASES = {
    "windspeed": "wind_speed", "winddirection": "wind_direction", "windgusts": "wind_gusts", "relativehumidity": "relative_humidity",
    "dewpoint": "dew_point", "cloudcover": "cloud_cover", "weathercode": "weather_code", "vapor_pressure": "vapour_pressure",
    "freezinglevel_height": "freezing_level_height",
}


def resolve_alias(name: str) -> str:
    for old, new in ALIASES.items():
        if name == old or name.startswith(old + "_"):
            return new + name[len(old) :]
    return name


# fixed values: dataset names that ensemble requests use, and the ensemble each stands for
ENSEMBLE_ALIASES = {
    "icon_global": "dwd_icon_eps", "icon_eu": "dwd_icon_eu_eps", "icon_d2": "dwd_icon_d2_eps", "ecmwf_ifs025": "ecmwf_ifs025_ensemble", "ecmwf_aifs025": "ecmwf_aifs025_ensemble", "gem_global": "cmc_gem_geps",
    "gfs025": "ncep_gefs025", "gfs05": "ncep_gefs05", "meteoswiss_icon_ch1": "meteoswiss_icon_ch1_ensemble", "meteoswiss_icon_ch2": "meteoswiss_icon_ch2_ensemble",
}


def select_datasets(series: DataFrame, names: str | list[str], ensemble: bool = False) -> DataFrame:
    """Rows of the datasets, given as a list or comma-separated; in ensemble requests, names of models stand for their ensembles."""
    wanted = [n.strip() for n in (names.split(",") if isinstance(names, str) else names)]
    return series.where(F.col("domain").isin(sorted({ENSEMBLE_ALIASES.get(n, n) if ensemble else n for n in wanted})))


def select_variables(series: DataFrame, names: str | list[str]) -> DataFrame:
    """Rows of the variables, given as a list or comma-separated, old names included."""
    wanted = names.split(",") if isinstance(names, str) else names
    return series.where(F.col("variable").isin(sorted({resolve_alias(n.strip()) for n in wanted})))


def parse_variable_names(df: DataFrame, name: str = "variable") -> DataFrame:
    """Split names into base, level (hPa), height (m), statistic, lead_day and member."""
    n = F.col(name)
    number = lambda pattern: F.try_to_number(F.nullif(F.regexp_extract(n, pattern, 1), F.lit("")), F.lit("9999")).cast("int")
    base = F.regexp_replace(F.regexp_replace(n, r"_member\d+$", ""), r"_previous_day\d+$", "")
    base = F.regexp_replace(F.regexp_replace(base, r"_spread$", ""), r"_\d+(?:hPa|m)$", "")
    return df.withColumns(
        {
            "base": base,
            "level": number(r"_(\d+)hPa"),
            "height": number(r"_(\d+)m(?:_|$)"),
            "statistic": F.when(n.rlike(r"_spread(?:_|$)"), F.lit("spread")).otherwise(F.lit("value")),
            "lead_day": F.coalesce(number(r"_previous_day(\d+)"), F.lit(0)),
            "member": F.coalesce(number(r"_member(\d+)"), F.lit(0)),
        }
    )


def time_range_for(places: DataFrame, now: Column, past_days: int = 0, forecast_days: int = 7, offset: str = "utc_offset_seconds", max_days: int = 16) -> DataFrame:
    """Add start and stop (read times): whole local days around now, aligned to whole hours of the offset."""
    if not (0 <= past_days <= 92 and 0 <= forecast_days <= max_days):
        raise ValueError(f"past_days within 0..92 and forecast_days within 0..{max_days}")
    hours = F.floor(F.col(offset) / 3600) * 3600
    today = F.floor((F.unix_seconds(now) + F.col(offset)) / 86400) * 86400 - hours
    return places.withColumns({"start": F.timestamp_seconds(today - 86400 * past_days), "stop": F.timestamp_seconds(today + 86400 * forecast_days)})


def date_range_for(places: DataFrame, start_date: str, end_date: str, offset: str = "utc_offset_seconds", earliest: str = "1940-01-01", latest: str = "2100-01-01") -> DataFrame:
    """Add start and stop (read times) of whole local days from start_date to end_date, both included, aligned to whole hours of
    the offset. Dates must be ordered and within the limits."""
    if not earliest <= start_date <= end_date <= latest:
        raise ValueError(f"dates must be ordered and within {earliest} to {latest}")
    hours = F.floor(F.col(offset) / 3600) * 3600
    day = lambda text: F.unix_seconds(F.lit(text).cast("timestamp")) - hours
    return places.withColumns({"start": F.timestamp_seconds(day(start_date)), "stop": F.timestamp_seconds(day(end_date) + 86400)})


def run_range_for(places: DataFrame, run: str, steps: int, dt: int) -> DataFrame:
    """Add start and stop of a single run: so many steps from the run's time on."""
    first = F.lit(run).cast("timestamp")
    return places.withColumns({"start": first, "stop": F.timestamp_seconds(F.unix_seconds(first) + steps * dt)})


def step_range_for(places: DataFrame, now: Column, steps: int, dt: int = 3600, past: int = 0, initial: str = "next") -> DataFrame:
    """Add start and stop of so many steps of dt seconds (900 for quarters): from the step after now (next), the one that now
    lies in (current), or midnight of its day (midnight), and `past` steps before it."""
    seconds_now = F.unix_seconds(now)
    first = {"next": F.ceil(seconds_now / dt) * dt, "current": F.floor(seconds_now / dt) * dt, "midnight": F.floor(seconds_now / 86400) * 86400}[initial]
    return places.withColumns({"start": F.timestamp_seconds(first - past * dt), "stop": F.timestamp_seconds(first + steps * dt)})


def steps_ahead(now: Column, steps: int, dt: int, past: int = 0) -> tuple[Column, Column]:
    """Start and stop of so many steps from the one after now, or from past steps before it."""
    first = F.ceil(F.unix_seconds(now) / dt) * dt
    return F.timestamp_seconds(first - past * dt), F.timestamp_seconds(first + steps * dt)


def time_spine(places: DataFrame, dt: int | str, start: str = "start", stop: str = "stop", time: str = "valid_time") -> DataFrame:
    """One row for each place and step in [start, stop). dt: seconds, or week (Mondays) or month."""
    a, b = F.col(start), F.col(stop)
    if dt == "month":
        first = F.date_trunc("month", a + F.expr("interval 1 month") - F.expr("interval 1 microsecond"))
        spread = F.sequence(first, b, F.expr("interval 1 month"))
    elif dt == "week":
        first = F.date_trunc("week", a + F.expr("interval 7 day") - F.expr("interval 1 microsecond"))
        spread = F.sequence(first, b, F.expr("interval 7 day"))
    else:
        first = F.timestamp_seconds(F.ceil(seconds(start) / dt) * dt)
        spread = F.sequence(first, b, F.expr(f"interval {int(dt)} second"))
    rows = places.where((a < b) & (first < b)).withColumn(time, F.explode(spread))
    return rows.where(F.col(time) < F.col(stop))


def expand_requests(places: DataFrame, dates: DataFrame, order: str = "position") -> DataFrame:
    """Places with ranges: one of either with all of the other, or pairs by position. Anything else is an error."""
    n, m = places.count(), dates.count()
    if n == 1 or m == 1:
        one, many = (dates, places) if m == 1 else (places, dates)
        if one.count() != 1:
            raise ValueError("one side must have exactly one row")
        return many.drop(order).join(F.broadcast(one.drop(order)))
    if n != m:
        raise ValueError(f"{n} places with {m} date ranges")
    return places.join(dates, order)


def validate_places(places: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add reason: null for good places."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    reason = F.when(bad(lat) | bad(lon), "coordinate missing").when(F.abs(lat) > 90, "latitude outside -90 to 90").when(F.abs(lon) > 180, "longitude outside -180 to 180")
    return places.withColumn("reason", reason)


def align_to_local_period(places: DataFrame, period: str, run: str = "run_time", offset: str = "utc_offset_seconds") -> DataFrame:
    """Places whose run starts at local midnight (day), Monday (week) or first day (month)."""
    local = F.timestamp_seconds(seconds(run) + F.col(offset))
    return places.where(local == F.date_trunc(period, local))


def select_members(series: DataFrame, single: list[str], n: int | None = None) -> DataFrame:
    """The first n members, and only member 0 of variables that have one."""
    own = (F.col("member") == 0) | ~F.col("variable").isin(single)
    return series.where(own if n is None else own & (F.col("member") < n))


# units ---------------------------------------------------------------------------------------------------------------

# fixed values: factor, added constant and new unit by unit and wanted unit
UNITS = {
    ("°C", "fahrenheit"): (1.8, 32.0, "°F"),
    ("m/s", "kmh"): (3.6, 0.0, "km/h"),
    ("m/s", "mph"): (2.237, 0.0, "mp/h"),
    ("m/s", "kn"): (1.94384, 0.0, "kn"),
    ("mm", "inch"): (1 / 25.4, 0.0, "inch"),
    ("cm", "inch"): (1 / 2.54, 0.0, "inch"),
    ("m", "inch"): (3.280839895, 0.0, "ft"),
}
# fixed values: decimals by unit
DIGITS = {"°C": 1, "°F": 1, "km/h": 1, "mp/h": 1, "kn": 1, "m/s": 2, "mm": 2, "cm": 2, "inch": 3, "hPa": 1, "%": 0, "W/m²": 1, "m": 2, "ft": 0, "wmo code": 0, "s": 2}


def convert_units(series: DataFrame, temperature: str = "celsius", wind: str = "kmh", precipitation: str | None = None, length: str = "metric", value: str = "value", unit: str = "unit") -> DataFrame:
    """Convert value by its unit and set the new one. Imperial lengths also make inches of amounts and feet of metres."""
    amount = precipitation or ("inch" if length == "imperial" else "mm")
    factor, shift, name = F.lit(1.0), F.lit(0.0), F.col(unit)
    for (own, wanted), (f, s, new) in UNITS.items():
        if wanted in (temperature, wind, amount):
            factor = F.when(F.col(unit) == own, F.lit(f)).otherwise(factor)
            shift = F.when(F.col(unit) == own, F.lit(s)).otherwise(shift)
            name = F.when(F.col(unit) == own, F.lit(new)).otherwise(name)
    return series.withColumns({value: F.col(value) * factor + shift, unit: name})


def pascal_to_hectopascal(series: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    pascal = F.col(unit) == "Pa"
    return series.withColumns({value: F.when(pascal, F.col(value) / 100).otherwise(F.col(value)), unit: F.when(pascal, F.lit("hPa")).otherwise(F.col(unit))})


def lapse(model: str = "cell_elevation", target: str = "elevation") -> Column:
    """0.65 K for 100 m from the model's height to the wanted one."""
    return (F.col(model) - F.col(target)) * 0.0065


def correct_elevation(series: DataFrame, variables: list[str], model: str = "cell_elevation", target: str = "elevation", value: str = "value") -> DataFrame:
    """0.65 K for 100 m on the variables that depend on height; nothing where a height is missing."""
    by = lapse(model, target)
    return series.withColumn(value, F.when(F.col("variable").isin(variables) & by.isNotNull(), F.col(value) + by).otherwise(F.col(value)))


def clamp_values(series: DataFrame, bounds: DataFrame, value: str = "value") -> DataFrame:
    """Keep values within lower_bound and upper_bound of their variable; a bound may be null."""
    joined = series.join(bounded(bounds.select("variable", "lower_bound", "upper_bound"), 10_000, "a table of bounds"), "variable", "left")
    out = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("lower_bound")), F.col("upper_bound")))
    return joined.withColumn(value, out).select(*series.columns)


def round_to_unit(series: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Decimals by unit."""
    out = F.round(F.col(value), 2)
    for name, digits in DIGITS.items():
        out = F.when(F.col(unit) == name, F.round(F.col(value), digits)).otherwise(out)
    return series.withColumn(value, out)


def format_time(series: DataFrame, form: str = "iso8601", daily: bool = False, offset: str | None = None, time: str = "valid_time") -> DataFrame:
    """Local ISO text, or epoch seconds, or dates alone."""
    local = F.col(time) if offset is None else F.timestamp_seconds(seconds(time) + F.col(offset))
    out = seconds(time) if form == "unixtime" else F.date_format(local, "yyyy-MM-dd" if daily else "yyyy-MM-dd'T'HH:mm")
    return series.withColumn(time, out)


def query_cost(requests: DataFrame, key: str, variables: str = "n_variables", days: str = "n_days") -> DataFrame:
    """Weight of requests: ten variables over two weeks cost 1 for each place, and no place less."""
    share = F.col(variables) / 10
    return requests.groupBy(key).agg(F.sum(F.greatest(F.lit(1.0), share, share * F.col(days) / 14)).alias("cost"))


def drop_empty_series(series: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    by = keys(series, by)
    return series.join(series.groupBy(*by).agg(F.count(value).alias("_n")).where("_n > 0").select(*by), by, "left_semi")


def order_result(result: DataFrame, place: str, columns: list[str], time: str = "valid_time") -> DataFrame:
    return result.orderBy(place, time).select(place, time, *columns)


def limit_places(places: DataFrame, n: int, reject: bool = True, key: str = "place_id") -> DataFrame:
    """The places, if there are at most n; else an error, or the first n by id."""
    if not reject:
        return places.orderBy(key).limit(n)
    found = places.limit(n + 1).count()
    if found > n:
        raise ValueError(f"over {n} places")
    return places


def gaps(series: DataFrame, dt: int, by: list[str] | None = None, time: str = "valid_time") -> DataFrame:
    """Steps that are missing between neighbouring rows."""
    before = F.lag(time).over(Window.partitionBy(*keys(series, by)).orderBy(time))
    return series.withColumn("missing_steps", (seconds(time) - F.unix_seconds(before)) / dt - 1).where("missing_steps > 0")
