"""Weather codes and thunderstorm probability as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobarn.functions.meteo import Num, clamp, col

# fixed values: weather codes by upper bound of the rate in mm or cm per hour, from 0.01 on
DRIZZLE_AND_RAIN = [(0.5, 51), (1.0, 53), (1.3, 55), (2.5, 61), (7.6, 63), (None, 65)]
FREEZING = [(0.5, 56), (1.3, 57), (2.5, 66), (None, 67)]
SNOW = [(0.2, 71), (0.8, 73), (None, 75)]
SNOW_SHOWERS = [(0.8, 85), (None, 86)]
RAIN_SHOWERS = [(1.3, None), (2.5, 80), (7.6, 81), (None, 82)]
CLOUDS = [(20, 0), (50, 1), (80, 2), (None, 3)]
SNOW_TO_RAIN = {71: 61, 73: 63, 75: 65}
PRECIPITATION_CODES = [51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85, 86]


def _class(x: Column, classes: list[tuple[float | None, int | None]], least: float) -> Column:
    out = F.lit(None).cast("int")
    for bound, code in reversed(classes):
        own = F.lit(code).cast("int")
        out = own if bound is None else F.when(x < bound, own).otherwise(out)
    return F.when(x >= least, out)


def _optional(x: Num | None) -> Column:
    return F.lit(None).cast("double") if x is None else col(x)


def thunderstorm_probability(
    cloud_cover: Num, precipitation: Num, cape: Num, latitude: Num, dt_hours: float = 1.0,
    showers: Num | None = None, gusts: Num | None = None, lifted_index: Num | None = None, inhibition: Num | None = None, boundary_layer: Num | None = None,
) -> Column:
    """Percent. A weighted mean of the scores whose inputs are there, damped by cap, cloud and latitude."""
    cover, rain, energy = col(cloud_cover), col(precipitation), col(cape)
    shower, gust, lifted, cin, layer = map(_optional, (showers, gusts, lifted_index, inhibition, boundary_layer))
    tropics = F.least(F.abs(col(latitude)), F.lit(30.0)) / 30
    need = (2 + 3 * (1 - tropics)) * dt_hours
    convective = shower > 0
    parts = [
        (clamp((energy - 300) / (2200 + 1500 * (1 - tropics)), 0.0, 1.0), F.lit(0.25)),
        (F.when(cin <= 15, F.lit(1.0)).otherwise(clamp(1 - (cin - 15) / 135, 0.0, 1.0)), F.when(cin.isNotNull(), F.lit(0.15))),
        (clamp(-lifted / 8, 0.0, 1.0), F.when(lifted.isNotNull(), F.lit(0.15))),
        (F.when(convective, clamp(shower / need, 0.0, 1.0)).otherwise(clamp(rain / (need * 1.6), 0.0, 1.0)), F.when(convective, F.lit(0.25)).otherwise(F.lit(0.15))),
        (clamp((layer - 300) / 1200, 0.0, 1.0), F.when(layer.isNotNull(), F.lit(0.075))),
        (clamp((gust - 5) / 13, 0.0, 1.0), F.when(gust.isNotNull(), F.lit(0.075))),
    ]
    zero = F.lit(0.0)
    score = sum((F.coalesce(s * w, zero) for s, w in parts), zero) / sum((F.coalesce(w, zero) for _, w in parts), zero) * 100
    factor = lambda rule, f: F.when(rule, F.lit(f)).otherwise(F.lit(1.0))
    boosted = F.least(score * factor((shower > 0.1 * dt_hours) & (energy > 300) & (cin < 50), 1.3), F.lit(100.0))
    damped = factor(F.coalesce(shower, rain) <= 0, 0.7) * factor(cin > 100, 0.3) * F.when(cover >= 60, F.lit(1.0)).otherwise(0.6 + 0.4 * (cover - 30) / 30)
    score = boosted * damped * (0.8 + 0.2 * tropics)
    blocked = (energy <= 10) | (cover < 30) | F.coalesce(cin > 250, F.lit(False)) | F.coalesce(lifted > 2, F.lit(False))
    return F.when(blocked, F.lit(0.0)).otherwise(clamp(score, 0.0, 100.0))


def weather_code(
    cloud_cover: Num, precipitation: Num, snowfall_cm: Num, latitude: Num = 45.0, dt_hours: float = 1.0,
    showers: Num | None = None, cape: Num | None = None, gusts: Num | None = None, lifted_index: Num | None = None,
    inhibition: Num | None = None, boundary_layer: Num | None = None, visibility: Num | None = None, freezing_rain: Num | None = None,
) -> Column:
    """Present weather; the first rule that applies: thunder, freezing, showers, snow, rain, fog, clouds."""
    cover, rain, snow = col(cloud_cover), col(precipitation), col(snowfall_cm)
    per_hour, snow_rate = rain / dt_hours, snow / dt_hours
    rules = []
    if cape is not None:
        storm = thunderstorm_probability(cover, rain, cape, latitude, dt_hours, showers, gusts, lifted_index, inhibition, boundary_layer)
        rules.append(F.when(storm > 85, F.lit(96)).when(storm > 60, F.lit(95)))
    if freezing_rain is not None:
        rules.append(F.when(col(freezing_rain) >= 1, _class(per_hour, FREEZING, 0.01)))
    if showers is not None or cape is not None:
        convective = (F.coalesce(_optional(showers), F.lit(0.0)) > 0) | (F.coalesce(_optional(cape), F.lit(0.0)) >= 800)
        rules.append(F.when(convective, F.coalesce(_class(snow_rate, SNOW_SHOWERS, 0.01), _class(per_hour, RAIN_SHOWERS, 1.3))))
    rules += [_class(snow_rate, SNOW, 0.01), _class(per_hour, DRIZZLE_AND_RAIN, 0.01)]
    if visibility is not None:
        rules.append(F.when(col(visibility) <= 1000, F.lit(45)))
    rules.append(_class(cover, CLOUDS, 0.0))
    return F.when(cover.isNotNull() & rain.isNotNull() & snow.isNotNull(), F.coalesce(*rules))


def _swap(code: Column, pairs: dict[int, int]) -> Column:
    out = code
    for a, b in pairs.items():
        out = F.when(code == a, F.lit(b)).otherwise(out)
    return out


def correct_code(code: Column, temperature: Num, precipitation: Num, snow_line_above: Column | None = None) -> Column:
    """No precipitation code without precipitation, no snow at 2 °C or below the snow line, no rain under -1 °C."""
    t = col(temperature)
    warm = t >= 2 if snow_line_above is None else (t >= 2) | snow_line_above
    back = {b: a for a, b in SNOW_TO_RAIN.items()}
    fixed = F.when(warm & code.isin(*SNOW_TO_RAIN), _swap(code, SNOW_TO_RAIN)).when((t < -1) & code.isin(*back), _swap(code, back)).otherwise(code)
    return F.when((col(precipitation) <= 0) & code.isin(PRECIPITATION_CODES), F.lit(3)).otherwise(fixed)


def cut_code_at_freezing(code: Column, temperature: Num) -> Column:
    """Snow above 0 °C becomes rain, rain below becomes snow."""
    t = col(temperature)
    back = {b: a for a, b in SNOW_TO_RAIN.items()}
    return F.when(t > 0, _swap(code, SNOW_TO_RAIN)).when(t < 0, _swap(code, back)).otherwise(code)
