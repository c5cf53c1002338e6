"""Weather formulas as column expressions; every argument is a column or a number, missing values are null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Num, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def at_least(x: Num, low: float) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(col(x), F.lit(low)))


# wind -----------------------------------------------------------------------------------------------------------


def wind_speed(u: Num, v: Num) -> Column:
    return F.sqrt(col(u) * col(u) + col(v) * col(v))


def wind_direction(u: Num, v: Num) -> Column:
    """Where the wind comes from, in (0, 360]; 270 without wind."""
    return F.when((col(u) == 0) & (col(v) == 0), F.lit(270.0)).otherwise(F.degrees(F.atan2(col(u), col(v))) + 180)


def u_wind(speed: Num, direction: Num) -> Column:
    return -col(speed) * F.sin(F.radians(col(direction)))


def v_wind(speed: Num, direction: Num) -> Column:
    return -col(speed) * F.cos(F.radians(col(direction)))


def wind_factor(from_height: float, to_height: float) -> float:
    """Logarithmic profile over short grass between two heights in metres."""
    log = lambda z: math.log(67.8 * z - 5.42)
    return log(to_height) / log(from_height)


def wind_at_height(speed: Num, from_height: float, to_height: float) -> Column:
    return col(speed) * F.lit(wind_factor(from_height, to_height))


def speed_spread(u: Num, v: Num, u_spread: Num, v_spread: Num) -> Column:
    """First-order error of the speed; 0 without wind."""
    s = wind_speed(u, v)
    return F.when(s == 0, F.lit(0.0)).otherwise(F.sqrt((col(u) * col(u_spread)) ** 2 + (col(v) * col(v_spread)) ** 2) / s)


def direction_spread(u: Num, v: Num, u_spread: Num, v_spread: Num) -> Column:
    """First-order error of the direction in degrees; 0 without wind."""
    square = col(u) * col(u) + col(v) * col(v)
    error = F.sqrt((col(v) * col(u_spread)) ** 2 + (col(u) * col(v_spread)) ** 2) / square
    return F.when(square == 0, F.lit(0.0)).otherwise(F.degrees(error))


def true_north(direction: Num, north: Num) -> Column:
    """Direction on a projected grid turned by the grid's angle to the pole."""
    return F.pmod(col(direction) - col(north) + 360, F.lit(360.0))


# humidity --------------------------------------------------------------------------------------------------------


def _magnus(t: Num) -> Column:
    return 17.625 * col(t) / (243.04 + col(t))


def _tetens(t: Num) -> Column:
    """Saturation vapour pressure in kPa."""
    return 0.6108 * F.exp(17.27 * col(t) / (col(t) + 237.3))


def relative_humidity(temperature: Num, dew_point: Num) -> Column:
    return clamp(100 * F.exp(_magnus(dew_point) - _magnus(temperature)), 0.0, 100.0)


def dew_point(temperature: Num, humidity: Num) -> Column:
    x = F.log(col(humidity) / 100) + _magnus(temperature)
    return 243.04 * x / (17.625 - x)


def dew_point_daily(t_max: Num, t_min: Num, humidity: Num) -> Column:
    x = F.log(col(humidity) / 100) + (_magnus(t_min) + _magnus(t_max)) / 2
    return 243.04 * x / (17.625 - x)


def humidity_from_specific(specific: Num, temperature: Num, pressure: Num) -> Column:
    """Relative humidity of g/kg at °C and hPa over water, ice, or a mixture between 250.16 and 273.16 K."""
    q, t = col(specific) / 1000, col(temperature) + 273.15
    e = q * col(pressure) * 100 / (0.622 + 0.378 * q)
    ice = F.exp(9.550426 - 5723.265 / t + 3.53068 * F.log(t) - 0.00728332 * t)
    water = F.exp(
        54.842763 - 6763.22 / t - 4.21 * F.log(t) + 0.000367 * t
        + F.tanh(0.0415 * (t - 218.8)) * (53.878 - 1331.22 / t - 9.44523 * F.log(t) + 0.014025 * t)
    )
    liquid = F.when(t <= 250.16, F.lit(0.0)).when(t >= 273.16, F.lit(1.0)).otherwise(((t - 250.16) / 23.0) ** 2)
    return clamp(100 * e / (liquid * water + (1 - liquid) * ice), 0.0, 100.0)


def wet_bulb(temperature: Num, humidity: Num) -> Column:
    t, rh = col(temperature), col(humidity)
    wet = t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035
    return F.when(wet.isNotNull(), F.least(wet, t))


def apparent_temperature(temperature: Num, humidity: Num, wind_10m: Num, radiation: Num | None = None) -> Column:
    t, wind = col(temperature), col(wind_10m) * 0.75
    e = col(humidity) / 100 * 6.105 * F.exp(17.27 * t / (237.7 + t))
    absorbed = F.lit(0.0) if radiation is None else at_least(0.1 * (col(radiation) - 550), 0.0)
    return t + 0.348 * e - 0.70 * wind + 0.70 * absorbed / (wind + 10) - 4.25


def vapour_pressure_deficit(temperature: Num, dew: Num) -> Column:
    return at_least(_tetens(temperature) - _tetens(dew), 0.0)


def vapour_pressure_deficit_daily(t_max: Num, t_min: Num, rh_max: Num | None = None, rh_min: Num | None = None, rh_mean: Num | None = None) -> Column:
    low, high = _tetens(t_min), _tetens(t_max)
    actual = col(rh_mean) / 100 * (low + high) / 2 if rh_mean is not None else (low * col(rh_max) + high * col(rh_min)) / 200
    return (low + high) / 2 - actual


def leaf_wetness(temperature: Num, dew: Num, precipitation: Num) -> Column:
    return _wetness(col(temperature), vapour_pressure_deficit(temperature, dew), precipitation)


def leaf_wetness_daily(t_max: Num, t_min: Num, rh_mean: Num, precipitation: Num) -> Column:
    return _wetness((col(t_max) + col(t_min)) / 2, vapour_pressure_deficit_daily(t_max, t_min, rh_mean=rh_mean), precipitation)


def _wetness(t: Column, deficit: Column, precipitation: Num) -> Column:
    dry = clamp((t - 5) / 10, 0.0, 1.0) * clamp(1 - (deficit - 0.1) * 1.25, 0.0, 1.0) * 100
    return F.when(col(precipitation) > 1, F.least(80 + col(precipitation) * 2, F.lit(100.0))).otherwise(dry)


# evapotranspiration ------------------------------------------------------------------------------------------------

STEFAN_BOLTZMANN_HOURLY = 0.20429166e-9
ALBEDO = 0.23


def evapotranspiration(latent_heat_flux: Num) -> Column:
    return at_least(col(latent_heat_flux) * -3600 / 2.5e6, 0.0)


def _slope(t: Num) -> Column:
    return 4098 * _tetens(t) / F.pow(col(t) + 237.3, F.lit(2.0))


def _psychrometric(elevation: Num) -> Column:
    return 0.000665 * 101.3 * F.pow((293 - 0.0065 * col(elevation)) / 293, F.lit(5.26))


def _cloudiness(radiation: Num, elevation: Num, top: Num, humidity: Num) -> Column:
    """Share of clear-sky radiation, from humidity at night."""
    clear = (0.75 + 0.00002 * col(elevation)) * col(top)
    return F.when(col(top) <= 0, 0.8 - 0.4 * clamp(humidity, 0.0, 100.0) / 100).otherwise(F.least(col(radiation) / clear, F.lit(1.0)))


def reference_evapotranspiration(temperature: Num, wind_10m: Num, dew: Num, radiation: Num, elevation: Num, top_radiation: Num, dt_seconds: int) -> Column:
    """FAO-56 for short steps, in mm for the step. Radiation in W/m²."""
    t, wind, ea = col(temperature), wind_at_height(wind_10m, 10, 2), _tetens(dew)
    slope, gamma = _slope(t), _psychrometric(elevation)
    share = _cloudiness(radiation, elevation, top_radiation, relative_humidity(temperature, dew))
    long_wave = STEFAN_BOLTZMANN_HOURLY * F.pow(t + 273.16, F.lit(4.0)) * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * share - 0.35)
    net = col(radiation) * (1 - ALBEDO) * 0.0864 / 24 - long_wave
    ground = F.when(col(radiation) <= 0, 0.5 * net).otherwise(0.1 * net)
    et = (0.408 * slope * (net - ground) + gamma * 37 / (t + 273) * wind * (_tetens(t) - ea)) / (slope + gamma * (1 + 0.34 * wind))
    return at_least(et * (dt_seconds / 3600), 0.0)


def reference_evapotranspiration_daily(t_max: Num, t_min: Num, t_mean: Num, wind_10m: Num, radiation_mj: Num, elevation: Num, top_mj: Num, rh_mean: Num) -> Column:
    """FAO-56 for days, in mm; radiation from the temperature range where it is missing."""
    low, high, wind = _tetens(t_min), _tetens(t_max), wind_at_height(wind_10m, 10, 2)
    radiation = F.coalesce(col(radiation_mj), 0.16 * F.sqrt(col(t_max) - col(t_min)) * col(top_mj))
    ea = col(rh_mean) / 100 * (low + high) / 2
    slope, gamma = _slope(t_mean), _psychrometric(elevation)
    share = _cloudiness(radiation, elevation, top_mj, rh_mean)
    fourth = lambda t: F.pow(col(t) + 273.16, F.lit(4.0))
    long_wave = STEFAN_BOLTZMANN_HOURLY * (fourth(t_max) + fourth(t_min)) / 2 * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * share - 0.35)
    net = radiation * (1 - ALBEDO) - long_wave
    et = (0.408 * slope * net + gamma * 900 / (col(t_mean) + 273) * wind * ((low + high) / 2 - ea)) / (slope + gamma * (1 + 0.34 * wind))
    return at_least(et, 0.0)


# pressure ----------------------------------------------------------------------------------------------------------


def _barometric(temperature: Num, elevation: Num) -> Column:
    h = col(elevation)
    return F.pow(1 - 0.0065 * h / (col(temperature) + 273.15 + 0.0065 * h), F.lit(-5.25578129287))


def surface_pressure(temperature: Num, sea_level: Num, elevation: Num) -> Column:
    return col(sea_level) / _barometric(temperature, F.coalesce(col(elevation), F.lit(0.0)))


def sea_level_pressure(temperature: Num, surface: Num, elevation: Num) -> Column:
    return col(surface) * _barometric(temperature, F.when(col(elevation) <= -999, F.lit(0.0)).otherwise(col(elevation)))


def elevation_from_pressures(sea_level: Num, surface: Num, temperature: Num) -> Column:
    r = F.pow(col(surface) / col(sea_level), F.lit(0.1902666690786014))
    return 153.846 * (col(temperature) + 273.15) * (1 - r) / r


def altitude_of_pressure(pressure: Num) -> Column:
    return -1e5 / 2.25577 * (F.pow(col(pressure) / 1013.25, F.lit(1 / 5.25588)) - 1)


def pressure_of_altitude(altitude: Num) -> Column:
    return 1013.25 * F.pow(1 - 2.25577e-5 * col(altitude), F.lit(5.25588))


def air_density(temperature: Num, humidity: Num, pressure: Num) -> Column:
    t = col(temperature) + 273.15
    vapour = col(humidity) / 100 * 610.5 * F.exp(17.27 * col(temperature) / (237.7 + col(temperature)))
    return (col(pressure) * 100 - vapour) / (287.058 * t) + vapour / (461.495 * t)


def vertical_velocity(omega: Num, temperature: Num, pressure: Num) -> Column:
    density = col(pressure) * 100 / (287.058 * (col(temperature) + 273.15))
    return -col(omega) / (density * 9.80665)


# clouds ------------------------------------------------------------------------------------------------------------


def cloud_cover_at_level(humidity: Num, pressure: Num) -> Column:
    critical = 0.7 + 0.2 * F.exp(1 - F.pow(1013.25 / col(pressure), F.lit(4.0)))
    return 100 * at_least(1 - F.sqrt(at_least(1 - col(humidity) / 100, 0.0) / (1 - critical)), 0.0)


def cloud_cover_total(low: Num, mid: Num, high: Num) -> Column:
    total = col(low) * 0.9 + col(mid) * 0.6 + col(high) * 0.3
    return F.when(total.isNotNull(), F.least(total, F.lit(100.0)))


def cloud_cover_of_group(humidities: dict[int, Num]) -> Column:
    """Largest cover over several levels, by pressure."""
    covers = [cloud_cover_at_level(rh, p) for p, rh in humidities.items()]
    return F.greatest(*covers, F.lit(0.0)) if covers else F.lit(None).cast("double")


# precipitation and snow ----------------------------------------------------------------------------------------------


def snowfall_water_equivalent(precipitation: Num, temperature: Num, elevation: Num | None = None, snow_line: Num | None = None) -> Column:
    cold = col(temperature) < 0
    if snow_line is not None and elevation is not None:
        cold = F.when(col(snow_line).isNotNull(), col(snow_line) <= col(elevation)).otherwise(cold)
    return F.when(cold, col(precipitation)).when(~cold, F.lit(0.0))


def snowfall(water_equivalent: Num) -> Column:
    """Centimetres of snow from millimetres of water."""
    return col(water_equivalent) * 0.7


def rain(precipitation: Num, snow_water: Num, showers: Num | None = None) -> Column:
    return at_least(col(precipitation) - col(snow_water) - (F.lit(0.0) if showers is None else F.coalesce(col(showers), F.lit(0.0))), 0.0)


def total_precipitation(rain_: Num, snow: Num, graupel: Num | None = None) -> Column:
    return col(rain_) + col(snow) + (F.lit(0.0) if graupel is None else col(graupel))


def snow_from_frozen_percent(precipitation: Num, percent: Num) -> Column:
    """Frozen part of the precipitation; negative percentages count as none."""
    return col(precipitation) * clamp(percent, 0.0, 100.0) / 100


def water_equivalent_from_snow(snow_cm: Num, liquid_ratio: Num, precipitation: Num, elevation: Num | None = None, snow_line: Num | None = None) -> Column:
    """At most the precipitation; all of it well above the snow line."""
    found = F.when(col(liquid_ratio) > 0, F.least(col(snow_cm) * 10 / col(liquid_ratio), col(precipitation))).otherwise(F.lit(0.0))
    if elevation is not None and snow_line is not None:
        found = F.when(col(elevation) > col(snow_line) + 200, col(precipitation)).otherwise(found)
    return F.when(col(precipitation).isNotNull() & col(snow_cm).isNotNull(), found)


def snow_depth_from_water(water_kg: Num, density: Num) -> Column:
    return F.when(col(density) > 0, col(water_kg) / col(density))


def snow_water_from_depth(depth_m: Num, density: Num) -> Column:
    return col(depth_m) * col(density)


def snowfall_height(height: Num, elevation: Num, temperature: Num) -> Column:
    """A snow line at or below ground is lowered by the temperature below freezing, at 0.7 K per 100 m."""
    return F.when((col(height) <= col(elevation)) & (col(temperature) < 0), col(elevation) + col(temperature) / 0.007).otherwise(col(height))


# soil and growth ---------------------------------------------------------------------------------------------------

# fixed values: field capacity and wilting point of soil types 1 to 7
FIELD_CAPACITY = [0.244, 0.347, 0.383, 0.448, 0.541, 0.663, 0.323]
WILTING_POINT = [0.059, 0.151, 0.133, 0.279, 0.335, 0.267, 0.171]


def soil_moisture_index(moisture: Num, soil_type: Column) -> Column:
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), soil_type.cast("int") - 1)
    return (col(moisture) - pick(WILTING_POINT)) / (pick(FIELD_CAPACITY) - pick(WILTING_POINT))


def soil_0_to_100cm(layer_0_7: Num, layer_7_28: Num, layer_28_100: Num) -> Column:
    return col(layer_0_7) * 0.07 + col(layer_7_28) * 0.21 + col(layer_28_100) * 0.72


def growing_degree(temperature: Num, base: float = 0.0, limit: float = 50.0) -> Column:
    """Degree days of one hour."""
    return clamp(col(temperature) - base, 0.0, limit - base) / 24
