"""The derivation graph: named outputs from the columns that a wide table has.

An output has rules in order of preference; the first whose inputs can be had, raw or derived, is taken. All outputs
of a request become column expressions of one projection, so nothing runs in Python and unused inputs are pruned.
Some rules need the place, time and step besides columns: the sun's geometry of the interval, or a panel's angles. The planner
finds out which of the taken rules do, and attaches each geometry once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.functions import air, codes, meteo, solar
from isobarn.operators.series import bounded


# fixed value: factor of radiation in the archives of one provider
ARCHIVE_RADIATION = 10_000_000 / (3600 * 3600)


@dataclass(frozen=True)
class Site:
    """Where and when the rows of a table are, and what a request sets besides: seconds of a step, tilt and azimuth of a
    panel (degrees; azimuth 0 south, -90 east; None tracks the sun)."""

    time: str = "valid_time"
    lat: str = "lat"
    lon: str = "lon"
    dt: int = 3600
    tilt: float | None = 0.0
    azimuth: float | None = 0.0

    @property
    def sun(self) -> solar.Sun:
        """The sun over the whole interval between rise and set."""
        return solar.Sun(_SUN)

    @property
    def high_sun(self) -> solar.Sun:
        """The sun while it is some degrees above the horizon."""
        return solar.Sun(_HIGH)


#: Prefixes of the geometries' columns, and the geometries that a rule may need.
_SUN, _HIGH = "_sun_", "_high_"
_DAY = "_is_day"
GEOMETRIES = ("sun", "high_sun", "day")


@dataclass(frozen=True)
class Rule:
    """geometry: what of GEOMETRIES must be attached; the expression then takes the Site before its inputs."""

    output: str
    inputs: tuple[str, ...]
    expression: Callable[..., Column]
    unit: str
    geometry: tuple[str, ...] = ()


RULES: dict[str, list[Rule]] = {}
#: Rules that a dataset prefers to the general ones.
DATASET_RULES: dict[str, dict[str, list[Rule]]] = {}


def register_rule(output: str, inputs: list[str], expression: Callable[..., Column], unit: str = "", dataset: str | None = None, geometry: tuple[str, ...] = ()) -> None:
    """Add a rule; later rules for an output are tried after earlier ones, those of a dataset before all general ones."""
    table = RULES if dataset is None else DATASET_RULES.setdefault(dataset, {})
    table.setdefault(output, []).append(Rule(output, tuple(inputs), expression, unit, geometry))


def _same(x: Column) -> Column:
    return x


def _scaled(from_height: float, to_height: float) -> Callable[[Column], Column]:
    return lambda x: meteo.wind_at_height(x, from_height, to_height)


def _register_all() -> None:
    r = register_rule
    for z in (10, 80, 100, 120, 180, 200):
        u, v = f"wind_u_component_{z}m", f"wind_v_component_{z}m"
        r(f"wind_speed_{z}m", [u, v], meteo.wind_speed, "m/s")
        r(f"wind_direction_{z}m", [u, v], meteo.wind_direction, "°")
        r(f"wind_speed_{z}m_spread", [u, v, u + "_spread", v + "_spread"], meteo.speed_spread, "m/s")
        r(f"wind_direction_{z}m_spread", [u, v, u + "_spread", v + "_spread"], meteo.direction_spread, "°")
    for z, others in {80: (100, 120, 10), 100: (80, 120, 10), 120: (100, 80, 10), 180: (200, 120, 100, 10), 200: (180, 120, 100, 10)}.items():
        for other in others:
            r(f"wind_speed_{z}m", [f"wind_u_component_{other}m", f"wind_v_component_{other}m"], lambda u, v, a=other, b=z: meteo.wind_at_height(meteo.wind_speed(u, v), a, b), "m/s")
            r(f"wind_direction_{z}m", [f"wind_u_component_{other}m", f"wind_v_component_{other}m"], meteo.wind_direction, "°")
    r("relative_humidity_2m", ["temperature_2m", "dew_point_2m"], meteo.relative_humidity, "%")
    r("relative_humidity_2m", ["specific_humidity_2m", "temperature_2m", "surface_pressure"], meteo.humidity_from_specific, "%")
    r("dew_point_2m", ["temperature_2m", "relative_humidity_2m"], meteo.dew_point, "°C")
    r("wet_bulb_temperature_2m", ["temperature_2m", "relative_humidity_2m"], meteo.wet_bulb, "°C")
    r("apparent_temperature", ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "shortwave_radiation"], meteo.apparent_temperature, "°C")
    r("apparent_temperature", ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"], meteo.apparent_temperature, "°C")
    r("vapour_pressure_deficit", ["temperature_2m", "dew_point_2m"], meteo.vapour_pressure_deficit, "kPa")
    r("evapotranspiration", ["latent_heat_flux"], meteo.evapotranspiration, "mm")
    r("et0_fao_evapotranspiration", ["temperature_2m", "wind_speed_10m", "dew_point_2m", "shortwave_radiation", "elevation"], lambda at, t, w, d, s, e: meteo.reference_evapotranspiration(t, w, d, s, e, at.sun.potential(), at.dt), "mm", geometry=("sun",))
    r("leaf_wetness_probability", ["temperature_2m", "dew_point_2m", "precipitation"], meteo.leaf_wetness, "%")
    r("surface_pressure", ["temperature_2m", "pressure_msl", "elevation"], meteo.surface_pressure, "hPa")
    r("pressure_msl", ["temperature_2m", "surface_pressure", "elevation"], meteo.sea_level_pressure, "hPa")
    r("air_density", ["temperature_2m", "relative_humidity_2m", "surface_pressure"], meteo.air_density, "kg/m³")
    r("cloud_cover", ["cloud_cover_low", "cloud_cover_mid", "cloud_cover_high"], meteo.cloud_cover_total, "%")
    groups = {"low": (1000, 950, 925, 900, 850), "mid": (700, 600, 500, 400), "high": (300, 250, 200, 150, 100, 50)}
    for name, levels in groups.items():
        inputs = [f"relative_humidity_{p}hPa" for p in levels]
        r(f"cloud_cover_{name}", inputs, lambda *x, p=levels: meteo.cloud_cover_of_group(dict(zip(p, x))), "%")
    for p in (1000, 925, 850, 700, 500, 300, 200):
        r(f"cloud_cover_{p}hPa", [f"relative_humidity_{p}hPa"], lambda x, p=p: meteo.cloud_cover_at_level(x, p), "%")
        r(f"vertical_velocity_{p}hPa", [f"omega_{p}hPa", f"temperature_{p}hPa"], lambda w, t, p=p: meteo.vertical_velocity(w, t, p), "m/s")
        r(f"geopotential_height_{p}hPa", [], lambda p=p: meteo.altitude_of_pressure(p), "m")
    r("snowfall_water_equivalent", ["precipitation", "temperature_2m", "elevation", "snowfall_height"], meteo.snowfall_water_equivalent, "mm")
    r("snowfall_water_equivalent", ["precipitation", "temperature_2m"], meteo.snowfall_water_equivalent, "mm")
    r("snowfall", ["snowfall_water_equivalent"], meteo.snowfall, "cm")
    r("rain", ["precipitation", "snowfall_water_equivalent", "showers"], meteo.rain, "mm")
    r("rain", ["precipitation", "snowfall_water_equivalent"], meteo.rain, "mm")
    r("precipitation", ["rain", "snowfall_water_equivalent"], meteo.total_precipitation, "mm")
    r("snow_depth", ["snow_depth_water_equivalent", "snow_density"], meteo.snow_depth_from_water, "m")
    r("snow_depth_water_equivalent", ["snow_depth", "snow_density"], meteo.snow_water_from_depth, "mm")
    r("weather_code", ["cloud_cover", "precipitation", "snowfall", "showers", "cape"], lambda c, p, s, h, e: codes.weather_code(c, p, s, showers=h, cape=e), "wmo code")
    r("weather_code", ["cloud_cover", "precipitation", "snowfall"], codes.weather_code, "wmo code")
    r("is_precipitation", ["weather_code"], lambda c: c.isin(codes.PRECIPITATION_CODES).cast("int"), "")
    for pollutant in air.EUROPE:
        r(f"european_aqi_{pollutant}", [pollutant], lambda x, p=pollutant: air.european_index(x, p), "EAQI")
    r("european_aqi", [f"european_aqi_{p}" for p in air.EUROPE], air.overall, "EAQI")
    r("us_aqi_pm2_5", ["pm2_5_24h"], lambda x: air.us_index(x, "pm2_5_24h"), "USAQI")
    r("us_aqi_pm10", ["pm10_24h"], lambda x: air.us_index(x, "pm10_24h"), "USAQI")
    r("us_aqi_nitrogen_dioxide", ["nitrogen_dioxide"], lambda x: air.us_index(x / air.MICROGRAMS_PER_PPB["nitrogen_dioxide"], "nitrogen_dioxide"), "USAQI")
    r("us_aqi_ozone", ["ozone", "ozone_8h"], lambda a, b: air.us_ozone(a / air.MICROGRAMS_PER_PPB["ozone"], b / air.MICROGRAMS_PER_PPB["ozone"]), "USAQI")
    r("us_aqi_sulphur_dioxide", ["sulphur_dioxide", "sulphur_dioxide_24h"], lambda a, b: air.us_sulphur_dioxide(a / air.MICROGRAMS_PER_PPB["sulphur_dioxide"], b / air.MICROGRAMS_PER_PPB["sulphur_dioxide"]), "USAQI")
    r("us_aqi_carbon_monoxide", ["carbon_monoxide_8h"], lambda x: air.us_index(x / air.MICROGRAMS_PER_PPB["carbon_monoxide"] / 1000, "carbon_monoxide_8h"), "USAQI")
    r("soil_moisture_index_0_to_7cm", ["soil_moisture_0_to_7cm", "soil_type"], meteo.soil_moisture_index, "")
    for x in ("soil_moisture", "soil_temperature"):
        r(f"{x}_0_to_100cm", [f"{x}_0_to_7cm", f"{x}_7_to_28cm", f"{x}_28_to_100cm"], meteo.soil_0_to_100cm, "")
    for a, b in {"soil_temperature_0cm": "soil_temperature_0_to_7cm", "soil_temperature_6cm": "soil_temperature_0_to_7cm", "soil_temperature_18cm": "soil_temperature_7_to_28cm", "soil_temperature_54cm": "soil_temperature_28_to_100cm", "soil_moisture_0_to_1cm": "soil_moisture_0_to_7cm", "soil_moisture_1_to_3cm": "soil_moisture_0_to_7cm", "soil_moisture_3_to_9cm": "soil_moisture_0_to_7cm", "soil_moisture_9_to_27cm": "soil_moisture_7_to_28cm", "soil_moisture_27_to_81cm": "soil_moisture_28_to_100cm"}.items():
        r(a, [b], _same)
    for a, others in {"temperature_80m": ("temperature_100m",), "temperature_120m": ("temperature_150m", "temperature_100m"), "temperature_180m": ("temperature_200m",)}.items():
        for b in others:
            r(a, [b], _same, "°C")
    r("diffuse_radiation", ["shortwave_radiation", "direct_radiation"], lambda s, d: meteo.at_least(s - d, 0.0), "W/m²")
    r("direct_radiation", ["shortwave_radiation", "diffuse_fraction"], lambda s, f: s * (1 - f), "W/m²")
    r("direct_radiation", ["shortwave_radiation", "diffuse_radiation"], lambda s, d: meteo.at_least(s - d, 0.0), "W/m²")
    r("shortwave_radiation", ["direct_radiation", "diffuse_radiation"], lambda a, b: a + b, "W/m²")
    r("shortwave_radiation_spread", ["direct_radiation_spread", "diffuse_radiation_spread"], lambda a, b: F.sqrt(a * a + b * b), "W/m²")
    watts = lambda name, inputs, expression, *geometry: r(name, inputs, expression, "W/m²", geometry=geometry)
    watts("diffuse_radiation", ["shortwave_radiation"], lambda at, s: at.sun.diffuse(s), "sun")
    watts("direct_radiation", ["shortwave_radiation"], lambda at, s: meteo.at_least(s - at.sun.diffuse(s), 0.0), "sun")
    watts("terrestrial_radiation", [], lambda at: at.sun.potential(), "sun")
    watts("terrestrial_radiation_instant", [], lambda at: at.sun.potential_instant(), "sun")
    watts("shortwave_radiation_clear_sky", [], lambda at: at.sun.clear_sky(), "sun")
    for name in ("shortwave_radiation", "direct_radiation", "diffuse_radiation", "shortwave_radiation_clear_sky"):
        watts(f"{name}_instant", [name], lambda at, x: x * at.sun.instant_factor(), "sun")
    # direct radiation on a moving or tilted plane is cut near the horizon; its instant form follows the whole sun
    normal, tilted = lambda at, d: at.high_sun.direct_normal(d), lambda at, d, f: at.high_sun.tilted(d, f, F.col(at.lat), at.tilt, at.azimuth)
    for end in ("", "_spread"):
        watts(f"direct_normal_irradiance{end}", [f"direct_radiation{end}"], normal, "high_sun")
    watts("direct_normal_irradiance_instant", ["direct_radiation"], lambda at, d: normal(at, d) * at.sun.instant_factor(), "sun", "high_sun")
    watts("global_tilted_irradiance", ["direct_radiation", "diffuse_radiation"], tilted, "high_sun")
    watts("global_tilted_irradiance_instant", ["direct_radiation", "diffuse_radiation"], lambda at, d, f: tilted(at, d, f) * at.sun.instant_factor(), "sun", "high_sun")
    r("sunshine_duration", ["direct_radiation"], lambda at, d: at.sun.sunshine(d, at.dt), "s", geometry=("sun",))
    r("is_day", [], lambda at: F.col(_DAY), "", geometry=("day",))
    for name in ("ocean_current", "wave"):
        r(f"{name}_velocity", [f"{name}_u", f"{name}_v"], meteo.wind_speed, "m/s")
        # currents and waves are named by where they go
        r(f"{name}_direction", [f"{name}_u", f"{name}_v"], lambda u, v: meteo.wind_direction(-u, -v), "°")
    r("growing_degree_days_base_0_limit_50", ["temperature_2m"], meteo.growing_degree, "")
    # daily climate data have extremes and means in place of hours
    d = "daily_climate"
    extremes = ["temperature_2m_max", "temperature_2m_min"]
    r("dew_point_2m_mean", [*extremes, "relative_humidity_2m_mean"], meteo.dew_point_daily, "°C", d)
    r("vapour_pressure_deficit_max", [*extremes, "relative_humidity_2m_mean"], lambda a, b, h: meteo.vapour_pressure_deficit_daily(a, b, rh_mean=h), "kPa", d)
    r("leaf_wetness_probability_mean", [*extremes, "relative_humidity_2m_mean", "precipitation_sum"], meteo.leaf_wetness_daily, "%", d)
    r("growing_degree_days_base_0_limit_50", extremes, lambda a, b: meteo.growing_degree((a + b) / 2) * 24, "", d)
    r("snowfall_sum", ["snowfall_water_equivalent_sum"], meteo.snowfall, "cm", d)
    r("rain_sum", ["precipitation_sum", "snowfall_water_equivalent_sum"], meteo.rain, "mm", d)
    for x in ("soil_moisture", "soil_temperature"):
        r(f"{x}_0_to_100cm_mean", [f"{x}_0_to_7cm_mean", f"{x}_7_to_28cm_mean", f"{x}_28_to_100cm_mean"], meteo.soil_0_to_100cm, "", d)
        r(f"{x}_0_to_100cm_mean", [f"{x}_0_to_10cm_mean"], _same, "", d)
    # reanalysis has winds at 100 m, which stand in for others; without showers and instability, codes come from cloud and amounts
    r("wind_speed_80m", ["wind_u_component_100m", "wind_v_component_100m"], lambda u, v: meteo.wind_at_height(meteo.wind_speed(u, v), 100, 80), "m/s", "reanalysis")
    # humidity of open pressure-level data comes from specific humidity
    for p in (1000, 925, 850, 700, 500, 300, 250, 200, 50):
        r(f"relative_humidity_{p}hPa", [f"specific_humidity_{p}hPa", f"temperature_{p}hPa"], lambda q, t, p=p: meteo.humidity_from_specific(q, t, F.lit(float(p))), "%", "pressure_levels")


_register_all()


@dataclass(frozen=True)
class Node:
    """An output by the rule that is taken for it, over raw columns (names) and other nodes."""

    output: str
    rule: Rule
    inputs: tuple[str | Node, ...]

    @property
    def needs(self) -> frozenset[str]:
        return frozenset(self.rule.geometry).union(*(x.needs for x in self.inputs if isinstance(x, Node)))

    @property
    def depth(self) -> int:
        return 1 + max((x.depth for x in self.inputs if isinstance(x, Node)), default=0)

    def nodes(self) -> dict[Node, None]:
        """This node and those below it, each once."""
        out: dict[Node, None] = {self: None}
        for x in self.inputs:
            out |= x.nodes() if isinstance(x, Node) else {}
        return out

    def expression(self, site: Site | None, inputs: list[Column]) -> Column:
        return self.rule.expression(site, *inputs) if self.rule.geometry else self.rule.expression(*inputs)


def chosen(output: str, columns: set[str], _open: frozenset[str] = frozenset(), dataset: str | None = None, site: Site | None = None) -> str | Node | None:
    """What gives the output: its name if it is a column, else the first rule that can be met; None if there is none. Without
    a site, rules with geometry can't be met."""
    if output in columns:
        return output
    if output in _open:
        return None
    for rule in [*DATASET_RULES.get(dataset or "", {}).get(output, []), *RULES.get(output, [])]:
        if rule.geometry and site is None:
            continue
        inputs = tuple(chosen(i, columns, _open | {output}, dataset, site) for i in rule.inputs)
        if all(i is not None for i in inputs):
            return Node(output, rule, inputs)
    return None


def resolve(output: str, columns: set[str], dataset: str | None = None, site: Site | None = None) -> Column | None:
    """The output as one expression over the columns; None if no rule gives it."""

    def written(x: str | Node) -> Column:
        return F.col(x) if isinstance(x, str) else x.expression(site, [written(i) for i in x.inputs])

    found = chosen(output, columns, dataset=dataset, site=site)
    return None if found is None else written(found)


def inputs_of(outputs: list[str], dataset: str | None = None) -> set[str]:
    """All names from which the outputs may be derived, themselves included."""
    found, open_ = set(), list(outputs)
    while open_:
        name = open_.pop()
        if name not in found:
            found.add(name)
            open_ += [i for rule in [*DATASET_RULES.get(dataset or "", {}).get(name, []), *RULES.get(name, [])] for i in rule.inputs]
    return found


def with_geometries(df: DataFrame, needs: frozenset[str] | set[str], site: Site) -> DataFrame:
    """The columns of the geometries, each once, behind the sun's position, which they share."""
    if "day" in needs:
        df = solar.is_day(df.withColumn("_kept", F.col("is_day")) if "is_day" in df.columns else df, site.time, site.lat, site.lon).withColumnRenamed("is_day", _DAY)
        df = df.withColumnRenamed("_kept", "is_day") if "_kept" in df.columns else df
    if {"sun", "high_sun"} & set(needs):
        df = solar.with_sun_position(df, solar.epoch(F.col(site.time)))
        for name, prefix, cutoff in (("sun", _SUN, 0.0), ("high_sun", _HIGH, solar.CUTOFF)):
            if name in needs:
                df = solar.attach_sun(df, prefix, site.time, site.lat, site.lon, site.dt, cutoff)
        df = df.drop("sun_declination", "sun_equation_of_time")
    return df


def derive(df: DataFrame, outputs: list[str], dataset: str | None = None, site: Site | None = None) -> DataFrame:
    """Add the outputs, a dataset's own rules first. An output that no rule can give is an error that names it.

    Every node that the outputs share is a column of its own, written before those that use it, so that it is computed once a row.
    """
    columns = set(df.columns)
    found = {o: chosen(o, columns, dataset=dataset, site=site) for o in outputs}
    if missing := [o for o, x in found.items() if x is None]:
        raise ValueError(f"no rule gives {missing} from {sorted(columns)}")
    tops = {o: x for o, x in found.items() if isinstance(x, Node)}
    nodes: dict[Node, None] = {}
    for x in tops.values():
        nodes |= x.nodes()
    needs = frozenset().union(*(x.needs for x in tops.values()))
    wide = with_geometries(df, needs, site) if needs else df
    name = {x: f"_node{i}" for i, x in enumerate(nodes)} | {x: o for o, x in tops.items()}
    for depth in range(1, max((x.depth for x in nodes), default=0) + 1):
        wide = wide.withColumns({name[x]: x.expression(site, [F.col(i if isinstance(i, str) else name[i]) for i in x.inputs]) for x in nodes if x.depth == depth})
    return wide.select(*df.columns, *tops)


def phase_corrected(df: DataFrame, temperature: str, model_height: str, height: str, precipitation: str = "precipitation", snow: str = "snowfall_water_equivalent", code: str = "weather_code") -> DataFrame:
    """Snow, rain and code by the sign of the temperature, where heights differ by over 100 m."""
    far = F.abs(F.col(model_height) - F.col(height)) > 100
    cold = F.col(temperature) <= 0
    fixed = F.when(cold, F.col(precipitation)).otherwise(F.lit(0.0))
    return df.withColumns({snow: F.when(far, fixed).otherwise(F.col(snow)), code: F.when(far, codes.cut_code_at_freezing(F.col(code), F.col(temperature))).otherwise(F.col(code))})


# fixed values: factors by domain and variable of stored data; showers are 0 where a domain has none but precipitation
SCALE_FIXES = {(domain, "shortwave_radiation"): ARCHIVE_RADIATION for domain in ("meteofrance_arome_france0025", "meteofrance_arome_france_hd", "meteofrance_arome_france0025_15min", "meteofrance_arome_france_hd_15min", "meteofrance_arpege_europe", "meteofrance_arpege_world025")} | {
    (domain, f"geopotential_height_{level}hPa"): 9.80665 for domain in ("jma_gsm", "jma_msm_upper_level") for level in (1000, 925, 850, 700, 600, 500, 400, 300, 250, 200, 150, 100, 70, 50)
}
NO_SHOWERS = ["ncep_gfs025", "ncep_nam_conus", "ncep_gefs025", "ncep_gefs05", "ncep_gefs025_ensemble_mean", "ncep_gefs05_ensemble_mean", "ncep_hrrr_conus", "ncep_hrrr_conus_15min", "ncep_nbm_conus"]
# fixed values: weather codes of the symbols 1 to 32 of one provider
SYMBOLS = [0, 1, 2, 3, 3, 45, 45, 61, 63, 65, 66, 66, 66, 71, 73, 75, 81, 81, 82, 85, 85, 85, 85, 85, 86, 95, 95, 95, 96, 99, 96, 99]


def zero_showers(series: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Adds showers of 0 to the precipitation of domains that store none."""
    own = series.where(F.col("domain").isin(domains or NO_SHOWERS) & (F.col("variable") == "precipitation"))
    return series.unionByName(own.withColumns({"variable": F.lit("showers"), "value": F.col("value") * 0}))


def scale_fixes(df: DataFrame, fixes: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Multiply values by (domain, variable): a dataset's corrections as data."""
    fixes = SCALE_FIXES if fixes is None else fixes
    factor = F.lit(1.0)
    for (domain, variable), f in fixes.items():
        factor = F.when((F.col("domain") == domain) & (F.col("variable") == variable), F.lit(f)).otherwise(factor)
    return df.withColumn("value", F.col("value") * factor)


def symbol_table(spark: SparkSession) -> DataFrame:
    """(symbol, weather_code) of SYMBOLS."""
    return spark.createDataFrame(list(enumerate(SYMBOLS, 1)), "symbol int, weather_code int")


def symbol_to_code(df: DataFrame, table: DataFrame | None = None, symbol: str = "symbol") -> DataFrame:
    """A provider's weather symbols by a lookup table of (symbol, weather_code); unknown ones are null."""
    table = symbol_table(df.sparkSession) if table is None else table
    return df.join(bounded(table, 10_000, "a table of symbols"), symbol, "left")


def model_height(sea_level: Column, surface: Column, temperature: Column, landmask: Column) -> Column:
    """Height of the model's ground from its pressures; -999 where the mask says sea."""
    return F.when(landmask < 0.5, F.lit(-999.0)).otherwise(meteo.elevation_from_pressures(sea_level, surface, temperature))
