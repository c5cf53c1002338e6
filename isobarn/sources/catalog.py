"""Datasets as declarative tables: domains with their grids, variables with their units, and mappings of source fields.

A family of datasets is its domains and the vocabularies in which its fields come; a vocabulary says which variable a field
is and in what unit it comes. The rescaling of S20 follows from the two units, so there is no number for each field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.operators.grids import Grid, Projection, in_region

# fixed values: variables by name: pattern, unit, interpolation, digits of a step as a factor, bounds, corrected by height
VARIABLES = [
    (r"temperature_2m|apparent_temperature|temperature_\d+m|temperature_2m_(max|min|mean)", "°C", "hermite", 20.0, None, None, True),
    (r"temperature_\d+hPa", "°C", "hermite", 20.0, None, None, False), (r"dew_point_2m|wet_bulb_temperature_2m", "°C", "hermite", 20.0, None, None, True),
    (r"(surface|soil|sea_surface)_temperature.*", "°C", "hermite", 20.0, None, None, False), (r"relative_humidity_.*|cloud_cover.*|frozen_precipitation_percent|precipitation_probability", "%", "hermite", 1.0, 0.0, 100.0, False),
    (r"specific_humidity_.*", "g/kg", "hermite", 100.0, 0.0, None, False), (r"pressure_msl|surface_pressure", "hPa", "hermite", 10.0, None, None, False),
    (r"wind_(u|v)_component_.*|wind_speed_.*|ocean_current_(u|v)|wave_(u|v)", "m/s", "hermite", 10.0, None, None, False), (r"wind_gusts_10m", "m/s", "hermite", 10.0, 0.0, None, False),
    (r"(wind|wave|wind_wave|swell_wave)_direction.*", "°", "degrees", 1.0, None, None, False), (r"(wave|wind_wave|swell_wave)_height|sea_level_height", "m", "hermite", 50.0, None, None, False),
    (r"(wave|wind_wave|swell_wave)(_peak)?_period", "s", "hermite", 20.0, 0.0, None, False), (r"precipitation(_sum)?|rain|showers|snowfall_water_equivalent|evapotranspiration|runoff", "mm", "backwards_sum", 10.0, 0.0, None, False),
    (r"snowfall", "cm", "backwards_sum", 10.0, 0.0, None, False), (r"snow_depth", "m", "linear", 100.0, 0.0, None, False), (r"(shortwave|direct|diffuse)_radiation(_mean)?", "W/m²", "solar", 1.0, 0.0, None, False),
    (r"(latent|sensible)_heat_flux", "W/m²", "hermite", 0.144, None, None, False), (r"cape", "J/kg", "hermite", 0.1, 0.0, None, False), (r"convective_inhibition", "J/kg", "hermite", 1.0, None, None, False),
    (r"visibility|boundary_layer_height|freezing_level_height|snowfall_height|geopotential_height_.*", "m", "linear", 0.1, None, None, False), (r"soil_moisture.*", "m³/m³", "hermite", 1000.0, 0.0, None, False),
    (r"diffuse_fraction", "1", "linear", 100.0, 0.0, 1.0, False), (r"snow_density", "kg/m³", "linear", 1.0, 0.0, None, False), (r"snow_depth_water_equivalent", "mm", "linear", 10.0, 0.0, None, False),
    (r"k_index|total_totals_index", "K", "hermite", 10.0, None, None, False), (r"albedo|sea_ice_concentration|sea_ice_thickness", "", "linear", 100.0, 0.0, None, False), (r"sunshine_duration", "s", "backwards_sum", 0.1, 0.0, None, False),
    (r"(convective|mass_density|vertically_integrated)_.*|updraft|lightning_potential|hail", "", "linear", 100.0, None, None, False), (r"omega_.*", "Pa/s", "hermite", 100.0, None, None, False), (r"roughness_length", "m", "linear", 100.0, 0.0, None, False),
    (r"soil_type|land_sea_mask|categorical_freezing_rain|is_day", "", "backwards", 1.0, None, None, False), (r"swell_wave_.*|secondary_.*|tertiary_.*", "m", "hermite", 50.0, None, None, False), (r"(terrestrial|clear_sky|shortwave_radiation_clear_sky).*", "W/m²", "solar", 1.0, 0.0, None, False),
    (r"dew_point_\d+hPa", "°C", "hermite", 20.0, None, None, False), (r"thunderstorm_probability|(rain|snowfall|ice_pellets|freezing_rain)_probability", "%", "linear", 1.0, 0.0, 100.0, False), (r"hail_.*", "mm", "linear", 10.0, 0.0, None, False),
    (r"uv_index.*", "", "hermite", 20.0, 0.0, None, False), (r"weather_code", "wmo code", "backwards", 1.0, None, None, False), (r"vertical_velocity_.*", "m/s", "hermite", 20.0, None, None, False),
    (r"(pm2_5|pm10|dust|nitrogen_dioxide|nitrogen_monoxide|ozone|sulphur_dioxide|ammonia|carbon_monoxide)", "µg/m³", "hermite", 10.0, 0.0, None, False), (r"(alder|birch|grass|mugwort|olive|ragweed)_pollen", "grains/m³", "linear", 10.0, 0.0, None, False),
    (r"carbon_dioxide|methane", "ppm", "hermite", 1.0, 0.0, None, False), (r"aerosol_optical_depth|lifted_index", "", "hermite", 100.0, None, None, False), (r"river_discharge", "m³/s", "hermite", 1000.0, 0.0, None, False),
    (r"elevation", "m", "linear", 1.0, None, None, False), (r"total_column_integrated_water_vapour", "kg/m²", "hermite", 10.0, 0.0, None, False), (r"symbol", "", "backwards", 1.0, None, None, False),
]
# fixed values: factor and added constant from a source unit to a unit; `dt` stands for the seconds of a step
CONVERSIONS = {
    ("K", "°C"): (1.0, -273.15), ("Pa", "hPa"): (0.01, 0.0), ("1", "%"): (100.0, 0.0), ("kg/kg", "g/kg"): (1000.0, 0.0), ("kg/m²/s", "mm"): ("dt", 0.0), ("m", "mm"): (1000.0, 0.0), ("kg/m²", "mm"): (1.0, 0.0), ("m", "cm"): (100.0, 0.0),
    ("J/m²", "W/m²"): ("1/dt", 0.0), ("kg/m³", "µg/m³"): (1e9, 0.0), ("m²/s²", "m"): (1 / 9.80665, 0.0), ("cm", "m"): (0.01, 0.0), ("km/h", "m/s"): (1 / 3.6, 0.0), ("MJ/m²", "W/m²"): ("1e6/dt", 0.0), ("mol/mol", "ppm"): (1e6, 0.0), ("dm", "m"): (10.0, 0.0), ("mm/h", "mm"): ("dt/3600", 0.0),
}

# fixed values: vocabularies of source fields: field -> (variable, source unit); {p} is a pressure level in hPa
LEVELS = (1000, 925, 850, 700, 500, 300, 250, 200, 100, 50)
VOCABULARIES: dict[str, dict[str, tuple[str, str]]] = {
    "ncep": {
        "TMP:2 m above ground": ("temperature_2m", "K"), "RH:2 m above ground": ("relative_humidity_2m", "%"), "UGRD:10 m above ground": ("wind_u_component_10m", "m/s"), "VGRD:10 m above ground": ("wind_v_component_10m", "m/s"), "GUST:surface": ("wind_gusts_10m", "m/s"),
        "PRMSL:mean sea level": ("pressure_msl", "Pa"), "TCDC:entire atmosphere": ("cloud_cover", "%"), "LCDC:low cloud layer": ("cloud_cover_low", "%"), "MCDC:middle cloud layer": ("cloud_cover_mid", "%"), "HCDC:high cloud layer": ("cloud_cover_high", "%"),
        "PRATE:surface": ("precipitation", "kg/m²/s"), "CPRAT:surface": ("showers", "kg/m²/s"), "DSWRF:surface": ("shortwave_radiation", "W/m²"), "CAPE:surface": ("cape", "J/kg"), "VIS:surface": ("visibility", "m"), "SNOD:surface": ("snow_depth", "m"), "TMP:surface": ("surface_temperature", "K"),
        "TMP:{p} mb": ("temperature_{p}hPa", "K"), "UGRD:{p} mb": ("wind_u_component_{p}hPa", "m/s"), "VGRD:{p} mb": ("wind_v_component_{p}hPa", "m/s"), "HGT:{p} mb": ("geopotential_height_{p}hPa", "m"), "RH:{p} mb": ("relative_humidity_{p}hPa", "%"),
    },
    "ncep_ai": {"TMP:2 m above ground": ("temperature_2m", "K"), "UGRD:10 m above ground": ("wind_u_component_10m", "m/s"), "VGRD:10 m above ground": ("wind_v_component_10m", "m/s"), "PRMSL:mean sea level": ("pressure_msl", "Pa"), "APCP:surface": ("precipitation", "kg/m²"), "TMP:{p} mb": ("temperature_{p}hPa", "K"), "SPFH:{p} mb": ("specific_humidity_{p}hPa", "kg/kg"), "HGT:{p} mb": ("geopotential_height_{p}hPa", "m")},
    "ecmwf": {
        "2t": ("temperature_2m", "K"), "2d": ("dew_point_2m", "K"), "10u": ("wind_u_component_10m", "m/s"), "10v": ("wind_v_component_10m", "m/s"), "100u": ("wind_u_component_100m", "m/s"), "100v": ("wind_v_component_100m", "m/s"), "10fg": ("wind_gusts_10m", "m/s"), "msl": ("pressure_msl", "Pa"), "sp": ("surface_pressure", "Pa"), "tp": ("precipitation", "m"), "sf": ("snowfall_water_equivalent", "m"),
        "ssrd": ("shortwave_radiation", "J/m²"), "fdir": ("direct_radiation", "J/m²"), "tcc": ("cloud_cover", "1"), "lcc": ("cloud_cover_low", "1"), "mcc": ("cloud_cover_mid", "1"), "hcc": ("cloud_cover_high", "1"), "mucape": ("cape", "J/kg"), "skt": ("surface_temperature", "K"), "ro": ("runoff", "m"), "swvl1": ("soil_moisture_0_to_7cm", "m³/m³"), "stl1": ("soil_temperature_0_to_7cm", "K"),
        "t@{p}": ("temperature_{p}hPa", "K"), "u@{p}": ("wind_u_component_{p}hPa", "m/s"), "v@{p}": ("wind_v_component_{p}hPa", "m/s"), "gh@{p}": ("geopotential_height_{p}hPa", "m"), "q@{p}": ("specific_humidity_{p}hPa", "kg/kg"),
    },
    "icon": {
        "t_2m": ("temperature_2m", "K"), "td_2m": ("dew_point_2m", "K"), "u_10m": ("wind_u_component_10m", "m/s"), "v_10m": ("wind_v_component_10m", "m/s"), "vmax_10m": ("wind_gusts_10m", "m/s"), "pmsl": ("pressure_msl", "Pa"), "clct": ("cloud_cover", "%"), "clcl": ("cloud_cover_low", "%"), "clcm": ("cloud_cover_mid", "%"), "clch": ("cloud_cover_high", "%"), "tot_prec": ("precipitation", "kg/m²"), "snow_gsp": ("snowfall_water_equivalent", "kg/m²"),
        "aswdir_s": ("direct_radiation", "W/m²"), "aswdifd_s": ("diffuse_radiation", "W/m²"), "cape_ml": ("cape", "J/kg"), "h_snow": ("snow_depth", "m"), "hzerocl": ("freezing_level_height", "m"), "snowlmt": ("snowfall_height", "m"), "ww": ("weather_code", "wmo code"), "t@{p}": ("temperature_{p}hPa", "K"), "fi@{p}": ("geopotential_height_{p}hPa", "m²/s²"), "relhum@{p}": ("relative_humidity_{p}hPa", "%"),
    },
    "cf": {
        "air_temperature_2m": ("temperature_2m", "K"), "relative_humidity_2m": ("relative_humidity_2m", "1"), "wind_speed_10m": ("wind_speed_10m", "m/s"), "wind_direction_10m": ("wind_direction_10m", "°"), "wind_speed_of_gust": ("wind_gusts_10m", "m/s"), "air_pressure_at_sea_level": ("pressure_msl", "Pa"), "cloud_area_fraction": ("cloud_cover", "1"), "precipitation_amount": ("precipitation", "kg/m²"), "integral_of_surface_downwelling_shortwave_flux_in_air_wrt_time": ("shortwave_radiation", "J/m²"),
    },
    "cf_long": {
        "temperature_at_screen_level": ("temperature_2m", "K"), "relative_humidity_at_screen_level": ("relative_humidity_2m", "1"), "wind_speed_at_10m": ("wind_speed_10m", "m/s"), "wind_direction_at_10m": ("wind_direction_10m", "°"), "wind_gust_at_10m": ("wind_gusts_10m", "m/s"), "pressure_at_mean_sea_level": ("pressure_msl", "Pa"), "cloud_amount_of_total_cloud": ("cloud_cover", "1"), "precipitation_rate": ("precipitation", "mm/h"), "radiation_flux_in_shortwave_total_downward_at_surface": ("shortwave_radiation", "W/m²"), "visibility_at_screen_level": ("visibility", "m"), "CAPE_surface": ("cape", "J/kg"), "snowfall_rate": ("snowfall_water_equivalent", "mm/h"),
    },
    "cmip": {"tas": ("temperature_2m_mean", "K"), "tasmax": ("temperature_2m_max", "K"), "tasmin": ("temperature_2m_min", "K"), "pr": ("precipitation_sum", "kg/m²/s"), "hurs": ("relative_humidity_2m_mean", "%"), "sfcWind": ("wind_speed_10m_mean", "m/s"), "psl": ("pressure_msl", "Pa"), "clt": ("cloud_cover_mean", "%"), "rsds": ("shortwave_radiation_mean", "W/m²"), "snw": ("snowfall_water_equivalent", "kg/m²"), "mrsos": ("soil_moisture_0_to_10cm_mean", "m³/m³")},
    "cams_europe": {"pm10_conc": ("pm10", "µg/m³"), "pm2p5_conc": ("pm2_5", "µg/m³"), "no2_conc": ("nitrogen_dioxide", "µg/m³"), "o3_conc": ("ozone", "µg/m³"), "so2_conc": ("sulphur_dioxide", "µg/m³"), "co_conc": ("carbon_monoxide", "µg/m³"), "nh3_conc": ("ammonia", "µg/m³"), "dust": ("dust", "µg/m³"), "apg_conc": ("alder_pollen", "grains/m³"), "bpg_conc": ("birch_pollen", "grains/m³"), "gpg_conc": ("grass_pollen", "grains/m³")},
    "cams_global": {"pm10": ("pm10", "kg/m³"), "pm2p5": ("pm2_5", "kg/m³"), "aod550": ("aerosol_optical_depth", ""), "co2": ("carbon_dioxide", "mol/mol"), "ch4": ("methane", "mol/mol"), "uvbed": ("uv_index", "")},
    "radiation": {"SIS": ("shortwave_radiation", "W/m²"), "SID": ("direct_radiation", "W/m²")},
    "satellite_flux": {"DSSF": ("shortwave_radiation", "W/m²"), "FRACTION_DIFFUSE": ("diffuse_fraction", "1")}, "satellite_swr": {"SWR": ("shortwave_radiation", "W/m²")},
    "waves": {"swh": ("wave_height", "m"), "mwd": ("wave_direction", "°"), "mwp": ("wave_period", "s"), "shww": ("wind_wave_height", "m"), "mdww": ("wind_wave_direction", "°"), "mpww": ("wind_wave_period", "s"), "shts": ("swell_wave_height", "m"), "mdts": ("swell_wave_direction", "°"), "mpts": ("swell_wave_period", "s")},
    "marine": {"VHM0": ("wave_height", "m"), "VMDR": ("wave_direction", "°"), "VTM10": ("wave_period", "s"), "VHM0_WW": ("wind_wave_height", "m"), "VHM0_SW1": ("swell_wave_height", "m"), "uo": ("ocean_current_u", "m/s"), "vo": ("ocean_current_v", "m/s"), "zos": ("sea_level_height", "m"), "thetao": ("sea_surface_temperature", "°C")},
    "rivers": {"dis24": ("river_discharge", "m³/s")}, "heights": {"dem": ("elevation", "m")}, "rain_gauge": {"precipitation": ("precipitation_sum", "mm")},
    "grib": {
        "t2m": ("temperature_2m", "K"), "r2": ("relative_humidity_2m", "%"), "u10": ("wind_u_component_10m", "m/s"), "v10": ("wind_v_component_10m", "m/s"), "gust": ("wind_gusts_10m", "m/s"), "prmsl": ("pressure_msl", "Pa"), "tcc": ("cloud_cover", "%"), "lcc": ("cloud_cover_low", "%"), "mcc": ("cloud_cover_mid", "%"), "hcc": ("cloud_cover_high", "%"), "tp": ("precipitation", "kg/m²"), "sdwe": ("snowfall_water_equivalent", "kg/m²"), "dswrf": ("shortwave_radiation", "W/m²"), "ssrd": ("shortwave_radiation", "J/m²"), "cape": ("cape", "J/kg"), "vis": ("visibility", "m"), "t@{p}": ("temperature_{p}hPa", "K"), "gh@{p}": ("geopotential_height_{p}hPa", "m"), "r@{p}": ("relative_humidity_{p}hPa", "%"),
    },
    "arome_austria": {"T2M": ("temperature_2m", "°C"), "RH2M": ("relative_humidity_2m", "%"), "U10M": ("wind_u_component_10m", "m/s"), "V10M": ("wind_v_component_10m", "m/s"), "SP": ("surface_pressure", "Pa"), "TCC": ("cloud_cover", "1"), "RR_ACC": ("precipitation", "kg/m²"), "GLOB": ("shortwave_radiation", "J/m²"), "SNOWLMT": ("snowfall_height", "m"), "CAPE": ("cape", "J/kg"), "SYMBOL": ("symbol", "")},
    "access": {"temp_scrn": ("temperature_2m", "K"), "dewpt_scrn": ("dew_point_2m", "K"), "u10": ("wind_u_component_10m", "m/s"), "v10": ("wind_v_component_10m", "m/s"), "wndgust10m": ("wind_gusts_10m", "m/s"), "mslp": ("pressure_msl", "Pa"), "ttl_cld": ("cloud_cover", "1"), "accum_prcp": ("precipitation", "kg/m²"), "av_swsfcdown": ("shortwave_radiation", "W/m²"), "visibility": ("visibility", "m")},
    "weather_ai": {"2m_temperature": ("temperature_2m", "K"), "10m_u_component_of_wind": ("wind_u_component_10m", "m/s"), "10m_v_component_of_wind": ("wind_v_component_10m", "m/s"), "100m_u_component_of_wind": ("wind_u_component_100m", "m/s"), "mean_sea_level_pressure": ("pressure_msl", "Pa"), "total_precipitation_6hr": ("precipitation", "m"), "sea_surface_temperature": ("sea_surface_temperature", "K"), "temperature@{p}": ("temperature_{p}hPa", "K"), "geopotential@{p}": ("geopotential_height_{p}hPa", "m²/s²"), "specific_humidity@{p}": ("specific_humidity_{p}hPa", "kg/kg")},
}


@dataclass(frozen=True)
class Domain:
    """One gridded product. grid: a Grid, or the name of a Gaussian grid. Raw fields may start at Greenwich or in the north."""

    name: str
    dt: int
    grid: Grid | str
    members: int = 1
    from_greenwich: bool = False
    north_first: bool = False


def _regular(name: str, dt: int, nx: int, ny: int, south: float, west: float, dx: float, dy: float, members: int = 1, **flags) -> Domain:
    return Domain(name, dt, Grid(name, nx, ny, west, south, dx, dy), members, **flags)


def _between(name: str, dt: int, nx: int, ny: int, projection: Projection, first: tuple[float, float], last: tuple[float, float] | None = None, step: float = 0.0, members: int = 1, **flags) -> Domain:
    """A projected grid from its first cell's place and its last cell's, or the step."""
    x, y = projection.point(*first)
    if last:
        x2, y2 = projection.point(*last)
        return Domain(name, dt, Grid(name, nx, ny, x, y, (x2 - x) / (nx - 1), (y2 - y) / (ny - 1), projection), members, **flags)
    return Domain(name, dt, Grid(name, nx, ny, x, y, step, step, projection), members, **flags)


def _plane(name: str, dt: int, nx: int, ny: int, projection: Projection, x: float, y: float, step: float, members: int = 1) -> Domain:
    return Domain(name, dt, Grid(name, nx, ny, x, y, step, step, projection), members)


def _cone(lon0: float, lat0: float, lat1: float, lat2: float) -> Projection:
    return Projection("lambert", {"lon0": lon0, "lat0": lat0, "lat1": lat1, "lat2": lat2})


def _rotated(lat: float, lon: float) -> Projection:
    return Projection("rotated", {"lat": lat, "lon": lon})


H, WORLD = 3600, {"from_greenwich": True, "north_first": True}
# fixed values: families of datasets: vocabularies and domains with their grids
FAMILIES: dict[str, tuple[list[str], list[Domain]]] = {
    "bom": (["access"], [_regular("bom_access_global", H, 2048, 1536, -89.941406, -179.912109, 360 / 2048, 180 / 1536, **WORLD), _regular("bom_access_global_ensemble", 3 * H, 800, 600, -89.85, -179.775, 360 / 800, 180 / 600, 18, **WORLD)]),
    "cma": (["grib"], [_regular("cma_grapes_global", 3 * H, 2880, 1440, -89.9375, -180, 0.125, 0.125, **WORLD)]),
    "cams": (["cams_europe", "cams_global"], [_regular("cams_global", H, 900, 451, -90, -180, 0.4, 0.4, **WORLD), _regular("cams_global_greenhouse_gases", 3 * H, 3600, 1801, -90, -180, 0.1, 0.1, **WORLD), _regular("cams_europe", H, 700, 420, 71.95, -24.95, 0.1, -0.1)]),
    "chmi": (["grib"], [_regular("chmi_aladin_cz_1km", H, 501, 290, 48.5, 12.0, 6.995 / 500, 2.598 / 289), _between("chmi_aladin_central_europe_2km", H, 1053, 837, _cone(17, 46.244, 46.244, 46.244), (38.599, 1.334), step=2325)]),
    "cmip6": (["cmip"], [_regular("cmip_CMCC_CM2_VHR4", 24 * H, 1152, 768, -90, -180, 0.3125, 180 / 768), _regular("cmip_FGOALS_f3_H", 24 * H, 1440, 720, -90, -180, 0.25, 0.25), _regular("cmip_HiRAM_SIT_HR", 24 * H, 1536, 768, -90, -180, 360 / 1536, 180 / 768), _regular("cmip_MRI_AGCM3_2_S", 24 * H, 1920, 960, -90, -180, 0.1875, 0.1875), _regular("cmip_EC_Earth3P_HR", 24 * H, 1024, 512, -90, -180, 360 / 1024, 180 / 512), _regular("cmip_MPI_ESM1_2_XR", 24 * H, 768, 384, -90, -180, 360 / 768, 180 / 384), _regular("cmip_NICAM16_8S", 24 * H, 1280, 640, -90, -180, 360 / 1280, 180 / 640)]),
    "height_model": (["heights"], [_regular("copernicus_dem90", 0, 432000, 216000, -90, -180, 1 / 1200, 1 / 1200)]),
    "dmi": (["grib"], [_between("dmi_harmonie_arome_europe", H, 1906, 1606, _cone(352, 55.5, 55.5, 55.5), (39.671, -25.421997), step=2000)]),
    "dwd_satellite": (["radiation"], [_regular("dwd_sis_europe_africa_v4", H, 3201, 4121, -38, -20, 0.025, 0.025)]),
    "ecmwf_open": (["ecmwf"], [_regular("ecmwf_ifs04", 3 * H, 900, 451, -90, -180, 0.4, 0.4, north_first=True), _regular("ecmwf_ifs025", 3 * H, 1440, 721, -90, -180, 0.25, 0.25, north_first=True), _regular("ecmwf_ifs025_ensemble", 3 * H, 1440, 721, -90, -180, 0.25, 0.25, 51, north_first=True), _regular("ecmwf_aifs025_single", 6 * H, 1440, 721, -90, -180, 0.25, 0.25, north_first=True)]),
    "ecmwf_full": (["ecmwf"], [Domain("ecmwf_ifs", H, "o1280"), Domain("ecmwf_ifs_europe_ensemble", H, "o1280", 51)]),
    "ecmwf_seasonal": (["ecmwf"], [Domain("ecmwf_seas5", 6 * H, "o320", 51), Domain("ecmwf_ec46", 6 * H, "o320", 51), Domain("ecmwf_seas5_12hourly", 12 * H, "n160", 51)]),
    "reanalysis": (["ecmwf"], [_regular("copernicus_era5", H, 1440, 721, -90, -180, 0.25, 0.25, **WORLD), _regular("copernicus_era5_ocean", H, 720, 361, -90, -180, 0.5, 0.5, **WORLD), _regular("copernicus_era5_land", H, 3600, 1801, -90, -180, 0.1, 0.1, **WORLD), _between("copernicus_cerra", 3 * H, 1069, 1069, _cone(8, 50, 50, 50), (20.29228, -17.485962), (63.769516, 74.10509)), Domain("ecmwf_ifs_analysis", 6 * H, "o1280")]),
    "lsa_saf": (["satellite_flux"], [_regular("eumetsat_lsa_saf_msg_15min", 900, 3201, 3201, -80, -80, 0.05, 0.05, north_first=True), _regular("eumetsat_lsa_saf_iodc_15min", 900, 3201, 3201, -80, -40, 0.05, 0.05, north_first=True)]),
    "sarah": (["radiation"], [_regular("eumetsat_sarah3_30min", 1800, 2600, 2600, -65, -65, 0.05, 0.05)]),
    "gem": (["ncep"], [_regular("cmc_gem_gdps", 3 * H, 2400, 1201, -90, -180, 0.15, 0.15), _between("cmc_gem_rdps", H, 935, 824, Projection("stereographic", {"lat": 90.0, "lon": 249.0}), (18.14503, 217.10745), (45.405453, 349.8256)), _between("cmc_gem_hrdps", H, 2540, 1290, _rotated(-36.0885, 245.305), (39.626034, -133.62952), (47.876457, -40.708557)), _plane("cmc_gem_hrdps_west", H, 1330, 1180, _rotated(33.443381, 86.463574), -22.18489, 5.308595 - 1180 * 0.00899, 0.00899), _regular("cmc_gem_geps", 3 * H, 720, 361, -90, -180, 0.5, 0.5, 21)]),
    "geosphere": (["arome_austria"], [_regular("geosphere_arome_austria", H, 594, 492, 42.981, 5.498, 0.028, 0.018)]),
    "ncep_gfs": (["ncep"], [_regular("ncep_gfs013", H, 3072, 1536, -0.11714935 * 1535 / 2, -180, 360 / 3072, 0.11714935, **WORLD), _regular("ncep_gfs025", H, 1440, 721, -90, -180, 0.25, 0.25, **WORLD), _regular("ncep_gefs05", 3 * H, 720, 361, -90, -180, 0.5, 0.5, 31, **WORLD), _between("ncep_hrrr_conus", H, 1799, 1059, _cone(-97.5, 0, 38.5, 38.5), (21.138, -122.72), (47.8424, -60.918)), _regular("ncep_gfswave016", H, 2160, 406, -15, -180, 360 / 2160, 67.5 / 405, **WORLD)]),
    "ncep_ai": (["ncep_ai"], [_regular("ncep_gfs_graphcast025", 6 * H, 1440, 721, -90, -180, 0.25, 0.25, **WORLD), _regular("ncep_aigefs025", 6 * H, 1440, 721, -90, -180, 0.25, 0.25, 31, **WORLD)]),
    "glofas": (["rivers"], [_regular("glofas_forecast_v4", 24 * H, 7200, 3000, -59.975, -180.025, 0.05, 0.05, 51, north_first=True), _regular("glofas_forecast_v3", 24 * H, 3600, 1500, -60, -180, 0.1, 0.1, 51, north_first=True)]),
    "dwd_icon": (["icon"], [_regular("dwd_icon", H, 2879, 1441, -90, -180, 0.125, 0.125), _regular("dwd_icon_eu", H, 1377, 657, 29.5, -23.5, 0.0625, 0.0625), _regular("dwd_icon_d2", H, 1215, 746, 43.18, -3.94, 0.02, 0.02), _regular("dwd_icon_eps", H, 1439, 721, -90, -180, 0.25, 0.25, 40), _regular("dwd_icon_d2_eps", H, 1214, 745, 43.18, -3.94, 0.02, 0.02, 20)]),
    "dwd_waves": (["waves"], [_regular("dwd_gwam", 3 * H, 1440, 699, -85.25, -180, 0.25, 0.25, **WORLD), _regular("dwd_ewam", H, 526, 721, 30, -10.5, 0.1, 0.05, north_first=True)]),
    "arpae": (["icon"], [_regular("italia_meteo_arpae_icon_2i", H, 761, 761, 33.7, 3, 0.025, 0.02)]),
    "jma": (["grib"], [_regular("jma_gsm", 6 * H, 720, 361, -90, -180, 0.5, 0.5, **WORLD), _regular("jma_msm", H, 481, 505, 22.4, 120, 0.0625, 0.05, north_first=True), _regular("jma_msm_upper_level", 3 * H, 241, 253, 22.4, 120, 0.125, 0.1, north_first=True)]),
    "himawari": (["satellite_swr"], [_regular("jma_jaxa_himawari_10min", 600, 2401, 2401, -60, 80, 0.05, 0.05, north_first=True), _regular("jma_jaxa_mtg_fci_10min", 600, 2801, 2401, -60, -70, 0.05, 0.05, north_first=True)]),
    "kma": (["grib"], [_regular("kma_gdps", 3 * H, 2560, 1920, -90 + 180 / 3840, -180 + 360 / 5120, 360 / 2560, 180 / 1920, from_greenwich=True), _between("kma_ldps", H, 602, 781, _cone(126, 38, 30, 60), (32.2569, 121.834), step=1500)]),
    "knmi": (["grib"], [_between("knmi_harmonie_arome_europe", H, 676, 564, _rotated(-35, -8), (39.740627, -25.162262), (62.619324, 38.75702)), _regular("knmi_harmonie_arome_netherlands", H, 390, 390, 49, 0, 0.029, 0.018)]),
    "met_norway": (["cf"], [_between("metno_nordic_pp", H, 1796, 2321, _cone(15, 63, 63, 63), (52.30272, 1.9184653), (72.18527, 41.764282))]),
    "meteo_france": (["grib"], [_regular("meteofrance_arpege_europe", H, 741, 521, 20, -32, 0.1, 0.1, north_first=True), _regular("meteofrance_arpege_world025", H, 1440, 721, -90, -180, 0.25, 0.25, **WORLD), _regular("meteofrance_arome_france0025", H, 1121, 717, 37.5, -12.0, 0.025, 0.025, north_first=True), _regular("meteofrance_arome_france_hd", H, 2801, 1791, 37.5, -12.0, 0.01, 0.01, north_first=True)]),
    "meteoswiss": (["icon"], [_plane("meteoswiss_icon_ch1", H, 1089, 705, _rotated(43.0, 190.0), -6.46, -4.06, 0.01), _plane("meteoswiss_icon_ch2_ensemble", H, 545, 353, _rotated(43.0, 190.0), -6.46, -4.06, 0.02, 21)]),
    "mf_marine": (["marine"], [_regular("meteofrance_wave", 3 * H, 4320, 2041, -80 + 1 / 24, -180 + 1 / 24, 1 / 12, 1 / 12), _regular("meteofrance_currents", H, 4320, 2041, -80 + 1 / 24, -180 + 1 / 24, 1 / 12, 1 / 12)]),
    "nbm": (["ncep"], [_between("ncep_nbm_conus", H, 2345, 1597, Projection("lambert", {"lon0": -95.0, "lat0": 0.0, "lat1": 25.0, "lat2": 25.0}, 6371200.0), (19.229, -126.277), step=2539.7)]),
    "imerg": (["rain_gauge"], [_regular("nasa_imerg_daily", 24 * H, 3600, 1800, -89.95, -179.95, 0.1, 0.1)]),
    "ukmo": (["cf_long"], [_regular("ukmo_global_deterministic_10km", H, 2560, 1920, -90, -180, 360 / 2560, 180 / 1920), _regular("ukmo_global_ensemble_20km", H, 1280, 960, -90, -180, 360 / 1280, 180 / 960, 18), _plane("ukmo_uk_deterministic_2km", H, 1042, 970, Projection("lambert_area", {"lat": 54.9, "lon": -2.5}), -1158000.0, -1036000.0, 2000.0)]),
    "weathernext": (["weather_ai"], [_regular("google_weathernext2_ensemble", 6 * H, 1440, 721, -90, -180, 0.25, 0.25, 64, **WORLD)]),
}


def variable(name: str) -> dict:
    """Unit, interpolation, scale, bounds and correction by height of a variable; an unknown name is an error."""
    for pattern, unit, interpolation, scale, low, high, corrected in VARIABLES:
        if re.fullmatch(pattern, name) or re.fullmatch(pattern, re.sub("_(mean|max|min|sum|spread)$", "", name)):
            return {"variable": name, "unit": unit, "interpolation": interpolation, "scalefactor": scale, "lower_bound": low, "upper_bound": high, "elevation_correctable": corrected}
    raise ValueError(f"unknown variable {name}; add it to VARIABLES")


def known(name: str) -> bool:
    return any(re.fullmatch(v[0], name) or re.fullmatch(v[0], re.sub("_(mean|max|min|sum|spread)$", "", name)) for v in VARIABLES)


def variables_of(domain: str) -> set[str]:
    """The variables of a dataset of the catalogue; none for other names."""
    return {name for vocabularies, domains in FAMILIES.values() if any(d.name == domain for d in domains) for v in vocabularies for name, _ in fields(v).values()}


def fields(vocabulary: str) -> dict[str, tuple[str, str]]:
    """A vocabulary with its pressure levels written out."""
    out = {}
    for field, (name, unit) in VOCABULARIES[vocabulary].items():
        for p in LEVELS if "{p}" in field else (0,):
            out[field.replace("{p}", str(p))] = (name.replace("{p}", str(p)), unit)
    return out


def rescaling(source: str, target: str, dt: int) -> tuple[float, float]:
    if source == target:
        return 1.0, 0.0
    factor, shift = CONVERSIONS.get((source, target), (1.0, 0.0))
    steps = {"dt": float(dt), "1/dt": 1 / dt if dt else 1.0, "1e6/dt": 1e6 / dt if dt else 1.0, "dt/3600": dt / 3600}
    return (steps[factor] if isinstance(factor, str) else factor), shift


def domains_table(spark: SparkSession) -> DataFrame:
    """family, domain, dt_seconds, members, grid, nx, ny, from_greenwich, north_first."""
    rows = []
    for family, (_, domains) in FAMILIES.items():
        for d in domains:
            own = isinstance(d.grid, Grid)
            kind = (d.grid.projection.kind if d.grid.projection else "regular") if own else d.grid
            rows.append((family, d.name, d.dt, d.members, kind, d.grid.nx if own else None, d.grid.ny if own else None, d.from_greenwich, d.north_first))
    return spark.createDataFrame(rows, "family string, domain string, dt_seconds int, members int, grid string, nx int, ny int, from_greenwich boolean, north_first boolean")


def mapping_rows() -> list[tuple[str, str, str, float, float]]:
    """domain, source_variable, variable, multiply, add of every field of every domain."""
    rows = []
    for vocabularies, domains in FAMILIES.values():
        for d in domains:
            for field, (name, unit) in {f: x for v in vocabularies for f, x in fields(v).items()}.items():
                rows.append((d.name, field, name, *rescaling(unit, variable(name)["unit"], d.dt)))
    return rows


def mapping_table(spark: SparkSession) -> DataFrame:
    """The table that ingest_fields takes."""
    return spark.createDataFrame(mapping_rows(), "domain string, source_variable string, variable string, multiply double, add double")


def variables_table(spark: SparkSession) -> DataFrame:
    """domain, variable, unit, interpolation, scalefactor, bounds, elevation_correctable."""
    rows = [(d, *variable(v).values()) for d, v in sorted({(r[0], r[2]) for r in mapping_rows()})]
    return spark.createDataFrame(rows, "domain string, variable string, unit string, interpolation string, scalefactor double, lower_bound double, upper_bound double, elevation_correctable boolean")


# fixed values: readers of several datasets: name -> datasets by priority and the set of rules that comes before the general ones
READERS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "era5_seamless": (("copernicus_era5_land", "copernicus_era5", "copernicus_era5_ocean"), "reanalysis"),
    "era5": (("copernicus_era5", "copernicus_era5_ocean"), "reanalysis"),
    "era5_land": (("copernicus_era5_land",), "reanalysis"),
    "cerra": (("copernicus_cerra",), "reanalysis"),
    "climate": ((), "daily_climate"),
}

# fixed values: regions of the best models in order: name, south, north, west, east, the domain whose grid must hold the place, and
# the domains by priority. The region of the UK lacks a triangle of the Channel.
CHANNEL = [(49.9, -0.2), (49.9, 1.8), (51.1, 1.8)]
REGIONS = [
    ("benelux", 49.35, 53.79, 2.19, 7.66, "knmi_harmonie_arome_netherlands", ["knmi_harmonie_arome_netherlands", "ecmwf_ifs", "ecmwf_ifs025", "dwd_icon_d2", "dwd_icon_eu", "dwd_icon"]),
    ("nordic", 54.9, 90.1, -180.0, 180.1, "metno_nordic_pp", ["metno_nordic_pp", "ecmwf_ifs"]),
    ("uk", 49.9, 61.0, -11.0, 1.8, None, ["ukmo_uk_deterministic_2km", "ukmo_global_deterministic_10km", "ecmwf_ifs", "ecmwf_ifs025"]),
    ("central_europe", -90.0, 90.1, -180.0, 180.1, "dwd_icon_d2", ["dwd_icon_d2", "ecmwf_ifs", "ecmwf_ifs025", "dwd_icon_eu", "dwd_icon"]),
    ("western_europe", 42.10, 51.32, -6.18, 8.35, "meteofrance_arome_france_hd", ["meteofrance_arome_france_hd", "meteofrance_arome_france0025", "meteofrance_arpege_europe", "ecmwf_ifs", "dwd_icon_eu", "dwd_icon"]),
    ("northern_europe", 44.0, 66.0, -180.0, 180.1, "dmi_harmonie_arome_europe", ["dmi_harmonie_arome_europe", "ecmwf_ifs", "dwd_icon_eu", "dwd_icon"]),
    ("north_america", -90.0, 90.1, -180.0, 180.1, "ncep_hrrr_conus", ["ncep_hrrr_conus", "ncep_nbm_conus", "ecmwf_ifs", "ncep_gfs013", "dwd_icon"]),
    ("japan", 27.4, 42.65, 125.0, 145.0, "jma_msm", ["jma_msm", "ecmwf_ifs", "dwd_icon"]),
    ("eastern_europe", -90.0, 90.1, -180.0, 180.1, "dwd_icon_eu", ["dwd_icon_eu", "ecmwf_ifs", "dwd_icon"]),
    ("world", -90.0, 90.1, -180.0, 180.1, None, ["ecmwf_ifs", "ncep_gfs013", "dwd_icon"]),
]


def best_match(places: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, region, priority, domain: the models of the first of REGIONS that serves a place; no join, as the table is in the plan."""
    out = F.lit(None)
    for name, south, north, west, east, needs, domains in reversed(REGIONS):
        inside = (F.col(lat) >= south) & (F.col(lat) < north) & (F.col(lon) >= west) & (F.col(lon) < east)
        if name == "uk":
            inside = inside & in_region(F.col(lat), F.col(lon), (south, west, north, east), CHANNEL)
        if needs:
            inside = inside & grid_of(needs).cell(F.col(lat), F.col(lon)).isNotNull()
        out = F.when(inside, F.struct(F.lit(name).alias("region"), F.array(*map(F.lit, domains)).alias("domains"))).otherwise(out)
    return places.withColumn("_m", out).select(key, F.col("_m.region").alias("region"), F.posexplode("_m.domains").alias("priority", "domain"))


def domain_of(name: str) -> Domain:
    return next(d for _, domains in FAMILIES.values() for d in domains if d.name == name)


def vocabularies_of(name: str) -> list[str]:
    return next(v for v, domains in FAMILIES.values() if any(d.name == name for d in domains))


def grid_of(domain: str) -> Grid | str:
    return domain_of(domain).grid


__all__ = ["FAMILIES", "READERS", "REGIONS", "best_match", "Domain", "domain_of", "domains_table", "fields", "grid_of", "known", "mapping_rows", "mapping_table", "rescaling", "variable", "variables_of", "variables_table", "vocabularies_of"]
