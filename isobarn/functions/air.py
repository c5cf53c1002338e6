"""Air quality indices as column expressions over fixed breakpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobarn.functions.meteo import Num, col

# fixed values: breakpoints of the European index, one class for each 20 points
EUROPE = {
    "nitrogen_dioxide": [0, 10, 25, 60, 100, 150],
    "ozone": [0, 60, 100, 120, 160, 180],
    "sulphur_dioxide": [0, 20, 40, 125, 190, 275],
    "pm2_5": [0, 5, 15, 50, 90, 140],
    "pm10": [0, 15, 45, 120, 195, 270],
}

# fixed values: breakpoints of the United States index; None where a class has none
UNITED_STATES = {
    "ozone": [None, None, 125, 165, 205, 405, 505, 605],
    "ozone_8h": [0, 55, 70, 85, 105, 200, None, None],
    "pm2_5_24h": [0, 9, 35.5, 55.5, 125.5, 225.5, 325.5, 500],
    "pm10_24h": [0, 55, 155, 255, 355, 425, 505, 605],
    "carbon_monoxide_8h": [0, 4.5, 9.5, 12.5, 15.5, 30.5, 40.5, 50.5],
    "sulphur_dioxide": [0, 35, 75, 185, 305, None, None, None],
    "sulphur_dioxide_24h": [None, None, None, None, 305, 605, 805, 1005],
    "nitrogen_dioxide": [0, 54, 100, 360, 650, 1250, 1650, 2050],
}
# fixed values: µg/m³ of one ppb
MICROGRAMS_PER_PPB = {"ozone": 1.96, "nitrogen_dioxide": 1.88, "sulphur_dioxide": 2.62, "carbon_monoxide": 1.145}


def position(x: Num, breakpoints: list[float | None]) -> Column:
    """Fractional number of the class a value lies in; beyond the last class the last slope goes on.

    Null below the first breakpoint, and where the classes at the value are not defined.
    """
    value = col(x)
    out = F.lit(None).cast("double")
    for i in range(len(breakpoints) - 1, 0, -1):
        low, high = breakpoints[i - 1], breakpoints[i]
        if high is None:
            continue
        inside = F.lit(None).cast("double") if low is None else (i - 1) + (value - low) / (high - low)
        beyond = out if i < len(breakpoints) - 1 else inside
        out = F.when(value < high, inside).otherwise(beyond)
    first = next(b for b in breakpoints if b is not None)
    return F.when(value >= first, out)


def european_index(x: Num, pollutant: str) -> Column:
    return position(x, EUROPE[pollutant]) * 20


def _scaled(at: Column) -> Column:
    return F.when(at <= 4, at * 50).otherwise(at * 100 - 200)


def us_index(x: Num, name: str) -> Column:
    return _scaled(position(x, UNITED_STATES[name]))


def us_ozone(hourly: Num, mean_8h: Num) -> Column:
    """The larger of both rules; either alone where the other has no class."""
    a, b = position(hourly, UNITED_STATES["ozone"]), position(mean_8h, UNITED_STATES["ozone_8h"])
    return _scaled(F.greatest(a, b))


def us_sulphur_dioxide(hourly: Num, mean_24h: Num) -> Column:
    return _scaled(F.coalesce(position(hourly, UNITED_STATES["sulphur_dioxide"]), position(mean_24h, UNITED_STATES["sulphur_dioxide_24h"])))


def overall(*indices: Column) -> Column:
    """The largest index; null if one is missing."""
    there = indices[0].isNotNull()
    for x in indices[1:]:
        there = there & x.isNotNull()
    return F.when(there, F.greatest(*indices))
