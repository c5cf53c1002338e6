"""Sun position, radiation and day length over tables with a time, a latitude and a longitude.

Each function adds its results as columns; intermediate values are columns of their own in between, so that Spark
computes each once. The sun's position follows the low-precision series of Meeus (about 0.01 degrees).
An interval ends at the row's time and lasts dt seconds. Hour angles are radians, 0 at solar noon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.functions.meteo import Num, at_least, clamp, col

SOLAR_CONSTANT = 1367.7
#: Below this sine of the sun's height, ratios of radiation are not trusted.
LOW_SUN = 5 / SOLAR_CONSTANT
#: Degrees of the sun below the horizon at rise and set.
HORIZON = 0.83333
YEAR = 31_557_600
MOST_KNOTS = 100_000


def epoch(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6


def with_sun_position(df: DataFrame, seconds: Column, prefix: str = "sun_") -> DataFrame:
    """Add declination (degrees) and equation of time (minutes) at epoch seconds."""
    p = prefix + "_"
    c = lambda name: F.col(p + name)
    df = df.withColumn(p + "t", (seconds - 946728000.0) / (86400.0 * 36525))
    df = df.withColumns(
        {
            p + "l0": F.radians(280.46646 + 36000.76983 * c("t") + 0.0003032 * c("t") * c("t")),
            p + "m": F.radians(357.52911 + 35999.05029 * c("t") - 0.0001537 * c("t") * c("t")),
            p + "e": 0.016708634 - 0.000042037 * c("t"),
            p + "o": F.radians(125.04 - 1934.136 * c("t")),
        }
    )
    # multiples of an angle come from its sine and cosine, so that a row takes ten trigonometric functions
    df = df.withColumns({p + "sm": F.sin(c("m")), p + "cm": F.cos(c("m")), p + "s2": F.sin(2 * c("l0")), p + "c2": F.cos(2 * c("l0"))})
    sm, s2, c2, t = c("sm"), c("s2"), c("c2"), c("t")
    twice = 2 * sm * c("cm")
    center = (1.914602 - 0.004817 * t) * sm + (0.019993 - 0.000101 * t) * twice + 0.000289 * sm * (3 - 4 * sm * sm)
    df = df.withColumns(
        {
            p + "long": c("l0") + F.radians(center - 0.00569 - 0.00478 * F.sin(c("o"))),
            p + "tilt": F.radians(23.439291 - 0.0130042 * t + 0.00256 * F.cos(c("o"))),
        }
    )
    df = df.withColumn(p + "ct", F.cos(c("tilt")))
    df = df.withColumn(p + "y", (1 - c("ct")) / (1 + c("ct")))
    y, e = c("y"), c("e")
    equation = y * s2 - 2 * e * sm + 4 * e * y * sm * c2 - y * y * s2 * c2 - 1.25 * e * e * twice
    df = df.withColumns({prefix + "declination": F.degrees(F.asin(F.sin(c("tilt")) * F.sin(c("long")))), prefix + "equation_of_time": 4 * F.degrees(equation)})
    return df.drop(*[p + x for x in ("t", "l0", "m", "e", "o", "long", "tilt", "y", "sm", "cm", "s2", "c2", "ct")])


def sun_distance(time: Column) -> Column:
    """Distance of the sun over its mean, by the day of the average year."""
    day = F.pmod(epoch(time), F.lit(float(YEAR))) / 86400 - 3
    return 1 - 0.01672 * F.cos(F.radians(360 / 365.256363 * day))


_GEOMETRY = ["_a", "_b", "_h", "_w", "_rise", "_lo", "_hi", "_up", "_sum", "_r2"]


def with_geometry(df: DataFrame, time: str, lat: str, lon: str, dt: int, cutoff: float = 0.0) -> DataFrame:
    """Add the interval's geometry: sine of the height is _a + _b cos h; _lo to _hi is the lit part of it; _sum is the
    integral of the sine there, _w the width of the whole interval. cutoff: degrees above the horizon to leave out."""
    given = {"sun_declination", "sun_equation_of_time"} <= set(df.columns)
    df = df if given else with_sun_position(df, epoch(F.col(time)))
    c = F.col
    hours = F.pmod(epoch(c(time)), F.lit(86400.0)) / 3600
    angle = F.radians(15 * (hours - 12 + c("sun_equation_of_time") / 60) + c(lon))
    df = df.withColumns(
        {
            "_a": F.sin(F.radians(c(lat))) * F.sin(F.radians(c("sun_declination"))),
            "_b": F.cos(F.radians(c(lat))) * F.cos(F.radians(c("sun_declination"))),
            "_h": F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi,
            "_w": F.lit(math.radians(15 * dt / 3600)),
            "_r": sun_distance(c(time)),
        }
    )
    df = df.withColumn("_r2", c("_r") * c("_r")).drop("_r")
    edge = -c("_a") / c("_b")
    df = df.withColumn("_rise", F.when((edge > 1) | (edge < -1), F.lit(math.pi)).otherwise(F.acos(clamp(edge, -1.0, 1.0)) - math.radians(cutoff)))
    df = df.withColumns({"_lo": F.greatest(-c("_rise"), c("_h") - c("_w")), "_hi": F.least(c("_rise"), c("_h"))})
    df = df.withColumns({"_up": (c("_hi") > c("_lo")), "_sum": c("_b") * (F.sin(c("_hi")) - F.sin(c("_lo"))) + c("_a") * (c("_hi") - c("_lo"))})
    return df if given else df.drop("sun_declination", "sun_equation_of_time")


class Sun:
    """The columns of an interval's geometry as with_geometry names them, behind a prefix, and outputs as expressions over them."""

    def __init__(self, prefix: str = ""):
        self.a, self.b, self.h, self.w, _, self.lo, self.hi, self.up, self.sum, self.r2 = (F.col(prefix + x) for x in _GEOMETRY)

    def mean_height(self) -> Column:
        """Mean sine of the height over the interval; 0 without sun."""
        return F.when(self.up, at_least(self.sum / self.w, 0.0)).otherwise(F.lit(0.0))

    def lit_height(self) -> Column:
        """Mean sine of the height over the lit part."""
        return self.sum / F.greatest(self.hi - self.lo, F.lit(0.001))

    def instant_height(self) -> Column:
        return self.a + self.b * F.cos(self.h)

    def potential(self) -> Column:
        return SOLAR_CONSTANT * self.mean_height() / self.r2

    def potential_instant(self) -> Column:
        return SOLAR_CONSTANT * at_least(self.instant_height(), 0.0) / self.r2

    def clear_sky(self) -> Column:
        middle, half = (self.lo + self.hi) / 2, (self.hi - self.lo) / 2

        def lit(shift: float) -> Column:
            height = self.a + self.b * F.cos(middle + half * shift)
            return F.when(height < 0.005, F.lit(0.0)).otherwise(height * F.exp(-0.057 / height))

        total = half * (5 / 9 * (lit(-0.77459667) + lit(0.77459667)) + 8 / 9 * lit(0.0)) / (self.r2 * self.w)
        dark = (self.a < 0) & (-self.a / self.b >= 1)
        return F.when(self.up & ~dark, 1098 * total).otherwise(F.lit(0.0))

    def instant_factor(self) -> Column:
        mean, now = self.mean_height(), self.instant_height()
        return F.when((mean > 0) & (now > 0), now / mean).otherwise(F.lit(0.0))

    def direct_normal(self, direct: Column) -> Column:
        """Of a geometry with a cutoff of CUTOFF degrees, as are the next three."""
        return F.when(direct.isNull(), None).when((direct <= 0) | ~self.up, F.lit(0.0)).otherwise(direct / F.greatest(self.lit_height(), F.lit(math.sin(math.radians(CUTOFF)))))

    def direct_normal_instant(self, direct: Column) -> Column:
        now = self.instant_height()
        return F.when(direct.isNull(), None).when((direct <= 0) | (now <= 0), F.lit(0.0)).otherwise(direct / F.greatest(now, F.lit(math.sin(math.radians(CUTOFF)))))

    def sunshine(self, direct: Column, dt: int) -> Column:
        height = self.lit_height()
        normal = F.when(height <= 0.0001, direct).otherwise(direct / height)
        lit = dt * (self.hi - self.lo) / self.w
        found = F.least(F.greatest(normal - 60, F.lit(0.0)) / 120 * lit, lit)
        return F.when(direct.isNull(), None).when((direct <= 0) | ~self.up, F.lit(0.0)).otherwise(found)

    def diffuse(self, shortwave: Column) -> Column:
        z = F.when(self.up, self.lit_height()).otherwise(F.lit(0.0))
        clearness, angle = shortwave / F.greatest(F.least(z * SOLAR_CONSTANT, F.lit(0.95 * SOLAR_CONSTANT)), F.lit(1.0)), F.acos(clamp(z, -1.0, 1.0))
        share = F.lit(DIFFUSE_CONSTANT)
        for factor, k, i in DIFFUSE_TERMS:
            share = share + factor * F.pow(clearness, F.lit(float(k))) * F.pow(angle, F.lit(float(i)))
        return F.when(z <= LOW_SUN, shortwave).otherwise(F.least(share * shortwave, shortwave))

    def tilted(self, direct: Column, diffuse: Column, lat: Column, tilt: float | None, azimuth: float | None) -> Column:
        """On a panel with tilt and azimuth (0 south, -90 east), None to track the sun."""
        width = F.greatest(self.hi - self.lo, F.lit(0.001))
        lat_r, dec = F.radians(lat), F.acos(clamp(self.b / F.cos(F.radians(lat)), -1.0, 1.0)) * F.signum(self.a * F.signum(lat))
        z, dec = clamp(self.sum / width, -1.0, 1.0), F.when(lat == 0, F.lit(0.0)).otherwise(dec)
        east = -(F.cos(dec) * (F.cos(self.lo) - F.cos(self.hi))) / width
        north = F.cos(lat_r) * F.sin(dec) - F.sin(lat_r) * F.cos(dec) * (F.sin(self.hi) - F.sin(self.lo)) / width
        zenith, around = F.acos(z), F.atan2(east, north)
        panel = around - math.pi if azimuth is None else F.lit(math.radians(azimuth))
        slope = zenith if tilt is None else F.lit(math.radians(tilt))
        sky = (1 + F.cos(slope)) / 2
        both = direct + diffuse
        normal = F.when(z <= 0.0001, direct).otherwise(direct / z)
        facing = F.greatest(F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(around - math.pi - panel), F.lit(0.0))
        total = normal * facing + sky * diffuse + both * 0.2 * (1 - sky)
        return F.when(both.isNull(), None).when((both <= 0) | ~self.up, F.lit(0.0)).otherwise(total)


#: Degrees above the horizon below which direct radiation isn't turned to the sun or a panel.
CUTOFF = 3.0


def attach_sun(df: DataFrame, prefix: str, time: str, lat: str, lon: str, dt: int, cutoff: float = 0.0) -> DataFrame:
    """Add an interval's geometry under a prefix, for Sun; the sun's position is computed once for several of them."""
    df = df if "sun_declination" in df.columns else with_sun_position(df, epoch(F.col(time)))
    return with_geometry(df, time, lat, lon, dt, cutoff).withColumnsRenamed({x: prefix + x for x in _GEOMETRY})


def _done(df: DataFrame) -> DataFrame:
    return df.drop(*_GEOMETRY)


def potential_radiation(df: DataFrame, time: str, lat: str, lon: str, dt: int) -> DataFrame:
    """Add potential_radiation (interval mean) and potential_radiation_instant at the top of the atmosphere, W/m²."""
    df, sun = with_geometry(df, time, lat, lon, dt), Sun()
    return _done(df.withColumns({"potential_radiation": sun.potential(), "potential_radiation_instant": sun.potential_instant()}))


def clear_sky_radiation(df: DataFrame, time: str, lat: str, lon: str, dt: int) -> DataFrame:
    """Add clear_sky_radiation: three-point Gauss-Legendre mean of the attenuated radiation, W/m²."""
    return _done(with_geometry(df, time, lat, lon, dt).withColumn("clear_sky_radiation", Sun().clear_sky()))


def instant_factor(df: DataFrame, time: str, lat: str, lon: str, dt: int) -> DataFrame:
    """Add instant_factor: the sun's height at the time over its mean in the interval; 0 without sun."""
    return _done(with_geometry(df, time, lat, lon, dt).withColumn("instant_factor", Sun().instant_factor()))


def to_interval_mean(instant: Num, factor: Num) -> Column:
    """Interval mean from an instant value; unchanged where the factor is too small to divide by."""
    return F.when(col(factor) < 0.05, col(instant)).otherwise(col(instant) / col(factor))


def direct_normal(df: DataFrame, direct: str, time: str, lat: str, lon: str, dt: int) -> DataFrame:
    """Add direct_normal_irradiance (interval) and direct_normal_irradiance_instant from direct horizontal radiation."""
    df, sun = with_geometry(df, time, lat, lon, dt, cutoff=CUTOFF), Sun()
    return _done(df.withColumns({"direct_normal_irradiance": sun.direct_normal(F.col(direct)), "direct_normal_irradiance_instant": sun.direct_normal_instant(F.col(direct))}))


def sunshine_duration(df: DataFrame, direct: str, time: str, lat: str, lon: str, dt: int) -> DataFrame:
    """Add sunshine_duration in seconds: direct normal radiation from 60 to 180 W/m² counts from none to all."""
    return _done(with_geometry(df, time, lat, lon, dt).withColumn("sunshine_duration", Sun().sunshine(F.col(direct), dt)))


# fixed values: terms of the diffuse share by clearness k and zenith angle z, as (factor, power of k, power of z)
DIFFUSE_TERMS = [(1.58, 1, 0), (0.991, 0, 1), (-5.084, 2, 0), (-2.11, 1, 1), (-1.16, 0, 2), (2.918, 3, 0), (1.307, 2, 1), (0.762, 1, 2), (0.432, 0, 3)]
DIFFUSE_CONSTANT = 0.718


def diffuse_radiation(df: DataFrame, shortwave: str, time: str, lat: str, lon: str, dt: int) -> DataFrame:
    """Add diffuse_radiation from the clearness and the sun's angle; everything is diffuse at low sun."""
    return _done(with_geometry(df, time, lat, lon, dt).withColumn("diffuse_radiation", Sun().diffuse(F.col(shortwave))))


def tilted_irradiance(df: DataFrame, direct: str, diffuse: str, time: str, lat: str, lon: str, dt: int, tilt: float | None = 0.0, azimuth: float | None = 0.0) -> DataFrame:
    """Add global_tilted_irradiance on a panel with tilt and azimuth (0 south, -90 east), None to track the sun."""
    df = with_geometry(df, time, lat, lon, dt, cutoff=CUTOFF)
    return _done(df.withColumn("global_tilted_irradiance", Sun().tilted(F.col(direct), F.col(diffuse), F.col(lat), tilt, azimuth)))


def _half_day(df: DataFrame, seconds: Column, lat: str) -> DataFrame:
    """Add _arg: cosine of the hour angle at rise, with the position at epoch seconds."""
    df = with_sun_position(df, seconds, "day_")
    up, across = F.sin(F.radians(F.col(lat))), F.cos(F.radians(F.col(lat)))
    dec = F.radians(F.col("day_declination"))
    return df.withColumn("_arg", -(math.sin(math.radians(HORIZON)) + up * F.sin(dec)) / (across * F.cos(dec)))


def sunrise_sunset(df: DataFrame, midnight: str, lat: str, lon: str, offset: str | int = 0) -> DataFrame:
    """Add sunrise, sunset (timestamps) and daylight_duration (s) of the local day that starts at `midnight` plus offset
    seconds. Polar night: both at midnight; polar day: a day apart."""
    shift = F.col(offset) if isinstance(offset, str) else F.lit(offset)
    start = epoch(F.col(midnight))
    noon = 12 - F.col(lon) / 15
    df = _half_day(df, start + shift + F.floor(noon * 3600), lat)
    half = F.degrees(F.acos(clamp(F.col("_arg"), -1.0, 1.0))) / 15
    equation = F.col("day_equation_of_time") / 60
    toward = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    at = lambda x: F.timestamp_seconds(start + shift + toward(x * 3600))
    night, day = F.col("_arg") > 1, F.col("_arg") < -1
    same = F.timestamp_seconds(start)
    return df.withColumns(
        {
            "sunrise": F.when(night | day, same).otherwise(at(noon - half - equation)),
            "sunset": F.when(night, same).when(day, F.timestamp_seconds(start + 86400)).otherwise(at(noon + half - equation)),
            "daylight_duration": F.when(night, F.lit(0.0)).when(day, F.lit(86400.0)).otherwise(half * 7200),
        }
    ).drop("_arg", "day_declination", "day_equation_of_time")


def is_day(df: DataFrame, time: str, lat: str, lon: str) -> DataFrame:
    """Add is_day: 1 strictly between rise and set of the local solar day."""
    shift = F.floor(F.col(lon) / 15 * 3600)
    local = F.floor((epoch(F.col(time)) + shift) / 86400) * 86400 - shift
    df = df.withColumn("_midnight", F.timestamp_seconds(local))
    df = sunrise_sunset(df, "_midnight", lat, lon)
    found = F.when(F.col("daylight_duration") == 0, 0).when(F.col("daylight_duration") == 86400, 1)
    found = found.otherwise(((F.col(time) > F.col("sunrise")) & (F.col(time) < F.col("sunset"))).cast("int"))
    return df.withColumn("is_day", found).drop("_midnight", "sunrise", "sunset", "daylight_duration")


def build_ephemeris(spark, start: str, stop: str, step_days: int = 20) -> DataFrame:
    """knot_time, declination_deg, equation_of_time_min every step_days from start to stop."""
    knots = spark.sql(f"SELECT explode(sequence(timestamp'{start}', timestamp'{stop}', interval {step_days} day)) AS knot_time")
    found = with_sun_position(knots, epoch(F.col("knot_time")))
    return found.select("knot_time", F.col("sun_declination").alias("declination_deg"), F.col("sun_equation_of_time").alias("equation_of_time_min"))


def attach_ephemeris(df: DataFrame, ephemeris: DataFrame, time: str) -> DataFrame:
    """Add sun_declination and sun_equation_of_time by a cubic through four knots; the table repeats as a ring.

    Knots are numbered and joined by number; a century of them is some 1,800 rows, so the side is broadcast. A table of over
    MOST_KNOTS is an error.
    """
    bounds = ephemeris.agg(F.min(epoch(F.col("knot_time"))).alias("first"), F.max(epoch(F.col("knot_time"))).alias("last"), F.count(F.lit(1)).alias("n")).first()
    if bounds["n"] > MOST_KNOTS:
        raise ValueError(f"an ephemeris of over {MOST_KNOTS:,} knots")
    step = (bounds["last"] - bounds["first"]) / max(1, bounds["n"] - 1)
    number = F.round((epoch(F.col("knot_time")) - bounds["first"]) / step).cast("long")
    names = {"sun_declination": "declination_deg", "sun_equation_of_time": "equation_of_time_min"}
    knots = ephemeris.select(number.alias("_knot"), *names.values())
    around = knots
    for shift in (-1, 1, 2):
        near = knots.select(F.pmod(F.col("_knot") - shift, F.lit(bounds["n"])).alias("_knot"), *[F.col(x).alias(f"{x}_{shift}") for x in names.values()])
        around = around.join(near, "_knot")
    place = (epoch(F.col(time)) - bounds["first"]) / step
    out = df.withColumns({"_knot": F.pmod(F.floor(place), F.lit(bounds["n"])), "_f": place - F.floor(place)}).join(F.broadcast(around), "_knot", "left")
    for target, x in names.items():
        out = out.withColumn(target, cubic(F.col(f"{x}_-1"), F.col(x), F.col(f"{x}_1"), F.col(f"{x}_2"), F.col("_f")))
    return out.drop("_knot", "_f", *around.columns)


def cubic(a: Column, b: Column, c: Column, d: Column, f: Column) -> Column:
    """Cubic through b and c with slopes from the neighbours."""
    return b + f * ((c - a) / 2 + f * (a - 2.5 * b + 2 * c - d / 2 + f * ((d - a) / 2 + 1.5 * (b - c))))


def moon_phase(time: Column) -> Column:
    """Share of the synodic month since new moon, in [0, 1)."""
    return F.pmod((epoch(time) - 947182440.0) / (29.530588853 * 86400), F.lit(1.0))


def with_moon_altitude(df: DataFrame, seconds: Column, lat: str, lon: str) -> DataFrame:
    """Add moon_altitude in degrees from the main terms of the moon's longitude and latitude (about 0.3 degrees)."""
    c = F.col
    df = df.withColumn("_d", (seconds - 946728000.0) / 86400)
    rad = lambda x: F.radians(x)
    df = df.withColumns({"_l": 218.316 + 13.176396 * c("_d"), "_m": rad(134.963 + 13.064993 * c("_d")), "_fm": rad(93.272 + 13.229350 * c("_d")), "_el": rad(297.850 + 12.190749 * c("_d")), "_ms": rad(357.529 + 0.98560028 * c("_d"))})
    longitude = c("_l") + 6.289 * F.sin(c("_m")) + 1.274 * F.sin(2 * c("_el") - c("_m")) + 0.658 * F.sin(2 * c("_el")) + 0.214 * F.sin(2 * c("_m")) - 0.186 * F.sin(c("_ms"))
    df = df.withColumns({"_lo": rad(longitude), "_la": rad(5.128 * F.sin(c("_fm"))), "_ob": rad(23.4393 - 3.563e-7 * c("_d"))})
    ra = F.atan2(F.sin(c("_lo")) * F.cos(c("_ob")) - F.tan(c("_la")) * F.sin(c("_ob")), F.cos(c("_lo")))
    dec = F.asin(F.sin(c("_la")) * F.cos(c("_ob")) + F.cos(c("_la")) * F.sin(c("_ob")) * F.sin(c("_lo")))
    df = df.withColumns({"_ra": ra, "_dec": dec, "_st": rad(280.46061837 + 360.98564736629 * c("_d") + c(lon))})
    height = F.asin(F.sin(rad(c(lat))) * F.sin(c("_dec")) + F.cos(rad(c(lat))) * F.cos(c("_dec")) * F.cos(c("_st") - c("_ra")))
    # parallax lowers the moon by up to 0.95 degrees
    return df.withColumn("moon_altitude", F.degrees(height) - 0.9507 * F.cos(height)).drop("_d", "_l", "_m", "_fm", "_el", "_ms", "_lo", "_la", "_ob", "_ra", "_dec", "_st")


def moon_events(places: DataFrame, key: str, midnight: str, lat: str, lon: str) -> DataFrame:
    """key, midnight, moonrise, moonset: the first crossings of the horizon in the 24 hours from midnight.

    Hourly samples; within the hour the crossing is that of the line between them, corrected by a parabola.
    """
    samples = places.select(key, midnight, lat, lon, F.explode(F.sequence(F.lit(-1), F.lit(25))).alias("hour"))
    high = with_moon_altitude(samples, epoch(F.col(midnight)) + 3600 * F.col("hour"), lat, lon)
    w = Window.partitionBy(key, midnight).orderBy("hour")
    y0, y1, y2 = F.lag("moon_altitude").over(w), F.col("moon_altitude"), F.lead("moon_altitude").over(w)
    near = high.select(key, midnight, "hour", y0.alias("y0"), y1.alias("y1"), y2.alias("y2")).where("hour BETWEEN 0 AND 23 AND y1 * y2 <= 0 AND y1 <> y2")
    line = F.col("y1") / (F.col("y1") - F.col("y2"))
    bend = (F.col("y0") - 2 * F.col("y1") + F.col("y2")) / 2
    root = line - bend * line * (line - 1) / ((F.col("y2") - F.col("y1")) + bend * (2 * line - 1))
    at = F.timestamp_seconds(F.round(epoch(F.col(midnight)) + 3600 * (F.col("hour") + clamp(root, 0.0, 1.0))))
    events = near.select(key, midnight, at.alias("at"), (F.col("y2") > F.col("y1")).alias("up"))
    found = events.groupBy(key, midnight).agg(F.min(F.when(F.col("up"), F.col("at"))).alias("moonrise"), F.min(F.when(~F.col("up"), F.col("at"))).alias("moonset"))
    return places.select(key, midnight).join(found, [key, midnight], "left")
