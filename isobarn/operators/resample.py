"""Resampling of regular series to other steps, and accumulated or averaged series to values per step.

Rules that look at neighbouring steps are windows over a series; sub-steps come from an explode of a short sequence,
so a series is shuffled once whatever the ratio of the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.functions.solar import LOW_SUN, SOLAR_CONSTANT, Sun, cubic, with_geometry
from isobarn.operators.series import keys, ordered, rounded, seconds


def _forward(df: DataFrame, dt_old: int, dt_new: int, time: str) -> DataFrame:
    """Each row as its sub-steps from its time on; _f is their place in the old step."""
    n = dt_old // dt_new
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.withColumns({"_f": F.col("_j") / n, time: F.timestamp_seconds(seconds(time) + F.col("_j") * dt_new)})


def upsample_linear(df: DataFrame, dt_old: int, dt_new: int, scale: float | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """On the line to the next step; the last value repeats."""
    w = ordered(keys(df, by), time)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*keys(df, by)))
    df = _forward(df.withColumn("_b", F.when(last, F.col(value)).otherwise(F.lead(value).over(w))), dt_old, dt_new, time)
    return df.withColumn(value, rounded(F.col(value) * (1 - F.col("_f")) + F.col("_b") * F.col("_f"), scale)).drop("_b", "_f", "_j")


def upsample_degrees(df: DataFrame, dt_old: int, dt_new: int, scale: float | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """As upsample_linear, over the shorter arc."""
    w = ordered(keys(df, by), time)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*keys(df, by)))
    df = _forward(df.withColumn("_b", F.when(last, F.col(value)).otherwise(F.lead(value).over(w))), dt_old, dt_new, time)
    a, b, f = F.col(value), F.col("_b"), F.col("_f")
    a2 = F.when((F.abs(b - a) > 180) & (a < b), a + 360).otherwise(a)
    b2 = F.when((F.abs(b - a) > 180) & (a > b), b + 360).otherwise(b)
    return df.withColumn(value, rounded((a2 * (1 - f) + b2 * f) % 360, scale)).drop("_b", "_f", "_j")


def upsample_hermite(df: DataFrame, dt_old: int, dt_new: int, bounds: tuple[float, float] | None = None, scale: float | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """By a cubic through four steps; missing neighbours repeat the value, results are kept within the bounds."""
    w = ordered(keys(df, by), time)
    v = F.col(value)
    c, d = F.lead(value).over(w), F.lead(value, 2).over(w)
    ends = F.count(F.lit(1)).over(w.rowsBetween(2, 2)) == 0
    df = df.withColumns({"_a": F.coalesce(F.lag(value).over(w), v), "_c": F.coalesce(c, v), "_d": F.when(ends, F.coalesce(c, v)).otherwise(F.coalesce(d, v))})
    df = _forward(df, dt_old, dt_new, time)
    out = rounded(cubic(F.col("_a"), v, F.col("_c"), F.col("_d"), F.col("_f")), scale)
    if bounds:
        out = F.when(out.isNotNull(), F.least(F.greatest(out, F.lit(bounds[0])), F.lit(bounds[1])))
    return df.withColumn(value, out).drop("_a", "_c", "_d", "_f", "_j")


def upsample_backwards(df: DataFrame, dt_old: int, dt_new: int, summation: bool = False, scale: float | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Each value is held back over its interval, or split evenly if it is a sum. Needs no neighbours, so no shuffle."""
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(dt_old // dt_new - 1))))
    share = F.col(value) * (dt_new / dt_old if summation else 1.0)
    return df.withColumns({time: F.timestamp_seconds(seconds(time) - F.col("_j") * dt_new), value: rounded(share, scale)}).drop("_j")


def _clear_steps(df: DataFrame, low: str, dt_old: int, dt_new: int, by: list[str], time: str, value: str) -> DataFrame:
    """Rows of the new steps: value is their clearness by the cubic through four old ones, or by the line where that falls below zero,
    and _given whether the old step had a value. Clearness at low sun is taken from neighbours."""
    w = ordered(by, time)
    ratio = F.when(F.col(low) > LOW_SUN, F.least(F.col(value) / F.col(low), F.lit(SOLAR_CONSTANT * 0.95)))
    df = df.withColumn("_k", ratio)
    df = df.withColumns({"_ka": F.coalesce(F.lag("_k").over(w), F.when(F.lag(value).over(w).isNull(), F.col("_k"))), "_kc": F.lead("_k").over(w), "_kd": F.lead("_k", 2).over(w), "_vc": F.lead(value).over(w)})
    a, b, c, d = (F.col(x) for x in ("_ka", "_k", "_kc", "_kd"))
    df = df.withColumns({"_ka": F.coalesce(a, b, c, d), "_k": F.coalesce(b, a, c, d), "_kc": F.coalesce(c, b, d, a), "_kd": F.coalesce(d, c, b, a)})
    n = dt_old // dt_new
    # interval means belong to the interval's middle, so a row serves the new steps around its own middle
    first = -((n - 1) // 2)
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
    df = df.withColumns({"_f": (F.col("_j") + (n - 1) / 2) / n, time: F.timestamp_seconds(seconds(time) + F.col("_j") * dt_new)})
    f, v = F.col("_f"), F.col(value)
    bent = cubic(F.col("_ka"), F.col("_k"), F.col("_kc"), F.col("_kd"), f)
    line = F.col("_k") * (1 - f) + F.col("_kc") * f
    shape = F.when((bent < 0) & (v >= 0) & (F.coalesce(F.col("_vc"), F.lit(0.0)) >= 0), line).otherwise(bent)
    return df.withColumns({"_given": v.isNotNull(), value: shape}).drop("_k", "_ka", "_kc", "_kd", "_vc", "_f", "_j")


def _lit_again(df: DataFrame, sun: Column, scale: float | None, value: str) -> DataFrame:
    """Clearness to radiation. The sun is never negative, so it doesn't matter for the choice of cubic or line."""
    out = F.when(~F.col("_given"), None).when(sun == 0, F.lit(0.0)).otherwise(F.col(value) * sun)
    return df.withColumn(value, rounded(out, scale)).drop("_given")


def upsample_solar(df: DataFrame, low: str, high: DataFrame, potential: str, dt_old: int, dt_new: int, scale: float | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Interval means of radiation to shorter intervals, by the cubic of the clearness times the potential radiation.

    low: column with the potential radiation (fraction of the solar constant) of the old intervals; high: keys, time and
    column `potential` with that of the new ones, once for each. Both are as large as the result, whatever a plan takes their size for,
    so they aren't joined, which could broadcast one: they meet as rows of one table, grouped by key and time. Tables that are
    dealt by series already are not shuffled for that.
    """
    by = keys(df, by)
    fine = _clear_steps(df, low, dt_old, dt_new, by, time, value)
    others = [c for c in df.columns if c not in (*by, time, value)]
    kinds = {f.name: f.dataType for f in fine.schema}
    lit = high.select(*by, time, *[F.lit(None).cast(kinds[c]).alias(c) for c in (value, "_given", *others)], F.col(potential).cast("double").alias("_high"), F.lit(True).alias("_there"))
    both = fine.withColumns({"_high": F.lit(None).cast("double"), "_there": F.lit(None).cast("boolean")}).unionByName(lit)
    met = both.groupBy(*by, time).agg(*[F.max(c).alias(c) for c in (value, "_given", "_high", "_there")], *[F.first(c, True).alias(c) for c in others])
    lit = met.where("_given IS NOT NULL AND _there").drop("_there").select(*df.columns, "_given", "_high")
    return _lit_again(lit, F.col("_high"), scale, value).drop("_high")


def upsample_radiation(df: DataFrame, dt_old: int, dt_new: int, lat: str = "lat", lon: str = "lon", scale: float | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """As upsample_solar, with the potential radiation of both steps computed from the place of the row itself: one window by series
    and no join."""
    by = keys(df, by)
    share = lambda x, dt: with_geometry(x, time, lat, lon, dt)
    sun = Sun().potential() / SOLAR_CONSTANT
    low = share(df, dt_old).withColumn("_low", sun).select(*df.columns, "_low")
    fine = _clear_steps(low, "_low", dt_old, dt_new, by, time, value).drop("_low")
    lit = share(fine, dt_new).withColumn("_high", sun).select(*fine.columns, "_high")
    return _lit_again(lit, F.col("_high"), scale, value).select(*df.columns)


def downsample(df: DataFrame, dt_old: int, dt_new: int, kind: str = "instant", by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """instant: the value at the new step. mean, sum: over the old steps in (t - dt_new, t]; null if one is missing."""
    if kind == "instant":
        return df.where(seconds(time) % dt_new == 0)
    by = keys(df, by)
    end = F.timestamp_seconds(F.ceil(seconds(time) / dt_new) * dt_new)
    found = df.groupBy(*by, end.alias(time)).agg((F.avg if kind == "mean" else F.sum)(value).alias(value), F.count(value).alias("_n"))
    return found.withColumn(value, F.when(F.col("_n") == dt_new // dt_old, F.col(value))).drop("_n")


#: Steps that a kind of resampling looks beyond either end of a range.
PADDING = {"instant": 0, "mean": 1, "sum": 1, "linear": 1, "degrees": 1, "backwards": 1, "backwards_sum": 1, "hermite": 2, "solar": 2}


def expand_for_resampling(places: DataFrame, kind: str, dt: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Ranges widened by the steps that the kind needs, for the scan before it."""
    a, b = padded_range(F.col(start), F.col(stop), dt, PADDING[kind])
    return places.withColumns({start: a, stop: b})


def padded_range(start: Column, stop: Column, dt: int, padding: int) -> tuple[Column, Column]:
    """The range to read for an interpolation that looks `padding` steps beyond either end."""
    return start - F.expr(f"interval {padding * dt} second"), stop + F.expr(f"interval {padding * dt} second")


def _since_last(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    w = ordered(by, time)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    return df.withColumns({"_v0": F.last(value, True).over(before), "_i0": F.last(at, True).over(before), "_s": F.min(at).over(Window.partitionBy(*by))})


def deaccumulate(df: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Difference to the last valid value, divided by the steps in between; the first valid value stays."""
    df = _since_last(df, keys(df, by), time, value)
    out = (F.col(value) - F.col("_v0")) / (F.col("_i") - F.col("_i0"))
    return df.withColumn(value, F.when(F.col("_v0").isNull(), F.col(value)).otherwise(out)).drop("_i", "_v0", "_i0", "_s")


def deaverage(df: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """From means since the first valid step to values per step."""
    df = _since_last(df, keys(df, by), time, value)
    n, n0 = F.col("_i") - F.col("_s") + 1, F.col("_i0") - F.col("_s") + 1
    out = (F.col(value) * n - F.col("_v0") * n0) / (n - n0)
    return df.withColumn(value, F.when(F.col("_v0").isNull(), F.col(value)).otherwise(out)).drop("_i", "_v0", "_i0", "_s")


def per_step(df: DataFrame, accumulated: tuple[str, ...], averaged: tuple[str, ...], by: list[str], time: str = "valid_time", value: str = "value") -> DataFrame:
    """Series of several variables per step, by one window: some are sums since the start, some means; the others stay."""
    df = _since_last(df, by, time, value)
    v, last, n, n0 = F.col(value), F.col("_v0"), F.col("_i") - F.col("_s") + 1, F.col("_i0") - F.col("_s") + 1
    summed, mean = (v - last) / (F.col("_i") - F.col("_i0")), (v * n - last * n0) / (n - n0)
    kind = F.col("variable")
    out = F.when(last.isNull(), v).when(kind.isin(*accumulated) if accumulated else F.lit(False), summed).when(kind.isin(*averaged) if averaged else F.lit(False), mean).otherwise(v)
    return df.withColumn(value, out).drop("_i", "_v0", "_i0", "_s")


def deaccumulate_sections(df: DataFrame, by: list[str], start: str = "step_start", stop: str = "step_end", kind: str = "step_type", value: str = "value") -> DataFrame:
    """Differences where a step continues the section of the step before; a step that starts at the other's end stands
    alone. Means are weighted by their lengths. Steps without length go, as do those that don't move on."""
    df = df.where(F.col(stop) > F.col(start))
    w = Window.partitionBy(*by, start).orderBy(stop)
    v0, e0 = F.lag(value).over(w), F.lag(stop).over(w)
    length, length0 = F.col(stop) - F.col(start), e0 - F.col(start)
    mean = (F.col(value) * length - v0 * length0) / (F.col(stop) - e0)
    out = F.when(v0.isNull() | ~F.col(kind).isin("accum", "avg"), F.col(value)).when(F.col(kind) == "avg", mean).otherwise(F.col(value) - v0)
    begin = F.when(v0.isNull() | ~F.col(kind).isin("accum", "avg"), F.col(start)).otherwise(e0)
    return df.select(*[c for c in df.columns if c not in (value, start)], begin.alias(start), out.alias(value))


def sliding_mean(df: DataFrame, n: int, drop_first: bool = True, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Mean of the n values before the row; null if one is missing. The first n rows have none and go."""
    w = ordered(keys(df, by), time)
    frame = w.rowsBetween(-n, -1)
    df = df.withColumns({"_r": F.row_number().over(w), "_m": F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))})
    df = df.where(F.col("_r") > n) if drop_first else df
    return df.withColumn(value, F.col("_m")).drop("_r", "_m")


def trailing_mean(df: DataFrame, n: int, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Mean of the row and up to n rows before it."""
    return df.withColumn(value, F.avg(value).over(ordered(keys(df, by), time).rowsBetween(-n, 0)))


def shift(df: DataFrame, steps: int = 24, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """The value of a later step."""
    return df.withColumn(value, F.lead(value, steps).over(ordered(keys(df, by), time)))


def place_irregular_steps(df: DataFrame, spine: DataFrame, by: list[str] | None = None, time: str = "valid_time") -> DataFrame:
    """Irregular steps on a regular axis; steps in between are null."""
    return spine.join(df, [*keys(df, by), time], "left")
