"""Seasonal means, cumulative distributions, climate normals and bias correction.

A year is 365.25 days of seconds from the epoch; a value between two season bins is shared between them by its place.
Distributions are tables of one row for each series, bin and season, made by grouping and joined by bin number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.functions.solar import YEAR
from isobarn.operators.series import keys, ordered, seconds, whole_series
from isobarn.session import ship_package

QUANTILES = 100


def season(time: str | Column, bins: int) -> tuple[Column, Column]:
    """Season bin and place within it."""
    width = YEAR // bins
    second = F.pmod(seconds(time), F.lit(YEAR))
    return F.floor(second / width), (second % width) / width


def _shared(df: DataFrame, time: str, bins: int) -> DataFrame:
    """Each row for its season bin and the next one, with weights."""
    own, place = season(time, bins)
    parts = F.array(F.struct(own.alias("season"), (1 - place).alias("weight")), F.struct(((own + 1) % bins).alias("season"), place.alias("weight")))
    return df.withColumn("_p", F.explode(parts)).withColumns({"season": F.col("_p.season"), "weight": F.col("_p.weight")}).drop("_p")


def seasonal_weighted_means(df: DataFrame, bins: int = 6, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Mean by season bin; null where next to nothing was seen. As a stored table these are the bias weights."""
    own = _shared(df.where(F.col(value).isNotNull()), time, bins)
    found = own.groupBy(*keys(df, by), "season").agg(F.sum(F.col(value) * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return found.withColumn("mean", F.when(F.col("w") > 0.001, F.col("s") / F.col("w"))).drop("s", "w")


def _by_season(weights: DataFrame, name: str, bins: int, by: list[str]) -> DataFrame:
    """A series' seasonal means as one array."""
    return weights.groupBy(*by).agg(F.array(*[F.max(F.when(F.col("season") == k, F.col("mean"))) for k in range(bins)]).alias(name))


def apply_bias(df: DataFrame, reference: DataFrame, control: DataFrame, kind: str = "add", bins: int = 6, bounds: tuple[float, float] | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Correct values by the difference (add) or ratio (multiply) of two tables of seasonal means, within bounds.

    A series' means are two arrays by season, so the series is joined once.
    """
    by = keys(df, by)
    own, place = season(time, bins)
    means = _by_season(reference, "_ms", bins, by).join(_by_season(control, "_os", bins, by), by, "full_outer")
    between = lambda name: F.get(name, own.cast("int")) * (1 - place) + F.get(name, ((own + 1) % bins).cast("int")) * place
    df = df.join(means, by, "left").withColumns({"_m": between("_ms"), "_o": between("_os")})
    out = F.col(value) + F.col("_m") - F.col("_o") if kind == "add" else F.col(value) * F.try_divide("_m", "_o")
    if bounds:
        out = F.when(out.isNotNull(), F.least(F.greatest(out, F.lit(bounds[0])), F.lit(bounds[1])))
    return df.withColumn(value, out).drop("_m", "_o", "_ms", "_os")


def interpolated_weights(weights: DataFrame, corners: DataFrame, key: str) -> DataFrame:
    """Seasonal means of places between four cells. corners: key, cell_id, w (see grids.bilinear_at)."""
    joined = corners.join(weights, "cell_id")
    mean = F.sum(F.col("w") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("w")))
    return joined.groupBy(key, *[c for c in weights.columns if c not in ("cell_id", "season", "mean")], "season").agg(mean.alias("mean"))


def preferred_weights(layers: list[DataFrame], by: list[str]) -> DataFrame:
    """Weights of the first reference that has any for the series and season: land first, then global."""
    stacked = layers[0].withColumn("_r", F.lit(0))
    for i, layer in enumerate(layers[1:], 1):
        stacked = stacked.unionByName(layer.withColumn("_r", F.lit(i)))
    return stacked.groupBy(*by, "season").agg(F.min_by("mean", F.when(F.col("mean").isNotNull(), F.col("_r"))).alias("mean"))


def value_range_bins(df: DataFrame, n: int = QUANTILES, least: float | None = None, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Smallest value and width of n - 1 equal steps to the largest."""
    return df.groupBy(*keys(df, by)).agg(*_range_of(n, least, value))


def _range_of(n: int, least: float | None, value: str) -> list[Column]:
    low = F.min(value) if least is None else F.lit(float(least))
    return [low.alias("bin_min"), ((F.max(value) - low) / (n - 1)).alias("bin_width")]


def _cumulated(df: DataFrame, ranges: DataFrame, group: list[str], by: list[str], n: int, value: str) -> DataFrame:
    """Cumulative distribution from weighted rows: a value counts for all edges above it, and partly for the one below.

    Weights are summed by bin first; running sums then run over at most n rows of a group, not over the data.
    """
    joined = df.join(ranges.select(*by, "bin_min", "bin_width"), by)
    place = F.when(F.col("bin_width") > 0, (F.col(value) - F.col("bin_min")) / F.col("bin_width")).otherwise(F.lit(0.0))
    bin_ = F.least(F.greatest(F.floor(place), F.lit(-1)), F.lit(n - 1))
    part = F.when(bin_ >= 0, 1 - (place - bin_)).otherwise(F.lit(0.0))
    sums = joined.withColumns({"bin": bin_, "_part": F.greatest(part, F.lit(0.0))}).groupBy(*group, "bin").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("_part")).alias("p"))
    spine = sums.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    w = Window.partitionBy(*group).orderBy("bin")
    joined = spine.unionByName(sums.where("bin < 0").select(*group, "bin")).join(sums, [*group, "bin"], "left")
    below = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    counted = joined.withColumn("_c", below + F.coalesce(F.when(F.col("bin") == n - 1, F.col("w")).otherwise(F.col("p")), F.lit(0.0)))
    total = F.max("_c").over(Window.partitionBy(*group))
    return counted.withColumn("cdf", F.when(total > 0, F.col("_c") / total).otherwise(F.lit(0.0))).where("bin >= 0").select(*group, "bin", "cdf")


def seasonal_cdf(df: DataFrame, ranges: DataFrame, seasons: int = 3, n: int = QUANTILES, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """by, season, bin, cdf."""
    by = keys(df, by)
    return _cumulated(_shared(df.where(F.col(value).isNotNull()), time, seasons), ranges, [*by, "season"], by, n, value)


def year_block(time: str | Column, first_year: Column, years: int = 10) -> tuple[Column, Column]:
    """Block of years and place within it; blocks meet in the middle of the years they stand for."""
    place = (seconds(time) / YEAR - first_year - years / 2) / years
    return F.floor(place), place - F.floor(place)


def sliding_cdf(df: DataFrame, ranges: DataFrame, seasons: int = 4, years: int = 10, n: int = QUANTILES, by: list[str] | None = None, time: str = "valid_time", value: str = "value", span: DataFrame | None = None) -> DataFrame:
    """by, block, season, bin, cdf: distributions by season and block of years, shared in both directions. span: first_year and
    blocks of each series, if they are known."""
    by = keys(df, by)
    span = (df.groupBy(*by).agg(*_span_of(time, years)) if span is None else span).select(*by, "first_year", "blocks")
    own = _shared(df.where(F.col(value).isNotNull()), time, seasons).join(span, by)
    block, place = year_block(time, F.col("first_year"), years)
    parts = F.array(F.struct(block.alias("block"), (1 - place).alias("share")), F.struct((block + 1).alias("block"), place.alias("share")))
    own = own.withColumn("_y", F.explode(parts)).where("_y.block >= 0 AND _y.block < blocks")
    own = own.withColumns({"block": F.col("_y.block"), "weight": F.col("weight") * F.col("_y.share")})
    return _cumulated(own, ranges, [*by, "block", "season"], by, n, value)


def _span_of(time: str, years: int) -> list[Column]:
    """First year and number of blocks of a series."""
    first, last = F.round(F.min(seconds(time)) / YEAR), F.round(F.max(seconds(time)) / YEAR)
    return [first.alias("first_year"), F.greatest(F.floor((last - first + 1) / years), F.lit(1)).alias("blocks")]


def cdf_lookup(curve: str, value: Column, low: str = "bin_min", width: str = "bin_width", n: int = QUANTILES) -> Column:
    """Share below a value, on the line between bin edges; the ends hold beyond."""
    place = F.when(F.col(width) > 0, (value - F.col(low)) / F.col(width)).otherwise(F.lit(0.0))
    place = F.least(F.greatest(place, F.lit(0.0)), F.lit(n - 1.0))
    left = F.least(F.floor(place), F.lit(n - 2)).cast("int")
    a, b = F.get(F.col(curve), left), F.get(F.col(curve), left + 1)
    return a + (b - a) * (place - left)


def cdf_inverse(curve: str, share: Column, low: str = "bin_min", width: str = "bin_width", n: int = QUANTILES) -> Column:
    """Value below which the share lies; the first bin whose right edge reaches it, but for the noise of sums."""
    left = F.array_position(F.transform(F.slice(F.col(curve), 2, n - 1), lambda y: y >= share - 1e-9), F.lit(True)) - 1
    left = F.when(left < 0, F.lit(n - 2)).otherwise(left).cast("int")
    a, b = F.get(F.col(curve), left), F.get(F.col(curve), left + 1)
    inside = F.when(b > a, F.least(F.greatest((share - a) / (b - a), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.col(low) + (left + inside) * F.col(width)


def linear_trend_removed(df: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Slope times the position, and half the intercept, taken off each series."""
    by = keys(df, by)
    df = df.withColumn("_i", (F.row_number().over(ordered(by, time)) - 1).cast("double"))
    fit = df.groupBy(*by).agg(F.regr_slope(value, "_i").alias("_m"), F.regr_intercept(value, "_i").alias("_c"))
    return df.join(fit, by).withColumn(value, F.col(value) - F.col("_i") * F.col("_m") - F.col("_c") / 2).drop("_i", "_m", "_c")


def quantile_delta_mapping(reference: DataFrame, control: DataFrame, kind: str = "add", detrend: bool = False, by: list[str] | None = None, time: str = "valid_time", value: str = "value", n: int = QUANTILES, years: int = 10, limit: float = 10.0) -> DataFrame:
    """Map the control (with its forecast) onto the reference's distribution and keep its change signal.

    The distributions that stand for the reference period are read at most years / 2 before its end. A relative change
    is kept within the limit, and zero stays zero. detrend: distributions of detrended series by season alone.
    """
    by = keys(control, by)
    ship_package(control.sparkSession)
    # both tables are dealt by series once, as rows of one; the distributions of a series are made and read where its rows are
    others = [c for c in control.columns if c != value]
    side = lambda past: [F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), F.lit(past).alias("_past"), F.col(value).cast("double").alias(value)]
    types = {f.name: f.dataType for f in control.schema}
    past = reference.select(*[F.col(c) if c in by else F.lit(None).cast(types[c]).alias(c) for c in others], *side(True))
    both = past.unionByName(control.select(*others, *side(False))).where(" AND ".join(f"`{k}` IS NOT NULL" for k in by) or "true")
    placed = both.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_past"), "_us")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != value else 'double'}" for f in control.schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches, "_i"):
            x, us = table.column(value).to_numpy().astype(np.float64), table.column("_us").to_numpy()
            is_past = table.column("_past").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(table.column("_i").to_numpy() == 1)
            kept = np.zeros(table.num_rows, bool)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                m = a + int(is_past[a:b].sum())
                if a < m < b and (out := _mapped_series(x[a:m], us[a:m], x[m:b], us[m:b], kind, detrend, n, years, limit)) is not None:
                    x[m:b], kept[m:b] = out, True
            out = table.set_column(table.schema.get_field_index(value), value, pa.array(x, pa.float64(), mask=np.isnan(x)))
            yield from out.filter(pa.array(kept)).select(columns).combine_chunks().to_batches(max_chunksize=10_000)

    columns = control.columns
    return placed.mapInArrow(mapped, schema)


#: Rows of a series that are mapped at a time; each needs three curves.
MAP_ROWS = 16_384


class _Curves(NamedTuple):
    """Distributions of a series by block of years and season (NaN where nothing was seen), its least value, the width of a bin, and the
    first year."""

    shares: np.ndarray
    low: float
    width: float
    first: float


def _curves_of(value: np.ndarray, s: np.ndarray, n: int, least: float | None, seasons: int, years: int | None) -> _Curves | None:
    """As value_range_bins with sliding_cdf, or seasonal_cdf without years, of one series; None without a value."""
    good = ~np.isnan(value)
    if not good.any():
        return None
    first, last = (float(np.copysign(np.floor(abs(x) + 0.5), x)) for x in (s.min() / YEAR, s.max() / YEAR))
    blocks = max(int((last - first + 1) // years), 1) if years else 1
    value, s = value[good], s[good]
    low = float(value.min()) if least is None else least
    width = (float(value.max()) - low) / (n - 1)
    second, wide = s % YEAR, YEAR // seasons
    own, at = second // wide, second % wide / wide
    in_years = [(np.zeros(len(s), np.int64), np.ones(len(s)))]
    if years:
        place = (s / YEAR - first - years / 2) / years
        block = np.floor(place).astype(np.int64)
        in_years = [(block, 1 - (place - block)), (block + 1, place - block)]
    place = (value - low) / width if width > 0 else np.zeros(len(value))
    bin_ = np.clip(np.floor(place), -1, n - 1).astype(np.int64)
    part = np.where(bin_ >= 0, np.maximum(1 - (place - bin_), 0), 0.0)
    cells, weights, rows = [], [], []
    for block, share in in_years:
        inside = np.flatnonzero((block >= 0) & (block < blocks))
        for k, weight in ((own, 1 - at), ((own + 1) % seasons, at)):
            cells.append((block * seasons + k)[inside])
            weights.append((weight * share)[inside])
            rows.append(inside)
    cell, weight, row = (np.concatenate(x) for x in (cells, weights, rows))
    place = cell * (n + 1) + bin_[row] + 1
    count = lambda w: np.bincount(place, w, blocks * seasons * (n + 1)).reshape(-1, n + 1)
    w, p = count(weight), count(weight * part[row])
    counted = np.cumsum(w, axis=1)[:, :n]
    counted[:, : n - 1] += p[:, 1:n]
    counted[:, n - 1] += w[:, n]
    total = counted.max(axis=1, keepdims=True)
    shares = np.divide(counted, total, out=np.zeros_like(counted), where=total > 0)
    shares[np.bincount(cell, minlength=blocks * seasons) == 0] = np.nan
    return _Curves(shares.reshape(blocks, seasons, n), low, width, first)


def _trendless(value: np.ndarray) -> np.ndarray:
    """As linear_trend_removed, of one series in order; all missing without a line."""
    i, good = np.arange(len(value), dtype=np.float64), ~np.isnan(value)
    x, y = i[good], value[good]
    if len(x) < 2:
        return np.full(len(value), np.nan)
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return value - i * slope - (y.mean() - slope * x.mean()) / 2


def _curves_at(curves: _Curves, s: np.ndarray, years: int | None) -> np.ndarray:
    """The distribution at each second: between two seasons and, with years, between two blocks."""
    blocks, seasons, _ = curves.shares.shape
    width = YEAR // seasons
    second = s % YEAR
    own, place = second // width, (second % width / width)[:, None]
    of_block = lambda b: curves.shares[b, own] * (1 - place) + curves.shares[b, (own + 1) % seasons] * place
    if not years:
        return of_block(np.zeros(len(s), np.int64))
    at = (s / YEAR - curves.first - years / 2) / years
    block, last = np.floor(at).astype(np.int64), blocks - 1
    inside = np.where((block < 0) | (block >= last), 0.0, at - block)[:, None]
    return of_block(np.clip(block, 0, last)) * (1 - inside) + of_block(np.clip(block + 1, 0, last)) * inside


def _shares(curve: np.ndarray, value: np.ndarray, low: float, width: float) -> np.ndarray:
    """As cdf_lookup, a curve a row."""
    n = curve.shape[1]
    place = np.clip((value - low) / width if width > 0 else np.zeros(len(value)), 0.0, n - 1.0)
    left = np.minimum(np.floor(np.nan_to_num(place)), n - 2).astype(np.int64)[:, None]
    a, b = (np.take_along_axis(curve, left + k, 1)[:, 0] for k in (0, 1))
    return a + (b - a) * (place - left[:, 0])


def _values(curve: np.ndarray, share: np.ndarray, low: float, width: float) -> np.ndarray:
    """As cdf_inverse, a curve a row."""
    reached = curve[:, 1:] >= share[:, None] - 1e-9
    left = np.where(reached.any(axis=1), reached.argmax(axis=1), curve.shape[1] - 2)[:, None]
    a, b = (np.take_along_axis(curve, left + k, 1)[:, 0] for k in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(b > a, np.clip((share - a) / (b - a), 0.0, 1.0), 0.0)
    return low + (left[:, 0] + inside) * width


def _mapped_series(past: np.ndarray, past_us: np.ndarray, value: np.ndarray, us: np.ndarray, kind: str, detrend: bool, n: int, years: int, limit: float) -> np.ndarray | None:
    """A series of the control mapped onto its reference; None where either has no distribution."""
    least, past_s, s = None if kind == "add" else 0.0, past_us // 1_000_000, us // 1_000_000
    future = _curves_of(value, s, n, least, 4, years)
    if detrend:
        during = us <= past_us[-1]
        reference, control = (_curves_of(_trendless(x), t, n, least, 3, None) if len(x) else None for x, t in ((past, past_s), (value[during], s[during])))
    else:  # the control stands for its own reference period
        reference, control = _curves_of(past, past_s, n, least, 4, years), future
    if future is None or reference is None or control is None:
        return None
    end, sliding = int(past_s[-1]) - YEAR * years // 2, None if detrend else years
    parts = [slice(a, a + MAP_ROWS) for a in range(0, len(value), MAP_ROWS)]
    return np.concatenate([_mapped_values(value[x], s[x], end, future, reference, control, kind, years, sliding, limit) for x in parts])


def _mapped_values(value: np.ndarray, s: np.ndarray, end: int, future: _Curves, reference: _Curves, control: _Curves, kind: str, years: int, sliding: int | None, limit: float) -> np.ndarray:
    then = s if sliding is None else np.where(s >= end, end + s % YEAR - YEAR, s)
    share = _shares(_curves_at(future, s, years), value, future.low, future.width)
    found, own = (_values(_curves_at(x, then, sliding), share, x.low, x.width) for x in (reference, control))
    if kind == "add":
        return found + value - own
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(own == 0, limit, np.clip(value / own, -limit, limit))
    return np.where(np.isnan(value), np.nan, np.where(value > 0, found * scale, 0.0))


# normals -----------------------------------------------------------------------------------------------------------


def _periods(df: DataFrame, years: list[int], width: int, date: str) -> DataFrame:
    """Each day for every period that holds it; periods are centred on the years and may overlap."""
    spans = F.array(*[F.struct(F.lit(y).alias("period"), F.lit(y - width // 2).alias("a"), F.lit(y + width // 2 + width % 2).alias("b")) for y in years])
    return df.withColumn("_s", F.explode(spans)).where(f"year({date}) >= _s.a AND year({date}) < _s.b").withColumn("period", F.col("_s.period")).drop("_s")


def daily_normals(df: DataFrame, years: list[int], width: int, by: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """by, period, day (0 to 364), normal: means over the period, each day counted for two days around it."""
    spread = _periods(df, years, width, date).withColumn("_o", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    number = F.unix_date(date) + F.col("_o")
    day = F.floor(number - F.floor(number / 365.25) * 365.25) % 365
    return spread.groupBy(*by, "period", day.alias("day")).agg(F.avg(value).alias("normal"))


# fixed values: days of a week with rain by their number
RAIN_DAYS = {1: [3], 2: [1, 4], 3: [1, 3, 5], 4: [0, 2, 4, 6], 5: [0, 2, 4, 5, 6], 6: [0, 1, 2, 4, 5, 6], 7: [0, 1, 2, 3, 4, 5, 6]}
PARTS = 52


def daily_normals_keep_dry_days(df: DataFrame, years: list[int], width: int, by: list[str], placement: str = "mixed", threshold: float = 0.3, date: str = "date", value: str = "value") -> DataFrame:
    """by, period, day, normal: weekly amounts on as many days as it rains, at the week's end or spread over it."""
    part = F.floor(F.unix_date(date).cast("long") * 86400 / (YEAR // PARTS))
    spread = _periods(df, years, width, date).withColumn("_o", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    parts = spread.groupBy(*by, "period", F.pmod(part + F.col("_o"), F.lit(PARTS)).alias("part")).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col(value) < threshold, 1.0).otherwise(F.lit(0.0))).alias("dry"))
    days = parts.select(*by, "period").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(364)))).withColumn("part", F.least(F.floor(F.col("day") / 7), F.lit(PARTS - 1)))
    joined = days.join(parts, [*by, "period", "part"], "left")
    dry = F.round(F.col("dry") * 7)
    wet = F.greatest(7 - dry, F.lit(1.0))
    weekday = F.col("day") % 7
    if placement == "end":
        rains = weekday >= dry
    else:
        table = F.array(*[F.array(*[F.lit(d) for d in RAIN_DAYS[k]]) for k in range(1, 8)])
        rains = F.array_contains(F.get(table, wet.cast("int") - 1), weekday)
    return joined.select(*by, "period", "day", F.when(rains, F.col("mean") / (wet / 7)).otherwise(F.lit(0.0)).alias("normal"))
