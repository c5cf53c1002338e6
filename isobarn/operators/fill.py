"""Gap filling inside series of regular steps: null values between valid ones are replaced.

All take the long table and fill `value`; positions are row numbers in time order, so the steps must be complete
(see time_spine). Series are windows by their keys; neighbours come from running last and first valid values. Cubic and solar filling
walk through a series, as what they fill feeds later gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.functions.solar import LOW_SUN, SOLAR_CONSTANT
from isobarn.operators.series import keys, ordered, whole_series
from isobarn.session import ship_package

#: Hours without a value that solar filling bridges.
SOLAR_HOURS = 12


def _with_neighbours(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Add _i, and value and position of the last valid row before (_v0, _i0) and the next from here (_v1, _i1).

    The next valid row is the last one of the reversed order: frames that grow take one step a row, while a frame that
    shrinks would be summed up anew for each row. Both orders share one shuffle.
    """
    w = ordered(by, time)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    return df.withColumns({"_v0": F.last(value, True).over(before), "_i0": F.last(at, True).over(before), "_v1": F.last(value, True).over(after), "_i1": F.last(at, True).over(after)})


def _drop(df: DataFrame) -> DataFrame:
    return df.drop("_i", "_v0", "_i0", "_v1", "_i1", "_first")


def _share() -> Column:
    return (F.col("_i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))


def fill_linear(df: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """On the line between the valid neighbours; gaps at either end stay."""
    df = _with_neighbours(df, keys(df, by), time, value)
    line = F.col("_v1") * _share() + F.col("_v0") * (1 - _share())
    return _drop(df.withColumn(value, F.coalesce(F.col(value), line)))


def fill_degrees(df: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """As fill_linear, over the shorter arc."""
    df = _with_neighbours(df, keys(df, by), time, value)
    a, b = F.col("_v1"), F.col("_v0")
    a2 = F.when((F.abs(b - a) > 180) & (a < b), a + 360).otherwise(a)
    b2 = F.when((F.abs(b - a) > 180) & (a > b), b + 360).otherwise(b)
    return _drop(df.withColumn(value, F.coalesce(F.col(value), (a2 * _share() + b2 * (1 - _share())) % 360)))


def fill_backwards(df: DataFrame, summation: bool = False, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """With the next valid value, or its equal share over the gap. The spacing of the first two valid values tells how
    far the first one reaches back."""
    by = keys(df, by)
    df = _with_neighbours(df, by, time, value)
    whole = Window.partitionBy(*by)
    count = F.count(value).over(ordered(by, time).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_n", F.when(F.col(value).isNotNull(), count))
    one, two = (F.min(F.when(F.col("_n") == k, F.col("_i"))).over(whole) for k in (1, 2))
    first = F.when(two.isNull(), one).otherwise(F.greatest(one - (two - one - 1), F.lit(0)))
    df = df.withColumn("_first", first)
    share = F.col("_v1") / (F.col("_i1") - F.coalesce(F.col("_i0"), F.col("_first") - 1)) if summation else F.col("_v1")
    out = F.when(F.col("_i") >= F.col("_first"), share)
    return _drop(df.withColumn(value, F.coalesce(out, F.col(value))).drop("_n"))


def _walked(df: DataFrame, walk: Callable[..., np.ndarray], by: list[str], time: str, value: str, *more: str) -> DataFrame:
    """Each series through walk(values, *more columns), in order of time, NaN for null; `value` is replaced by the result.

    For rules in which what is filled feeds later gaps. Series are dealt and ordered once and stream through the tasks in batches; a
    task holds the rows of one series and one batch.
    """
    ship_package(df.sparkSession)
    columns, at = df.columns, "_i"
    placed = df.withColumns({at: F.row_number().over(ordered(by, time)), value: F.col(value).cast("double"), **{c: F.col(c).cast("double") for c in more}})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole series one after another."""
        for table in whole_series(batches, at):
            given = [table.column(c).to_numpy().astype(np.float64) for c in (value, *more)]
            starts = np.flatnonzero(table.column(at).to_numpy() == 1)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                if np.isnan(given[0][a:b]).any():
                    given[0][a:b] = walk(*(x[a:b] for x in given))
            out = table.set_column(columns.index(value), value, pa.array(given[0], pa.float64(), mask=np.isnan(given[0]))).select(columns)
            yield from out.to_batches(max_chunksize=10_000)

    return placed.select(*columns, at).mapInArrow(run, schema)


def _gaps(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of each run of missing values before a valid one: the valid place before (-1 if none), that after, and the next after that (-1 if none)."""
    valid = np.flatnonzero(~np.isnan(x))
    before, after = np.concatenate([[-1], valid[:-1]]), np.append(valid[1:], -1)
    wide = valid - before > 1
    return zip(before[wide].tolist(), valid[wide].tolist(), after[wide].tolist())


def _cubic_walk(x: np.ndarray, bounds: tuple[float, float] | None) -> np.ndarray:
    last_given = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x)))).tolist()
    x, width = x.copy(), 0
    for p, c, d in list(_gaps(x)):
        width = d - c if d >= 0 else width
        if p < 0:
            continue
        b = max(c - width, 0)
        a = b - width if b >= width else b
        if not width or np.isnan(x[b]):
            b, a = p, last_given[p - 1] if p else p
            a = a if a >= 0 else p
        vb, vc = x[b], x[c]
        va, vd = vb if np.isnan(x[a]) else x[a], x[d] if d >= 0 else vc
        f = (np.arange(p + 1, c) - b) / (c - b)
        found = vb + f * ((vc - va) / 2 + f * (va - 2.5 * vb + 2 * vc - vd / 2 + f * ((vd - va) / 2 + 1.5 * (vb - vc))))
        x[p + 1 : c] = found if bounds is None else np.clip(found, *bounds)
    return x


def fill_hermite(df: DataFrame, bounds: tuple[float, float] | None = None, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """By a cubic through the end of the gap (c), the valid value after it (d), and two points before it (b and a) as far
    from each other as d from c; those may be values that were filled before. A b before the series' start is its first value, a missing a is b.
    Without a d the spacing is that of the gap before and d is c. Where b is missing, the last two given values before the gap are b
    and a. Gaps at either end stay."""
    return _walked(df, lambda x: _cubic_walk(x, bounds), keys(df, by), time, value)


def _solar_walk(x: np.ndarray, light: np.ndarray, most: int, mean_preserving: bool) -> np.ndarray:
    x, n, limit = x.copy(), len(x), SOLAR_CONSTANT * 0.95
    valid = np.flatnonzero(~np.isnan(x))
    if not len(valid):
        return x
    # the spacing of the first two values tells how far the first one reaches back
    first = int(valid[0]) if len(valid) == 1 else max(int(valid[0]) - (int(valid[1]) - int(valid[0]) - 1), 0)

    def clearness(mean: float, shape: np.ndarray) -> float:
        sun = shape.mean()
        return min(mean / sun, limit) if sun > LOW_SUN else np.nan

    for p, c, _ in list(_gaps(x)):
        begin = max(p + 1, first)
        if begin >= c:
            continue
        if c - begin > most:
            break
        b = begin - 1
        width = c - b
        a, d = b - width, c + width
        over = (lambda i, j: slice(i + 1, j + 1)) if mean_preserving else (lambda i, j: slice(j, j + 1))
        kc = clearness(x[c], light[over(b, c)]) if x[c] > 0 else np.nan
        kb = clearness(x[over(a, b)].mean(), light[over(a, b)]) if a >= 0 and not np.isnan(x[a]) else np.nan
        kd = clearness(x[d], light[over(c, d)]) if d < n and not np.isnan(x[d]) else np.nan
        kb, kd = kc if np.isnan(kb) else kb, kc if np.isnan(kd) else kd
        middle = next((k for k in (kc, kb, kd) if not np.isnan(k)), None)
        if middle is None:
            x[begin:c] = 0.0
            continue
        kb, kd = middle if np.isnan(kb) else kb, middle if np.isnan(kd) else kd
        end = c + 1 if mean_preserving else c
        f = (np.arange(begin, end) - b) / width
        curve = (1 - f) ** 2 * (kb + middle) / 2 + 2 * f * (1 - f) * middle + f**2 * (middle + kd) / 2
        found = np.maximum(curve, 0.0) * light[begin:end]
        if mean_preserving and x[c] > 5:
            total = found.sum()
            found *= x[c] * len(found) / total if total > 5 else 0.0
        x[begin:end] = found
    return x


def fill_solar(df: DataFrame, shape: str, dt: int = 3600, mean_preserving: bool = True, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Radiation by the shape of the clear sky, column `shape` (interval means, see solar.clear_sky_radiation).

    The clearness of a gap with its end, of an equally long time before and of one after are points of a quadratic curve
    through their borders; a step gets clearness times shape. What was filled before counts for the time before. If
    mean_preserving, the value after a gap is the mean over the gap and itself, which the steps then share so that it stays their mean.
    Gaps without light are 0. A gap of over SOLAR_HOURS ends the filling of its series. The spacing of the first two values
    tells how far the first one reaches back.
    """
    most = SOLAR_HOURS * 3600 // dt + 1
    return _walked(df, lambda x, light: _solar_walk(x, light, most, mean_preserving), keys(df, by), time, value, shape)


def backfill_scan_time(df: DataFrame, scan_hours: str, mean_height: str, scan_height: str, low: float, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Instant satellite radiation at scan time to means over the step; heights of the sun are columns (see functions.solar).

    A value counts for the step by the ratio of the sun's mean height to that at scan time. Without sun, or with too little
    to divide by, it is 0. Around sunset scans are 0 or missing while the sun is still up: the first such step after a good
    one takes that one's clearness; further ones stay as they are. Steps without a scan time are untouched.
    """
    v, mean, now, c = F.col(value), F.col(mean_height), F.col(scan_height), F.col
    there = c(scan_hours).isNotNull() & ~F.isnan(c(scan_hours))
    weak = (mean <= low) | (now <= low) | (F.try_divide(now, mean) < 0.05)
    lost = (v.isNull() | (v == 0)) & (mean > low)
    kind = F.when(~there, None).when(mean <= 0, "dark").when(lost, "lost").when(v.isNull(), None).when(weak, "dark").otherwise("good")
    df = df.withColumn("_kind", kind)
    event = F.when(c("_kind").isNotNull(), F.struct(c("_kind").alias("kind"), F.try_divide(v, now).alias("k")))
    before = ordered(keys(df, by), time).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_last", F.last(event, True).over(before))
    filled = F.when(c("_last.kind") == "good", c("_last.k") * mean).otherwise(v)
    out = F.when(c("_kind") == "dark", F.lit(0.0)).when(c("_kind") == "good", F.try_divide(v, now) * mean).when(c("_kind") == "lost", filled).otherwise(v)
    return df.withColumn(value, out).drop("_kind", "_last")
