"""Combination of models: priorities, blending, routing of places, pairing and comparison of series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.operators.series import bounded, keys, ordered

#: Steps before a gap in which the lower model fades in.
FADE = 3
#: Degrees of a routing tile, and how many tiles may be broadcast.
TILE = 10
MOST_TILES = 200_000


def fill_from_lower_priority(high: DataFrame, low: DataFrame, smooth: bool = True, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """The high model, and the low one where it is missing; before such a step the low one counts 3/4, 2/4 and 1/4."""
    return seamless([high, low], smooth, by, time, value)


def seamless(models: list[DataFrame], smooth: bool = False, by: list[str] | None = None, time: str = "valid_time", value: str = "value", hard: Column | None = None) -> DataFrame:
    """Models in order of priority, each read once, in one shuffle whatever their number. hard: rows that are cut hard all the same.

    Cut hard, one aggregate picks the first model that has a value. Blended, the models are dealt by series, stand side by side at each
    step, and are folded from the first to the last: the model with number k counts 3/4, 2/4 and 1/4 at the three steps before
    one that only it (or a later one) can fill. Which model fills a step is told by the missing values alone, so looking ahead
    is one window for all of them.
    """
    by = keys(models[0], by)
    stacked = reduce(DataFrame.unionByName, [m.select(*by, time, F.col(value), F.lit(i).alias("_rank")) for i, m in enumerate(models)])
    if not smooth or len(models) == 1:
        return stacked.groupBy(*by, time).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_rank"))).alias(value))
    side = [F.max(F.when(F.col("_rank") == i, F.col(value))).alias(f"_v{i}") for i in range(len(models))]
    steps = stacked.repartition(*by).groupBy(*by, time).agg(*side)
    fills = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)) for i in range(len(models))])
    w = ordered(by, time)
    steps = steps.withColumn("_fills", fills).withColumns({f"_a{d}": F.lead("_fills", d).over(w) for d in range(1, FADE + 1)})
    found = F.col("_v0")
    for k in range(1, len(models)):
        own, ahead = F.col(f"_v{k}"), F.coalesce(*[F.when(F.col(f"_a{d}") == k, F.lit(d)) for d in range(1, FADE + 1)])
        share = (FADE + 1 - ahead) / (FADE + 1)
        blends = found.isNotNull() & own.isNotNull() & ahead.isNotNull()
        blends = blends if hard is None else blends & ~hard
        found = F.when(blends, own * share + found * (1 - share)).otherwise(F.coalesce(found, own))
    return steps.select(*by, time, found.alias(value))


def read_priority_layers(layers: list[DataFrame], by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Of master, yearly and rolling files, the first layer that has a row for the time, missing values included."""
    by = keys(layers[0], by)
    stacked = reduce(DataFrame.unionByName, [x.withColumn("_layer", F.lit(i)) for i, x in enumerate(layers)])
    others = [c for c in layers[0].columns if c not in (*by, time)]
    best = stacked.groupBy(*by, time).agg(F.min(F.struct("_layer", *others)).alias("_b"))
    return best.select(*by, time, *[F.col(f"_b.{c}").alias(c) for c in others])


def rank_models(df: DataFrame, rank: str, by: list[str], value: str = "value") -> DataFrame:
    """The best source for each step: the lowest rank with a value."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank))


def route_models(places: DataFrame, regions: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """key, domain, priority: the models of the first region that holds the place.

    regions: south, north, west, east, rank, domains (array). Regions and places are joined by tiles of TILE degrees, so a
    place meets the regions of its tile only; the tiles of a routing table of tens of regions are broadcast.
    """
    tile = lambda c: F.floor(c / TILE)
    over = lambda a, b: F.explode(F.sequence(tile(F.col(a)), tile(F.col(b))))
    tiles = regions.where("south <= north AND west <= east").withColumn("_y", over("south", "north")).withColumn("_x", over("west", "east"))
    inside = (F.col(lat) >= F.col("south")) & (F.col(lat) <= F.col("north")) & (F.col(lon) >= F.col("west")) & (F.col(lon) < F.col("east"))
    keyed = places.withColumns({"_y": tile(F.col(lat)), "_x": tile(F.col(lon))})
    best = keyed.join(bounded(tiles, MOST_TILES, "a table of routing tiles"), ["_y", "_x"]).where(inside).groupBy(key).agg(F.min_by("domains", "rank").alias("domains"))
    return best.select(key, F.posexplode("domains").alias("priority", "domain"))


# fixed values: satellites by longitude, the first match wins
SATELLITES = [("mtg_0deg", -20.0, 60.0), ("msg_0deg", -60.0, 50.0), ("msg_iodc", 50.0, 90.0), ("himawari", 90.0, 180.1)]


def route_satellite(places: DataFrame, lon: str = "lon", bands: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Add satellite by longitude band; bands: name, west, east."""
    out = F.lit(None).cast("string")
    for name, west, east in reversed(bands or SATELLITES):
        out = F.when((F.col(lon) >= west) & (F.col(lon) < east), F.lit(name)).otherwise(out)
    return places.withColumn("satellite", out)


def priority_resolve_elevation(places: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """Places without a height take that of the model of highest priority which has one. models: key, rank, elevation."""
    best = models.where("elevation IS NOT NULL").groupBy(key).agg(F.min_by("elevation", "rank").alias("_e"))
    return places.join(best, key, "left").withColumn("elevation", F.coalesce("elevation", "_e")).drop("_e")


def mix_before_derivation(groups: list[list[DataFrame]], derive, before: bool = True, by: list[str] | None = None) -> DataFrame:
    """Siblings mixed as raw input and then derived, or derived each and then mixed. derive: DataFrame -> DataFrame."""
    mixed = [seamless(g, by=by) for g in groups] if before else [seamless([derive(x) for x in g], by=by) for g in groups]
    return seamless([derive(x) for x in mixed] if before else mixed, by=by)


def interpolate_levels(df: DataFrame, level: float, lower: float, upper: float, rule: str = "linear", by: list[str] | None = None, value: str = "value") -> DataFrame:
    """A missing level from two neighbours of column `level`: linear in pressure, mean, or linear in log pressure."""
    by = [*keys(df, by), "valid_time"]
    share = {"linear": (level - lower) / (upper - lower), "mean": 0.5, "log": math.log(level / lower) / math.log(upper / lower)}[rule]
    at = lambda p: F.max(F.when(F.col("level") == p, F.col(value)))
    found = df.where(F.col("level").isin(lower, upper, level)).groupBy(*by).agg(F.coalesce(at(level), at(lower) * (1 - share) + at(upper) * share).alias(value))
    return found.withColumn("level", F.lit(level))


def attach_static(series: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    return series.join(cells.select("domain", F.col("cell_id").alias("location_id"), *columns), ["domain", "location_id"], "left")


def pair_variables(series: DataFrame, names: list[str], by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Variables side by side, one column each, in one grouped pass over those rows alone."""
    by = [k for k in keys(series, by) if k != "variable"]
    own = series.where(F.col("variable").isin(names))
    return own.groupBy(*by, time).agg(*[F.max(F.when(F.col("variable") == n, F.col(value))).alias(n) for n in names])


def compare_models(a: DataFrame, b: DataFrame, on: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Mean error, root mean square error and root of the mean absolute error of a against b."""
    joined = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    off = F.col("_a") - F.col("_b")
    return joined.groupBy(*by).agg(F.avg(off).alias("mean_error"), F.sqrt(F.avg(off * off)).alias("rmse"), F.sqrt(F.avg(F.abs(off))).alias("sqrt_mae"), F.count(off).alias("n"))


def as_of_run(runs: DataFrame, available_before: Column | str, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """The newest forecast of each time whose run was there at a given moment."""
    cut = F.expr(available_before) if isinstance(available_before, str) else available_before
    own = runs.where((F.col("run_time") <= cut) & F.col(value).isNotNull())
    return own.groupBy(*keys(runs, by), time).agg(F.max_by(value, "run_time").alias(value), F.max("run_time").alias("run_time"))


def latest_run(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["domain"]
    return runs.groupBy(*by).agg(F.max("run_time").alias("run_time"))


def merge_sections(sections: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Sections of several models side by side, suffixed by model; an error if they have other steps."""
    first = next(iter(sections.values()))
    out = None
    for model, section in sections.items():
        named = section.select(*on, *[F.col(c).alias(f"{c}_{model}") for c in section.columns if c not in on], F.lit(1).alias(f"_has_{model}"))
        out = named if out is None else out.join(named, on, "full_outer")
    missing = reduce(lambda a, b: a | b, [F.col(f"_has_{m}").isNull() for m in sections])
    checked = out.withColumn("_same", F.when(missing, F.raise_error(F.lit("sections have different steps"))).otherwise(F.lit(1).cast("int")))
    value_columns = [c for c in checked.columns if not c.startswith("_has_") and c != "_same" and c not in on]
    return checked.where("_same = 1").select(*[c for c in first.columns if c in on], *value_columns)


def member_columns(wide: DataFrame, outputs: list[str], members: int, on: list[str]) -> DataFrame:
    """Members side by side: member 0 under the output's name, others with the suffix _memberNN."""
    name = lambda o, m: o if m == 0 else f"{o}_member{m:02d}"
    return wide.groupBy(*on).agg(*[F.max(F.when(F.col("member") == m, F.col(o))).alias(name(o, m)) for o in outputs for m in range(members)])


def stack_models(models: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.withColumn("domain", F.lit(name)) for name, m in models.items()])


def unique_valid_times(series: DataFrame, time: str = "valid_time") -> DataFrame:
    return series.select(time).distinct().orderBy(time)


def common_coverage(models: list[DataFrame], on: list[str], value: str = "value") -> DataFrame:
    """Keys and times for which every model has a value."""
    return reduce(DataFrame.intersect, [m.where(F.col(value).isNotNull()).select(*on) for m in models])


def changed_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def current_values(series: DataFrame, now: Column, step: int = 3600, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """The newest step at `now`, floored to the step."""
    at = F.timestamp_seconds(F.floor(F.unix_seconds(now) / step) * step)
    own = series.where((F.col(time) <= at) & F.col(value).isNotNull())
    return own.groupBy(*keys(series, by)).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def latest_by_lead(runs: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Of several runs, the value with the shortest lead."""
    w = Window.partitionBy(*keys(runs, by), time).orderBy(F.col("run_time").desc())
    return runs.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
