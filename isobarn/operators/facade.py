"""Requests for many places in one job: ranges, cells, runs and members, resampling, model mix, derivation, daily aggregates, units."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobarn.operators import aggregate, combine, derive, requests, resample
from isobarn.operators.grids import Grid, best_terrain_cell, filter_bounding_box, locate, nearest_sea_cell, read_elevation
from isobarn.sources.catalog import READERS, known, variable, variables_of
from isobarn.sources.storage import prune_to_ranges


@dataclass(frozen=True)
class Product:
    """Defaults and limits of one kind of request."""

    name: str
    models: tuple[str, ...] = ()
    forecast_days: int = 7
    past_days: int = 0
    max_days: int = 16
    dt: int = 3600
    smooth: bool = True
    members: int | None = 1


PRODUCTS = {
    p.name: p
    for p in (
        Product("forecast"), Product("archive", forecast_days=0, past_days=92), Product("historical_forecast", forecast_days=0, past_days=92),
        Product("previous_runs"), Product("single_run"), Product("satellite", forecast_days=0, past_days=1, smooth=False),
        Product("seasonal", forecast_days=92, max_days=274, dt=21600, members=None), Product("ensemble", max_days=36, members=None), Product("marine"),
        Product("air_quality", forecast_days=5, max_days=7), Product("climate", forecast_days=0, dt=86400), Product("flood", forecast_days=92, max_days=210, dt=86400, members=None),
    )
}


@dataclass
class Request:
    """hourly, daily, minutely_15, current: outputs of the sections, old spellings included; current is the step that `now` lies in. units:
    temperature, wind, precipitation, length (see requests.convert_units). past_days and forecast_days count only with now. cells: nearest,
    land or sea. run: one model run's time; None takes, of runs, the one with the shortest lead. lead_day: forecasts of so
    many days before, where series have them. dataset: whose rules come before the general ones, or a reader of several datasets
    (catalog.READERS), which also says what models are read. tilt, azimuth: of a panel, in
    degrees (azimuth 0 south, -90 east); None tracks the sun."""

    hourly: list[str] = field(default_factory=list)
    daily: list[str] = field(default_factory=list)
    minutely_15: list[str] = field(default_factory=list)
    current: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    product: str = "forecast"
    units: dict[str, str] = field(default_factory=dict)
    steps: int | None = None
    now: str | None = None
    past_days: int | None = None
    forecast_days: int | None = None
    cells: str = "nearest"
    correct_elevation: bool = True
    run: str | None = None
    lead_day: int = 0
    members: int | None = None
    dt: int | None = None
    dataset: str | None = None
    tilt: float | None = 0.0
    azimuth: float | None = 0.0


def _cells(places: DataFrame, grid: Grid, heights: DataFrame | None, request: Request, key: str) -> DataFrame:
    """key, location_id and cell_elevation of the cell that serves each place on the grid; null where its height isn't known."""
    own = locate(places, grid).select(key, F.col("cell_id").alias("location_id"))
    if heights is None:
        return own.withColumn("cell_elevation", F.lit(None).cast("double"))
    if request.cells == "land":
        found = best_terrain_cell(places, heights, grid, key).withColumnRenamed("cell_id", "_best")
        return own.join(found, key, "left").select(key, F.coalesce("_best", "location_id").alias("location_id"), "cell_elevation")
    if request.cells == "sea":
        found = nearest_sea_cell(places, heights, grid, key).select(key, F.col("cell_id").alias("_best"))
        own = own.join(found, key, "left").select(key, F.coalesce("_best", "location_id").alias("location_id"))
    known = heights.select(F.col("cell_id").alias("location_id"), F.col("elevation").alias("cell_elevation"))
    return own.join(known, "location_id", "left").select(key, "location_id", "cell_elevation")


def _one_run(series: DataFrame, request: Request) -> DataFrame:
    if "lead_day" in series.columns:
        series = series.where(F.col("lead_day") == request.lead_day).drop("lead_day")
    if "run_time" not in series.columns:
        return series
    if request.run:
        return series.where(F.col("run_time") == F.lit(request.run).cast("timestamp")).drop("run_time")
    return combine.latest_by_lead(series).drop("run_time")


def resampled(series: DataFrame, names: list[str], dt_old: int, dt_new: int, by: list[str]) -> DataFrame:
    """Each variable to other steps by its kind of interpolation. series: by (with variable), lat, lon, valid_time, value."""
    if dt_old == dt_new:
        return series
    kinds: dict[str, list[str]] = {}
    for name in names:
        kinds.setdefault(variable(name)["interpolation"], []).append(name)
    parts = []
    for kind, own in kinds.items():
        part = series.where(F.col("variable").isin(own))
        if dt_new > dt_old:
            parts.append(resample.downsample(part, dt_old, dt_new, {"backwards_sum": "sum", "solar": "mean"}.get(kind, "instant"), [*by, "lat", "lon"]))
        elif kind == "solar":
            parts.append(resample.upsample_radiation(part, dt_old, dt_new, by=by))
        elif kind in ("backwards", "backwards_sum"):
            parts.append(resample.upsample_backwards(part, dt_old, dt_new, kind == "backwards_sum"))
        else:
            up = {"hermite": resample.upsample_hermite, "degrees": resample.upsample_degrees}.get(kind, resample.upsample_linear)
            parts.append(up(part, dt_old, dt_new, by=by))
    columns = [*by, "lat", "lon", "valid_time", "value"]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def _mixed(models: list[DataFrame], smooth: bool, names: list[str], by: list[str]) -> DataFrame:
    """Models by priority: blended, but for codes and values without a unit, which are cut hard."""
    cut = [n for n in names if variable(n)["unit"] in ("wmo code", "")]
    return combine.seamless(models, smooth, by, hard=F.col("variable").isin(cut) if cut else None)


def _unit(output: str, wanted: dict[str, str]) -> tuple[Column, str]:
    """An output column in the wanted units, and its unit."""
    if output in aggregate.EVENTS or output in aggregate.DOMINANT:
        return F.col(output), "°" if output in aggregate.DOMINANT else ""
    base = requests.resolve_alias(output)
    for kind in ("_max", "_min", "_mean", "_sum"):
        base = base.removesuffix(kind)
    rules = derive.RULES.get(base, [])
    unit = variable(base)["unit"] if known(base) else rules[0].unit if rules else ""
    amount = wanted.get("precipitation") or ("inch" if wanted.get("length") == "imperial" else "mm")
    for (own, name), (factor, shift, new) in requests.UNITS.items():
        if own == unit and name in (wanted.get("temperature"), wanted.get("wind"), amount):
            return (F.col(output) * factor + shift).alias(output), new
    return F.col(output), unit


#: Cells and bytes of one model's series that are sent to the tasks of a request's places; beyond, the series are dealt by cell.
MOST_CELLS, MOST_SENT = 100_000, 192 << 20
#: Rows of places that a task makes, but for so many tasks.
PLACE_ROWS, MOST_PARTS = 500_000, 20_000


@dataclass
class _Reader:
    """What a request reads from: models by priority with grids, heights, seconds of their steps, and the names that they have."""

    series: dict[str, DataFrame]
    grids: dict[str, Grid]
    heights: dict[str, DataFrame]
    steps: dict[str, int]
    models: list[str]
    key: str
    available: dict[str, set[str]]
    request: Request
    product: Product
    rules: str | None

    def __post_init__(self) -> None:
        self.on = [self.key, "member"] if any("member" in self.series[m].columns for m in self.models) else [self.key]

    def rows(self, name: str, places: DataFrame, names: list[str], wider: bool) -> DataFrame:
        """One model's stored rows of the names, of the chunks, run and members that are asked for. wider: ranges reach beyond their ends."""
        request = self.request
        own = self.series[name].where(F.col("variable").isin(names))
        if "time_chunk" in own.columns:
            # by the places' own ranges: a plan with a join in it is not reused for pruning
            own = prune_to_ranges(own, resample.expand_for_resampling(places, "hermite", self.step(name)) if wider else places)
        own = _one_run(own, request)
        if len(self.on) > 1:
            own = own if "member" in own.columns else own.withColumn("member", F.lit(0))
            n = request.members if request.members is not None else self.product.members
            own = own if n is None else own.where(F.col("member") < n)
        return own

    def step(self, name: str) -> int:
        return self.steps.get(name, self.product.dt)

    def corrected(self, names: list[str]) -> list[str]:
        return [n for n in names if variable(n)["elevation_correctable"]] if self.request.correct_elevation else []

    def model(self, name: str, places: DataFrame, cells: DataFrame, names: list[str], dt: int) -> DataFrame:
        """One model's series at the places, in steps of dt: on, variable, valid_time, value."""
        key, on = self.key, self.on
        names = [n for n in names if n in self.available[name]]
        own_dt = self.step(name)
        wanted = places.select(key, "lat", "lon", "elevation", "start", "stop").join(cells, key)
        wide = resample.expand_for_resampling(wanted, "hermite", own_dt) if own_dt > dt else wanted
        read = self.rows(name, places, names, own_dt > dt).join(wide, "location_id").where("valid_time >= start AND valid_time < stop")
        if corrected := self.corrected(names):
            read = requests.correct_elevation(read, corrected)
        read = resampled(read.select(*on, "variable", "lat", "lon", "valid_time", "value"), names, own_dt, dt, [*on, "variable"])
        if own_dt > dt:
            read = read.join(wanted.select(key, "start", "stop"), key).where("valid_time >= start AND valid_time < stop")
        return read.select(*on, "variable", "valid_time", "value")

    def sent(self, name: str, places: DataFrame, cells: DataFrame, sites: DataFrame, names: list[str]) -> DataFrame | None:
        """As wide, of one model in its own steps: variables stand side by side at the cells already, and if those few rows fit into every
        task, they are sent to the places, which are dealt by ranges of their key. Rows of places, many for one of a cell, are then
        never shuffled, nor for their order. None if there is too much to send."""
        key, on = self.key, self.on
        dealt = sites.join(places.select(key, "start", "stop"), key).join(cells, key)
        asked = dealt.groupBy("location_id").agg(F.min("start").alias("_from"), F.max("stop").alias("_to"), F.count(F.lit(1)).alias("_places"))
        if asked.count() > MOST_CELLS:
            return None
        own = self.rows(name, places, names, False).join(asked, "location_id").where("valid_time >= _from AND valid_time < _to")
        pivoted = own.groupBy("location_id", *on[1:], "valid_time").agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names], F.first("_places").alias("_places"))
        size = pivoted.agg(F.count(F.lit(1)).alias("sent"), F.sum("_places").alias("found")).first()
        if size["sent"] * (8 * len(pivoted.columns) + 32) > MOST_SENT:
            return None
        parts = min(max((size["found"] or 0) // PLACE_ROWS + 1, 1), MOST_PARTS)
        found = dealt.repartitionByRange(parts, key).join(F.broadcast(pivoted.drop("_places")), "location_id").where("valid_time >= start AND valid_time < stop")
        lapse = requests.lapse()
        found = found.withColumns({n: F.coalesce(F.col(n) + lapse, F.col(n)) for n in self.corrected(names)})
        return found.select(*on, "valid_time", *names, *[c for c in sites.columns if c != key])

    def wide(self, places: DataFrame, outputs: list[str], dt: int) -> DataFrame:
        """A row for each place and step with the raw variables behind the outputs, and where the place's cell of the first model lies."""
        names = sorted(derive.inputs_of(outputs, self.rules) & set().union(*self.available.values()))
        cells = {m: _cells(places, self.grids[m], self.heights.get(m), self.request, self.key) for m in self.models}
        first = self.models[0]
        lat, lon = self.grids[first].coordinates(F.col("location_id"))
        sites = places.join(cells[first].select(self.key, lat.alias("_lat"), lon.alias("_lon")), self.key, "left")
        sites = sites.select(self.key, "elevation", "utc_offset_seconds", F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"))
        if not names:  # outputs of the sun alone
            spine = requests.time_spine(places.select(self.key, "start", "stop"), dt)
            return (spine.withColumn("member", F.lit(0)) if len(self.on) > 1 else spine).select(*self.on, "valid_time").join(sites, self.key)
        read = [m for m in self.models if self.available[m] & set(names)]
        if len(read) == 1 and self.step(read[0]) == dt and (found := self.sent(read[0], places, cells[read[0]], sites, names)) is not None:
            return found
        mix = _mixed([self.model(m, places, cells[m], names, dt) for m in read], self.product.smooth, names, [*self.on, "variable"])
        wide = mix.groupBy(*self.on, "valid_time").agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])
        return wide.join(sites, self.key)

    def derived(self, wide: DataFrame, outputs: list[str], dt: int) -> DataFrame:
        site = derive.Site(dt=dt, tilt=self.request.tilt, azimuth=self.request.azimuth)
        return derive.derive(wide, outputs, self.rules, site)

    def section(self, wide: DataFrame, outputs: list[str], dt: int) -> DataFrame:
        """The outputs under the names and in the units that were asked for."""
        names = [requests.resolve_alias(o) for o in outputs]
        found = self.derived(wide, names, dt)
        return found.select(*self.on, "valid_time", *[_unit(n, self.request.units)[0].alias(o) for o, n in zip(outputs, names)])

    def days(self, wide: DataFrame, places: DataFrame, dt: int) -> DataFrame:
        request, key, on = self.request, self.key, self.on
        needed = aggregate.daily_inputs(request.daily)
        own = [o for o in request.daily if o not in aggregate.EVENTS]
        values = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("value")) for n in needed])
        long = self.derived(wide, needed, dt).select(*on, "utc_offset_seconds", "valid_time", F.explode(values).alias("x")) if needed else None
        if own:
            found = aggregate.daily_summary(long.select(*on, "utc_offset_seconds", "valid_time", "x.variable", "x.value"), own, request.steps or 86400 // dt, dt, on, "utc_offset_seconds")
        else:
            found = wide.select(*on, aggregate.local_day("valid_time", "utc_offset_seconds").alias("day")).distinct()
        if len(own) < len(request.daily):
            days = found.select(key, "day").distinct().join(places.select(key, "lat", "lon", "utc_offset_seconds"), key)
            found = found.join(aggregate.daily_events(days, request.daily, key).drop("lat", "lon", "utc_offset_seconds"), [key, "day"])
        return found.select(*on, "day", *[_unit(o, request.units)[0] for o in request.daily])


def _names_of(series: dict[str, DataFrame], models: list[str], raw: list[str], given: list[str] | dict[str, list[str]] | None) -> dict[str, set[str]]:
    """Which of the raw variables each model has: as given, from the catalogue for its datasets, otherwise from the series."""
    found = {m: set(given.get(m, ()) if isinstance(given, dict) else given) if given is not None else variables_of(m) for m in models}
    for m in models:
        if given is None and not found[m]:
            names = series[m].where(F.col("variable").isin(raw)).select("variable").distinct().collect()  # names of variables, a short list
            found[m] = {r["variable"] for r in names}
    return {m: found[m] & set(raw) for m in models}


def forecast(places: DataFrame, series: dict[str, DataFrame], grids: dict[str, Grid], request: Request, key: str = "place_id", heights: dict[str, DataFrame] | None = None, steps: dict[str, int] | None = None, available: list[str] | dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The sections that are asked for, for all places, ordered by place and time. series: long tables by model, in order of priority.

    places: key, lat, lon, elevation, utc_offset_seconds, and start and stop unless the request has now. heights: cells with
    elevation by model, for land and sea cells and the correction by height; a place whose cell has no height is not
    corrected. steps: seconds of a model's step. available: raw variables of the models, or of each; without it they come from the
    catalogue, or are read from the series. A variable is taken from the first model that has a value, so a model with few variables
    stands before one with all. Series that keep their time_chunk (see storage.read_series) are read by the chunks of
    the requested ranges only. Each model's cells are found by arithmetic and its series are joined once; outputs are derived
    in one projection, those of the sun at the cell of the first model.
    """
    product = PRODUCTS[request.product]
    now = F.lit(request.now).cast("timestamp") if request.now else None
    if now is not None and "start" not in places.columns:
        past, ahead = (b if a is None else a for a, b in ((request.past_days, product.past_days), (request.forecast_days, product.forecast_days)))
        places = requests.time_range_for(places, now, past, ahead, max_days=product.max_days)
    chain, rules = READERS.get(request.dataset, ((), request.dataset))
    models = request.models or [m for m in chain or product.models if m in series] or list(series)
    needed = aggregate.daily_inputs(request.daily)
    names = lambda outputs: [requests.resolve_alias(o) for o in outputs]
    every = names([*request.hourly, *request.minutely_15, *request.current]) + needed
    raw = sorted(derive.inputs_of(every, rules) - {"elevation"})
    reader = _Reader(series, grids, heights or {}, steps or {}, models, key, _names_of(series, models, raw, available), request, product, rules)
    dt = request.dt or product.dt
    out = {}
    if request.hourly or request.daily:
        wide = reader.wide(places, [*names(request.hourly), *needed], dt)
        if request.hourly:
            out["hourly"] = reader.section(wide, request.hourly, dt).orderBy(*reader.on, "valid_time")
        if request.daily:
            out["daily"] = reader.days(wide, places, dt).orderBy(*reader.on, "day")
    for section, outputs, step in (("minutely_15", request.minutely_15, 900), ("current", request.current, product.dt)):
        if not outputs:
            continue
        asked = places
        if section == "current":
            if now is None:
                raise ValueError("the current section needs now")
            at = F.timestamp_seconds(F.floor(F.unix_seconds(now) / step) * step)
            asked = places.withColumns({"start": at, "stop": at + F.expr(f"interval {step} second")})
        out[section] = reader.section(reader.wide(asked, names(outputs), step), outputs, step).orderBy(*reader.on, "valid_time")
    return out


def output_units(outputs: list[str], wanted: dict[str, str]) -> dict[str, str]:
    """The unit of each output of a request, for the sinks."""
    return {o: _unit(o, wanted)[1] for o in outputs}


def elevation(places: DataFrame, heights: DataFrame, rows_per_degree: int = 1200) -> DataFrame:
    """Heights of places."""
    return read_elevation(places, heights, rows_per_degree)


def flood(members: DataFrame, key: str = "place_id", statistics: bool = True) -> DataFrame:
    """River discharge by member, or its statistics over the members."""
    return aggregate.ensemble_quantiles(members, [key, "valid_time"]) if statistics else members


def bounding_box(cells: DataFrame, grid: Grid, box: tuple[float, float, float, float], series: dict[str, DataFrame], request: Request, start: str, stop: str, heights: dict[str, DataFrame] | None = None, steps: dict[str, int] | None = None, available: list[str] | dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """forecast for all cells of a box of one model; heights, steps and available as there."""
    inside = filter_bounding_box(cells, grid, *box)
    places = inside.select(F.col("cell_id").alias("place_id"), "lat", "lon", "elevation", F.lit(0).alias("utc_offset_seconds"), F.lit(start).cast("timestamp").alias("start"), F.lit(stop).cast("timestamp").alias("stop"))
    return forecast(places, series, {m: grid for m in series}, request, heights=heights, steps=steps, available=available)


__all__ = ["PRODUCTS", "Product", "Request", "bounding_box", "elevation", "flood", "forecast", "output_units", "requests"]
