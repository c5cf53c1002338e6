"""What a family's fields go through after their names and units are mapped (S20): chains of operators, declared as data.

One planner composes a chain to one job a domain: fields are turned to the grid's order, mapped, differenced in one window over their
series, set side by side once for everything that is derived from several of them, and written out again as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.functions import solar
from isobarn.operators import derive, resample
from isobarn.operators.grids import Grid, normalise_orientation
from isobarn.sources.catalog import domain_of, fields, mapping_table, vocabularies_of
from isobarn.sources.storage import ingest_fields


@dataclass(frozen=True)
class Chain:
    """accumulated, averaged: variables that come as sums or means since the run's start. instant: radiation at the time of the
    field, to be the mean over the step. derived: variables that are added, by `rules` of a dataset first. dropped: variables that are not
    stored. spread: the members' mean and spread stand beside them, as members -1 and -2."""

    accumulated: tuple[str, ...] = ()
    averaged: tuple[str, ...] = ()
    instant: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    rules: str | None = None
    spread: bool = False


_ECMWF = Chain(accumulated=("precipitation", "snowfall_water_equivalent", "runoff", "shortwave_radiation", "direct_radiation"), derived=("relative_humidity_2m", *(f"relative_humidity_{p}hPa" for p in (1000, 925, 850, 700, 500, 300, 250, 50))), dropped=tuple(f"specific_humidity_{p}hPa" for p in (1000, 925, 850, 700, 500, 300, 250, 200, 100, 50)), rules="pressure_levels")
# fixed values: what the providers' fields need, by domain
CHAINS: dict[str, Chain] = {
    "ecmwf_ifs025": _ECMWF,
    "ecmwf_ifs025_ensemble": Chain(_ECMWF.accumulated, derived=("relative_humidity_2m",), spread=True),
    "ncep_gfs025": Chain(averaged=("shortwave_radiation", "precipitation", "showers")),
    "ncep_gfs013": Chain(averaged=("shortwave_radiation", "precipitation", "showers")),
    "dwd_icon": Chain(accumulated=("precipitation", "snowfall_water_equivalent"), averaged=("direct_radiation", "diffuse_radiation"), derived=("relative_humidity_2m", "shortwave_radiation")),
    "dwd_icon_eu": Chain(accumulated=("precipitation", "snowfall_water_equivalent"), averaged=("direct_radiation", "diffuse_radiation"), derived=("relative_humidity_2m", "shortwave_radiation")),
    "geosphere_arome_austria": Chain(accumulated=("precipitation", "snowfall_water_equivalent", "shortwave_radiation"), derived=("wind_speed_10m", "wind_direction_10m"), dropped=("wind_u_component_10m", "wind_v_component_10m")),
    "eumetsat_lsa_saf_msg_15min": Chain(instant=("shortwave_radiation",), derived=("direct_radiation",), dropped=("diffuse_fraction",)),
    "eumetsat_lsa_saf_iodc_15min": Chain(instant=("shortwave_radiation",), derived=("direct_radiation",), dropped=("diffuse_fraction",)),
}


def ingest(raw: DataFrame, domain: str, chain: Chain | None = None) -> DataFrame:
    """Series of one domain from its fields. raw: variable (the provider's name), run_time, x, y, member, valid_time, value; a step that is
    missing within a run is a row without a value, so that sums and means are told apart over it."""
    chain, own = chain or CHAINS[domain], domain_of(domain)
    grid: Grid = own.grid
    turned = normalise_orientation(raw, grid.nx, grid.ny, own.from_greenwich, own.north_first)
    turned = turned.select(F.lit(domain).alias("domain"), "variable", (F.col("y") * grid.nx + F.col("x")).cast("bigint").alias("location_id"), "member", "run_time", "valid_time", "value")
    series = ingest_fields(turned, mapping_table(raw.sparkSession).where(F.col("domain") == domain))
    keys = ["domain", "location_id", "member", "run_time"]
    # one shuffle serves the series' windows and the fields side by side
    series = series.repartition(*keys)
    if chain.accumulated or chain.averaged:
        series = resample.per_step(series, chain.accumulated, chain.averaged, [*keys, "variable"])
    raw_names = sorted({name for v in vocabularies_of(domain) for name, _ in fields(v).values()})
    wide = series.groupBy(*keys, "valid_time").agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in raw_names])
    outputs = [o for o in chain.derived if derive.chosen(o, set(raw_names), dataset=chain.rules) is not None]
    if chain.instant:
        lat, lon = grid.coordinates(F.col("location_id"))
        placed = solar.instant_factor(wide.withColumns({"lat": lat, "lon": lon}), "valid_time", "lat", "lon", own.dt)
        wide = placed.withColumns({n: solar.to_interval_mean(F.col(n), F.col("instant_factor")) for n in chain.instant}).drop("lat", "lon", "instant_factor")
    wide = derive.derive(wide, outputs, chain.rules) if outputs else wide
    stored = [n for n in dict.fromkeys([*raw_names, *outputs]) if n not in chain.dropped]
    values = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("value")) for n in stored])
    found = wide.select(*keys, "valid_time", F.explode(F.filter(values, lambda x: x["value"].isNotNull())).alias("x")).select(*keys, "valid_time", "x.variable", "x.value")
    if not chain.spread:
        return found
    # members and their statistics from one pass over the rows
    both = F.array(F.struct("member", "value"), F.struct(F.lit(None).cast("int").alias("member"), "value"))
    each = found.select("domain", "location_id", "run_time", "valid_time", "variable", F.explode(both).alias("x")).select("*", "x.member", "x.value").drop("x")
    sums = each.groupBy("domain", "location_id", "run_time", "valid_time", "variable", "member").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))
    kinds = F.when(F.col("member").isNotNull(), F.array(F.struct("member", F.col("mean").alias("value")))).otherwise(F.array(F.struct(F.lit(-1).alias("member"), F.col("mean").alias("value")), F.struct(F.lit(-2).alias("member"), F.col("spread").alias("value"))))
    return sums.select("domain", "location_id", "run_time", "valid_time", "variable", F.explode(kinds).alias("x")).select("*", "x.member", "x.value").drop("x").select(*found.columns)
