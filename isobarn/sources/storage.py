"""Stored series: scans, upserts, runs, manifests and exports, as partitioned Parquet.

Tables are partitioned by domain, variable and time chunk, and sorted by location and time inside files, so that a read
of some variables, places and hours prunes partitions and skips row groups. Writers replace whole chunks.
"""

from __future__ import annotations

import datetime as dt_
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobarn.operators.requests import DIGITS
from isobarn.operators.series import SCHEMA, bounded, keys, seconds, stored_keys

#: Seconds of one time chunk, and the location numbers that share a file of it.
CHUNK_SECONDS = 14 * 86400
LOCATIONS = 20_000
#: Rows up to which a table of mappings is broadcast.
MOST_MAPPINGS = 100_000


def time_chunk(time: str | Column = "valid_time", chunk: int = CHUNK_SECONDS) -> Column:
    return F.floor(seconds(time) / chunk)


def by_chunk(series: DataFrame, parts: list[str], locations: int = LOCATIONS) -> DataFrame:
    """Rows dealt by chunk and range of locations, and sorted: one task writes a file of each, however many places there are."""
    band = F.floor(F.col("location_id") / locations)
    return series.repartition(*parts, band).sortWithinPartitions(*parts, "location_id", "valid_time")


def write_series(series: DataFrame, path: str, mode: str = "overwrite", chunk: int = CHUNK_SECONDS, locations: int = LOCATIONS) -> None:
    """Sorted files for each domain, variable, time chunk and range of locations; only the chunks at hand are replaced."""
    out = by_chunk(series.withColumn("time_chunk", time_chunk("valid_time", chunk)), ["domain", "variable", "time_chunk"], locations)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("domain", "variable", "time_chunk").parquet(path)


def read_series(spark: SparkSession, path: str, domain: str | None = None, variables: list[str] | None = None, start: str | None = None, stop: str | None = None, chunk: int = CHUNK_SECONDS, keep_chunks: bool = False) -> DataFrame:
    """A time range of variables (UTC). The range is turned into chunk numbers as well, so that partitions are pruned.
    keep_chunks: leave the column time_chunk, by which prune_to_ranges reads the chunks of many ranges."""
    df = spark.read.schema(SCHEMA + ", time_chunk bigint").parquet(path)
    if domain:
        df = df.where(F.col("domain") == domain)
    if variables:
        df = df.where(F.col("variable").isin(variables))
    for text, chunk_rule, rule in ((start, lambda c, n: c >= n, lambda c, t: c >= t), (stop, lambda c, n: c <= n, lambda c, t: c < t)):
        if text:
            moment = F.lit(text).cast("timestamp")
            number = int(dt_.datetime.fromisoformat(text).replace(tzinfo=dt_.UTC).timestamp() // chunk)
            df = df.where(chunk_rule(F.col("time_chunk"), F.lit(number))).where(rule(F.col("valid_time"), moment))
    return df if keep_chunks else df.drop("time_chunk")


#: Most chunks of time that the ranges of a request may touch.
MOST_CHUNKS = 100_000


def prune_to_ranges(series: DataFrame, ranges: DataFrame, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """Stored series (with time_chunk) of the chunks that any of the ranges (start, stop) touches. The chunks are a small table made
    of the ranges; it is broadcast, and its values prune the scan's partitions when the query runs, so other files are not read."""
    first, last = F.floor(seconds("start") / chunk), F.floor((seconds("stop") - 1) / chunk)
    touched = ranges.where("stop > start").select(F.explode(F.sequence(first, last)).alias("time_chunk")).distinct()
    # runtime pruning asks for a filter on the small side
    touched = bounded(touched.where(F.col("time_chunk") > -(1 << 40)), MOST_CHUNKS, "a table of time chunks")
    return series.join(touched, "time_chunk", "left_semi").drop("time_chunk")


def read_run(runs: DataFrame, run_time: str, spine: DataFrame | None = None, by: list[str] | None = None, fill: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One model run; an error if there is no such run. On a regular axis if one is given: irregular steps are placed on it
    and the steps between them filled by `fill` (see operators.fill)."""
    own = runs.where(F.col("run_time") == F.lit(run_time).cast("timestamp"))
    if own.isEmpty():
        raise ValueError(f"no run {run_time}")
    if spine is None:
        return own
    placed = spine.join(own.drop("run_time"), [*keys(runs, by), "valid_time"], "left").withColumn("run_time", F.lit(run_time).cast("timestamp"))
    return fill(placed) if fill else placed


def merge_series(existing: DataFrame, new: DataFrame, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """New values win, missing ones never erase. One grouped pass over both.

    Lead days and runs are part of the key where the table has them. Other columns are those of the newest row.
    """
    on = [*stored_keys(existing, by), time]
    others = [c for c in existing.columns if c not in (*on, value)]
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.select(*on, value, *others).withColumn("_new", F.lit(1)))
    kept = [F.max_by(c, "_new").alias(c) for c in others]
    return both.groupBy(*on).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_new"))).alias(value), *kept).select(*existing.columns)


def merge_rolling(existing: DataFrame, new: DataFrame, run: Column, retain_days: int, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """As merge_series, without times before the run's midnight less the days kept."""
    return merge_series(existing, new, by, time, value).where(F.col(time) >= F.date_trunc("day", run) - F.expr(f"interval {retain_days} day"))


def by_lead_day(run: DataFrame, days: int = 7, time: str = "valid_time") -> DataFrame:
    """A run's rows for each lead day whose start they reach."""
    lead = F.floor((seconds(time) - seconds("run_time")) / 86400)
    return run.where(lead >= 1).withColumn("lead_day", F.explode(F.sequence(F.lit(1).cast("long"), F.least(lead, F.lit(days).cast("long")))))


def merge_previous_days(existing: DataFrame, run: DataFrame, days: int = 7, by: list[str] | None = None, time: str = "valid_time", value: str = "value") -> DataFrame:
    """Forecasts by lead day: day d of a run skips its first d days."""
    on = [*[k for k in keys(existing, by) if k != "lead_day"], "lead_day"]
    columns = [*on, time, value]
    return merge_series(existing.select(*columns), by_lead_day(run, days, time).select(*columns), on, time, value)


#: Pressure levels and the greatest height in metres that full runs keep.
RUN_LEVELS = [1000, 925, 850, 700, 600, 500, 400, 300, 250, 200, 150, 100, 50]
RUN_HEIGHT = 200


def full_run(series: DataFrame) -> DataFrame:
    """What is stored of each run: three-hourly runs, listed levels, heights near the ground."""
    level = F.try_to_number(F.nullif(F.regexp_extract("variable", r"_(\d+)hPa", 1), F.lit("")), F.lit("9999"))
    height = F.try_to_number(F.nullif(F.regexp_extract("variable", r"_(\d+)m(?:_|$)", 1), F.lit("")), F.lit("9999"))
    return series.where((F.hour("run_time") % 3 == 0) & (level.isNull() | level.isin(RUN_LEVELS)) & (height.isNull() | (height <= RUN_HEIGHT)))


def write_full_run(series: DataFrame, path: str) -> None:
    full_run(series).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "run_time", "variable").parquet(path)


def build_run_metadata(runs: DataFrame, time: str = "valid_time") -> DataFrame:
    """By domain and run: first and last time, number of times, step, variables."""
    times = runs.groupBy("domain", "run_time").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count_distinct(time).alias("n_times"), F.sort_array(F.collect_set("variable")).alias("variables"))
    step = (F.unix_seconds("end") - F.unix_seconds("start")) / F.nullif(F.col("n_times") - 1, F.lit(0))
    return times.withColumn("step_seconds", step)


def compact_yearly(series: DataFrame, year: int, dt: int = 3600, allow_missing: bool = False, chunk: int = CHUNK_SECONDS, by: list[str] | None = None) -> DataFrame:
    """The rows of a year in range order; an error if a time chunk of it has no row and partial years aren't allowed."""
    own = series.where(F.year("valid_time") == year)
    if not allow_missing:
        there = own.select(*[k for k in keys(series, by) if k in ("domain", "variable")], time_chunk("valid_time", chunk).alias("time_chunk")).distinct()
        first, last = f"timestamp'{year}-01-01'", f"timestamp'{year + 1}-01-01' - interval {dt} second"
        spine = series.sparkSession.sql(f"SELECT explode(sequence(floor(unix_seconds({first}) / {chunk}), floor(unix_seconds({last}) / {chunk}))) AS time_chunk")
        if not spine.join(there.select("time_chunk").distinct(), "time_chunk", "left_anti").isEmpty():
            raise ValueError(f"time chunks of {year} are missing")
    return own.repartitionByRange("location_id", "valid_time").sortWithinPartitions("location_id", "valid_time")


def verify_compaction(source: DataFrame, compacted: DataFrame) -> DataFrame:
    """Rows that only one of both has; none if the copy is exact."""
    columns = source.columns
    return source.exceptAll(compacted.select(*columns)).withColumn("side", F.lit("source")).unionByName(compacted.select(*columns).exceptAll(source).withColumn("side", F.lit("compacted")))


# manifests ----------------------------------------------------------------------------------------------------------


def select_changed_files(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files to fetch: missing here, of another size, or newer by over a second; metadata by time alone."""
    there = local.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    newer = seconds("modified") > seconds("_modified") + 1
    other = (F.col("size") != F.col("_size")) & ~F.col("path").endswith(".json")
    return remote.join(there, "path", "left").where(F.col("_size").isNull() | other | newer).select(*remote.columns)


def select_files_in_range(manifest: DataFrame, start: int, stop: int, chunk: int = CHUNK_SECONDS) -> DataFrame:
    """Files that may hold epoch seconds in [start, stop): static, master and rolling ones always, years and chunks
    when they overlap."""
    year = F.try_to_number(F.nullif(F.regexp_extract("path", r"year_(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int")
    number = F.try_to_number(F.nullif(F.regexp_extract("path", r"chunk_(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long")
    first = F.unix_seconds(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    last = F.unix_seconds(F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    in_year = (first < stop) & (last > start)
    in_chunk = (number * chunk < stop) & ((number + 1) * chunk > start)
    return manifest.where(F.when(year.isNotNull(), in_year).when(number.isNotNull(), in_chunk).otherwise(F.lit(True)))


def scan_health(series: DataFrame, dt: int = 3600, chunk: int = CHUNK_SECONDS, value: str = "value") -> DataFrame:
    """By domain, variable and time chunk: rows, share of nulls, extremes, and steps missing between rows."""
    by = keys(series)
    before = F.lag("valid_time").over(Window.partitionBy(*by).orderBy("valid_time"))
    missing = F.greatest((seconds("valid_time") - F.unix_seconds(before)) / dt - 1, F.lit(0.0))
    marked = series.withColumn("_gap", F.coalesce(missing, F.lit(0.0)))
    own = [k for k in by if k in ("domain", "variable")]
    return marked.groupBy(*own, time_chunk("valid_time", chunk).alias("time_chunk")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(value).isNull().cast("double")).alias("null_share"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum("_gap").cast("bigint").alias("missing_steps"))


# ingestion ----------------------------------------------------------------------------------------------------------


def ingest_fields(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """A provider's rows as series: mapping has domain, source_variable, variable, multiply, add. Unmapped rows go.

    One job with a table of mappings serves all providers; a table of over MOST_MAPPINGS rows is an error.
    """
    table = bounded(mapping.select("domain", "source_variable", "variable", "multiply", "add"), MOST_MAPPINGS, "a mapping table")
    joined = raw.withColumnRenamed("variable", "source_variable").join(table, ["domain", "source_variable"])
    value = F.when(~F.isnan("value"), F.col("value")) * F.coalesce("multiply", F.lit(1.0)) + F.coalesce("add", F.lit(0.0))
    return joined.withColumn("value", value).drop("source_variable", "multiply", "add")


def fill_missing_calendar_days(series: DataFrame, by: list[str] | None = None, date: str = "date") -> DataFrame:
    """28 February stands in for a missing 29th in leap years."""
    by = keys(series, by)
    leap = (F.year(date) % 4 == 0) & ((F.year(date) % 100 != 0) | (F.year(date) % 400 == 0))
    copies = series.where((F.month(date) == 2) & (F.dayofmonth(date) == 28) & leap).withColumn(date, F.date_add(date, 1))
    return series.unionByName(copies.join(series.select(*by, date), [*by, date], "left_anti"))


def assemble_chunks(parts: list[DataFrame], expected: int, by: list[str] | None = None, time: str = "valid_time") -> DataFrame:
    """Step files as one series; a series without the expected number of steps is an error when it is read."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    by = keys(whole, by)
    counts = whole.groupBy(*by).agg(F.count_distinct(time).alias("_n"))
    checked = counts.withColumn("_n", F.when(F.col("_n") != expected, F.raise_error(F.lit(f"not {expected} steps"))).otherwise(F.col("_n")))
    return whole.join(checked, by).where("_n > 0").drop("_n")


# sinks --------------------------------------------------------------------------------------------------------------


def wide_export(series: DataFrame, cells: DataFrame, variables: dict[str, str], time: str = "valid_time") -> DataFrame:
    """location_id, latitude, longitude, elevation, time and a column <variable>_<unit> each; variables: name -> unit."""
    columns = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(f"{v}_{u}") for v, u in variables.items()]
    grouped = series.where(F.col("variable").isin(list(variables))).groupBy("location_id", F.col(time).alias("time")).agg(*columns)
    place = cells.select(F.col("cell_id").alias("location_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "elevation")
    return grouped.join(place, "location_id").select("location_id", "latitude", "longitude", "elevation", "time", *[f"{v}_{u}" for v, u in variables.items()])


def export_points_parquet(series: DataFrame, cells: DataFrame, variables: dict[str, str], path: str) -> None:
    wide_export(series, cells, variables).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(result: DataFrame, units: dict[str, str], path: str, events: list[str] | None = None) -> None:
    """Header `name (unit)`; missing values are NaN, missing event times empty."""
    columns = []
    for name in result.columns:
        text = F.col(name).cast("string")
        if name in units and name not in (events or []):
            text = F.coalesce(text, F.lit("NaN"))
        columns.append(text.alias(f"{name} ({units[name]})" if name in units else name))
    result.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def json_documents(result: DataFrame, place: list[str], section: str, units: dict[str, str], time: str = "valid_time", decimals: bool = False) -> DataFrame:
    """One JSON document a place: its columns, the units, and arrays by time; non-finite values are null. decimals: as many as
    the unit has."""
    rounded = lambda c: F.round(F.col(c), DIGITS.get(units[c], 2)) if decimals else F.col(c)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), rounded(c))
    row = F.struct(F.col(time).alias("time"), *[(finite(c) if dict(result.dtypes)[c] in ("double", "float") else F.col(c)).alias(c) for c in units])
    grouped = result.groupBy(*place).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    arrays = F.struct(*[F.col("_r").getField(c).alias(c) for c in ("time", *units)])  # a field of an array of rows is an array
    described = F.struct(*[F.lit(u).alias(c) for c, u in units.items()])
    return grouped.select(F.to_json(F.struct(*place, described.alias(f"{section}_units"), arrays.alias(section)), {"ignoreNullFields": "false"}).alias("value"))


def json_sections(sections: dict[str, tuple[DataFrame, dict[str, str]]], place: list[str], time: dict[str, str] | None = None, decimals: bool = True) -> DataFrame:
    """One JSON document a place with several sections (hourly, daily...): name -> (table, units). A section without rows is left out.

    Each section is grouped by place for itself; the documents are then merged by place.
    """
    out, names = None, []
    for name, (table, units) in sections.items():
        own = json_documents(table, place, name, units, (time or {}).get(name, "valid_time"), decimals)
        kinds = dict(table.dtypes)
        keys_ = [F.get_json_object("value", f"$.{p}").cast(kinds[p]).alias(p) for p in place]
        part = own.select(*keys_, *[F.get_json_object("value", f"$.{x}").alias(x) for x in (f"{name}_units", name)])
        out = part if out is None else out.join(part, place, "full_outer")
        names += [f"{name}_units", name]
    head = F.to_json(F.struct(*place))
    body = F.concat_ws(",", *[F.when(F.col(n).isNotNull(), F.concat(F.lit(f'"{n}":'), F.col(n))) for n in names])
    return out.select(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), body, F.lit("}")).alias("value"))


def write_json(result: DataFrame, place: list[str], section: str, units: dict[str, str], path: str) -> None:
    json_documents(result, place, section, units).write.mode("overwrite").text(path)
