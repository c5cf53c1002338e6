"""Stored runs, manifests, sinks and streams (S, R) on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from isobarn.operators import fill, resample
from isobarn.operators.requests import time_spine
from isobarn.plans import tables as T
from isobarn.session import shared_dir
from isobarn.sources import storage as S
from isobarn.sources.versioned import Store
from isobarn.streaming import streams as R


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/isobarn/{name}-{uuid.uuid4().hex}"


def run_on_axis(spark, sf_dir):
    """The newest run, its irregular hours on a regular axis and filled."""
    runs = T.runs(spark, sf_dir).select(F.concat_ws("-", "location_id", "variable").alias("series"), "run_time", "valid_time", "value")
    newest = runs.agg(F.max("run_time")).first()[0]
    own = runs.where(F.col("run_time") == F.lit(newest))
    bounds = own.groupBy("series").agg(F.min("valid_time").alias("start"), (F.max("valid_time") + F.expr("interval 1 hour")).alias("stop"))
    spine = time_spine(bounds, 3600).select("series", "valid_time")
    return T.tidy(S.read_run(runs, str(newest), spine, ["series"], lambda d: fill.fill_linear(d, ["series"])).select("series", "valid_time", "value"))


LEVELS = {"view": "temperature_850hPa", "click": "wind_speed_180m", "purchase": "temperature_20hPa", "error": "wind_speed_250m", "signup": "cloud_cover"}


def stored_full_runs(spark, sf_dir):
    """What is kept of each run, written by run and read back."""
    names = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])
    shifted = F.timestamp_seconds(F.unix_seconds("run_time") + F.col("location_id") % 4 * 3600)
    runs = T.runs(spark, sf_dir).withColumns({"variable": names[F.col("variable")], "run_time": shifted})
    path = _path(spark, "runs")
    S.write_full_run(runs, path)
    return spark.read.parquet(path).groupBy("variable", F.hour("run_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_time").alias("runs"))


def _manifest(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    ending = F.when(F.col("o_orderkey") % 5 == 0, ".json").otherwise(".om")
    return o.select(F.concat(F.lit("f"), F.col("o_orderkey"), ending).alias("path"), (F.col("o_orderkey") % 97).alias("size"), F.timestamp_seconds(F.col("o_orderkey") * 1000).alias("modified"), F.col("o_orderkey").alias("k"))


def changed_files(spark, sf_dir):
    remote = _manifest(spark, sf_dir)
    local = remote.where("k % 3 > 0").withColumns({"size": F.when(F.col("k") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")), "modified": F.timestamp_seconds(F.unix_seconds("modified") - F.col("k") % 4)})
    return S.select_changed_files(remote.drop("k"), local.drop("k"))


def files_in_range(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "master").when(k % 4 == 1, F.concat(F.lit("year_"), 1980 + k % 60)).when(k % 4 == 2, F.concat(F.lit("chunk_"), k % 2000)).otherwise("static")
    files = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), k, F.lit("/"), name, F.lit(".om")).alias("path"))
    return S.select_files_in_range(files, 1_000_000_000, 1_200_000_000)


def csv_rows(spark, sf_dir):
    """Hourly values as CSV and back: header with units, NaN for what is missing."""
    h = T.hourly(spark, sf_dir).select("location_id", "variable", F.unix_seconds("valid_time").alias("time"), F.when(F.col("location_id") % 3 > 0, F.floor("value")).alias("value"), F.when(F.col("location_id") % 2 > 0, "rise").alias("sunrise"))
    path = _path(spark, "csv")
    S.write_csv(h, {"value": "°C", "sunrise": "iso8601"}, path, ["sunrise"])
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("location_id").cast("bigint"), "variable", F.col("time").cast("bigint"), F.col("value (°C)").alias("value"), F.coalesce("sunrise (iso8601)", F.lit("")).alias("sunrise"))


def calendar_days(spark, sf_dir):
    d = T.daily_long(spark, sf_dir).where("NOT (month(date) = 2 AND day(date) = 29)")
    return T.tidy(S.fill_missing_calendar_days(d, ["location_id"]))


def assembled_chunks(spark, sf_dir):
    hours = T.places(spark, sf_dir).select("place_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).withColumns({"valid_time": F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600), "value": (F.col("place_id") * F.col("hour")).cast("double")})
    parts = [hours.where(f"hour div 8 = {i}") for i in range(3)]
    return S.assemble_chunks(parts, 24, ["place_id"]).select("place_id", "hour", "value")


def _canonical(spark, sf_dir):
    """Hourly series by lead day: each hour is there for up to four lead days."""
    h = T.hourly(spark, sf_dir).withColumn("lead_day", F.explode(F.sequence(F.lit(0), (F.col("location_id") % 4).cast("int"))))
    return h.select(F.lit("events").alias("domain"), "variable", "location_id", F.lit(0).alias("member"), "lead_day", "valid_time", (F.col("value") + F.col("lead_day")).alias("value"))


def upserted_lead_days(spark, sf_dir):
    """A store with lead days, upserted twice with the same new values of some of them."""
    path = _path(spark, "leads")
    batch = R.upsert_batch(path)
    own = _canonical(spark, sf_dir)
    batch(own, 0)
    for _ in range(2):
        batch(own.where("lead_day < 2 AND location_id % 3 = 0").withColumn("value", F.when(F.col("variable") != "error", F.col("value") + 50)), 1)
    return T.tidy(Store(spark, path).read().select("variable", "location_id", F.col("lead_day").cast("int").alias("lead_day"), "valid_time", "value"))


def versioned_upserts(spark, sf_dir):
    """A store in commits: all events, then new values of its first days and of its last ones, one of them twice; read by a range, with
    the number of the commit that each chunk of time comes from."""
    store = Store(spark, _path(spark, "versions"), 5 * 86400)
    own = T.hourly(spark, sf_dir)
    store.upsert(own, batch="all")
    day = F.dayofmonth("valid_time")
    for name, days in (("first", day <= 2), ("last", day >= 29), ("last", day >= 29)):
        store.upsert(own.where(days & (F.col("location_id") % 2 == 0)).withColumn("value", F.col("value") + 1000), batch=name)
    store.vacuum()
    commits = store.current().select("variable", "time_chunk", F.col("number").alias("commit_number"))
    found = store.read(variables=["view", "click"], start="2024-01-02T00:00:00", stop="2024-01-30T00:00:00", keep_chunks=True)
    return T.tidy(found.join(F.broadcast(commits), ["variable", "time_chunk"]).select("variable", "location_id", "valid_time", "value", "commit_number"))


def streamed_fields(spark, sf_dir):
    """Field files read as a stream and appended to a table."""
    source, out = _path(spark, "fields"), _path(spark, "appended")
    _canonical(spark, sf_dir).repartition(4).write.parquet(source)
    R.stream_fields(spark, source, files_per_trigger=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return T.tidy(spark.read.parquet(out).groupBy("variable", "lead_day").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def _steps(spark, sf_dir):
    """Sums of quantities by supplier since its first order, every order a step; every second supplier gives means."""
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey")
    mean = F.col("l_suppkey") % 2 == 1
    total = F.sum("q").over(w)
    number = F.row_number().over(w)
    return lines.select(F.col("l_suppkey").alias("location_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("l_suppkey") * 3600).alias("run_time"), F.lit(0).alias("step_start"), number.alias("step_end"), F.when(mean, "avg").otherwise("accum").alias("step_type"), F.when(mean, total / number).otherwise(total).alias("value"))


def streamed_differences(spark, sf_dir):
    source, out = _path(spark, "steps"), _path(spark, "differences")
    steps = _steps(spark, sf_dir)
    steps.unionByName(steps.where("step_end % 10 = 0")).repartition(2).write.parquet(source)  # some steps arrive twice
    stream = spark.readStream.schema(steps.schema).parquet(source)
    found = R.stream_deaccumulate(stream, ["location_id"])
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return T.tidy(spark.read.schema(found.schema).parquet(out).select("location_id", "step_start", "step_end", "value"), 4)


def streamed_run_metadata(spark, sf_dir):
    """Counts of a stream of runs; the runs of at least 100 times are published, twice."""
    source, out = _path(spark, "arriving"), _path(spark, "published")
    T.runs(spark, sf_dir).repartition(3).write.parquet(source)
    counts = R.stream_run_metadata(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))
    publish = R.publish_run_metadata(out, 100)

    def twice(batch, number):
        for _ in range(2):
            publish(batch, number)

    counts.writeStream.outputMode("update").option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    found = spark.read.schema("domain string, n_times bigint, end timestamp, run_time timestamp").parquet(out)
    return found.select("domain", "run_time", "n_times", "end")


def differenced_batch(spark, sf_dir):
    """The same differences as a batch."""
    return T.tidy(resample.deaccumulate_sections(_steps(spark, sf_dir), ["location_id"]).select("location_id", "step_start", "step_end", "value"), 4)


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_r = T.r
_LEVELS = "CASE variable " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LEVELS.items()) + " END"
_STEPS = """q AS (SELECT l_suppkey AS s, l_orderkey AS o, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), n AS (SELECT s, row_number() OVER w AS e, sum(q) OVER w AS t FROM q WINDOW w AS (PARTITION BY s ORDER BY o)),
  st AS (SELECT s, e, CASE WHEN s % 2 = 1 THEN t / e ELSE t END AS v FROM n), d AS (SELECT *, lag(v) OVER w AS v0, lag(e) OVER w AS e0 FROM st WINDOW w AS (PARTITION BY s ORDER BY e))"""
_DIFFERENCES = f"WITH {_STEPS} SELECT s AS location_id, CAST(coalesce(e0, 0) AS BIGINT) AS step_start, CAST(e AS BIGINT) AS step_end, {_r('CASE WHEN v0 IS NULL THEN v WHEN s % 2 = 1 THEN (v * e - v0 * e0) / (e - e0) ELSE v - v0 END', 4)} AS value FROM d"
_LEADS = f"{T.HOURLY}, leads AS (SELECT variable, location_id, valid_time, value, CAST(unnest(range(location_id % 4 + 1)) AS INTEGER) AS lead_day FROM hourly)"
ORACLE = {
    "run_on_axis": f"""WITH {T.RUNS}, o AS (SELECT location_id || '-' || variable AS series, valid_time, value FROM runs WHERE run_time = (SELECT max(run_time) FROM runs)),
      sp AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS valid_time FROM (SELECT series, min(valid_time) AS a, max(valid_time) AS b FROM o GROUP BY series)),
      j AS (SELECT sp.series, sp.valid_time, o.value, CASE WHEN o.value IS NOT NULL THEN epoch(sp.valid_time) END AS t FROM sp LEFT JOIN o USING (series, valid_time)),
      n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(t IGNORE NULLS) OVER b AS t0, last_value(value IGNORE NULLS) OVER a AS v1, last_value(t IGNORE NULLS) OVER a AS t1 FROM j
        WINDOW b AS (PARTITION BY series ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY series ORDER BY valid_time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT series, valid_time, {_r('coalesce(value, v1 * ((epoch(valid_time) - t0) / (t1 - t0)) + v0 * (1 - (epoch(valid_time) - t0) / (t1 - t0)))')} AS value FROM n""",
    "stored_full_runs": f"""WITH {T.RUNS}, s AS (SELECT {_LEVELS} AS variable, run_time + to_hours(CAST(location_id % 4 AS INTEGER)) AS run_time, location_id FROM runs)
      SELECT variable, CAST(location_id % 4 AS INTEGER) AS hour, count(*) AS n, count(DISTINCT run_time) AS runs FROM s WHERE location_id % 4 IN (0, 3) AND variable NOT IN ('temperature_20hPa', 'wind_speed_250m') GROUP BY ALL""",
    "changed_files": """WITH f AS (SELECT 'f' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.json' ELSE '.om' END AS path, o_orderkey % 97 AS size, to_timestamp(o_orderkey * 1000)::TIMESTAMP AS modified, o_orderkey AS k FROM orders)
      SELECT path, size, modified FROM f WHERE k % 3 = 0 OR k % 4 > 1 OR (k % 7 = 0 AND k % 5 > 0)""",
    "files_in_range": """WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'master' WHEN 1 THEN 'year_' || (1980 + o_orderkey % 60) WHEN 2 THEN 'chunk_' || (o_orderkey % 2000) ELSE 'static' END AS name FROM orders)
      SELECT 'd' || k || '/' || name || '.om' AS path FROM f WHERE k % 4 IN (0, 3) OR (k % 4 = 1 AND 1980 + k % 60 BETWEEN 2001 AND 2008) OR (k % 4 = 2 AND k % 2000 * 1209600 < 1200000000 AND (k % 2000 + 1) * 1209600 > 1000000000)""",
    "csv_rows": f"""WITH {T.HOURLY} SELECT location_id, variable, CAST(epoch(valid_time) AS BIGINT) AS time, CASE WHEN location_id % 3 > 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE 'NaN' END AS value,
      CASE WHEN location_id % 2 > 0 THEN 'rise' ELSE '' END AS sunrise FROM hourly""",
    "calendar_days": f"""WITH {T.DAILY}, d AS (SELECT * FROM daily_long WHERE NOT (month(date) = 2 AND day(date) = 29)) SELECT location_id, date, {_r('value')} AS value FROM d
      UNION ALL SELECT location_id, date + 1, {_r('value')} FROM d WHERE month(date) = 2 AND day(date) = 28 AND year(date) % 4 = 0 AND (year(date) % 100 <> 0 OR year(date) % 400 = 0)""",
    "assembled_chunks": "SELECT s_suppkey AS place_id, CAST(h AS INTEGER) AS hour, CAST(s_suppkey * h AS DOUBLE) AS value FROM supplier, (SELECT unnest(range(24)) AS h)",
    "versioned_upserts": f"""WITH {T.HOURLY}, c AS (SELECT *, CAST(floor(epoch(valid_time) / 432000) AS BIGINT) AS chunk FROM hourly),
      n AS (SELECT variable, chunk, CASE WHEN bool_or(location_id % 2 = 0 AND day(valid_time) >= 29) THEN 3 WHEN bool_or(location_id % 2 = 0 AND day(valid_time) <= 2) THEN 2 ELSE 1 END AS commit_number FROM c GROUP BY ALL)
      SELECT variable, location_id, valid_time, {_r('value + CASE WHEN location_id % 2 = 0 AND (day(valid_time) <= 2 OR day(valid_time) >= 29) THEN 1000 ELSE 0 END')} AS value, CAST(commit_number AS BIGINT) AS commit_number FROM c JOIN n USING (variable, chunk)
      WHERE variable IN ('view', 'click') AND valid_time >= '2024-01-02' AND valid_time < '2024-01-30'""",
    "upserted_lead_days": f"""WITH {_LEADS} SELECT variable, location_id, lead_day, valid_time, {_r("value + lead_day + CASE WHEN lead_day < 2 AND location_id % 3 = 0 AND variable <> 'error' THEN 50 ELSE 0 END")} AS value FROM leads""",
    "streamed_fields": f"WITH {_LEADS} SELECT variable, lead_day, count(*) AS n, {_r('avg(value + lead_day)')} AS mean FROM leads GROUP BY ALL",
    "streamed_differences": _DIFFERENCES,
    "differenced_batch": _DIFFERENCES.replace("CAST(coalesce(e0, 0) AS BIGINT)", "CAST(coalesce(e0, 0) AS INTEGER)").replace("CAST(e AS BIGINT)", "CAST(e AS INTEGER)"),
    "streamed_run_metadata": f"""WITH {T.RUNS} SELECT domain, run_time::TIMESTAMP AS run_time, count(DISTINCT valid_time) AS n_times, max(valid_time)::TIMESTAMP AS "end" FROM runs GROUP BY domain, run_time HAVING count(DISTINCT valid_time) >= 100""",
}
