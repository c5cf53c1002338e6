"""The driver's tables as the engine's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.operators.grids import Grid
from isobarn.operators.requests import time_spine
from isobarn.session import tune

#: A 5-degree grid of the world.
WORLD = Grid("world", 72, 36, -177.5, -87.5, 5.0, 5.0)
DIGITS = 6


def _off_ties(digits: int) -> float:
    """A seventh of the last digit: exact halves would round by the noise of a sum's order."""
    return round(1.37 * 10.0 ** -(digits + 1), digits + 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its zoneless times are read as times of the session."""
    tune(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[(F.round(F.col(c) + F.lit(_off_ties(digits)), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r(expression: str, digits: int = DIGITS) -> str:
    """The same in SQL."""
    return f"round(({expression}) + CAST({_off_ties(digits):.{digits + 3}f} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hourly series: location_id, variable, valid_time, value."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("location_id"), F.col("event_type").alias("variable"), F.date_trunc("hour", "ts").alias("valid_time")).agg(F.avg("value").alias("value"))


HOURLY = "hourly AS (SELECT user_id AS location_id, event_type AS variable, date_trunc('hour', ts) AS valid_time, avg(value) AS value FROM events GROUP BY ALL)"


def regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as complete hourly series by location, null where nothing happened."""
    # the few events are dealt by location, in so many parts for good: whole series come of them, which stay where they are
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("location_id"), F.date_trunc("hour", "ts").alias("valid_time"), "value")
    events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "location_id")
    bounds = events.groupBy("location_id").agg(F.min("valid_time").alias("start"), (F.max("valid_time") + F.expr("interval 1 hour")).alias("stop"))
    spine = time_spine(bounds, 3600).select("location_id", "valid_time", F.lit(None).cast("double").alias("value"))
    seen = events.where("location_id IS NOT NULL AND valid_time IS NOT NULL")
    return spine.unionByName(seen).groupBy("location_id", "valid_time").agg(F.avg("value").alias("value"))


REGULAR = """eventhours AS (SELECT user_id AS location_id, date_trunc('hour', ts) AS valid_time, avg(value) AS value FROM events GROUP BY ALL),
bounds AS (SELECT user_id AS location_id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events GROUP BY ALL),
spine AS (SELECT location_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS valid_time FROM bounds),
regular AS (SELECT s.location_id, s.valid_time, e.value FROM spine s LEFT JOIN eventhours e USING (location_id, valid_time))"""


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("location_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))


DAILY = "daily_long AS (SELECT l_suppkey AS location_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of weather a line, with keys place_id and line."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("place_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("valid_time"),
        (q - 20).alias("temperature_2m"), (20 + d * 700).alias("relative_humidity_2m"), (q - 22 - d * 20).alias("dew_point_2m"),
        (t * 100 - 4).alias("wind_u_component_10m"), (d * 100 - 5).alias("wind_v_component_10m"), (980 + q).alias("pressure_msl"),
        (d * 60).alias("precipitation"), (F.col("l_partkey") % 101).cast("double").alias("cloud_cover"), (q * 60).alias("cape"),
        (q * 15).alias("shortwave_radiation"), (q * 10).alias("direct_radiation"), (F.col("l_suppkey") * 37 % 3000).cast("double").alias("elevation"),
        (F.col("l_suppkey") * 7 % 120 - 60).cast("double").alias("lat"), (F.col("l_suppkey") * 13 % 360 - 180).cast("double").alias("lon"),
    )


WEATHER = """weather AS (SELECT l_orderkey AS place_id, l_linenumber AS line, l_partkey AS part, l_shipdate AS valid_time,
  l_quantity - 20 AS temperature_2m, 20 + l_discount * 700 AS relative_humidity_2m, l_quantity - 22 - l_discount * 20 AS dew_point_2m,
  l_tax * 100 - 4 AS wind_u_component_10m, l_discount * 100 - 5 AS wind_v_component_10m, 980 + l_quantity AS pressure_msl,
  l_discount * 60 AS precipitation, CAST(l_partkey % 101 AS DOUBLE) AS cloud_cover, l_quantity * 60 AS cape,
  l_quantity * 15 AS shortwave_radiation, l_quantity * 10 AS direct_radiation, CAST(l_suppkey * 37 % 3000 AS DOUBLE) AS elevation,
  CAST(l_suppkey * 7 % 120 - 60 AS DOUBLE) AS lat, CAST(l_suppkey * 13 % 360 - 180 AS DOUBLE) AS lon FROM lineitem)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("member", "value"))
    time = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600)
    return vectors.select(F.col("label").alias("location_id"), time.alias("valid_time"), "member", F.col("value").cast("double").alias("value"))


MEMBERS = """members AS (SELECT label AS location_id, to_timestamp(1704067200 + vec_id * 3600)::TIMESTAMP AS valid_time,
  unnest(range(len(embedding))) AS member, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("place_id"), (F.col("s_suppkey") * 7 % 170 - 85 + 0.3).cast("double").alias("lat"), (F.col("s_suppkey") * 13 % 360 - 180 + 0.3).cast("double").alias("lon"),
        F.abs("s_acctbal").alias("elevation"), ((F.col("s_nationkey") - 12) * 3600).alias("utc_offset_seconds"),
    )


PLACES = """places AS (SELECT s_suppkey AS place_id, CAST(s_suppkey * 7 % 170 - 85 + 0.3 AS DOUBLE) AS lat, CAST(s_suppkey * 13 % 360 - 180 + 0.3 AS DOUBLE) AS lon,
  abs(s_acctbal) AS elevation, (s_nationkey - 12) * 3600 AS utc_offset_seconds FROM supplier)"""


def cells(spark: SparkSession) -> DataFrame:
    height = F.when(F.col("cell_id") % 4 == 0, F.lit(-999.0)).otherwise((F.col("cell_id") * 31 % 3000).cast("double"))
    return WORLD.cells(spark).withColumn("elevation", height)


CELLS = """cells AS (SELECT i AS cell_id, i % 72 AS x, i // 72 AS y, -87.5 + (i // 72) * 5.0 AS lat, -177.5 + (i % 72) * 5.0 AS lon,
  CASE WHEN i % 4 = 0 THEN -999.0 ELSE CAST(i * 31 % 3000 AS DOUBLE) END AS elevation FROM (SELECT unnest(range(2592)) AS i))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    run = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", "ts")) - F.col("event_id") % 8 * 86400)
    return e.groupBy(F.lit("events").alias("domain"), F.col("event_type").alias("variable"), F.col("user_id").alias("location_id"), F.date_trunc("hour", "ts").alias("valid_time"), run.alias("run_time")).agg(F.avg("value").alias("value"))


RUNS = """runs AS (SELECT 'events' AS domain, event_type AS variable, user_id AS location_id, date_trunc('hour', ts) AS valid_time,
  date_trunc('day', ts) - to_days(CAST(event_id % 8 AS INTEGER)) AS run_time, avg(value) AS value FROM events GROUP BY ALL)"""


def model(spark: SparkSession, sf_dir: str, high: bool) -> DataFrame:
    """Two models: the high one has a third of the events."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0" if high else "true")
    return e.groupBy(F.col("user_id").alias("location_id"), F.col("event_type").alias("variable"), F.date_trunc("hour", "ts").alias("valid_time")).agg((F.avg("value") + (0 if high else 1)).alias("value"))


MODELS = """high AS (SELECT user_id AS location_id, event_type AS variable, date_trunc('hour', ts) AS valid_time, avg(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
low AS (SELECT user_id AS location_id, event_type AS variable, date_trunc('hour', ts) AS valid_time, avg(value) + 1 AS value FROM events GROUP BY ALL)"""
