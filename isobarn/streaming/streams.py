"""Ingestion as streams: fields arrive step by step and member by member and are differenced, paired, averaged and merged.

Every operator takes and gives a streaming (or batch) DataFrame; sinks run in foreachBatch and may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isobarn.operators.series import SCHEMA
from isobarn.session import ship_package
from isobarn.sources.storage import CHUNK_SECONDS, build_run_metadata
from isobarn.sources.versioned import Store


def stream_fields(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """Files of field rows, as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_deaccumulate(steps: DataFrame, by: list[str], watermark: str = "2 days", keep_days: int = 16) -> DataFrame:
    """Differences of accumulated steps to the step before, by key and run; late steps are dropped.

    steps: by, run_time, step_start, step_end, step_type (accum, avg or other), value. State is one step a key and
    goes when the watermark is keep_days past the run.
    """
    ship_package(steps.sparkSession)
    names = [*by, "run_time", "step_start", "step_end", "value"]
    types = dict(steps.dtypes)
    out = ", ".join(f"`{n}` {types[n]}" for n in names)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        own = pd.concat(list(batches)).sort_values("step_end", kind="stable")
        own = own[own["step_end"] > own["step_start"]].drop_duplicates("step_end")
        if last:
            own = own[own["step_end"] > last[0]]
        if len(own):
            # each step beside the one before it, the first beside the state's
            before = own[["step_end", "value"]].shift()
            if last:
                before.iloc[0] = last
            goes_on = before["step_end"].notna() & (before["step_end"] != own["step_start"]) & own["step_type"].isin(["accum", "avg"])
            length, earlier = own["step_end"] - own["step_start"], before["step_end"] - own["step_start"]
            mean = (own["value"] * length - before["value"] * earlier) / (length - earlier)
            difference = (own["value"] - before["value"]).where(own["step_type"] == "accum", mean)
            out = pd.DataFrame({"step_start": before["step_end"].where(goes_on, own["step_start"]).astype("int64"), "step_end": own["step_end"], "value": difference.where(goes_on, own["value"])})
            last = (int(own["step_end"].iloc[-1]), float(own["value"].iloc[-1]))
        else:
            out = pd.DataFrame(columns=["step_start", "step_end", "value"])
        if last:
            state.update(last)
            run_ms = int(pd.Timestamp(key[-1]).timestamp() * 1000)
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), run_ms) + keep_days * 86_400_000)
        yield out.assign(**dict(zip([*by, "run_time"], key)))[names]

    watched = steps.withWatermark("run_time", watermark)
    return watched.groupBy(*by, "run_time").applyInPandasWithState(run, out, "step long, value double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_ensemble_mean_spread(members: DataFrame, by: list[str], watermark: str = "6 hours", time: str = "valid_time") -> DataFrame:
    """Mean and spread of the members that have come, by step."""
    return members.withWatermark(time, watermark).groupBy(*by, time).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.count("value").alias("members"))


def stream_pair(left: DataFrame, right: DataFrame, on: list[str], watermark: str = "6 hours", time: str = "valid_time") -> DataFrame:
    """Rows of two inputs of a derived field with equal keys and times, once both are there; repeats are dropped."""
    keyed = [*on, time]
    a = left.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keyed).withColumnRenamed("value", "left_value")
    b = right.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keyed).withColumnRenamed("value", "right_value")
    return a.select(*keyed, "left_value").join(b.select(*keyed, "right_value"), keyed)


def stream_probability(members: DataFrame, dt: int, by: list[str], threshold: float = 0.1, watermark: str = "6 hours", time: str = "valid_time") -> DataFrame:
    """Percent of members at or over the threshold, by step."""
    share = F.avg(F.when(F.col("value") >= threshold * dt / 3600, 100.0).otherwise(F.lit(0.0)))
    found = members.withWatermark(time, watermark).groupBy(*by, F.window(time, f"{dt} seconds")).agg(share.alias("precipitation_probability"), F.count(F.lit(1)).alias("members"))
    return found.where("members > 1").select(*by, F.col("window.start").alias(time), "precipitation_probability")


def stream_resample(events: DataFrame, dt: int, by: list[str], kind: str = "mean", watermark: str = "1 hour", time: str = "valid_time", value: str = "value") -> DataFrame:
    """Values over (t - dt, t], labelled by t."""
    rule = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[kind]
    # windows are closed on the left; a microsecond back makes them closed on the right
    moved = events.withColumn(time, F.col(time) - F.expr("interval 1 microsecond")).withWatermark(time, watermark)
    found = moved.groupBy(*by, F.window(time, f"{dt} seconds").alias("_w")).agg(rule(value).alias(value))
    return found.select(*by, F.col("_w.end").alias(time), value)


def stream_sliding_mean(events: DataFrame, hours: int, by: list[str], watermark: str = "1 hour", time: str = "valid_time", value: str = "value") -> DataFrame:
    """Means of the last hours, every hour."""
    found = events.withWatermark(time, watermark).groupBy(*by, F.window(time, f"{hours} hours", "1 hour")).agg(F.avg(value).alias(value))
    return found.select(*by, F.col("window.end").alias(time), value)


def upsert_batch(path: str, by: list[str] | None = None, chunk: int = CHUNK_SECONDS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch is merged into a versioned store (sources.versioned) as one commit, which reads and replaces
    the time chunks that it touches and no others. A batch that is repeated after its commit is left out; one that broke off
    before it has changed nothing that readers see."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        Store(spark, path, chunk).upsert(batch, by, f"{query}:{batch_id}")

    return run


def stream_upsert(series: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, chunk: int = CHUNK_SECONDS):
    """Start a query that merges arriving rows into a stored table; rows that come twice are merged once."""
    return series.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert_batch(path, by, chunk)).start()


def publish_run_metadata(path: str, expected_steps: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over run counts: metadata of the runs that have become complete. Each run is a partition,
    so other runs of the domain stay, and a repeated batch does no harm."""

    def run(batch: DataFrame, batch_id: int) -> None:
        done = batch.where(F.col("n_times") >= expected_steps)
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "run_time").parquet(path)

    return run


def stream_run_metadata(runs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Distinct times that have come of each run, for publish_run_metadata; the step's end names the last.

    The count is exact: state is the times of a run, which its steps bound.
    """
    watched = runs.withWatermark("run_time", watermark)
    return watched.groupBy("domain", "run_time").agg(F.size(F.collect_set("valid_time")).cast("bigint").alias("n_times"), F.max("valid_time").alias("end"))


__all__ = [n for n in dir() if n.startswith(("stream_", "publish_", "upsert_"))] + ["build_run_metadata"]
