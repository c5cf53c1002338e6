"""Shared pieces of the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobarn.session import shared_dir, ship_package

#: Rows and bytes of an Arrow batch; texts may be very long, so batches are kept small.
BATCH_ROWS = 500
BATCH_BYTES = 32 << 20
#: Keys with over one in so many of all rows are joined apart; there are fewer than so many of them.
HOT = 2000
#: Rows up to which a table of some numbers each is broadcast whole (about 20 MB).
FEW = 500_000
#: Column that tells rows apart where ids are null or repeat; written with a table, so that each read gives the same.
TAG = "_isobarn_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, in rows and bytes, so that a batch of long texts fits in a Python worker.

    The settings stay on the session, as plans are only run later; a single text is one batch at least.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The files survive lost executors and are computed once, however often the result is used. They stay
    until `discard` or the folder's owner clears them; the folder is the one that spark.checkpoint.dir names.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/isobarn/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._isobarn_files = path
    return found


def discard(*written: DataFrame) -> None:
    """Delete the files of results of `materialize` that nothing reads any more."""
    for df in written:
        if path := getattr(df, "_isobarn_files", None):
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)


def attach(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with facts, which have one row a key and the number `n` of its rows among `total`.

    Up to FEW rows there are as few facts, which are broadcast. Beyond, keys with many rows (fewer than HOT of them, so
    their facts are broadcast) are joined where the rows lie; only the rows of the others are dealt by key. `rows` is
    read twice then.
    """
    if total <= FEW:
        return rows.join(F.broadcast(facts.drop(n)), key)
    often = F.col(n) > max(1, total // HOT)
    hot, cold = F.broadcast(facts.where(often).drop(n)), facts.where(~often).drop(n)
    there = rows.join(hot, key)
    others = rows.join(F.broadcast(facts.where(often).select(key)), key, "left_anti").join(cold, key)
    return there.unionByName(others)


def with_tag(df: DataFrame) -> DataFrame:
    """Rows with a number each. It is stable only once the result is written."""
    return df.withColumn(TAG, F.monotonically_increasing_id())


def tagged(df: DataFrame) -> DataFrame:
    """Rows with a stable TAG: as it was written with them, or from a copy written now."""
    return df if TAG in df.columns else materialize(with_tag(df), "tagged")


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column; None stays None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on a uint64 array (new array)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows with a key, chosen by its hash, for fitting a model.

    A share of the hash's range that holds about four times as many rows is filtered first. So the tasks together send
    some 4 * most rows to the task that picks, however large the table is.
    """
    rows = df.where(F.col(key).isNotNull())
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, 4.0 * most / max(1, df.count()))
    return rows.where(spread < int(share * (1 << 40))).orderBy(spread, key).limit(most)
