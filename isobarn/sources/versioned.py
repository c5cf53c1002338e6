"""A versioned store of series: files of time chunks, and a commit log that says which version of each chunk counts.

data/v=<commit>/domain=.../variable=.../time_chunk=.../ holds the chunks that one commit wrote; log/<number>.json holds one line for each of
them. A commit is the creation of its log file, which is written aside and renamed, so readers see all of a commit or nothing, and of two writers
that race for a number one begins anew. A batch reads and replaces the chunks that it touches and no others. A batch that is repeated
after it was committed is left out, one that broke off before leaves files that nothing names. `vacuum` deletes those and
replaced versions, and folds the log into one file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobarn.operators.series import stored_keys
from isobarn.sources.storage import CHUNK_SECONDS, by_chunk, merge_series, time_chunk

#: Chunks that a batch may touch, and a read may open: their names pass through the driver.
MOST_CHUNKS = 100_000
LOG = "number bigint, batch string, domain string, variable string, time_chunk bigint, v string"
_PARTS = ("domain", "variable", "time_chunk")


class Conflict(Exception):
    """Another writer has committed meanwhile."""


class Store:
    """The store at a path. A chunk is named by the domain and variable that its series have, and by time_chunk."""

    def __init__(self, spark: SparkSession, path: str, chunk: int = CHUNK_SECONDS):
        self.spark, self.path, self.chunk = spark, path.rstrip("/"), chunk
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rest}".rstrip("/"))

    def _numbers(self) -> list[int]:
        """Numbers of the log's files."""
        if not self._fs.exists(self._path("log")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("log"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def log(self) -> DataFrame:
        """All lines of the log."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json([f"{self.path}/log/{n:012d}.json" for n in numbers])

    def current(self) -> DataFrame:
        """domain, variable, time_chunk, v, number: the version of each chunk that counts."""
        newest = F.max(F.struct("number", "v")).alias("_n")
        return self.log().where("time_chunk IS NOT NULL").groupBy(*_PARTS).agg(newest).select(*_PARTS, "_n.v", "_n.number")

    def _folder(self, row) -> str:
        quote = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join([f"v={row['v']}", *(f"{p}={quote(str(row[p]))}" for p in _PARTS if row[p] is not None)])

    def _open(self, chunks: DataFrame) -> DataFrame | None:
        """The files of the chunks (of `current`), None if there are none."""
        rows = chunks.limit(MOST_CHUNKS + 1).collect()  # names of chunks, bounded
        if len(rows) > MOST_CHUNKS:
            raise ValueError(f"over {MOST_CHUNKS:,} chunks at once; ask for fewer variables or a shorter range")
        if not rows:
            return None
        schema = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/{self._folder(rows[0])}").schema
        kinds = {"domain": T.StringType(), "variable": T.StringType(), "time_chunk": T.LongType()}  # and not what their values look like
        schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in schema])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{self._folder(r)}" for r in rows]).drop("v")

    def read(self, domain: str | None = None, variables: list[str] | None = None, start: str | None = None, stop: str | None = None, keep_chunks: bool = False) -> DataFrame:
        """The series as of now; later commits do not change what a read has begun. Only chunks of the range are opened."""
        chunks = self.current()
        moment = lambda t: F.lit(t).cast("timestamp")
        number = lambda t: F.floor(F.unix_seconds(moment(t)) / self.chunk)
        if domain is not None:
            chunks = chunks.where(F.col("domain") == domain)
        if variables is not None:
            chunks = chunks.where(F.col("variable").isin(variables))
        if start is not None:
            chunks = chunks.where(F.col("time_chunk") >= number(start))
        if stop is not None:
            chunks = chunks.where(F.col("time_chunk") <= number(stop))
        found = self._open(chunks)
        if found is None:
            raise ValueError(f"no chunks in {self.path} for this range")
        if start is not None:
            found = found.where(F.col("valid_time") >= moment(start))
        if stop is not None:
            found = found.where(F.col("valid_time") < moment(stop))
        return found if keep_chunks else found.drop("time_chunk")

    def has(self, batch: str) -> bool:
        return not self.log().where(F.col("batch") == batch).isEmpty()

    def _commit(self, number: int, lines: list[dict]) -> None:
        aside = self._path(f"log/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write("\n".join(json.dumps(x) for x in lines).encode())
        out.close()
        place = self._path(f"log/{number:012d}.json")
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            self._fs.delete(aside, False)
            raise Conflict(f"commit {number} of {self.path} is taken")

    def upsert(self, series: DataFrame, by: list[str] | None = None, batch: str | None = None) -> int:
        """Merge rows into the chunks that they touch, as one commit, and give its number; -1 if the batch was committed before.
        Rows are told apart by series, lead day, run and time, as far as the table has them."""
        if batch is not None and self.has(batch):
            return -1
        number = (self._numbers() or [0])[-1] + 1
        own = series.withColumn("time_chunk", time_chunk("valid_time", self.chunk))
        parts = [p for p in _PARTS if p in own.columns]
        absent = {p: F.lit(None).cast("string") for p in _PARTS if p not in own.columns}
        touched = own.select(*parts).distinct().withColumns(absent) if absent else own.select(*parts).distinct()
        touched = touched.select(*_PARTS).limit(MOST_CHUNKS + 1).collect()  # names of chunks, bounded
        if len(touched) > MOST_CHUNKS:
            raise ValueError(f"a batch of over {MOST_CHUNKS:,} chunks")
        kept = self.spark.createDataFrame(touched, "domain string, variable string, time_chunk bigint")
        same = [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in _PARTS]
        stored = self._open(self.current().alias("a").join(F.broadcast(kept).alias("b"), same, "left_semi")) if number > 1 else None
        merged = own if stored is None else merge_series(stored.select(*own.columns), own, [*stored_keys(series, by), "time_chunk"])
        v = uuid.uuid4().hex
        by_chunk(merged, parts).write.partitionBy(*parts).parquet(f"{self.path}/data/v={v}")
        lines = [{"number": number, "batch": batch, "v": v} | {p: r[p] for p in _PARTS} for r in touched] or [{"number": number, "batch": batch}]
        try:
            self._commit(number, lines)
        except Conflict:  # what was read may be out of date
            self._fs.delete(self._path(f"data/v={v}"), True)
            return self.upsert(series, by, batch)
        return number

    def vacuum(self) -> None:
        """Delete files that no chunk's current version names, and fold the log into its last file. Not while others read or write."""
        numbers = self._numbers()
        if not numbers:
            return
        rows = self.current().collect()
        batches = [r["batch"] for r in self.log().select("batch").distinct().collect() if r["batch"] is not None]
        used = {self._folder(r) for r in rows}
        lines = [{"number": r["number"], "v": r["v"]} | {p: r[p] for p in _PARTS} for r in rows] + [{"number": numbers[-1], "batch": b} for b in batches]
        self._commit(numbers[-1] + 1, lines)
        for n in numbers:
            self._fs.delete(self._path(f"log/{n:012d}.json"), False)
        depth = {f.split("/")[0] for f in used}
        for version in self._fs.listStatus(self._path("data")):
            name = version.getPath().getName()
            if name not in depth:
                self._fs.delete(version.getPath(), True)
                continue
            self._sweep(f"data/{name}", name, used)

    def _sweep(self, place: str, name: str, used: set[str]) -> None:
        for x in self._fs.listStatus(self._path(place)):
            own = f"{name}/{x.getPath().getName()}"
            if not x.isDirectory() or own in used:
                continue
            if any(f.startswith(own + "/") for f in used):
                self._sweep(f"{place}/{x.getPath().getName()}", own, used)
            else:
                self._fs.delete(x.getPath(), True)
