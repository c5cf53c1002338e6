"""Names and small helpers that the operators on the long series table share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Columns that identify a series.
KEYS = ["domain", "variable", "location_id", "member"]
SCHEMA = "domain string, variable string, location_id bigint, member int, lead_day int, valid_time timestamp, value double"


def keys(df: DataFrame, by: list[str] | None = None) -> list[str]:
    """The series keys that the table has."""
    return by if by is not None else [k for k in KEYS if k in df.columns]


def stored_keys(df: DataFrame, by: list[str] | None = None) -> list[str]:
    """The keys of stored rows: those of the series, and the lead day and run where the table has them."""
    return by if by is not None else [k for k in [*KEYS, "lead_day", "run_time"] if k in df.columns]


def bounded(table: DataFrame, most: int, what: str) -> DataFrame:
    """A small table, to be broadcast; an error where it has over `most` rows."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"{what} of over {most:,} rows")
    return F.broadcast(table)


def ordered(by: list[str], time: str = "valid_time") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time)


def seconds(time: str | Column = "valid_time") -> Column:
    return F.unix_seconds((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def step_index(dt: int, time: str | Column = "valid_time") -> Column:
    """Number of the step of dt seconds that a time lies in."""
    return F.floor(seconds(time) / dt)


def rounded(value: Column, scale: float | None) -> Column:
    """Values as stored with a scale factor: the nearest multiple of 1/scale, halves away from zero."""
    return value if scale is None else F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def whole_series(batches: Iterator[pa.RecordBatch], at: str) -> Iterator[pa.Table]:
    """Batches of ordered series, whose rows are numbered from 1 in column `at`, as tables of whole series: at most one batch and one series."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.schema.get_field_index(at)).to_numpy() == 1)
        if len(starts) and (last := int(starts[-1])) + sum(x.num_rows for x in held):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def missing_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null, once, at the source."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
