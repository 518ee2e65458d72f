"""Chunks of time: bounds with steps and widths, seasons, and padding, as tables and set-based joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_CHUNKS = 100_000
#: What :func:`with_chunks` adds to rows.
MARKS = ("chunk_id", "chunk_start", "in_chunk")


@dataclass(frozen=True)
class Bounds:
    """Ranges of days to iterate over. ``stops`` are inclusive; no chunk passes its range.

    ``step`` is how far chunks are apart and ``width`` how long they are: frequencies such as ``1D``, ``7D`` or ``1MS``.
    Steps over the width leave gaps; steps under it overlap.
    """

    starts: tuple[str, ...]
    stops: tuple[str, ...]
    step: str = "1D"
    width: str = "1D"

    @classmethod
    def of(cls, start: str | Sequence[str], stop: str | Sequence[str], step: str = "1D", width: str = "1D") -> Bounds:
        starts, stops = ((start,), (stop,)) if isinstance(start, str) else (tuple(start), tuple(stop))
        if len(starts) != len(stops):
            raise ValueError("as many starts as stops are needed")
        if any(pd.Timestamp(a) > pd.Timestamp(b) for a, b in zip(starts, stops, strict=True)):
            raise ValueError("a range ends before it starts")
        return cls(starts, stops, step, width)

    def chunks(self) -> list[tuple[int, pd.Timestamp, pd.Timestamp]]:
        """``(chunk_id, start, end)``, the end exclusive."""
        width = pd.tseries.frequencies.to_offset(self.width)
        out = []
        for a, b in zip(self.starts, self.stops, strict=True):
            behind = pd.Timestamp(b) + pd.Timedelta(days=1)
            for t in pd.date_range(a, b, freq=self.step):
                if t + width <= behind:
                    out.append((len(out), t, t + width))
        return out

    @property
    def overlaps(self) -> bool:
        first = pd.Timestamp(self.starts[0])
        return first + pd.tseries.frequencies.to_offset(self.step) < first + pd.tseries.frequencies.to_offset(self.width)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, a.to_pydatetime(), b.to_pydatetime()) for i, a, b in self.chunks()]
        return spark.createDataFrame(rows, "chunk_id int, chunk_start timestamp_ntz, chunk_end timestamp_ntz")


def with_chunks(df: DataFrame, bounds: Bounds, time: str = "epoch", *, pad: str | None = None) -> DataFrame:
    """Rows of ``df`` with the chunks they lie in; a row in several overlapping chunks comes once for each.

    With ``pad`` (an interval such as ``5 minutes``) chunks reach that far beyond both ends, and ``in_chunk`` tells the
    rows of the chunk proper. Days link rows and chunks, so this is an equi-join whatever the number of chunks; the
    covered range is pushed to the scan.
    """
    spark = df.sparkSession
    chunks = bounds.chunks()
    if not chunks:
        return df.limit(0).select("*", F.lit(0).alias("chunk_id"), F.lit(None).cast("timestamp_ntz").alias("chunk_start"), F.lit(True).alias("in_chunk"))
    reach = F.expr(f"interval {pad or '0 seconds'}")
    t = bounds.table(spark).withColumns({"lo": F.col("chunk_start") - reach, "hi": F.col("chunk_end") + reach})
    days = t.select("*", F.explode(F.sequence(F.col("lo").cast("date"), (F.col("hi") - F.expr("interval 1 microsecond")).cast("date"), F.expr("interval 1 day"))).alias("__day"))
    if len(chunks) <= MAX_BROADCAST_CHUNKS:
        days = F.broadcast(days)
    low, high = min(c[1] for c in chunks), max(c[2] for c in chunks)
    wide = pd.Timedelta(pad) if pad else pd.Timedelta(0)
    near = df.where((F.col(time) >= F.lit((low - wide).to_pydatetime()).cast("timestamp_ntz")) & (F.col(time) < F.lit((high + wide).to_pydatetime()).cast("timestamp_ntz")))
    e = F.col(time)
    joined = near.withColumn("__day", e.cast("date")).join(days, "__day").where((e >= F.col("lo")) & (e < F.col("hi")))
    inside: Column = (e >= F.col("chunk_start")) & (e < F.col("chunk_end"))
    return joined.withColumn("in_chunk", inside).drop("__day", "lo", "hi", "chunk_end")


def periodic_mean(df: DataFrame, value: str, *keys: str, time: str = "epoch") -> DataFrame:
    """Mean of ``value`` without NaN in each group of ``keys``, with the group's first time."""
    known = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.min(time).alias("first_time"), F.avg(known).alias("mean"))
