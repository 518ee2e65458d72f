"""The same operators on streams: chunk aggregates, sessions and replacement of re-issued files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.session import scratch


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need a time with a zone; the session's zone is UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def _span(column: str) -> list:
    return [F.col(f"{column}.{k}").cast("timestamp_ntz").alias(k) for k in ("start", "end")]


def chunk_means(stream: DataFrame, value: str, *keys: str, width: str = "1 day", step: str | None = None, time: str = "epoch", late: str = "1 hour", start: str | None = None) -> DataFrame:
    """Mean and count of ``value`` per chunk of time; chunks close when ``late`` has passed behind their end.

    Chunks are counted from ``start``, as those of bounds are; without it from 1970.
    """
    known = F.when(~F.isnan(value), F.col(value))
    every = step or width
    offset = pd.Timestamp(start or 0) - pd.Timestamp(0)
    window = F.window(time, width, every, f"{(offset % pd.Timedelta(every)) // pd.Timedelta(microseconds=1)} microseconds")
    grouped = timed(stream, time, late).groupBy(window.alias("chunk"), *keys)
    return grouped.agg(F.avg(known).alias("mean"), F.count(known).alias("n")).select(*_span("chunk"), *keys, "mean", "n")


def gap_session_counts(stream: DataFrame, gap: str, *keys: str, time: str = "epoch", late: str = "1 hour") -> DataFrame:
    """Sessions that end with a gap of ``gap`` in time."""
    grouped = timed(stream, time, late).groupBy(F.session_window(time, gap).alias("session"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(*_span("session"), *keys, "n")


def distinct_times(stream: DataFrame, *keys: str, time: str = "epoch", late: str = "1 hour") -> DataFrame:
    """The first row of each time and key that arrives within the watermark."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark([*keys, time])


def newest_only(batch: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """For foreachBatch: of a catalog and a batch of files, the highest version of each time."""
    both = batch if current is None else current.unionByName(batch, allowMissingColumns=True)
    ranked = [F.desc(c) for c in ("version", "revision", "cycle") if c in both.columns]
    w = Window.partitionBy("file_time").orderBy(*ranked, F.desc("file_name"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def run_once(result: DataFrame, name: str, mode: str = "append", *, stateful: bool = False) -> DataFrame:
    """Runs a stream over what its source has now into Parquet files, in the folder that ``spark.checkpoint.dir`` names.

    A complete result is written anew with each batch; a source without data gives an empty table. ``stateful`` streams keep their state in
    RocksDB. Each run begins anew, in a folder of its own that goes with the session; one that goes on from run to run is a
    :class:`skyframe.streaming.ingest.Follower`. Where the setting is unset and Spark is local, a temporary folder serves.
    """
    spark = result.sparkSession
    at = scratch(spark, f"stream-{name}")

    def written(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes the same folder
        batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

    setting, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    if stateful:
        spark.conf.set(setting, store)
    try:
        q = result.writeStream.foreachBatch(written).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    finally:
        if stateful:
            spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    q.awaitTermination()
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/out")
    if not out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out):
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{at}/out").select(*result.columns)
