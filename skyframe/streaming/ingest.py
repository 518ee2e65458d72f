"""An archive followed as a stream: files are read once as they come, and a later version of a time takes the place of the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators import files
from skyframe.sources.archive import Archive
from skyframe.streaming.windows import newest_only

_PART = "file_key"


@dataclass(frozen=True)
class Follower:
    """Keeps the rows of an archive's latest files in a table under ``at``, which driver and executors share.

    Each run takes the files that are new by path since the last one. The highest version of a time (then revision, cycle, name) holds its part of
    the table; older ones that come late change nothing. A batch compares its files with the catalog left by the batch before it, and overwrites just the parts of
    the table that it wins, so a batch that is run again after a failure leaves the same table. Files without rows are not seen; a file written anew under its
    old name is not either: it needs a version.
    """

    archive: Archive
    at: str

    def run(self, spark: SparkSession) -> None:
        """Takes in what has come; without a folder, or without new files, nothing changes."""
        for folder in self.archive.folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                break
        else:
            return
        if not self.archive.schema:
            raise ValueError("a stream of files needs a schema")
        reader = spark.readStream.format(self.archive.format).schema(self.archive.schema).options(**self.archive.options).option("pathGlobFilter", self.archive.template.glob)
        arrived = reader.load(folder)
        arrived = arrived.select(*arrived.columns, "_metadata.file_name")
        q = arrived.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    def _take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = files.parse_names(batch.select("file_name").distinct(), self.archive.template, two_digit_year_break=self.archive.two_digit_year_break)
        held = self._catalog(spark, number)
        came = names.withColumn("batch", F.lit(number).cast("long"))
        best = newest_only(came, held)
        best.coalesce(1).write.mode("overwrite").parquet(f"{self.at}/catalog/{number:012d}")
        won = spark.read.schema(best.schema).parquet(f"{self.at}/catalog/{number:012d}").where(F.col("batch") == number)
        rows = batch.join(F.broadcast(won.select("file_name", F.date_format("file_time", "yyyyMMddHHmmss").alias(_PART))), "file_name")
        rows.repartition(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(f"{self.at}/rows")

    def _catalog(self, spark: SparkSession, before: int) -> DataFrame | None:
        """The catalog that the batches before ``before`` left."""
        jvm = spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.at}/catalog/*/_SUCCESS")
        stored = [int(f.getPath().getParent().getName()) for f in found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []]
        earlier = [n for n in stored if n < before]
        return spark.read.parquet(f"{self.at}/catalog/{max(earlier):012d}") if earlier else None

    def catalog(self, spark: SparkSession) -> DataFrame:
        """``file_time``, ``file_name``, what the template parses and the batch of the files that hold the table; none before the first run."""
        held = self._catalog(spark, 1 << 62)
        if held is None:
            nothing = files.parse_names(spark.createDataFrame([], "file_name string"), self.archive.template)
            return nothing.withColumn("batch", F.lit(0).cast("long"))
        return held

    def rows(self, spark: SparkSession) -> DataFrame:
        """The rows of the latest files, with ``file_name``."""
        empty = spark.createDataFrame([], self.archive.schema).withColumn("file_name", F.lit("").cast("string"))
        if self._catalog(spark, 1 << 62) is None:
            return empty
        return spark.read.schema(empty.schema).parquet(f"{self.at}/rows").select(*empty.columns)
