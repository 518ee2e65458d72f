"""A Spark session with the settings the library counts on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(app: str = "skyframe", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, NTZ timestamps; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; a temporary one where it is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="skyframe-"))
    return _local[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which goes when the interpreter ends."""
    at = f"{shared_dir(spark)}/skyframe-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, at)
    return at


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values become NULL, so comparisons are false and aggregates skip them."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name, metadata=f.metadata) if is_floating(f.dataType) else F.col(f.name) for f in df.schema])


def null_to_nan(df: DataFrame) -> DataFrame:
    """The inverse, for sinks whose missing value is NaN."""
    return df.select(*[F.coalesce(f.name, F.lit(float("nan")).cast(f.dataType)).alias(f.name, metadata=f.metadata) if is_floating(f.dataType) else F.col(f.name) for f in df.schema])


def known(c: Column) -> Column:
    """A floating value without NaN."""
    return F.when(~F.isnan(c), c)
