"""File catalogs as tables: names parsed by a template, the latest version of each time, what is new or has changed."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FIELD = re.compile(r"\{(\w+)(?::(?:0?(\d+))?([ds]?))?\}")
_TIME = re.compile(r"\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?)?")


def is_time(text) -> bool:
    """Whether a text is a time rather than a file's name."""
    return _TIME.fullmatch(str(text)) is not None


@dataclass(frozen=True)
class Template:
    """A file name with fields such as ``{year:04d}`` between fixed text; ``?`` and ``*`` match any character or run.

    ``{name:s}`` is a text, anything else digits. With a ``delimiter`` names are blocks between its runs: fields need no width, and neither
    a field without one nor a ``*`` goes beyond its block, but for a ``*`` at the very end. With ``from_end`` anything may stand before the name.
    """

    text: str
    delimiter: str | None = None
    from_end: bool = False

    @property
    def fields(self) -> list[str]:
        return [m[1] for m in _FIELD.finditer(self.text)]

    @property
    def texts(self) -> set[str]:
        return {m[1] for m in _FIELD.finditer(self.text) if m[3] == "s"}

    @property
    def glob(self) -> str:
        """Each field as as many ``?`` as it is wide; a field without a width is a ValueError, but for names with a delimiter."""
        if self.delimiter is None and any(m[2] is None for m in _FIELD.finditer(self.text)):
            raise ValueError("every field needs a width, as in {day:03d}")
        return ("*" if self.from_end else "") + _FIELD.sub(lambda m: "?" * int(m[2]) if m[2] else "*", self.text)

    @property
    def regex(self) -> str:
        """One group for each field, in the order of their first places."""
        block = "." if self.delimiter is None else f"[^{re.escape(self.delimiter)}]"
        out, at, seen = "^.*" if self.from_end else "^", 0, set()
        for m in _FIELD.finditer(self.text):
            out += self._literal(self.text[at : m.start()], block)
            one = "\\d" if m[3] != "s" else block
            inner = one + (f"{{{int(m[2])}}}" if m[2] else "+")
            out += f"({inner})" if m[1] not in seen else inner
            seen.add(m[1])
            at = m.end()
        tail = self.text[at:]
        ends = tail.endswith("*")
        return out + self._literal(tail.removesuffix("*"), block) + (".*$" if ends else "$")

    def _literal(self, text: str, block: str) -> str:
        if self.delimiter is None:
            return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text)
        runs = f"(?:{re.escape(self.delimiter)})+"
        inner = lambda part: "".join(f"{block}*" if c == "*" else block if c == "?" else re.escape(c) for c in part)
        parts = re.split(runs, text)
        return runs.join(inner(p) for p in parts)

    def name(self, day: str, **fields: int | str) -> str:
        """The name of a file of a day (``yyyy-mm-dd``); ``fields`` are what the template names besides."""
        year, month, of_month = (int(x) for x in day.split("-"))
        of_year = date(year, month, of_month).timetuple().tm_yday
        known = {"year": year, "month": month, "day": of_month if "month" in self.fields else of_year, "hour": 0, "minute": 0, "second": 0}
        return self.text.format(**known | fields)


def parse_names(files: DataFrame, template: Template, name: str = "file_name", *, two_digit_year_break: int | None = None) -> DataFrame:
    """Adds ``file_time`` and the template's numbers and texts; names that do not fit or are no date go."""
    parsed = files.where(F.col(name).rlike(template.regex))
    groups = {f: i for i, f in enumerate(dict.fromkeys(template.fields), 1)}
    found = {f: F.regexp_extract(name, template.regex, i) for f, i in groups.items()}
    parsed = parsed.withColumns({f: c if f in template.texts else c.try_cast("int") for f, c in found.items()})
    for f in groups.keys() - template.texts:
        parsed = parsed.where(F.col(f).isNotNull())
    if two_digit_year_break is not None and "year" in groups:
        parsed = parsed.withColumn("year", F.col("year") + F.when(F.col("year") >= two_digit_year_break, 1900).otherwise(2000))
    part = lambda f, default: F.col(f) if f in groups else F.lit(default)
    if "month" in groups or "day" not in groups:
        at = F.try_make_timestamp_ntz(part("year", 1970), part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), part("second", 0))
    else:  # the day counts from the start of the year
        first = F.try_make_timestamp_ntz(part("year", 1970), F.lit(1), F.lit(1), part("hour", 0), part("minute", 0), part("second", 0))
        at = F.when(F.col("day").between(1, 366), F.timestamp_add("DAY", F.col("day") - 1, first))
    return parsed.withColumn("file_time", at).where("file_time is not null")


def latest_versions(files: DataFrame, *keys: str) -> DataFrame:
    """One file per time: the one with the highest version, then revision, then cycle, then name; all where none is parsed."""
    if not {"version", "revision", "cycle"} & set(files.columns):
        return files
    ranked = [F.desc(c) for c in ("version", "revision", "cycle") if c in files.columns]
    w = Window.partitionBy(*keys, "file_time").orderBy(*ranked, F.desc("file_name"))
    return files.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def first_of_each_time(files: DataFrame, *keys: str) -> DataFrame:
    """One file per time: the first by name."""
    return files.groupBy(*keys, "file_time").agg(F.min("file_name").alias("file_name"))


def unique_times(files: DataFrame, *keys: str) -> bool:
    """Whether every time has one file only; files without a time do not count."""
    return files.where("file_time IS NOT NULL").groupBy(*keys, "file_time").count().where("count > 1").isEmpty()


def without_folder(files: DataFrame, folder: str, name: str = "file_name") -> DataFrame:
    """Names without a leading folder; others stay."""
    lead = folder.rstrip("/") + "/"
    return files.withColumn(name, F.when(F.startswith(name, F.lit(lead)), F.substr(F.col(name), F.lit(len(lead) + 1))).otherwise(F.col(name)))


def listed_range(files: DataFrame, listing: str, *keys: str) -> DataFrame:
    """``first_time`` and ``last_time`` as a list has them: the times of its first and last file by ``listing``, whatever lies between."""
    timed = F.struct(listing, "file_time")
    ends = files.where("file_time IS NOT NULL").groupBy(*keys).agg(F.min(timed).alias("a"), F.max(timed).alias("b"))
    return ends.select(*keys, F.col("a.file_time").alias("first_time"), F.col("b.file_time").alias("last_time"))


def made_up(spark: SparkSession, template: Template, start: str, stop: str, cadence: str = "1 day", shift: str = "0 seconds") -> DataFrame:
    """The catalog of an archive that is whole from ``start`` to ``stop``: a file for every time, named by the template; ``shift`` moves the times, not the names."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"interval {cadence}"))).alias("t"))
    parts = {"year": F.year("t"), "month": F.month("t"), "day": F.dayofmonth("t") if "month" in template.fields else F.dayofyear("t"), "hour": F.hour("t"), "minute": F.minute("t"), "second": F.second("t").cast("int")}
    pattern = _FIELD.sub(lambda m: f"%0{int(m[2] or 1)}d", template.text.replace("%", "%%"))
    name = F.format_string(pattern, *[parts.get(f, F.lit(1)) for f in template.fields])
    return days.select(name.alias("file_name"), (F.col("t") + F.expr(f"interval {shift}")).alias("file_time"))


def daily(files: DataFrame, cadence: str) -> DataFrame:
    """One row per file and day until the next file is due; the row's name carries the day."""
    day = F.explode(F.sequence(F.col("file_time"), F.col("file_time") + F.expr(f"interval {cadence}") - F.expr("interval 1 day"), F.expr("interval 1 day")))
    out = files.withColumn("__day", day)
    return out.withColumns({"file_name": F.concat_ws("_", "file_name", F.date_format("__day", "yyyy-MM-dd")), "file_time": F.col("__day")}).drop("__day")


def in_range(files: DataFrame, start: str, stop: str, *, inclusive: bool = False) -> DataFrame:
    """Files by time: the stop is excluded for dates and included for file names."""
    t, hi = F.col("file_time"), F.lit(stop).cast("timestamp_ntz")
    return files.where((t >= F.lit(start).cast("timestamp_ntz")) & ((t <= hi) if inclusive else (t < hi)))


def new_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose names the previous snapshot lacks."""
    return current.join(previous.select("file_name"), "file_name", "left_anti")


def to_download(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Times that only the remote list has, or whose names differ."""
    mine = local.select("file_time", F.col("file_name").alias("__mine"))
    joined = remote.join(mine, "file_time", "left")
    return joined.where(F.col("__mine").isNull() | (F.col("__mine") != F.col("file_name"))).select("file_time", "file_name").distinct()


def missing_days(files: DataFrame, *keys: str, time: str = "file_time") -> DataFrame:
    """Days between the first and the last file of each key that have none; one row per key and day is compared, not files."""
    held = files.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("date").alias("day")).distinct()
    follows = Window.partitionBy(*keys).orderBy("day") if keys else Window.partitionBy(F.lit(0)).orderBy("day")
    gaps = held.select(*keys, "day", F.lead("day").over(follows).alias("__next")).where(F.datediff("__next", "day") > 1)
    return gaps.select(*keys, F.explode(F.sequence(F.date_add("day", 1), F.date_sub("__next", 1))).alias("day"))


def list_files(spark: SparkSession, path: str, template: Template, *, two_digit_year_break: int | None = None) -> DataFrame:
    """Names, sizes and times of files under ``path`` that fit the template, without their content; empty files go."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", template.glob).load(path)
    base = F.element_at(F.split("path", "/"), -1)
    rows = found.select(base.alias("file_name"), F.col("path").alias("data_path"), "length", F.col("modificationTime").alias("modified")).where("length > 0")
    return parse_names(rows, template, two_digit_year_break=two_digit_year_break)


def position(files: DataFrame, file_name: Column | str) -> DataFrame:
    """The place of each row of a name in the catalog's order of time and name: how many rows come before it, counted where they are.
    Files without a time come first.

    A name held at several times has a place for each; rows alike in time and name have one place, that of the first of them.
    """
    asked = files.where(F.col("file_name") == file_name)
    key = F.struct("file_time", "file_name")
    places = asked.select(key.alias("__at")).distinct()
    before = files.select(key.alias("__f")).join(F.broadcast(places), F.col("__f") < F.col("__at")).groupBy("__at").agg(F.count("*").alias("position"))
    counted = asked.withColumn("__at", key).join(F.broadcast(before), "__at", "left")
    return counted.select(*files.columns, F.coalesce("position", F.lit(0)).cast("long").alias("position"))


def between_names(files: DataFrame, spans: Sequence[tuple[str, str]]) -> DataFrame:
    """Files from one name to another, both included, in the catalog's order of time and name, for each of ``spans``.

    ``span`` (from 0) tells which one a file is of; a file in several spans comes once for each. A span with a name that
    the catalog lacks, or with its ends turned round, is empty. Only the spans are broadcast.
    """
    asked = files.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(spans)], "span int, __first string, __last string")
    key = F.struct("file_time", "file_name")
    ends = files.select(F.col("file_name").alias("__name"), key.alias("__key"))
    low = ends.join(F.broadcast(asked), F.col("__name") == F.col("__first")).groupBy("span").agg(F.min("__key").alias("__low"))
    high = ends.join(F.broadcast(asked), F.col("__name") == F.col("__last")).groupBy("span").agg(F.max("__key").alias("__high"))
    found = files.join(F.broadcast(low.join(high, "span")), (key >= F.col("__low")) & (key <= F.col("__high")))
    return found.select(*files.columns, "span")


def store_snapshot(files: DataFrame, path: str) -> int:
    """Writes the catalog as the next snapshot under ``path``, beside all earlier ones; gives its number, from 1 on."""
    number = 1 + _last_snapshot(files.sparkSession, path)
    files.write.mode("overwrite").parquet(f"{path}/snapshot_id={number}")
    return number


def load_snapshot(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The latest snapshot under ``path``, or the one ``back`` before it; a LookupError where there is none."""
    number = _last_snapshot(spark, path) - back
    if number < 1:
        raise LookupError(f"no such snapshot under {path}")
    return spark.read.parquet(f"{path}/snapshot_id={number}")


def _last_snapshot(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot_id=*/_SUCCESS")
    stored = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    return max((int(f.getPath().getParent().getName().partition("=")[2]) for f in stored), default=0)


def first_and_last(files: DataFrame) -> DataFrame:
    """One row: the times of the first and last file and how many there are; null times in an empty catalog."""
    return files.agg(F.min("file_time").alias("first_time"), F.max("file_time").alias("last_time"), F.count("*").alias("n"))
