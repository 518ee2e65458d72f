"""Archives: folders of files named by a template, their catalog, and loads that read the chosen files only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators import blocks, files
from skyframe.session import scratch

#: Files that one join may broadcast; more are joined as Spark sees fit.
MAX_BROADCAST_FILES = 100_000


def _ntz(t) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


@dataclass(frozen=True)
class Archive:
    """Where an instrument's files lie and how they are named and read.

    ``folders`` are tried in order, the first with a file that fits serves. ``schema`` is DDL; without it Spark infers it from the files. A file
    holds the rows of ``[file_time, file_time + cadence)``, or of ``slack`` more on both sides where days run over into their neighbours' files.
    ``format`` is any that Spark reads; ``options`` go to the reader and the writer.
    """

    folders: tuple[str, ...]
    template: files.Template
    format: str = "parquet"
    schema: str | None = None
    options: dict = field(default_factory=dict)
    cadence: str = "1 day"
    slack: str = "0 seconds"
    time: str = "epoch"
    two_digit_year_break: int | None = None

    def refresh(self, spark: SparkSession, snapshots: str | None = None) -> Catalog:
        """Lists the files as they are now: the latest version of each time, numbered from 0 by time and name.

        The catalog is written once, as the next snapshot under ``snapshots`` or in the shared folder, so folders are not listed again later.
        """
        found = None
        for folder in self.folders:
            listed = files.list_files(spark, folder, self.template, two_digit_year_break=self.two_digit_year_break) if _exists(spark, folder) else None
            if listed is not None and not listed.isEmpty():
                found = files.latest_versions(listed)
                break
        if found is None:
            found = files.parse_names(spark.createDataFrame([], "file_name string, data_path string, length long, modified timestamp"), self.template)
        days = blocks.keyed(found, (), "file_time")
        counts = days.groupBy(blocks.KEY, blocks.DAY).agg(F.count(F.lit(1)).alias("n"))
        table = blocks.numbered(days, ["file_time", "file_name"], counts).withColumn("file_number", F.col(blocks.RANK).cast("long")).drop(blocks.KEY, blocks.DAY, blocks.RANK)
        at = snapshots or scratch(spark, "catalog")
        files.store_snapshot(table.coalesce(1), at)
        return Catalog(self, files.load_snapshot(spark, at))

    def write(self, df: DataFrame, *, folder: str | None = None, **fields: int) -> None:
        """Writes ``df`` as a file for each day, named by the template, over files of the same name; ``fields`` such as a version name further numbers.

        Days are written side by side, each in one task; the driver renames the files. A day's file is there as a whole or not at all.
        """
        spark, target = df.sparkSession, folder or self.folders[0]
        part, behind = f"{target}/.new-{uuid.uuid4().hex[:12]}", "__day"
        dealt = df.withColumn(behind, F.col(self.time).cast("date")).repartition(behind).sortWithinPartitions(behind, self.time)
        dealt.write.format(self.format).options(**self.options).partitionBy(behind).save(part)
        fs, path = _fs(spark, part)
        for status in fs.globStatus(path(f"{part}/{behind}=*/part-*")) or []:
            old = status.getPath()
            new = path(f"{target}/{self.template.name(old.getParent().getName().partition('=')[2], **fields)}")
            if fs.exists(new):
                fs.delete(new, False)
            fs.mkdirs(new.getParent())
            fs.rename(old, new)
        fs.delete(path(part), True)


@dataclass(frozen=True)
class Catalog:
    """The files of an archive at one time: ``file_number``, ``file_time``, ``file_name``, ``data_path`` and what the template parses."""

    archive: Archive
    table: DataFrame

    def number(self, name: str) -> int:
        """The place of a file by name, from 0; a ValueError where the catalog has none or several."""
        found = self.table.where(F.col("file_name") == name).select("file_number").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{name} names {len(found) or 'no'} files" if not found else f"{name} names several files")
        return found[0][0]

    def __len__(self) -> int:
        return self.table.count()

    def __getitem__(self, which: int | str | slice) -> DataFrame:
        """Files by number, name or time, or slices of these: numbers leave the end out, names and times (``yyyy-mm-dd``) as in loads.

        Negative numbers count from the end; a number or name that is not there is an IndexError or ValueError.
        """
        if isinstance(which, slice):
            a, b = which.start, which.stop
            if all(x is None or isinstance(x, int) for x in (a, b)):
                i, j, step = which.indices(len(self))
                if step < 1:
                    raise ValueError("slices go forward")
                return self.between(i, j - 1).where((F.col("file_number") - i) % step == 0)
            if all(x is None or files.is_time(x) for x in (a, b)):
                return self.table.where(F.lit(True) if a is None else F.col("file_time") >= _ntz(a)).where(F.lit(True) if b is None else F.col("file_time") < _ntz(b))
            return self.between(0 if a is None else self.number(a), len(self) - 1 if b is None else self.number(b))
        if isinstance(which, int):
            n = len(self)
            if not -n <= which < n:
                raise IndexError(f"there is no file {which} among {n}")
            return self.between(which % n, which % n)
        return self.table.where(F.col("file_time") == _ntz(which)) if files.is_time(which) else self.between(*[self.number(which)] * 2)

    def between(self, first: int, last: int) -> DataFrame:
        return self.table.where(F.col("file_number").between(first, last))

    def over(self, start: str | None, stop: str | None, reach: str | None = None) -> DataFrame:
        """Files that may hold rows of ``[start, stop)``, or of ``reach`` more on both sides."""
        more = F.expr(f"interval {self.archive.slack}"), F.expr(f"interval {reach or '0 seconds'}")
        chosen = self.table
        if start is not None:
            chosen = chosen.where(F.col("file_time") + F.expr(f"interval {self.archive.cadence}") + more[0] > _ntz(start) - more[1])
        if stop is not None:
            chosen = chosen.where(F.col("file_time") - more[0] < _ntz(stop) + more[1])
        return chosen

    def span(self, first: int, last: int) -> tuple[str, str]:
        """The times that files ``first`` to ``last`` are of, the end excluded."""
        ends = self.between(first, last).agg(F.min("file_time"), F.max(F.col("file_time") + F.expr(f"interval {self.archive.cadence}"))).first()
        return str(ends[0]), str(ends[1])

    def read(self, chosen: DataFrame | None = None) -> DataFrame:
        """The rows of the chosen files (all without), with ``file_name`` and ``file_number``; no other file is opened.

        The driver learns the paths of the chosen files, as Spark does of any files that it reads. Without files there are no rows.
        """
        spark, archive = self.table.sparkSession, self.archive
        chosen = (self.table if chosen is None else chosen).select("file_name", "file_number", "data_path")
        paths = [r[0] for r in chosen.select("data_path").orderBy("file_number").collect()]
        reader = spark.read.format(archive.format).options(**archive.options)
        if archive.schema:
            reader = reader.schema(archive.schema)
        if not paths:
            if not archive.schema:
                raise ValueError("without files an archive needs a schema")
            return spark.createDataFrame([], archive.schema).select("*", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("long").alias("file_number"))
        rows = reader.load(paths)
        rows = rows.select(*rows.columns, "_metadata.file_name")
        names = chosen.select("file_name", "file_number")
        return rows.join(F.broadcast(names) if len(paths) <= MAX_BROADCAST_FILES else names, "file_name").select(*[c for c in rows.columns if c != "file_name"], "file_name", "file_number")


@dataclass(frozen=True)
class FileBounds:
    """Ranges of files to iterate over, by name; None is the first or the last file. Chunks are ``width`` files, ``step`` files apart.

    Stops are inclusive; no chunk passes its range.
    """

    starts: tuple[str | None, ...]
    stops: tuple[str | None, ...]
    step: int = 1
    width: int = 1

    @classmethod
    def of(cls, start: str | None | Sequence[str] = None, stop: str | None | Sequence[str] = None, step: int = 1, width: int = 1) -> FileBounds:
        starts, stops = (tuple(x) if isinstance(x, (list, tuple)) else (x,) for x in (start, stop))
        if len(starts) != len(stops):
            raise ValueError("as many starts as stops are needed")
        if step < 1 or width < 1:
            raise ValueError("steps and widths are one file or more")
        return cls(starts, stops, step, width)

    def chunks(self, catalog: Catalog) -> list[tuple[int, int, int]]:
        """``(chunk_id, first file, last file)`` by number."""
        out: list[tuple[int, int, int]] = []
        n = len(catalog)
        for a, b in zip(self.starts, self.stops, strict=True):
            first, last = 0 if a is None else catalog.number(a), n - 1 if b is None else catalog.number(b)
            if last < first and n:
                raise ValueError(f"{a} comes after {b}")
            out += [(len(out) + k, i, i + self.width - 1) for k, i in enumerate(range(first, last - self.width + 2, self.step))]
        return out


def _fs(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, at: str) -> bool:
    fs, path = _fs(spark, at)
    return fs.exists(path(at))
