"""Instruments and constellations: named sources with a declarative load pipeline, all of it lazy."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.time import least_step
from skyframe.meta import Meta, default_fill
from skyframe.operators import align, chunks
from skyframe.sources.archive import Catalog, FileBounds

# Fixed values, from the strictest on; "none" cleans nothing.
CLEAN_LEVELS = ("clean", "dusty", "dirty", "none")
INTERPOLATING = ("linear", "zero", "slinear", "quadratic", "cubic", "polynomial")
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Instrument:
    """A source of rows with an ``epoch``: how it is read, prepared, cleaned and changed on loading.

    ``read(spark)`` gives all rows lazily; selections reach its scan as filters. With a ``catalog`` instead, selections choose files,
    and no other file is opened. ``clean`` maps each level to conditions that good rows meet. Steps take and return a DataFrame. ``process_meta`` changes the labels of what is loaded.
    """

    platform: str
    name: str
    read: Callable[[SparkSession], DataFrame] | None = None
    tag: str = ""
    inst_id: str = ""
    preprocess: Step | None = None
    clean: dict[str, Sequence[Column]] = field(default_factory=dict)
    clean_level: str = "clean"
    pad: str | None = None
    custom: tuple[tuple[Callable, tuple, dict], ...] = ()
    meta: Meta = field(default_factory=Meta)
    catalog: Catalog | None = None
    process_meta: Callable[[Meta], Meta] | None = None

    def __post_init__(self):
        if self.clean_level not in CLEAN_LEVELS:
            raise ValueError(f"clean_level is one of {CLEAN_LEVELS}")
        if (self.read is None) == (self.catalog is None):
            raise ValueError("an instrument has either a source to read or a catalog of files")

    @property
    def key(self) -> str:
        return "_".join(x.lower() for x in (self.platform, self.name, self.tag, self.inst_id) if x)

    def attach(self, function: Callable, *args, at: int | str = "end", **kwargs) -> Instrument:
        """A copy whose load also runs ``function(df, *args, **kwargs)``, at the end or at a place in the queue.

        A function with a parameter ``chunk`` gets the names of the columns that tell chunks apart: none when one range is loaded, ``chunk_id``
        when chunks are iterated over. One that looks at neighbours partitions its windows by them, and so sees no row of another chunk.
        """
        queue = list(self.custom)
        queue.insert(len(queue) if at == "end" else int(at), (function, args, kwargs))
        return replace(self, custom=tuple(queue))

    def attach_pandas(self, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *keys: str, at: int | str = "end") -> Instrument:
        """A copy whose load also runs ``function`` on each chunk, or on what each of ``keys`` has in it, in order of time and as a whole.

        ``function`` takes and gives a pandas DataFrame with an epoch; ``schema`` (DDL) is what it gives. Rows that keep their index stay rows of the
        chunk or of its pad, new ones belong to the chunk. A chunk, or a key's part of it, has to fit into a task.
        """

        def per_chunk(df: DataFrame, chunk: tuple[str, ...] = ()) -> DataFrame:
            marks = [c for c in chunks.MARKS if c in df.columns]

            def run(whole: pd.DataFrame) -> pd.DataFrame:
                whole = whole.sort_values("epoch", kind="stable").reset_index(drop=True)
                out = function(whole.drop(columns=marks))
                for m in marks:
                    out[m] = whole[m].reindex(out.index).fillna(True).astype(bool) if m == "in_chunk" else whole[m].iloc[0]
                return out

            kinds = "".join(f", {m} {df.schema[m].dataType.simpleString()}" for m in marks)
            return df.groupBy(*chunk, *keys).applyInPandas(run, schema + kinds)

        return self.attach(per_chunk, at=at)

    def cleared(self) -> Instrument:
        return replace(self, custom=())

    def load(
        self, spark: SparkSession, start: str | None = None, stop: str | None = None, *, columns: Sequence[str] | None = None, keep_pad: bool = False,
        yr: int | None = None, doy: int | None = None, end_yr: int | None = None, end_doy: int | None = None, fname: str | None = None, stop_fname: str | None = None,
    ) -> DataFrame:
        """Rows with ``start <= epoch < stop`` (all without them), prepared, cleaned and changed.

        Instead of times, ``yr`` and ``doy`` select a day, and with ``end_yr`` and ``end_doy`` the days up to that one, which
        is left out; ``fname`` selects a file of the catalog, and with ``stop_fname`` the files up to that one, which is included. Only one way to select may be used.
        With a pad the steps see rows that far beyond both ends, from the files beside the chosen ones as well; these go afterwards unless ``keep_pad``.
        """
        ways = [start is not None or stop is not None, any(x is not None for x in (yr, doy, end_yr, end_doy)), fname is not None or stop_fname is not None]
        if sum(ways) > 1:
            raise ValueError("select by times, by years and days or by files, not by several of these")
        if ways[1]:
            start, stop = _days(yr, doy, end_yr, end_doy)
        if ways[2]:
            return self._of_files(spark, *self._numbers(fname, stop_fname), columns, keep_pad)
        if self.pad and (start is None or stop is None):
            raise ValueError("a pad needs a range")
        df = self._cleaned(self._between(spark, start, stop))
        df = self._changed(df, ())
        if self.pad and not keep_pad:
            df = df.where((F.col("epoch") >= F.lit(start).cast("timestamp_ntz")) & (F.col("epoch") < F.lit(stop).cast("timestamp_ntz")))
        return self._labelled(df.select(*columns) if columns else df)

    def _numbers(self, fname: str | None, stop_fname: str | None) -> tuple[int, int]:
        if fname is None:
            raise ValueError("a last file needs a first one")
        if self.catalog is None:
            raise ValueError("without a catalog there are no files to choose")
        first = self.catalog.number(fname)
        last = first if stop_fname is None else self.catalog.number(stop_fname)
        if last < first:
            raise ValueError(f"{stop_fname} comes before {fname}")
        return first, last

    def _of_files(self, spark: SparkSession, first: int, last: int, columns: Sequence[str] | None = None, keep_pad: bool = False) -> DataFrame:
        """The rows of files ``first`` to ``last``; with a pad these are the rows of the times that the files are of."""
        if self.pad:
            return self.load(spark, *self.catalog.span(first, last), columns=columns, keep_pad=keep_pad)
        df = self._changed(self._cleaned(self._plain(self.catalog.read(self.catalog.between(first, last)))), ())
        return self._labelled(df.select(*columns) if columns else df)

    @staticmethod
    def _plain(df: DataFrame) -> DataFrame:
        return df.drop("file_name", "file_number")

    def _between(self, spark: SparkSession, start: str | None, stop: str | None) -> DataFrame:
        """The source's rows of a range and its pad."""
        df = self.read(spark) if self.catalog is None else self._plain(self.catalog.read(self.catalog.over(start, stop, self.pad)))
        reach = F.expr(f"interval {self.pad or '0 seconds'}")
        if start is not None:
            df = df.where(F.col("epoch") >= F.lit(start).cast("timestamp_ntz") - reach)
        if stop is not None:
            df = df.where(F.col("epoch") < F.lit(stop).cast("timestamp_ntz") + reach)
        return df

    def _cleaned(self, df: DataFrame) -> DataFrame:
        if self.preprocess:
            df = self._checked(self.preprocess(df), "preprocess")
        if self.clean_level != "none":
            for level in CLEAN_LEVELS[CLEAN_LEVELS.index(self.clean_level) : 3]:
                for good in self.clean.get(level, ()):
                    df = df.where(good)
        return df

    def _labelled(self, df: DataFrame) -> DataFrame:
        """``df`` with its own labels, then the instrument's, then what ``process_meta`` makes of both."""
        if self.process_meta is None:
            return self.meta.attach(df)
        meta = self.process_meta(Meta.of(df).concat(self.meta))
        if not isinstance(meta, Meta):
            raise ValueError("process_meta must return a Meta")
        return meta.attach(df)

    def _changed(self, df: DataFrame, chunk: tuple[str, ...]) -> DataFrame:
        for function, args, kwargs in self.custom:
            asks = "chunk" in inspect.signature(function).parameters
            df = self._checked(function(df, *args, **kwargs, **({"chunk": chunk} if asks else {})), getattr(function, "__name__", "custom"))
        return df

    @staticmethod
    def _checked(out, name: str) -> DataFrame:
        if not isinstance(out, DataFrame):
            raise ValueError(f"{name} must return a DataFrame")
        return out

    def iterate(self, spark: SparkSession, bounds: chunks.Bounds | FileBounds, *, keep_pad: bool = False) -> DataFrame:
        """All chunks at once: rows with a ``chunk_id``. This, with a groupBy, is the loop over chunks.

        With a pad every chunk has its own copies of the rows that far beyond its ends while the steps run; these go afterwards unless
        ``keep_pad``, where ``in_chunk`` is false for them. Steps are told of chunks as :meth:`attach` says. Chunks of files have
        the rows of their files, whatever their times; their pad is of the times before the first and behind the last file.
        """
        if isinstance(bounds, FileBounds):
            if self.catalog is None:
                raise ValueError("without a catalog there are no files to iterate over")
            df = self._file_chunks(spark, bounds.chunks(self.catalog))
        else:
            ranges = bounds.chunks()
            low, high = (min((a for _, a, _ in ranges), default="1970-01-01"), max((b for _, _, b in ranges), default="1970-01-01"))
            df = chunks.with_chunks(self._cleaned(self._between(spark, str(low), str(high))), bounds, pad=self.pad)
        df = self._changed(df, ("chunk_id",))
        return self._labelled(df if keep_pad else df.where("in_chunk"))

    def _file_chunks(self, spark: SparkSession, chosen: list[tuple[int, int, int]]) -> DataFrame:
        files = self.catalog
        pairs = spark.createDataFrame([(k, n) for k, i, j in chosen for n in range(i, j + 1)], "chunk_id int, file_number long")
        times = files.table.select("file_number", "file_time", (F.col("file_time") + F.expr(f"interval {files.archive.cadence}")).alias("behind"))
        spans = pairs.join(times, "file_number").groupBy("chunk_id").agg(F.min("file_time").alias("chunk_start"), F.max("behind").alias("chunk_end"))
        pairs = pairs.join(spans, "chunk_id")
        few = len(chosen) <= chunks.MAX_BROADCAST_CHUNKS
        low, high = (min((i for _, i, _ in chosen), default=0), max((j for _, _, j in chosen), default=-1))
        wanted = files.between(low, high)
        if self.pad and chosen:
            wanted = files.over(*files.span(low, high), self.pad)
        else:
            wanted = wanted.join(F.broadcast(pairs.select("file_number").distinct()) if few else pairs.select("file_number").distinct(), "file_number", "left_semi")
        rows = self._cleaned(files.read(wanted))
        own = rows.join(F.broadcast(pairs) if few else pairs, "file_number").withColumn("in_chunk", F.lit(True))
        kept = [*self._plain(rows).columns, "chunk_id", "chunk_start", "in_chunk"]
        if not self.pad or not chosen:
            return own.select(*kept)
        reach = F.expr(f"interval {self.pad}")
        edges = spans.withColumn("edge", F.explode(F.array(F.struct((F.col("chunk_start") - reach).alias("lo"), F.col("chunk_start").alias("hi")), F.struct(F.col("chunk_end").alias("lo"), (F.col("chunk_end") + reach).alias("hi")))))
        edges = edges.join(spark.createDataFrame([(k, i, j) for k, i, j in chosen], "chunk_id int, first long, last long"), "chunk_id")
        days = edges.select("*", F.explode(F.sequence(F.col("edge.lo").cast("date"), (F.col("edge.hi") - F.expr("interval 1 microsecond")).cast("date"), F.expr("interval 1 day"))).alias("__day"))
        e = F.col("epoch")
        near = rows.withColumn("__day", e.cast("date")).join(F.broadcast(days) if few else days, "__day")
        near = near.where((e >= F.col("edge.lo")) & (e < F.col("edge.hi")) & ~F.col("file_number").between(F.col("first"), F.col("last"))).withColumn("in_chunk", F.lit(False))
        return own.select(*kept).unionByName(near.select(*kept))


def _days(yr: int | None, doy: int | None, end_yr: int | None, end_doy: int | None) -> tuple[str, str]:
    if yr is None or doy is None or (end_yr is None) != (end_doy is None):
        raise ValueError("a day is a year and a day of the year")

    def day(y: int, d: int) -> pd.Timestamp:
        at = pd.Timestamp(int(y), 1, 1) + pd.Timedelta(days=int(d) - 1)
        if at.year != y:
            raise ValueError(f"year {y} has no day {d}")
        return at

    first = day(yr, doy)
    behind = first + pd.Timedelta(days=1) if end_yr is None else day(end_yr, end_doy)
    if behind <= first:
        raise ValueError("a range ends before it starts")
    return str(first), str(behind)


@dataclass(frozen=True)
class Cursor:
    """One chunk of an instrument's bounds, and the ones before and after it. At ``None`` no chunk is loaded yet."""

    instrument: Instrument
    bounds: chunks.Bounds | FileBounds
    at: int | None = None

    def _chunks(self) -> list[tuple]:
        return self.bounds.chunks(self.instrument.catalog) if isinstance(self.bounds, FileBounds) else self.bounds.chunks()

    def next(self) -> Cursor:
        return self._moved(0 if self.at is None else self.at + 1)

    def prev(self) -> Cursor:
        return self._moved(len(self._chunks()) - 1 if self.at is None else self.at - 1)

    def _moved(self, at: int) -> Cursor:
        if not 0 <= at < len(self._chunks()):
            raise StopIteration("outside of the bounds")
        return replace(self, at=at)

    def load(self, spark: SparkSession, **options) -> DataFrame:
        if self.at is None:
            raise ValueError("move the cursor first")
        _, start, end = self._chunks()[self.at]
        if isinstance(self.bounds, FileBounds):
            return self.instrument._of_files(spark, start, end, **options)
        return self.instrument.load(spark, str(start), str(end), **options)


@dataclass(frozen=True)
class Constellation:
    """Several instruments loaded and aligned together."""

    members: tuple[Instrument, ...]
    custom: tuple[tuple[Callable, tuple, dict], ...] = ()

    def __getitem__(self, i: int) -> Instrument:
        return self.members[i]

    def load(self, spark: SparkSession, start: str | None = None, stop: str | None = None) -> dict[str, DataFrame]:
        loaded = {m.key: m.load(spark, start, stop) for m in self.members}
        for function, args, kwargs in self.custom:
            loaded = function(loaded, *args, **kwargs)
        return loaded

    def column_names(self, loaded: dict[str, DataFrame]) -> dict[tuple[str, str], str]:
        """Names of all variables side by side: those in several members end in their member's key."""
        seen: dict[str, int] = {}
        for df in loaded.values():
            for c in df.columns:
                seen[c.lower()] = seen.get(c.lower(), 0) + 1
        return {(k, c): f"{c}_{k}" if seen[c.lower()] > 1 else c for k, df in loaded.items() for c in df.columns if c != "epoch"}

    def to_frame(self, spark: SparkSession, start: str | None = None, stop: str | None = None, *, step: str | None = None, overlap: bool = True, method: str | None = None, order: int | None = None) -> DataFrame:
        """One row per time of a regular grid over the members' shared range, with all variables of all members.

        Texts and other values that cannot be interpolated take the nearest row where ``method`` interpolates. Unmatched
        rows get the fill value of the variable's metadata where ``method`` is None. Without a ``step`` the grid is as fine
        as the finest step of any member. Labels of variables go along, as :meth:`meta` has them. Members without rows count for nothing; without any common time there
        are no rows.
        """
        loaded = self.load(spark, start, stop)
        names = self.column_names(loaded)
        low, high = align.shared_range(list(loaded.values()), overlap=overlap)
        if step is None:
            seconds = [least_step(df, "epoch").first()[0] for df in loaded.values()]
            step = f"{min((round(s * 1e6) for s in seconds if s), default=86_400_000_000)} microseconds"
        if low is None:
            grid = spark.range(0).select(F.lit(None).cast("timestamp_ntz").alias("epoch"))
        else:
            grid = spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high), F.expr(f"interval {step}"))).alias("epoch"))
        out = grid
        for key, df in loaded.items():
            meta = Meta.of(df)
            numeric = [f.name for f in df.schema if f.name != "epoch" and f.dataType.typeName() in ("double", "float", "long", "integer")]
            other = [f.name for f in df.schema if f.name != "epoch" and f.name not in numeric]
            for values, how in ((numeric, method), (other, "nearest" if method in INTERPOLATING else method)):
                if values:
                    fills = {v: meta[v, "fill"] if v in meta else default_fill(df.schema[v].dataType) for v in values}
                    fills = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in fills.items()}
                    got = align.align(grid, df, values, how, fills=fills, order=order)
                    out = out.join(got.select("epoch", *[F.col(v).alias(names[key, v]) for v in values]), "epoch", "left")
        return self.meta(loaded).attach(out)

    def meta(self, loaded: dict[str, DataFrame]) -> Meta:
        """Labels of all members' variables under their names side by side; the header says what the members have in common."""
        out, names = Meta(header={k: v for k, v in self.attributes().items() if v}), self.column_names(loaded)
        for key, df in loaded.items():
            for name, labels in Meta.of(df).to_dict().items():
                if (key, name) in names:
                    out[names[key, name]] = labels
        return out

    def distinct(self, attribute: str) -> list:
        """The members' different values of an attribute, in the order of the members."""
        return list(dict.fromkeys(getattr(m, attribute) for m in self.members))

    def attributes(self) -> dict[str, str | None]:
        """Names of all members joined by ``_``, the lowest clean level and the longest pad."""
        out: dict[str, str | None] = {a: "_".join(x for x in self.distinct(a) if x) for a in ("platform", "name", "tag", "inst_id")}
        levels = self.distinct("clean_level")
        out["clean_level"] = max(levels, key=CLEAN_LEVELS.index) if levels else None
        out["pad"] = max((p for p in self.distinct("pad") if p), key=pd.Timedelta, default=None)
        return out

    def attach(self, function: Callable, *args, at: int | str = "end", members: bool = False, **kwargs) -> Constellation:
        """A copy whose load also runs ``function`` on all loaded members by key; with ``members``, whose every member's load runs it on its rows."""
        if members:
            return replace(self, members=tuple(m.attach(function, *args, at=at, **kwargs) for m in self.members))
        queue = list(self.custom)
        queue.insert(len(queue) if at == "end" else int(at), (function, args, kwargs))
        return replace(self, custom=tuple(queue))

    def cleared(self) -> Constellation:
        """A copy without steps, its own and its members'."""
        return replace(self, custom=(), members=tuple(m.cleared() for m in self.members))

    def empty(self, loaded: dict[str, DataFrame]) -> bool:
        """Whether no member has rows."""
        return all(df.isEmpty() for df in loaded.values())

    def empty_partial(self, loaded: dict[str, DataFrame]) -> bool:
        """Whether some member has no rows; so has a constellation without members."""
        return not loaded or any(df.isEmpty() for df in loaded.values())

    def drop(self, loaded: dict[str, DataFrame], names: str | Sequence[str]) -> dict[str, DataFrame]:
        """``loaded`` without variables, by plain name (of every member that has it) or by the name that ends in a member's key; KeyError where none has it."""
        side, out = self.column_names(loaded), dict(loaded)
        for name in [names] if isinstance(names, str) else names:
            hits = [(k, c) for (k, c), s in side.items() if name in (c, s)]
            if not hits:
                raise KeyError(name)
            for k, c in hits:
                out[k] = out[k].drop(c)
        return out


class Registry:
    """Instruments by platform and name."""

    def __init__(self):
        self._known: dict[tuple[str, str, str, str], Instrument] = {}

    def register(self, instrument: Instrument, *, overwrite: bool = False) -> None:
        at = tuple(x.lower() for x in (instrument.platform, instrument.name, instrument.tag, instrument.inst_id))
        if at in self._known and not overwrite:
            raise ValueError(f"{instrument.key} is registered")
        self._known[at] = instrument

    def register_module(self, module, *, overwrite: bool = False) -> int:
        """Registers every instrument that a module names in its own scope; gives how many. A ValueError if one is known, and then none is registered."""
        found = [x for n, x in vars(module).items() if isinstance(x, Instrument) and not n.startswith("_")]
        trial = Registry()
        trial._known = dict(self._known)
        for instrument in found:
            trial.register(instrument, overwrite=overwrite)
        self._known = trial._known
        return len(found)

    def get(self, platform: str, name: str, tag: str = "", inst_id: str = "") -> Instrument:
        return self._known[tuple(x.lower() for x in (platform, name, tag, inst_id))]

    def remove(self, platform: str, name: str | None = None) -> None:
        gone = [k for k in self._known if k[0] == platform.lower() and (name is None or k[1] == name.lower())]
        if not gone:
            raise ValueError(f"not registered: {platform} {name or ''}")
        for k in gone:
            del self._known[k]

    def select(self, platforms: Sequence[str] = (), names: Sequence[str] = (), tags: Sequence[str] = ()) -> Constellation:
        want = [[x.lower() for x in w] for w in (platforms, names, tags)]
        return Constellation(tuple(v for k, v in self._known.items() if all(not w or k[i] in w for i, w in enumerate(want))))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self._known) or [], "platform string, name string, tag string, inst_id string")
