"""A record's orbits, one after the other: an index of where they lie, and loads of one orbit's range at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.operators.chunks import Bounds
from skyframe.plans.instrument import Instrument
from skyframe.session import scratch
from skyframe.sources.archive import FileBounds


@dataclass(frozen=True)
class OrbitRecord:
    """The orbits that a rule finds in an instrument's record, indexed once: their first and last rows and how many they have.

    The index has one row for each orbit of each key; an orbit is then loaded by the instrument as any range is, so its scan (or its choice
    of files) is that of the orbit's times, and orbits over midnight, or over files that run into each other, come as a whole.
    """

    instrument: Instrument
    index: DataFrame
    keys: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()

    @classmethod
    def build(cls, spark: SparkSession, instrument: Instrument, rule: Callable[[DataFrame], DataFrame], *keys: str, bounds: Bounds | FileBounds | None = None, ties: tuple[str, ...] = (), at: str | None = None) -> OrbitRecord:
        """``rule`` adds ``orbit`` to rows, from 1 in each of ``keys``, as the continuous rules of :mod:`skyframe.operators.orbits` do; ``ties`` order rows of one time.

        ``bounds`` narrow the record; chunks that overlap are refused, as a row would lie in two orbits of one number. The index is written to ``at``
        or to the shared folder.
        """
        if bounds is not None and (bounds.overlaps if isinstance(bounds, Bounds) else bounds.step < bounds.width):
            raise ValueError("orbits need bounds whose chunks do not overlap")
        rows = instrument.load(spark) if bounds is None else instrument.iterate(spark, bounds).drop("chunk_id", "chunk_start", "in_chunk")
        place = F.struct("epoch", *ties)
        index = rule(rows).groupBy(*keys, "orbit").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
        at = at or scratch(spark, "orbits")
        index.write.mode("overwrite").parquet(at)
        return cls(instrument, spark.read.schema(index.schema).parquet(at), tuple(keys), tuple(ties))

    def cursor(self, **key) -> OrbitPlayer:
        """The orbits of one key, none of them loaded yet; every column of the keys is named."""
        if set(key) != set(self.keys):
            raise ValueError(f"an orbit is one of {self.keys}")
        mine = self.index
        for k, v in key.items():
            mine = mine.where(F.col(k).eqNullSafe(F.lit(v)))
        return OrbitPlayer(self, mine, tuple(key.items()), mine.agg(F.max("orbit")).first()[0] or 0)


@dataclass(frozen=True)
class OrbitPlayer:
    """A place among a record's orbits. ``current`` counts from 0 and is None before the first step; the ends of the record are refused."""

    record: OrbitRecord
    index: DataFrame
    key: tuple[tuple[str, object], ...]
    n: int
    current: int | None = field(default=None)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> OrbitPlayer:
        """The cursor at an orbit, from 0; negative numbers count from the end."""
        if not -self.n <= i < self.n:
            raise IndexError(f"there is no orbit {i} among {self.n}")
        return replace(self, current=i % self.n)

    def next(self) -> OrbitPlayer:
        return self._moved(0 if self.current is None else self.current + 1)

    def prev(self) -> OrbitPlayer:
        return self._moved(self.n - 1 if self.current is None else self.current - 1)

    def _moved(self, to: int) -> OrbitPlayer:
        if not 0 <= to < self.n:
            raise StopIteration("outside of the record")
        return replace(self, current=to)

    def __iter__(self) -> Iterator[OrbitPlayer]:
        """Cursors at each orbit in turn; all at once, orbits are a groupBy."""
        return (self[i] for i in range(self.n))

    def load(self, spark: SparkSession, *, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of the current orbit; one row of the index reaches the driver."""
        if self.current is None:
            raise ValueError("step to an orbit first")
        found = self.index.where(F.col("orbit") == self.current + 1).select("first", "last").first()
        if found is None:
            raise LookupError(f"the index has no orbit {self.current + 1}")
        first, last = found
        rows = self.record.instrument.load(spark, str(first["epoch"]), str(last["epoch"] + timedelta(microseconds=1)))
        place = F.struct("epoch", *self.record.ties)
        for k, v in self.key:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
        rows = rows.where((place >= self._place(first, rows)) & (place <= self._place(last, rows)))
        return rows.select(*columns) if columns else rows

    def _place(self, at, rows: DataFrame) -> Column:
        return F.struct(*[F.lit(at[c]).cast(rows.schema[c].dataType).alias(c) for c in ("epoch", *self.record.ties)])
