"""Segmentation of a record into orbits or sessions by what its variables do, as window expressions.

Breaks are found inside partitions of ``keys`` (instrument and day, as a rule), so a long mission fills many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from skyframe.operators import blocks
from skyframe.session import known

# Fixed values of the break rules.
BREAK_SHARE, LARGE_STEP, NEAR_ROWS, GAP_SHARE, ORBIT_SHARE = 0.2, 10.0, 5, 0.95, 0.97
RANGES = {"local time": 24.0, "lt": 24.0, "longitude": 360.0, "long": 360.0, "lon": 360.0}
DEFAULT_PERIOD_S = 97 * 60.0


def _seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def _with_breaks(df: DataFrame, w: WindowSpec, index: str, span: float, period: float, time: str) -> DataFrame:
    """Adds ``__break``, the time and value of a row that breaks an orbit, else null: for rows in order ``w`` with their number ``index``, value ``__v`` and typical step ``__m``."""
    no, norm = F.lit(False), F.col("__dt") / period
    held = df.withColumns({"__dv": F.col("__v") - F.lag("__v").over(w), "__dt": _seconds(F.col(time), F.lag(time).over(w))})
    held = held.withColumns(
        {
            "__big": F.coalesce(F.col("__dv") > LARGE_STEP * F.col("__m"), no),
            "__fits": F.coalesce(F.col("__dt") * span < F.col("__dv") * period, no),
            "__fall": F.coalesce(F.col("__dv") < -BREAK_SHARE * F.col("__m"), no),
            "__gap": F.coalesce(norm > 1, no) | F.coalesce((norm > F.abs("__dv") / span) & (norm > GAP_SHARE), no),
        }
    )
    near = w.rowsBetween(-NEAR_ROWS, NEAR_ROWS)
    held = held.withColumns({"__any": F.max("__big").over(near), "__ok": F.max(F.col("__big") & ~F.col("__fits")).over(near), "__alone": ~F.coalesce(F.lead("__fall").over(w), F.lit(True))})
    confirmed = F.col("__fall") & F.col("__alone") & ((F.col(index) < NEAR_ROWS) | ~F.col("__any") | F.col("__ok"))
    return held.withColumn("__break", F.when(F.col("__gap") | confirmed, F.struct(F.col(time).alias("t"), F.col("__v").alias("v"))))


def _far(later: Column, earlier: Column, span: float, period: float) -> Column:
    """The first break of all stands; one less than an orbit behind the break before it is none."""
    ahead = _seconds(later["t"], earlier["t"]) / period - (later["v"] - earlier["v"]) / span
    return later.isNotNull() & (earlier.isNull() | F.coalesce(ahead > ORBIT_SHARE, F.lit(False)))


def cyclic_orbits(df: DataFrame, variable: str, span: float, *keys: str, time: str = "epoch", period: float = DEFAULT_PERIOD_S, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``orbit`` (from 1 in each partition of ``keys``) by falls of a variable that rises through ``span`` per orbit.

    A break is a fall by more than a fifth of the median step, confirmed by the rows around it, or a gap in time about an
    orbit long; breaks too near to the one before them go. Rows with a missing variable belong to the orbit they lie in.
    Rows are dealt and sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(time, *ties)
    held = df.withColumns({"__i": F.row_number().over(w) - 1, "__v": known(F.col(variable).cast("double"))})
    held = held.withColumn("__step", F.col("__v") - F.lag("__v").over(w)).withColumn("__m", F.median("__step").over(Window.partitionBy(*keys)))
    broken = _with_breaks(held, w, "__i", span, period, time)
    prior = F.last("__break", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = _far(F.col("__break"), F.col("__prior"), span, period)
    told = broken.withColumn("__prior", prior).withColumn("__start", start.cast("long"))
    return told.withColumn("orbit", 1 + F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*df.columns, "orbit")


def continuous_cyclic_orbits(
    df: DataFrame, variable: str, span: float, *keys: str, time: str = "epoch", period: float = DEFAULT_PERIOD_S, ties: tuple[str, ...] = (), rows_per_block: int = 100_000
) -> DataFrame:
    """As :func:`cyclic_orbits`, but rows next to midnight see each other, an orbit goes on over it and numbers go on from day to day.

    The result is that of one scan of each key's record. The typical step stays that of a day: the median of the steps inside it,
    or of the last day before that has any; before the first such day no fall is known. The record is dealt into blocks with a halo as
    wide as the rules look; each block hands its last break and its number of orbits on, in one row per key and block.
    """
    order = [time, *ties]
    daily = Window.partitionBy(blocks.KEY, blocks.DAY).orderBy(*order)
    rows = blocks.keyed(df, keys, time).withColumn("__v", known(F.col(variable).cast("double")))
    days = rows.withColumn("__dv", F.col("__v") - F.lag("__v").over(daily)).groupBy(blocks.KEY, blocks.DAY).agg(F.count(F.lit(1)).alias("n"), F.median("__dv").alias("__m"))
    days = days.withColumn("__m", F.last("__m", ignorenulls=True).over(Window.partitionBy(blocks.KEY).orderBy(blocks.DAY).rowsBetween(Window.unboundedPreceding, 0)))
    # a step reaches one row back, so what lies NEAR_ROWS away needs one row more
    held = blocks.with_halo(blocks.numbered(rows, order, days), rows_per_block, NEAR_ROWS + 1)
    w = Window.partitionBy(blocks.KEY, blocks.BLOCK).orderBy(blocks.RANK)
    broken = _with_breaks(held, w, blocks.RANK, span, period, time).where(blocks.OWN)
    broken = broken.withColumn("__prior", F.last("__break", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    far = lambda later, earlier: _far(F.col(later), earlier, span, period)
    at = F.when(F.col("__break").isNotNull(), F.col(blocks.RANK))
    ends = broken.groupBy(blocks.KEY, blocks.BLOCK).agg(
        F.min_by("__break", at).alias("first"), F.max_by("__break", at).alias("last"), F.count_if(F.col("__prior").isNotNull() & far("__break", F.col("__prior"))).alias("more")
    )
    along = Window.partitionBy(blocks.KEY).orderBy(blocks.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.last("last", ignorenulls=True).over(along))
    ends = ends.withColumn("__starts", F.col("more") + far("first", F.col("__carried")).cast("long")).withColumn("__earlier", F.coalesce(F.sum("__starts").over(along), F.lit(0)))
    told = broken.join(ends.select(blocks.KEY, blocks.BLOCK, "__carried", "__earlier"), [blocks.KEY, blocks.BLOCK])
    start = far("__break", F.coalesce("__prior", "__carried")).cast("long")
    running = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("__start", start).withColumn("orbit", 1 + F.col("__earlier") + running).select(*df.columns, "orbit")


def polar_orbits(df: DataFrame, latitude: str, *keys: str, time: str = "epoch", period: float = DEFAULT_PERIOD_S, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``orbit``: a new one at each change of the latitude's sign and after gaps of 0.95 periods; missing counts as south."""
    w = Window.partitionBy(*keys).orderBy(time, *ties)
    north = F.coalesce(known(F.col(latitude).cast("double")) >= 0, F.lit(False))
    crossed = F.coalesce(north != F.lag(north).over(w), F.lit(False))
    gap = F.coalesce(_seconds(F.col(time), F.lag(time).over(w)) / period > GAP_SHARE, F.lit(False))
    marked = df.withColumn("__break", (crossed | gap).cast("int"))
    return marked.withColumn("orbit", 1 + F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def continuous_polar_orbits(df: DataFrame, latitude: str, *keys: str, time: str = "epoch", period: float = DEFAULT_PERIOD_S, ties: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`polar_orbits`, but an orbit goes on over midnight and numbers go on from day to day.

    Each day takes the last row of the day before it that has rows, and the number of breaks before it: one row per key
    and day. So no window holds more rows than a day has.
    """
    day, north = F.col(time).cast("date"), F.coalesce(known(F.col(latitude).cast("double")) >= 0, F.lit(False))
    own = df.withColumns({"__day": day, "__row": F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(ties)], north.alias("north"))})
    by_day = Window.partitionBy(*keys).orderBy("__day")
    joined = lambda left, right: left.join(right, [*[left[k].eqNullSafe(right[f"__key{i}"]) for i, k in enumerate(keys)], left["__day"] == right["__d"]], "left").drop("__d", *[f"__key{i}" for i in range(len(keys))])
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    last = own.groupBy(*keys, "__day").agg(F.max("__row").alias("__last"))
    carried = last.select(*named, F.col("__day").alias("__d"), F.lag("__last").over(by_day).alias("__before"))
    w = Window.partitionBy(*keys, "__day").orderBy(time, *ties)
    prior = F.coalesce(F.lag("__row").over(w), F.col("__before"))
    marked = joined(own, carried).withColumn("__prior", prior)
    crossed = F.coalesce(F.col("__row.north") != F.col("__prior.north"), F.lit(False))
    gap = F.coalesce(_seconds(F.col(time), F.col("__prior.t")) / period > GAP_SHARE, F.lit(False))
    marked = marked.withColumn("__break", (crossed | gap).cast("int"))
    counts = marked.groupBy(*keys, "__day").agg(F.sum("__break").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = joined(marked, counts.select(*named, F.col("__day").alias("__d"), earlier.alias("__earlier")))
    orbit = 1 + F.col("__earlier") + F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("orbit", orbit).select(*df.columns, "orbit")


def numbered_orbits(df: DataFrame, number: str, *keys: str) -> DataFrame:
    """Adds ``orbit``: the rank of a given orbit number in its partition."""
    return df.withColumn("orbit", F.dense_rank().over(Window.partitionBy(*keys).orderBy(number)))


def gap_sessions(df: DataFrame, gap_seconds: float, *keys: str, time: str = "epoch", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``session``: a new one after each gap of more than ``gap_seconds``."""
    w = Window.partitionBy(*keys).orderBy(time, *ties)
    new = F.coalesce(_seconds(F.col(time), F.lag(time).over(w)) > gap_seconds, F.lit(False)).cast("int")
    marked = df.withColumn("__new", new)
    return marked.withColumn("session", 1 + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def one_orbit(df: DataFrame, number: int, *keys: str) -> DataFrame:
    """Rows of the ``number``-th orbit (from 1; negative: from the end) of each partition."""
    if number == 0:
        raise ValueError("orbits count from 1")
    if number > 0:
        return df.where(F.col("orbit") == number)
    last = F.max("orbit").over(Window.partitionBy(*keys))
    return df.withColumn("__last", last).where(F.col("orbit") == F.col("__last") + 1 + number).drop("__last")


@dataclass(frozen=True)
class OrbitCursor:
    """A place among the orbits of a record whose ``orbit`` goes on over days, as of :func:`continuous_polar_orbits`.

    Steps move no data: an orbit over midnight is already one. ``current`` counts from 0 and is None before the first step.
    Beyond the last orbit there are no rows; before the first one there is nothing to step to.
    """

    data: DataFrame
    current: int | None = None

    def next(self) -> OrbitCursor:
        return replace(self, current=0 if self.current is None else self.current + 1)

    def prev(self) -> OrbitCursor:
        if not self.current:
            raise StopIteration("no orbit before the first")
        return replace(self, current=self.current - 1)

    def rows(self) -> DataFrame:
        """The rows of the current orbit of every key."""
        if self.current is None:
            raise ValueError("step to an orbit first")
        return self.data.where(F.col("orbit") == self.current + 1)
