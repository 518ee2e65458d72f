"""Blocks of equally many rows of a record, with a halo: what looks at neighbours over a whole record runs in many tasks.

Rows are numbered along each key, day by day, and a block is a range of numbers. Rows near a border are copied to the
blocks on its other side, so lags, leads and windows of a few rows give what one pass over the record would give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What the columns of this module are called: key, day, number along the key, block, and whether a row is the block's own.
KEY, DAY, RANK, BLOCK, OWN = "__key", "__day", "__rank", "__block", "__own"
_NO_DAY = "date'0001-01-01'"


def keyed(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Adds the key as one struct, in which nulls equal each other, and the day; rows without a time lie on a day before all others."""
    return df.withColumns({KEY: F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")), DAY: F.coalesce(F.col(time).cast("date"), F.expr(_NO_DAY))})


def numbered(df: DataFrame, order: Sequence[str], days: DataFrame) -> DataFrame:
    """Adds the number along the key, from 0; ``df`` is keyed, ``days`` has ``n`` for every key and day, and its further columns are added."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(KEY).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = df.join(days.withColumn("__before", before).drop("n"), [KEY, DAY])
    return joined.withColumn(RANK, F.col("__before") + F.row_number().over(Window.partitionBy(KEY, DAY).orderBy(*order)) - 1).drop("__before")


def with_halo(df: DataFrame, rows: int, halo: int) -> DataFrame:
    """Each numbered row in its block of ``rows`` rows and, as not its own, in the blocks that begin or end up to ``halo`` rows away."""
    if not 0 <= halo <= rows:
        raise ValueError("a halo is no wider than a block")
    block = lambda shift: F.floor((F.col(RANK) + shift) / rows)
    reached = F.array_distinct(F.array(block(0), F.greatest(block(-halo), F.lit(0)), block(halo)))
    copied = df.withColumn(BLOCK, F.explode(reached))
    return copied.withColumn(OWN, F.col(BLOCK) == block(0))

