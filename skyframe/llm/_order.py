"""Rows of a table in one order over many tasks: range partitions, each row with its partition and its place in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm._common import stage

_PLACES = (1 << 33) - 1


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """A staged table ``(row, part, at)``: ``row`` holds the columns of ``df``, ``(part, at)`` ascends with ``order`` (nulls first).

    Rows that ``order`` does not tell apart go by a salt, so that one key with a third of all rows fills many partitions.
    There are as many partitions as the session has for shuffles, each of about as many rows; ``at`` counts from 0 without gaps.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[c.alias(k) for c, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("salt"))
    dealt = rows.repartitionByRange(parts, *keys, "salt").sortWithinPartitions(*keys, "salt")
    named = dealt.select("row", F.monotonically_increasing_id().alias("id"))
    return stage(named.select("row", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit(_PLACES)).alias("at")), name)


def offsets(ordered: DataFrame) -> DataFrame:
    """``(part, n, before)``: rows of each partition and of all before it; one row for each partition, however many rows there are."""
    sizes = ordered.groupBy("part").agg((F.max("at") + 1).alias("n"))
    return sizes.select("part", "n", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
