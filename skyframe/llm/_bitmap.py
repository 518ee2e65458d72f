"""Bitmaps of hashed keys: a filter of a bounded size that lets through all keys it was built from, and some others."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm._common import record_batch

_CHUNK = 1 << 20
#: 128 MB; the most that is ever broadcast. With more keys the filter lets more through; what follows stays exact.
MOST_BITS = 1 << 30


def build(keys: DataFrame, key: Column, *, most_bits: int = MOST_BITS) -> Broadcast:
    """A broadcast ``(bits, bytes)`` with bit ``key mod bits`` set for every ``key`` (long); about 16 bits for each.

    Keys are best distinct already: each one is sent to the task that fills its part of the bitmap.
    """
    n = keys.count()
    bits = min(most_bits, max(_CHUNK, 1 << (16 * n).bit_length()))
    slots = keys.select(F.pmod(key, F.lit(bits)).alias("slot")).select(F.floor(F.col("slot") / _CHUNK).alias("chunk"), F.pmod("slot", F.lit(_CHUNK)).cast("int").alias("at"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(chunk):
                held.setdefault(int(c), np.zeros(_CHUNK, bool))[at[chunk == c]] = True
        for c, b in held.items():
            yield record_batch(chunk=[c], bits=pa.array([zlib.compress(np.packbits(b, bitorder="little").tobytes(), 1)], pa.binary()))

    parts = slots.repartition("chunk").mapInArrow(fill, "chunk long, bits binary").collect()
    packed = np.zeros(bits // 8, np.uint8)
    for p in parts:
        a = p["chunk"] * _CHUNK // 8
        packed[a : a + _CHUNK // 8] = np.frombuffer(zlib.decompress(bytes(p["bits"])), np.uint8)
    return keys.sparkSession.sparkContext.broadcast((bits, packed.tobytes()))


def contains(shared: Broadcast, key: np.ndarray) -> np.ndarray:
    """``key``: int64 or uint64 words. Powers of two as moduli make both the same slot."""
    bits, packed = shared.value
    b = np.frombuffer(packed, np.uint8)
    slot = key.view(np.uint64) & np.uint64(bits - 1)
    return (b[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


def split(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that surely have none of the ``keys`` (one column) in ``column``, and the others with some more."""
    shared = build(keys.select(F.xxhash64(keys.columns[0]).alias("key")), F.col("key"))

    @F.arrow_udf("boolean")
    def may_have(key: pa.Array) -> pa.Array:
        return pa.array(contains(shared, key.to_numpy()))

    mark = "__sf"
    asked = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias(mark), F.xxhash64(rows[column]).alias("__key")).withColumn("__asked", may_have("__key"))
    return asked.where(~F.col("__asked")).select(f"{mark}.*"), asked.where("__asked").select(f"{mark}.*")
