"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

How documents share sequences depends on their lengths alone, and there are no more lengths than the capacity. So Spark
counts the pieces of each length, the fill is planned on these counts (a table bounded by the capacity, whatever the
corpus), and each piece finds its place by its number among the pieces of its length, which salted windows give.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm._common import small_batches, stage, table
from skyframe.llm._tokens import encoder

CAPACITY = 2_048
#: Pieces that one window numbers, about.
WINDOW_ROWS = 500_000


def plan_fill(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Fills as ``(pieces by length, how many sequences are filled alike)``, using every counted piece once.

    A sequence starts with the longest piece left and takes the longest that fits until none does. Then its smallest
    piece gives way to the two unpacked ones that fill the gap it leaves most tightly, as long as this leaves less room.
    The same fill is repeated while pieces for it last, so every step uses up some length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    fills: list[tuple[Counter, int]] = []
    while left.any():
        have = left.copy()
        used: Counter = Counter()
        gap = capacity
        while gap:
            fit = np.flatnonzero(have[1 : gap + 1])
            if not len(fit):
                break
            length = int(fit[-1]) + 1
            n = int(min(have[length], gap // length))
            used[length] += n
            have[length] -= n
            gap -= n * length
        while gap:
            smallest = min(used)
            pair = _tightest_pair(have, smallest + gap, smallest)
            if pair is None:
                break
            used[smallest] -= 1
            have[smallest] += 1
            used += Counter()  # drops what has come to nought
            for length in pair:
                used[length] += 1
                have[length] -= 1
            gap += smallest - sum(pair)
        times = int(min(left[length] // n for length, n in used.items()))
        for length, n in used.items():
            left[length] -= n * times
        fills.append((used, times))
    return fills


def _tightest_pair(have: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    lengths = np.flatnonzero(have[: room + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return None
    other = np.searchsorted(lengths, room - lengths, "right") - 1
    # a length of which there is one piece cannot be taken twice
    other = np.where((other >= 0) & (lengths[np.maximum(other, 0)] == lengths) & (have[lengths] < 2), other - 1, other)
    sums = np.where(other >= 0, lengths + lengths[np.maximum(other, 0)], -1)
    best = int(sums.argmax())
    if sums[best] <= more_than:
        return None
    return int(lengths[best]), int(lengths[other[best]])


def token_pieces(
    docs: DataFrame, *, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, payload: str | None = "ids"
) -> DataFrame:
    """``(key, piece, start, length, payload)`` of every document's ids followed by ``end_id``.

    ``payload``: ``ids`` keeps the token ids (array<int>), ``crc32`` their checksum as little-endian 32-bit words.
    """
    small_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    kind = {"ids": "ids array<int>", "crc32": "ids_crc32 long"}[payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for i, j, ids, ends in encode(batch.column(1)):
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                n = ends - starts + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                # the first piece takes what whole pieces leave
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                whole = np.zeros(int(n.sum()), np.int32)
                at = np.cumsum(n) - n
                where = np.arange(len(ids)) + np.repeat(np.arange(j - i), n - 1)
                whole[:] = end_id
                whole[where] = ids
                a = at[doc] + start
                if payload == "ids":
                    carried = pa.ListArray.from_arrays(pa.array(np.append(a, len(whole)).astype(np.int32)), pa.array(whole))
                else:
                    raw = whole.astype("<u4")
                    carried = pa.array([zlib.crc32(raw[x : x + m]) for x, m in zip(a.tolist(), length.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + i)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), carried],
                    ["key", "piece", "start", "length", kind.split()[0]],
                )

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {key_type}, piece int, start long, length long, {kind}").withColumnRenamed("key", key)


def pack(
    docs: DataFrame, *, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, payload: str = "ids"
) -> DataFrame:
    """Places every document's token ids in sequences of at most ``capacity`` tokens.

    Returns one row per piece: the key, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, the
    payload (see :func:`token_pieces`), ``sequence_id`` and ``offset`` (where the piece begins in its sequence; a
    sequence has no gaps). A document longer than the capacity is cut into whole sequences behind a first piece.

    * null and empty texts are the end id alone; repeated rows and rows with a null key are packed like others.
    * ties between pieces of one length: any order; very long texts: many whole sequences.
    * an empty table gives no rows; columns other than key and text are not carried, whatever their names.
    """
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, vocabulary=vocabulary, key=key, text=text, capacity=capacity, end_id=end_id, payload=payload), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    longest = math.ceil(max(counts.values(), default=1) / WINDOW_ROWS)
    salt = F.pmod(F.xxhash64(key, "piece", "start", *([c for c in pieces.columns if c == "ids_crc32"])), F.lit(longest)).cast("int")

    rows, sequence = [], 0
    given: Counter = Counter()
    for used, times in plan_fill(counts, capacity):
        at = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, given[length], given[length] + n * times, sequence, n, at))
            given[length] += n * times
            at += n * length
        sequence += times
    places = spark.createDataFrame(rows, "length long, from_rank long, to_rank long, first_sequence long, uses long, at long")

    salted = pieces.withColumn("salt", salt)
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(key, "piece", "start")
    numbered = salted.withColumn("k", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("base"))
    # at most a few rows per length and fill, so bounded by the capacity
    placed = numbered.join(F.broadcast(places), "length").where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    turn = F.col("rank") - F.col("from_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(turn / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("uses")) * F.col("length")).cast("long").alias("offset"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed_digests(docs: DataFrame, vocabulary: Callable[[], str] = default_vocabulary) -> DataFrame:
    return pack(docs, vocabulary=vocabulary(), payload="crc32")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))
