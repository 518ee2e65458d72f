"""Sharding by a Feistel permutation of global row numbers: a reproducible shuffle whose shards and slots are computed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm._common import stage, table
from skyframe.llm._order import in_order, offsets

ROUNDS = 6
#: A prime below 2^31: products of two residues fit a long.
PRIME = (1 << 31) - 1
#: Steps of a walk that stay in a plan; see :func:`permuted`.
MOST_STEPS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Factor and summand of every round."""
    digests = [sha256(f"{seed}:{r}".encode()).digest() for r in range(ROUNDS)]
    return [(1 + int.from_bytes(d[:8], "big") % (PRIME - 1), int.from_bytes(d[8:16], "big") % PRIME) for d in digests]


def _side(n: int) -> int:
    """The least a with a * a >= n: numbers below a * a are pairs of digits below a."""
    side = max(1, math.isqrt(n))
    return side if side * side >= n else side + 1


def _div(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by).cast("long"))


def _digest(digit: Column, key: Column) -> Column:
    mixed = (digit * key["factor"] + key["summand"]) % PRIME
    return (mixed * mixed) % PRIME


def _once(number: Column, side: int, seed: int, inverse: bool) -> Column:
    keys = round_keys(seed)
    rounds = F.array(*[F.struct(F.lit(a).cast("long").alias("factor"), F.lit(b).cast("long").alias("summand")) for a, b in (reversed(keys) if inverse else keys)])

    def forward(pair: Column, key: Column) -> Column:
        return F.struct(pair["right"].alias("left"), ((pair["left"] + _digest(pair["right"], key)) % side).alias("right"))

    def backward(pair: Column, key: Column) -> Column:
        return F.struct(F.pmod(pair["right"] - _digest(pair["left"], key), F.lit(side).cast("long")).alias("left"), pair["left"].alias("right"))

    pair = F.struct(_div(number, side).alias("left"), (number % side).alias("right"))
    return F.aggregate(rounds, pair, backward if inverse else forward, lambda p: p["left"] * side + p["right"])


def permuted(number: Column, n: int, seed: int, *, inverse: bool = False) -> Column:
    """A permutation of 0..n-1: a Feistel network over pairs of digits, walked on while it leads to n or beyond.

    Pairs of digits name fewer than n + 2 * sqrt(n) + 1 numbers, so a walk has at most that many steps beyond n in its way;
    up to n = 1000 all of them fit the plan. Above, a walk goes on with a chance of 2 / sqrt(n) at most: 64 steps fall short
    with a chance below 2^-250, and then the query fails, asking for another seed, rather than give a wrong place.
    """
    side = _side(n)
    steps = min(MOST_STEPS, side * side - n)
    at = _once(number, side, seed, inverse)
    if steps > 0:
        at = F.aggregate(F.array(*[F.lit(0)] * steps), at, lambda p, _: F.when(p < n, p).otherwise(_once(p, side, seed, inverse)))
    return F.when(at < n, at).otherwise(F.raise_error(F.lit(f"a walk of {MOST_STEPS} steps did not end below {n}: take another seed")).cast("long"))


def place(number: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of row ``number`` of ``n``: no table is needed to find a row's place."""
    at = permuted(number, n, seed)
    return (at % shards).cast("int"), _div(at, shards)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number whose place is (shard, slot): the way back of :func:`place`; null beyond the shard's end."""
    at = slot.cast("long") * shards + shard
    return F.when((at >= 0) & (at < n), permuted(at, n, seed, inverse=True))


def shard(docs: DataFrame, order: Sequence[Column], *, shards: int = 16, seed: int = 1, staged: str = "sharded") -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard): counts of shards are at most one apart.

    A row's global number is its place by ``order``; its place among the shards is computed from that number, the table's
    row count and ``seed`` alone. So the same rows give the same shards, however they are dealt over files and tasks, and
    :func:`row_at` names the row that stands at any place. Nulls come first. Rows alike in all of ``order`` take their numbers
    in any way; if they are alike in all else too, results do not depend on it. No group of equal texts or ids is kept together, and a hot one
    is split like any other rows. Columns of ``docs`` called shard or slot are replaced, whatever their case; an empty table gives none.
    """
    rows = in_order(docs, order, staged)
    before = stage(offsets(rows), f"{staged}_offsets")
    n = before.agg(F.sum("n")).first()[0] or 0
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    at = rows.join(F.broadcast(before.select("part", "before")), "part").select("row", (F.col("before") + F.col("at")).alias("number"))
    home, slot = place(F.col("number"), n, shards, seed)
    return at.select(*[F.col("row")[c].alias(c) for c in kept], home.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, order: Sequence[Column], path: str, *, shards: int = 16, seed: int = 1, rows_per_file: int = 1_000_000) -> None:
    """Writes ``docs`` with their slots as folders ``shard=0`` and so on, of files of at most ``rows_per_file`` rows in order of slots."""
    sharded = shard(docs, order, shards=shards, seed=seed)
    block = _div(F.col("slot"), rows_per_file)
    sharded.repartition("shard", block).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


SHARDS, SEED = 16, 13


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts of shards differ by one at most. Only sizes and hashes of texts are shuffled, by doc_id."""
    text = F.col("text")
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("tie"),
    )
    sizes = stage(sizes, "sizes")  # texts are read once; dealing by ranges reads its input twice
    sharded = shard(sizes, [F.col(c) for c in ("doc_id", "size", "text_crc32", "tie")], shards=SHARDS, seed=SEED)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_rounds() -> str:
    """One network after the other in DuckDB: (left, right) becomes (right, (left + digest of right) mod side)."""
    out = []
    for r, (factor, summand) in enumerate(round_keys(SEED)):
        mixed = f"((b * {factor} + {summand}) % {PRIME})"
        out.append(f"r{r + 1} AS (SELECT number, hop, side, b AS a, (a + ({mixed} * {mixed}) % {PRIME}) % side AS b FROM r{r})")
    return ", ".join(out)


_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""

#: The network is applied to all numbers below side * side once; walks then follow that table until they are below n.
OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, total AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM documents),
r0 AS (SELECT i AS number, 0 AS hop, side, i // side AS a, i % side AS b FROM (SELECT unnest(range(side * side)) AS i, side FROM total)),
{_sql_rounds()},
image AS (SELECT number, a * side + b AS p FROM r{ROUNDS}),
walk(number, p) AS (
  SELECT image.number, p FROM image, total WHERE image.number < n
  UNION ALL
  SELECT walk.number, image.p FROM walk JOIN image ON walk.p = image.number, total WHERE walk.p >= n
),
numbered AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes,
         row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS number
  FROM documents
)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
       'rows' AS law, CAST(p % {SHARDS} AS INT) AS shard, p // {SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN walk USING (number), total, crc_table WHERE p < n
"""
