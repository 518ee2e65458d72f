"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length on a geometric grid, and large groups are cut into blocks. Every block meets every query
once, in one task, as a stream: the block's vectors (bounded) are held, the queries pass by in batches. For each chunk
of a block and each query the local cosine threshold ``theta / (|q| * longest)`` decides: above 1 nothing of the chunk
can count; high ones look at the query's strongest coordinate only, which leaves few vectors; low ones multiply all
vectors that are long enough. What is left is verified with exact integer products. ``theta`` starts from a bounded
seed block and rises with what the block has given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm._common import record_batch, table

#: Blocks hold about this many vectors; a chunk of a block is judged at once.
BLOCK_ROWS, CHUNK_ROWS, SEED_ROWS = 32_768, 4_096, 2_048
#: Local cosine thresholds from here on look at one coordinate first.
COORDINATE_FROM = 0.4
SLACK = 1e-9


def quantised(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x); rows whose key or vector is null or that hold a null or non-finite
    component are left out; products beyond 64 bits saturate."""
    x = F.col("v")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    doubles = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    return doubles.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(
        "vec_id", F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y)).alias("v")
    )


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))


def _bucket(norm: Column) -> Column:
    """Lengths within a factor of 2^(1/8) share a bucket; -9999 for the zero vector."""
    return F.when(norm > 0, F.floor(F.log2(norm) * 8).cast("int")).otherwise(F.lit(-9999))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's ``k`` highest inner products over all ``vectors`` but those of its own ``vec_id``.

    Both inputs: ``vec_id long, v array<long>`` without nulls (see :func:`quantised`); other columns are ignored.
    Returns ``query_id long, rank int, vec_id long, score long``; ties go to the smaller ``vec_id``.

    * of several query rows with one ``vec_id`` the greatest vector asks; repeated candidate rows all count.
    * vectors of different lengths: the shorter is filled up with zeros; an empty vector scores 0 everywhere.
    * fewer than ``k`` candidates: all of them; an empty table on either side: no rows.
    """
    own = vectors.select("vec_id", "v", _norm(F.col("v")).alias("norm"))
    asked = queries.groupBy("vec_id").agg(F.max("v").alias("v")).select("vec_id", "v", _norm(F.col("v")).alias("norm"))
    buckets = own.groupBy(_bucket(F.col("norm")).alias("bucket")).agg(F.count("*").alias("n")).collect()
    if not buckets:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # one row for each step of the length grid: at most some thousands, whatever the data
    blocks = {int(b["bucket"]): max(1, math.ceil(b["n"] / block_rows)) for b in buckets}
    total = sum(b["n"] for b in buckets)
    n_blocks = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair])

    share = min(1.0, SEED_ROWS / total)
    order = F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(1 << 30))
    seed = own.where(order < F.lit(int(share * (1 << 30)) + 1)).select(F.lit(0).alias("bucket"), F.lit(0).alias("block"), "vec_id", "v", "norm")
    # a floor under each query's k-th score, from a bounded number of vectors; it only saves work
    parts = 16
    first = _meet(seed.crossJoin(_range(seed, parts)), asked.select(F.lit(0).alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("salt"), F.lit(0).alias("block"), "vec_id", "v", "norm", F.lit(None).cast("double").alias("theta")), k)
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("theta"))
    asked = asked.join(floor, asked["vec_id"] == floor["query_id"], "left").drop("query_id")

    b = _bucket(F.col("norm"))
    held = own.select(b.alias("bucket"), F.lit(0).alias("salt"), F.pmod(F.xxhash64("vec_id"), n_blocks[b]).cast("int").alias("block"), "vec_id", "v", "norm")
    every = F.explode(F.array(*[F.struct(F.lit(x).alias("bucket"), F.lit(n).alias("n")) for x, n in sorted(blocks.items())]))
    ceiling = F.when(F.col("b.bucket") == -9999, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (F.col("b.bucket") + 1) / 8.0))
    calls = (
        asked.select("*", every.alias("b"))
        # length pruning of whole buckets: nothing in it can reach the floor
        .where(F.col("theta").isNull() | (F.col("norm") * ceiling * (1 + SLACK) + SLACK >= F.col("theta")))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("block"))
        .select("b.bucket", F.lit(0).alias("salt"), "block", "vec_id", "v", "norm", "theta")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        _meet(held, calls, k)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("salt"))


def _meet(held: DataFrame, calls: DataFrame, k: int) -> DataFrame:
    """Streams every block's vectors, longest first, then the queries that call it, through one task."""
    columns = ["bucket", "salt", "block", "asks", "vec_id", "v", "norm", "theta"]
    both = held.select(*columns[:3], F.lit(0).alias("asks"), *columns[4:7], F.lit(None).cast("double").alias("theta")).unionByName(
        calls.select(*columns[:3], F.lit(1).alias("asks"), *columns[4:])
    )
    dealt = both.repartition("bucket", "salt", "block").sortWithinPartitions("bucket", "salt", "block", "asks", F.desc("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        at, ready = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "salt", "block", "asks")), strict=True))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if keys[i][:3] != at:
                    at, block, ready = keys[i][:3], [], None
                part = batch.slice(i, j - i)
                if not keys[i][3]:
                    block.append(_arrays(part))
                elif block:
                    ready = ready or _prepare(block)
                    yield _score(ready, _arrays(part), k)

    return dealt.select(*columns).mapInArrow(run, "query_id long, vec_id long, score long")


def _arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = part.column("v")
    lengths = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        m = flat.reshape(len(lengths), width)
    else:
        m = np.zeros((len(lengths), width), np.int64)
        m[np.arange(width) < lengths[:, None]] = flat
    theta = part.column("theta").to_numpy(zero_copy_only=False).astype(float)
    return part.column("vec_id").to_numpy(zero_copy_only=False), m, part.column("norm").to_numpy(zero_copy_only=False), theta


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _prepare(block: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(b[1].shape[1] for b in block)
    ids, norms = np.concatenate([b[0] for b in block]), np.concatenate([b[2] for b in block])
    return ids, np.concatenate([_widen(b[1], width) for b in block]), norms


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact: in doubles where all sums stay below 2^53, else in Python's integers, saturated to 64 bits."""
    most = float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, p.shape[1])
    if most < 2**53:
        return (p.astype(float) @ q.astype(float).T).astype(np.int64)
    exact = p.astype(object) @ q.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _score(ready: tuple, asked: tuple, k: int) -> pa.RecordBatch:
    ids, vectors, norms = ready
    qids, q, qnorms, theta = asked
    width = max(vectors.shape[1], q.shape[1])
    vectors, q = _widen(vectors, width), _widen(q, width)
    theta = np.where(np.isnan(theta), -np.inf, theta)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qids]
    strongest = np.abs(q).argmax(axis=1) if width else np.zeros(len(q), int)

    def offer(n: int, rows: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= theta[n]) & (ids[rows] != qids[n])
        s, i = np.concatenate([best[n][0], scores[keep]]), np.concatenate([best[n][1], ids[rows[keep]]])
        order = np.lexsort((i, -s.astype(float) if np.abs(s).max(initial=0) < 2**53 else np.array([-int(x) for x in s], object)))[:k]
        best[n] = s[order], i[order]
        if len(order) == k:
            theta[n] = max(theta[n], float(s[order[-1]]) if abs(int(s[order[-1]])) < 2**53 else -np.inf)

    for a in range(0, len(ids), CHUNK_ROWS):
        rows = np.arange(a, min(a + CHUNK_ROWS, len(ids)))
        p, longest = vectors[rows], float(norms[rows].max())
        reach = qnorms * longest * (1 + SLACK) + SLACK
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, theta / reach, np.where(theta > SLACK, np.inf, -np.inf))
        by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1))
        by_length = np.flatnonzero(local < COORDINATE_FROM)
        if len(by_coordinate):
            unit = p / np.maximum(norms[rows], 1e-300)[:, None]
            for n in by_coordinate:
                f = strongest[n]
                c = q[n, f] / qnorms[n]
                # q and p meet at a cosine of at most c*x + sqrt(1-c^2) sqrt(1-x^2), x being p's share at f
                x = unit[:, f]
                bound = (c * x + math.sqrt(max(0.0, 1 - c * c)) * np.sqrt(np.maximum(0.0, 1 - x * x))) * norms[rows] * qnorms[n]
                left = np.flatnonzero(bound * (1 + SLACK) + 1e-6 * abs(theta[n]) + SLACK >= theta[n])
                if len(left):
                    offer(n, rows[left], _products(p[left], q[n : n + 1])[:, 0])
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(qnorms[by_length] > 0, theta[by_length] / qnorms[by_length], -np.inf).min()
            enough = norms[rows] * (1 + SLACK) + SLACK >= least
            scores = _products(p[enough], q[by_length])
            for m, n in enumerate(by_length):
                column = scores[:, m]
                if len(column) > 4 * k and not np.isfinite(theta[n]):
                    # one more than k, as the query's own row may be among them
                    at = np.flatnonzero(column >= np.partition(column, len(column) - k - 1)[len(column) - k - 1])
                else:
                    at = np.flatnonzero(column >= theta[n])
                offer(n, rows[enough][at], column[at])
    counts = [len(s) for s, _ in best]
    return record_batch(
        query_id=np.repeat(qids, counts).astype(np.int64),
        vec_id=np.concatenate([i for _, i in best]).astype(np.int64),
        score=np.concatenate([s for s, _ in best]).astype(np.int64),
    )


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0), 10)


OP8_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM valid
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM long q JOIN long c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
