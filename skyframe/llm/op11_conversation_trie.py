"""Conversation prefix trie: rebuilt conversations collapse into weighted sequences, whose prefixes are the nodes.

A sequence of turns is named by 128 bits: the bits of each turn's place, role and text, combined by exclusive or. So the name
of a prefix is a running combination, that of a whole conversation a plain aggregate, and texts are never shuffled.
A conversation is held in pieces, one for each range partition of the ordered turns that it reaches into: what runs along a
conversation runs inside its pieces and is carried from piece to piece, so one very long conversation fills many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm._common import drop_stage, record_batch, stage, table
from skyframe.llm._order import in_order

#: Turns at the beginning that a conversation takes from the first of its hundred: crc32 of its number modulo this.
HEADS = 6
#: Numbers of conversations that are joined to one string before they are hashed.
ENDS_CHUNK = 4096
#: A node with at least this share of all nodes as its children is joined by broadcast; there are at most so many.
HOT_PARENTS = 1000
NO_ENDS = sha256(b"").hexdigest()
_KEY = ("k1", "k2", "depth")


def _before(value: str, by: str, order: str, how: str = "sum") -> Column:
    """``value`` combined over the rows of ``by`` that come before this one."""
    return F.coalesce(F.expr(f"{how}({value}) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, part, depth, chars, x1, x2)``: the turns of every rebuilt conversation, and its root at depth 0.

    ``x1`` and ``x2`` name the turn at its depth; ``(part, depth)`` ascends along a conversation. The first turns come from the
    first conversation of the same hundred and have part -1.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.length(text).cast("long").alias("chars")
    )
    turns = stage(turns, "turns")  # texts are read once
    ordered = in_order(turns, [F.col(c) for c in ("conv", "turn", "role", "h1", "h2")], "turns_in_order")
    rows = ordered.select("part", "at", F.col("row.conv").alias("conv"), "row.chars", "row.h1", "row.h2")
    pieces = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    pieces = stage(pieces.withColumn("before", _before("n", "conv", "part")), "pieces")
    placed = rows.join(pieces, ["conv", "part"]).select("conv", "part", (F.col("before") + F.col("at") - F.col("first") + 1).alias("p"), "chars", "h1", "h2")
    firsts = placed.where(f"conv % 100 = 0 AND p < {HEADS}").groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "chars", "h1", "h2"))).alias("turns"))
    convs = pieces.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    convs = convs.join(firsts, "base", "left").select("conv", "h", F.coalesce(F.slice("turns", F.lit(1), F.col("h")), F.expr("array()").cast("array<struct<p:long,chars:long,h1:long,h2:long>>")).alias("turns"))
    convs = stage(convs, "conversations")
    named = (F.xxhash64("depth", "h1", "h2").alias("x1"), F.xxhash64("h2", "depth", "h1").alias("x2"))
    heads = convs.select("conv", F.inline("turns")).select("conv", F.lit(-1).cast("long").alias("part"), F.col("p").alias("depth"), "chars", "h1", "h2")
    starts = pieces.join(convs.select("conv", "h", F.size("turns").alias("b")), "conv").select("conv", "part", "before", "first", "h", "b")
    tails = rows.join(starts, ["conv", "part"]).withColumn("p", F.col("before") + F.col("at") - F.col("first") + 1).where("p > h")
    tails = tails.select("conv", "part", (F.col("p") - F.col("h") + F.col("b")).alias("depth"), "chars", "h1", "h2")
    roots = convs.select("conv", *[F.lit(v).cast("long").alias(c) for c, v in (("part", -1), ("depth", 0), ("chars", 0), ("x1", 0), ("x2", 0))])
    out = stage(heads.unionByName(tails).select("conv", "part", "depth", "chars", *named).unionByName(roots), "rebuilt")
    drop_stage(turns, ordered, pieces, convs)
    return out


def end_lists(convs: DataFrame) -> DataFrame:
    """``(k1, k2, depth, ends)``: SHA-256 of the numbers of the conversations that are one sequence, ascending, joined by commas.

    A hash takes its bytes in order, so those of one sequence pass through one task, as strings of up to 4096 numbers that
    are made in many; the task holds a batch of these and the hash's state.
    """
    ordered = in_order(convs.select(*_KEY, "conv"), [F.col(c) for c in (*_KEY, "conv")], "ends_in_order")
    chunks = ordered.select("row.*", "part", F.floor(F.col("at") / ENDS_CHUNK).alias("chunk")).groupBy(*_KEY, "part", "chunk").agg(F.array_sort(F.collect_list("conv")).alias("convs"))
    chunks = chunks.select(*_KEY, F.element_at("convs", 1).alias("first"), F.array_join(F.col("convs").cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if key == held:
                    state.update(b"," + ids.encode())
                    continue
                if held is not None:
                    done.append((*held, state.hexdigest()))
                held, state = key, sha256(ids.encode())
            if done:
                yield record_batch(**dict(zip((*_KEY, "ends"), map(list, zip(*done, strict=True)), strict=True)))
        if held is not None:
            yield record_batch(**{c: [v] for c, v in zip((*_KEY, "ends"), (*held, state.hexdigest()), strict=True)})

    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "k1 long, k2 long, depth long, ends string")


def sequences(rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of conversations with their bits, and ``(k1, k2, depth, conv, weight, ends)`` of each sequence: its least conversation stands for it."""
    pieces = rebuilt.groupBy("conv", "part").agg(F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"), F.max("depth").alias("depth"))
    pieces = stage(pieces, "pieces_of_rebuilt")
    convs = stage(pieces.groupBy("conv").agg(F.expr("bit_xor(x1)").alias("k1"), F.expr("bit_xor(x2)").alias("k2"), F.max("depth").alias("depth")), "whole")
    whole = convs.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"))
    whole = whole.join(end_lists(convs), list(_KEY))
    return pieces, stage(whole, "sequences")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text) of rebuilt conversations, the root among them.

    ``conversations`` has conv_id (whole numbers), turn, role and text; see :func:`rebuilt_turns`. Columns of the result:
    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty; a null turn comes before all others. Turns of one number go by role, then by a hash of
    the text; a turn given twice counts twice. Rows without conv_id take no part, further columns are not looked at. A conversation
    whose own turns are all replaced by an absent one's is the root alone. Without conversations there is no node.

    Identical conversations are one weighted sequence from the start. Sequences that are found among the proper prefixes of
    others drop out by an anti-join, what is left are leaves. What a subtree holds is summed along sequences: each node's saving is
    given to the sequence of its least member, whose total goes to all nodes on that sequence, less what lies above the node.
    """
    rebuilt = rebuilt_turns(conversations)
    pieces, whole = sequences(rebuilt)
    held = pieces.join(whole.select("conv", F.col("depth").alias("last")), "conv").select("conv", "part", "last", _before("x1", "conv", "part", "bit_xor").alias("c1"), _before("x2", "conv", "part", "bit_xor").alias("c2"))
    along = "(PARTITION BY conv, part ORDER BY depth)"
    k1, k2 = (F.expr(f"bit_xor(x{i}) OVER {along}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2))
    prefixes = rebuilt.join(held, ["conv", "part"]).select("conv", "part", "depth", "last", "chars", "x1", "x2", k1.alias("k1"), k2.alias("k2"))
    prefixes = stage(prefixes, "prefixes")

    # A prefix is proper where its sequence goes on.
    leaves = whole.join(prefixes.where("depth < last").select(*_KEY).distinct(), list(_KEY), "left_anti").select("conv", F.lit(1).alias("leaf"))
    ranked = whole.join(leaves, "conv", "left").select("conv", F.col("depth").alias("last"), "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"), "ends")
    weights = stage(pieces.join(ranked, "conv").select("conv", "part", "weight", "leaf", F.when(F.col("depth") == F.col("last"), F.col("ends")).alias("ends")), "weights")

    nodes = prefixes.join(weights, ["conv", "part"]).groupBy(*_KEY).agg(
        F.min(F.struct("conv", "part")).alias("own"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").cast("long").alias("n_leaves"),
        F.min(F.struct("chars", "x1", "x2")).alias("turn"),
        F.max(F.when(F.col("depth") == F.col("last"), F.col("ends"))).alias("ends"),
    )
    nodes = nodes.select(
        *_KEY, "own.conv", "own.part", "n_convs", "n_leaves", "ends",
        F.col("k1").bitwiseXOR(F.col("turn.x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("turn.x2")).alias("p2"), ((F.col("n_convs") - 1) * F.col("turn.chars")).alias("saved"),
    )
    nodes = stage(nodes, "nodes")

    # Savings: totals of the sequences through a node, less what its own sequence has above it.
    mine = nodes.where("saved > 0").groupBy("conv", "part").agg(F.sum("saved").alias("piece"))
    mine = stage(mine.select("conv", "part", "piece", _before("piece", "conv", "part").alias("above"), F.sum("piece").over(Window.partitionBy("conv")).alias("total")), "savings")
    through = pieces.select("conv", "part").join(mine.select("conv", "total").distinct(), "conv")
    subtree = prefixes.join(through, ["conv", "part"]).groupBy(*_KEY).agg(F.sum("total").alias("subtree"))
    above = pieces.select("conv", "part").join(whole.select("conv"), "conv").join(mine.select("conv", "part", "piece"), ["conv", "part"], "left")
    above = above.select("conv", "part", _before("piece", "conv", "part").alias("above"))
    placed = nodes.join(above, ["conv", "part"]).withColumn("above", F.col("above") + _before("saved", "conv, part", "depth"))

    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    told = placed.join(subtree, list(_KEY), "left").join(children, list(_KEY), "left")
    told = stage(told.select(*_KEY, "p1", "p2", "conv", "n_convs", "n_leaves", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (F.coalesce("subtree", F.lit(0)) - F.col("above")).alias("saved"), "ends"), "told")

    # Parents of very many children are few and broadcast; the others are joined by key.
    parents = told.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"), "n_children")
    most = told.agg(F.sum("n_children")).first()[0] or 0
    hot = parents.where(F.col("n_children") * HOT_PARENTS >= most).drop("n_children")
    cold = parents.where(F.col("n_children") * HOT_PARENTS < most).drop("n_children")
    on = ["p1", "p2", "depth"]
    known = told.join(F.broadcast(hot), on, "left")
    named = known.where("parent IS NOT NULL OR depth = 0").unionByName(known.where("parent IS NULL AND depth > 0").drop("parent").join(cold, on))
    return named.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns), crc_table
), rebuilt AS (
  SELECT c, p, r, x FROM convs JOIN turns ON conv_id = base AND p <= h
  UNION ALL
  SELECT c, p + 1000000, r, x FROM convs JOIN turns ON conv_id = c AND p > h
), whole AS (
  SELECT c, coalesce(list({'r': r, 'x': x} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), prefixes AS (
  SELECT c, d, s[:d] AS k, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends,
         (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(k[d].x) END) AS saved
  FROM prefixes GROUP BY d, k
), families AS (
  SELECT a.*, (SELECT count(*) FROM nodes b WHERE b.d = a.d + 1 AND b.k[:a.d] = a.k) AS n_children, (SELECT b.conv_id FROM nodes b WHERE a.d = b.d + 1 AND a.k[:b.d] = b.k) AS parent
  FROM nodes a
)
SELECT a.conv_id, a.d AS depth, any_value(a.parent) AS parent_conv_id, any_value(a.n) AS n_convs, any_value(a.n_children) AS n_children,
       CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, any_value(a.ends) AS ends_sha256
FROM families a JOIN families b ON b.d >= a.d AND b.k[:a.d] = a.k
GROUP BY a.d, a.k, a.conv_id
"""
