"""N-gram Jaccard join by signature trees.

Every document becomes a set of hashed word shingles; equal sets are one from then on. Two sets as similar as asked for
must share one of the few first shingles of each (all sets sorted alike), so sets meet by these. Among the sets that
meet, a signature tree decides: its leaves hold bitmaps of whole sets, its nodes the OR of their bitmaps and their range
of sizes, and a dual traversal leaves out pairs of nodes whose largest possible overlap is too small. What is left is
verified on whole sets. Links are looked for first between sets with the same first shingle, from each to a pivot of its
group; then between all sets of a group that are not connected yet. Groups with very many such pairs are linked by their
pivots once more. What is left of these meets with its whole sets, so that a group is searched where it lies and hands on
no pairs but links that connect what was not connected: fewer than it has members. So large groups of near copies cost
about one verification for each member, and most of their other groups are never built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import _bitmap as bitmaps
from skyframe.llm._common import drop_stage, grams, lists, mix, record_batch, small_batches, stage, table, temporary, text_chunks, words
from skyframe.llm._graph import components

#: A shingle that more sets than this (and a 100,000th of all) would be found by is moved to the end of the order.
HOT_SETS = 1_000
#: Groups with more members are dealt out as pairs of blocks.
BLOCK_SETS = 8_192
LEAF, FAN = 16, 4
#: A group with more pairs than this for each member is linked by its pivots before its whole sets are compared.
MANY_PAIRS = 16
#: Shingles of a group whose whole sets lie in a task at a time, beside bitmaps of half their bytes.
BLOCK_SHINGLES = 2_000_000
#: A bitmap takes the place of so many shingles at least.
LEAST_SHINGLES = 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle names of every row; a text of fewer than ``n`` words is one shingle, one without none."""
    rows = len(offsets) - 1
    _, _, row, name = words(data, offsets)
    edges = np.searchsorted(row, np.arange(rows + 1))
    whole, at = grams(name, row, n)
    first = np.searchsorted(at, edges)
    for r in range(rows):
        a, b = edges[r], edges[r + 1]
        if b - a >= n:
            yield np.unique(whole[first[r] : first[r + 1]])
        elif b > a:
            x = np.uint64(b - a)
            for w in name[a:b]:
                x = mix(np.array([x ^ w]))[0]
            yield np.array([x], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _prefix(s: np.ndarray, hot: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of which a partner of any size must have one: all but ceil(t * n) - 1 in the common order."""
    p = len(s) - -(-num * len(s) // den) + 1
    if len(hot) and len(s):
        place = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[place] == s
        if is_hot.any():
            s = np.concatenate([s[~is_hot], s[is_hot]])
    return s[:p]


def _bitmap(s: np.ndarray, wide: int = 2) -> bytes:
    """A power of two of bits, ``wide`` times as many as shingles at least: shingle x sets bit x modulo their number."""
    size = max(512, 1 << (wide * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _over(docs: DataFrame, handle, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                yield handle(batch.column(0).slice(i, j - i), data, offsets)

    return docs.mapInArrow(run, schema)


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_shingles`` and ``component_id``.

    Two documents link when intersection / union of their sets of ``n``-word shingles is at least the threshold (a
    fraction of whole numbers). ``component_id`` is the smallest key reachable by links, the document itself included.

    * null and empty texts and texts without a word: no shingles, no links, their own component.
    * texts with fewer than ``n`` words: their whole sequence is the one shingle.
    * repeated rows are copies of each other; ties do not arise, as components do not depend on an order.
    * a null key takes part; a component of null keys alone has a null id. An empty table gives no rows.
    * other columns, whatever their names, are not read; very long texts are handled one at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    num, den = threshold
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def firsts(keys, data, offsets):
        out = [_prefix(s, np.zeros(0, np.uint64), num, den) for s in shingle_sets(data, offsets, n)]
        token, times = np.unique(np.concatenate([*out, np.zeros(0, np.uint64)]), return_counts=True)
        return record_batch(token=token.view(np.int64), n=times)

    with temporary() as keep:
        counted = _over(source, firsts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        sizes = stage(counted.where(F.col("n") > HOT_SETS), "hot")
        totals = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
        # at most 100,000 shingles, whatever the corpus
        hot = np.sort(sizes.where(F.col("n") > totals / 100_000).select("token").toArrow().column("token").to_numpy().view(np.uint64)) if totals else np.zeros(0, np.uint64)
        shared_hot = spark.sparkContext.broadcast(hot)

        def describe(keys, data, offsets):
            sets = list(shingle_sets(data, offsets, n))
            prefixes = [_prefix(s, shared_hot.value, num, den) if len(s) else s for s in sets]
            return record_batch(
                key=keys,
                n=np.array([len(s) for s in sets], np.int64),
                set_id=np.array([_set_id(s) for s in sets], np.int64),
                bits=pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()),
                prefix=lists(np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64), np.cumsum([len(p) for p in prefixes])),
            )

        described = stage(_over(source, describe, f"key {kind}, n long, set_id long, bits binary, prefix array<long>"), "sets")
        by_set = described.where("n > 0").groupBy("set_id").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
        sets = stage(by_set, "distinct")

        links = _links(source, sets, n, num, den)
        roots = components(links) if links is not None else None

        least = sets.select("set_id", F.col("key").alias("least"))
        if roots is not None:
            rooted = least.join(roots, least["set_id"] == roots["node"], "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
            smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
            least = rooted.join(smallest, "root").select("set_id", "component_id")
        else:
            least = least.withColumnRenamed("least", "component_id")
        found = stage(least, "components")
        keep(described, found)
    joined = described.where("n > 0").select("key", "n", "set_id").join(found, "set_id", "left").select("key", "n", "component_id")
    none = described.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return joined.unionByName(none).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _rooted(sets: DataFrame, links: DataFrame | None, *columns: str) -> DataFrame:
    """``columns`` and ``root``: what a set is connected to by now, null where it is alone."""
    if links is None:
        return sets.select("set_id", *columns, F.lit(None).cast("long").alias("root"))
    roots = components(links)
    return sets.join(roots, sets["set_id"] == roots["node"], "left").select("set_id", *columns, "root")


def _meetings(rooted: DataFrame, num: int, den: int) -> DataFrame:
    """``(gid, set_id)``: groups of sets that share a prefix shingle and are not all connected; equal groups are given once.

    A group ends where the next size is too large for the size before it: no link crosses such a step.
    """
    rows = rooted.select("set_id", "n", "root", F.explode("prefix").alias("token")).repartition("token").sortWithinPartitions("token", "n", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, size, seen = None, 0, set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def ended() -> pa.RecordBatch | None:
            nonlocal held
            members, roots = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
            held = []
            if len(members) < 2 or (roots == roots[0]).all():
                return None
            members = np.unique(members)
            gid = _set_id(members.view(np.uint64))
            if gid in seen:
                return None
            if len(seen) < 500_000:
                seen.add(gid)
            return record_batch(gid=np.full(len(members), gid, np.int64), set_id=members)

        for batch in batches:
            tokens, ids, sizes = (batch.column(c).to_numpy() for c in ("token", "set_id", "n"))
            roots = pc.coalesce(batch.column("root"), batch.column("set_id")).to_numpy()
            if not len(tokens):
                continue
            step = (tokens[1:] != tokens[:-1]) | (sizes[:-1] * den < sizes[1:] * num)
            edges = np.concatenate([[0], np.flatnonzero(step) + 1, [len(tokens)]])
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a or tokens[a] != token or size * den < sizes[a] * num:
                    out.append(ended())
                held.append((ids[a:b].copy(), roots[a:b]))
            token, size = tokens[-1], int(sizes[-1])
            yield from _joined(out)
        yield from _joined([ended()])

    return rows.select("token", "set_id", "n", "root").mapInArrow(run, "gid long, set_id long").dropDuplicates(["gid", "set_id"])


def _joined(batches: list[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    some = [b for b in batches if b is not None]
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _links(source: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """Verified links that connect all sets which links connect; None without any."""
    links = None

    def verify(members: DataFrame, mode: str) -> DataFrame:
        """The groups that have been left for later."""
        nonlocal links
        pairs = stage(_candidates(members, num, den, mode), "pairs")
        more = _verified(source, sets, pairs.where("b is not null"), n, num, den)
        links = more if links is None else links if more is None else links.unionByName(more)
        return pairs.where("b is null").select(F.col("a").alias("gid"))

    verify(_first_groups(sets), "pivots")
    groups = stage(_meetings(_rooted(sets, links, "n", "prefix"), num, den), "groups")
    if groups.isEmpty():
        return links
    known = _rooted(stage(_dealt(groups, sets), "dealt"), links, "gid", "n", "bits")
    left = verify(known.withColumn("root", F.coalesce("root", "set_id")), "few")
    done = groups
    groups = stage(known.join(left, "gid", "left_semi").select("gid", "set_id"), "groups")
    drop_stage(done)
    if groups.isEmpty():
        return links
    more = stage(_linking(source, sets, _rooted(groups.join(sets.select("set_id", "n"), "set_id"), links, "gid", "n"), n, num, den), "links")
    return more if links is None else links.unionByName(more)


def _first_groups(sets: DataFrame) -> DataFrame:
    """Every set in the group of its first shingle. Large groups come in blocks: what these miss is found later."""
    first = sets.select(F.get("prefix", F.lit(0)).alias("gid"), "set_id", "n", "bits", F.col("set_id").alias("root"))
    large = stage(first.groupBy("gid").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_SETS), "large")
    if large.isEmpty():
        return first
    block = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("m") / (BLOCK_SETS // 2))).cast("int")
    return first.join(large, "gid", "left").withColumn("gid", F.when(F.col("m").isNull(), F.col("gid")).otherwise(F.xxhash64("gid", block))).drop("m")


def _dealt(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Groups with their members' sizes and bitmaps; the large ones as all pairs of blocks of a bounded size."""
    return _in_blocks(groups, F.count("*"), BLOCK_SETS).join(sets.select("set_id", "n", "bits"), "set_id").select("gid", "set_id", "n", "bits")


def _in_blocks(groups: DataFrame, weight: Column, most: int) -> DataFrame:
    """``(gid, set_id)``: groups of at most ``most`` by ``weight`` as they are, the others as all pairs of blocks of half of that."""
    large = groups.groupBy("gid").agg(weight.alias("m")).where(F.col("m") > most)
    blocks = F.ceil(F.col("m") / (most // 2)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    split = (
        groups.join(large, "gid")
        .select("gid", "set_id", own.alias("own"), other.alias("other"))
        .select(F.xxhash64("gid", F.least("own", "other"), F.greatest("own", "other")).alias("gid"), "set_id")
        .distinct()
    )
    return groups.join(large, "gid", "left_anti").select("gid", "set_id").unionByName(split)


def _linking(source: DataFrame, sets: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` within groups ``(gid, set_id, n, root)``, compared by whole sets.

    A group gives a link only where it connects two roots that its links before have not: one less than it has roots at most.
    """
    whole = _whole_sets(source, sets, members.select("set_id").distinct(), n)
    blocks = _in_blocks(members.select("gid", "set_id", "n"), F.sum(F.greatest("n", F.lit(LEAST_SHINGLES))), BLOCK_SHINGLES)
    known = members.select("set_id", "n", F.coalesce("root", "set_id").alias("root")).distinct().join(whole, "set_id")
    dealt = blocks.join(known, "set_id").repartition("gid").sortWithinPartitions("gid", "n", "set_id").select("gid", "set_id", "n", "root", "names")

    def linked(part: pa.Table) -> pa.RecordBatch | None:
        ids, size, root = (part.column(c).to_numpy() for c in ("set_id", "n", "root"))
        if (root == root[0]).all():
            return None
        names = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("names")]
        label, a, b = root.copy(), [], []
        for i, j in tree_pairs(size, [_bitmap(s, 16) for s in names], root, num, den):
            open_ = label[i] != label[j]
            for p, q in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
                if label[p] != label[q] and _alike(names[p], names[q], num, den):
                    a.append(min(ids[p], ids[q]))
                    b.append(max(ids[p], ids[q]))
                    label[label == label[p]] = label[q]
        return record_batch(a=np.array(a, np.int64), b=np.array(b, np.int64))

    return _by_group(dealt, linked, "a long, b long").distinct()


def _by_group(dealt: DataFrame, handle, schema: str) -> DataFrame:
    """``handle`` of each group of two rows or more as a table; rows of a group follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held = None, []

        def ended() -> pa.RecordBatch | None:
            nonlocal held
            part, held = held, []
            return handle(pa.Table.from_batches(part).combine_chunks()) if sum(b.num_rows for b in part) > 1 else None

        for batch in batches:
            gids = batch.column("gid").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(gids[1:] != gids[:-1]) + 1, [len(gids)]]) if len(gids) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if gids[a] != gid:
                    out.append(ended())
                    gid = gids[a]
                held.append(batch.slice(a, b - a))
            yield from _joined(out)
        yield from _joined([ended()])

    return dealt.mapInArrow(run, schema)


def _candidates(members: DataFrame, num: int, den: int, mode: str) -> DataFrame:
    """Pairs ``(a, b)`` within groups that the signature tree cannot rule out and whose roots differ.

    ``pivots``: of each group only the pairs with its middle, the member nearest to what most bitmaps hold, and with its
    first member by an order of its own. ``few``: all pairs, but of a group with very many the pivots' ones and a row
    ``(gid, null)``.
    """
    dealt = members.repartition("gid").sortWithinPartitions("gid", "n", "set_id").select("gid", "set_id", "n", "bits", "root")

    def met(part: pa.Table) -> pa.RecordBatch:
        ids, size, root = (part.column(c).to_numpy() for c in ("set_id", "n", "root"))
        bits = part.column("bits").to_pylist()
        pairs, found, later = [], 0, mode == "pivots"
        for p in () if later or (root == root[0]).all() else tree_pairs(size, bits, root, num, den):
            pairs.append(p)
            found += len(p[0])
            if later := found > MANY_PAIRS * part.num_rows:
                break
        if later:
            pairs = list(tree_pairs(size, bits, root, num, den, _pivots(ids, bits)))
        left = [part.column("gid")[0].as_py()] if later and mode == "few" else []
        i, j = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in pairs]]) for k in (0, 1))
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return record_batch(a=np.concatenate([a, np.array(left, np.int64)]), b=pa.array([*b.tolist(), *[None] * len(left)], pa.int64()))

    return _by_group(dealt, met, "a long, b long").distinct()


def _pivots(ids: np.ndarray, bits: list[bytes]) -> np.ndarray:
    widths = np.array([len(b) for b in bits])
    at = np.flatnonzero(widths == np.bincount(widths).argmax())
    rows = np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), -1)
    step = max(1, (1 << 20) // rows.shape[1])  # few rows are unpacked at a time
    held = sum(np.unpackbits(rows[k : k + step], axis=1).sum(axis=0, dtype=np.int32) for k in range(0, len(at), step))
    most = np.packbits(2 * held > len(at))
    near = 2 * np.bitwise_count(rows & most).sum(axis=1, dtype=np.int64) - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    return np.unique([int(at[near.argmax()]), int(ids.argmin())])


def tree_pairs(size: np.ndarray, bits: list[bytes], root: np.ndarray, num: int, den: int, pivots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that may reach the threshold, by dual traversal of the signature trees of each width of bitmap.

    Sets that may link have sizes within the threshold, so their bitmaps are as wide or one step apart; the wider one is
    folded to the other's width by OR-ing its parts.
    """
    widths = np.array([len(b) for b in bits])
    by_width = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    rows = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w // 8) for w, at in by_width.items()}
    for w, at in by_width.items():
        for other in by_width:
            if other < w or other > w * 2 * den // num:
                continue
            folded = rows[other]
            while folded.shape[1] > w // 8:
                half = folded.shape[1] // 2
                folded = folded[:, :half] | folded[:, half:]
            left, right = (at, rows[w], _bits(rows[w])), (by_width[other], folded, _bits(folded))
            if pivots is None:
                yield from _dual(left, right, size, root, num, den, other == w)
                continue
            for mine, theirs in ((left, right), (right, left)):
                for p in np.flatnonzero(np.isin(mine[0], pivots)):
                    j = np.arange(len(theirs[0]))
                    i = np.full(len(j), p)
                    keep = _may_link(mine, theirs, i, j, size, root, num, den)
                    yield mine[0][i[keep]], theirs[0][j[keep]]
                if other == w:
                    break


def _bits(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(axis=1, dtype=np.int64)


def _bits_in_both(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common bits of the rows ``i`` of x and ``j`` of y, of so many pairs at a time that they take a few megabytes."""
    out = np.zeros(len(i), np.int64)
    step = max(1, (1 << 19) // x.shape[1])
    for k in range(0, len(i), step):
        out[k : k + step] = _bits(x[i[k : k + step]] & y[j[k : k + step]])
    return out


def _may_link(left, right, i, j, size, root, num, den) -> np.ndarray:
    """Every bit that one set has and the other lacks stands for a shingle, at least, outside the overlap."""
    nx, ny = size[left[0][i]], size[right[0][j]]
    overlap = np.minimum(nx - left[2][i], ny - right[2][j]) + _bits_in_both(left[1], right[1], i, j)
    overlap = np.minimum(overlap, np.minimum(nx, ny))
    return (overlap * (num + den) >= num * (nx + ny)) & (root[left[0][i]] != root[right[0][j]])


class _Tree:
    """Levels from leaves to the root: OR of bitmaps, least size, the largest size less its bits, the root they share."""

    def __init__(self, at: np.ndarray, bits: np.ndarray, size: np.ndarray, root: np.ndarray):
        edges = np.arange(0, len(at), LEAF)
        count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        n = size[at]
        level = [
            np.bitwise_or.reduceat(bits, edges, axis=0),
            np.minimum.reduceat(n, edges),
            np.maximum.reduceat(n, edges),
            np.maximum.reduceat(n - count, edges),
            np.minimum.reduceat(root[at], edges),
            np.maximum.reduceat(root[at], edges),
        ]
        self.levels = [level]
        while len(level[0]) > 1:
            e = np.arange(0, len(level[0]), FAN)
            level = [f.reduceat(x, e, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level, strict=True)]
            self.levels.append(level)


def _dual(left, right, size, root, num, den, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a = _Tree(*left[:2], size, root)
    b = a if same else _Tree(*right[:2], size, root)
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        x, y = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        both = _bits_in_both(x[0], y[0], i, j)
        overlap = np.minimum(np.minimum(x[3][i], y[3][j]) + both, np.minimum(x[2][i], y[2][j]))
        keep = overlap * (num + den) >= num * (x[1][i] + y[1][j])
        keep &= (x[2][i] * den >= y[1][j] * num) & (y[2][j] * den >= x[1][i] * num)
        keep &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        step = LEAF if not level else FAN
        na = len(left[0]) if not level else len(a.levels[min(level - 1, len(a.levels) - 1)][1])
        nb = len(right[0]) if not level else len(b.levels[min(level - 1, len(b.levels) - 1)][1])
        for s in range(0, len(i), 4_096):
            ci = _children(i[s : s + 4_096], step, na, level and level >= len(a.levels))
            cj = _children(j[s : s + 4_096], step, nb, level and level >= len(b.levels))
            u = np.repeat(ci, cj.shape[1], axis=1).ravel()
            v = np.tile(cj, (1, ci.shape[1])).ravel()
            ok = (u >= 0) & (v >= 0) & ((u < v) | (bool(level) & (u == v)) if same else True)
            u, v = u[ok], v[ok]
            if level:
                stack.append((level - 1, u, v))
            elif len(u):
                found = _may_link(left, right, u, v, size, root, num, den)
                yield left[0][u[found]], right[0][v[found]]


def _children(nodes: np.ndarray, step: int, n: int, stays: bool) -> np.ndarray:
    if stays:  # a lower tree waits at its root
        return nodes[:, None]
    c = nodes[:, None] * step + np.arange(step)
    return np.where(c < n, c, -1)


def _verified(source: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """The pairs that reach the threshold by their whole sets."""
    whole = _whole_sets(source, sets, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), n)
    if whole is None:
        return None
    left = whole.select(F.col("set_id").alias("a"), F.col("names").alias("x"))
    right = whole.select(F.col("set_id").alias("b"), F.col("names").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stage(pairs.join(left, "a").join(right, "b").mapInArrow(check, "a long, b long"), "links")
    drop_stage(whole)
    return None if links.isEmpty() else links


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return den * both >= num * (len(x) + len(y) - both)


def _whole_sets(source: DataFrame, sets: DataFrame, ids: DataFrame, n: int) -> DataFrame | None:
    """``(set_id, names)`` of all ``ids`` and some others, taken anew from the text of one document each; None without any."""
    keys = stage(sets.select("set_id", F.xxhash64("key").alias("key")).join(ids, "set_id", "left_semi").select("key").distinct(), "asked")
    if keys.isEmpty():
        return None
    asked = bitmaps.build(keys, F.col("key"))
    drop_stage(keys)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(bitmaps.contains(asked, batch.column(0).to_numpy())))
            for _, _, data, offsets in text_chunks(some.column(1)):
                found = [s for s in shingle_sets(data, offsets, n) if len(s)]
                yield record_batch(set_id=np.array([_set_id(s) for s in found], np.int64), names=pa.array([s.tobytes() for s in found], pa.binary()))

    texts = source.select(F.xxhash64("key").alias("key"), "text")
    return stage(texts.mapInArrow(wanted, "set_id long, names binary").groupBy("set_id").agg(F.first("names").alias("names")), "names")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold=(90, 100))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, n.n
"""
