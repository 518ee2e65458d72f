"""Benchmark decontamination by greedy string tiling.

Word n-grams of the benchmark are seeds; a bounded bitmap of them picks what may match out of the documents, and a join on
the seed tells which items. Each pair of document and item is tiled: the longest match of unmarked words is found by
running Karp-Rabin hashes over windows of a length, marked, and the search repeated with shorter windows, so an item
is covered whatever the order its passages come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import _bitmap
from skyframe.llm._common import ALNUM_SEPARATOR, drop_stage, grams, lists, record_batch, small_batches, stage, table, text_chunks, whole_number_key, words

MIN_MATCH = 5
_U = np.uint64


def _seeds(name: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = grams(name, row, n)
    return h ^ _U(n), at


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles ``(doc place, item place, length)``: longest first, none overlapping in either text.

    Windows of ``s`` unmarked words are compared by running hashes; ``s`` is the longest that still matches, found by
    halving, as a match of s words holds one of s - 1.
    """
    tiles: list[tuple[int, int, int]] = []
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    high = min(len(doc), len(item))
    while high >= min_match:
        best, lo, hi = None, min_match, high
        while lo <= hi:
            s = (lo + hi + 1) // 2 if best is not None else hi if hi == high and not tiles else (lo + hi + 1) // 2
            found = _match(doc, item, free_d, free_i, s)
            if found is None:
                hi = s - 1
            else:
                best, lo = (*found, s), s + 1
        if best is None:
            break
        d, i, s = best
        free_d[d : d + s], free_i[i : i + s] = False, False
        tiles.append(best)
        high = s
    return tiles


def _running(words_: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of ``s`` unmarked words, and where they begin."""
    if len(words_) < s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = np.full(len(words_) + 1, 0x9E3779B97F4A7C15, np.uint64)
    base[0] = 1
    power = np.multiply.accumulate(base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words_ * power[:-1], dtype=np.uint64)])
    inverse = np.full(len(words_) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    at = np.arange(len(words_) - s + 1)
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = at[marked[at + s] == marked[at]]
    return (sums[at + s] - sums[at]) * inverse[at], at


def _match(doc, item, free_d, free_i, s) -> tuple[int, int] | None:
    hi, at_i = _running(item, free_i, s)
    if not len(hi):
        return None
    hd, at_d = _running(doc, free_d, s)
    order = np.argsort(hi, kind="stable")
    place = np.minimum(np.searchsorted(hi[order], hd), len(hi) - 1)
    for k in np.flatnonzero(hi[order][place] == hd):
        d, i = int(at_d[k]), int(at_i[order[place[k]]])
        if (doc[d : d + s] == item[i : i + s]).all():
            return d, i
    return None


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, min_match: int = MIN_MATCH
) -> DataFrame:
    """``(doc, tag, item, n_words, matched, n_tiles, coverage)`` of every document and item that it covers enough.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. Tiles have
    ``min_match`` words at least (the whole item where it is shorter); ``coverage`` is the share of the item's words in
    tiles, ``threshold`` at least. ``tag`` is a hash of the text and tells rows with one key apart.

    * null and empty texts and items, and those without a word: never reported. Repeated rows are one document.
    * ties between matches of one length: the first place in the document. A null key is reported as the lowest long.
    * the benchmark may have any size: its seeds go into a bounded bitmap, and what passes it is joined.
    * an empty table on either side gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    items = stage(benchmark.select(benchmark[item_key].alias("item"), benchmark[item_text].alias("text")).where("text is not null").mapInArrow(_item_words(min_match), f"item {benchmark.schema[item_key].dataType.simpleString()}, names array<long>, seeds array<long>, width int"), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # 1 to min_match
    seeds = items.select("item", F.explode("seeds").alias("seed")).distinct()
    known = _bitmap.build(seeds, F.col("seed"))
    source = docs.select(F.coalesce(whole_number_key(docs, key), F.lit(-(1 << 63))).alias("doc"), F.pmod(F.xxhash64(docs[text]), F.lit(1 << 31)).cast("int").alias("tag"), docs[text].alias("text"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in text_chunks(batch.column(2)):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                cover = np.zeros(len(name) + 1, np.int64)
                seed_row, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for n in widths:
                    h, at = _seeds(name, row, n)
                    on = np.flatnonzero(_bitmap.contains(known, h))
                    np.add.at(cover, at[on], 1)
                    np.add.at(cover, at[on] + n, -1)
                    seed_row.append(row[at[on]])
                    seed.append(h[on])
                covered = np.cumsum(cover[:-1]) > 0
                r, s = np.concatenate(seed_row), np.concatenate(seed)
                order = np.lexsort((s, r))
                r, s = r[order], s[order]
                first = np.ones(len(r), bool)
                first[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
                r, s = r[first], s[first]
                rows = np.unique(r)
                # what lies between covered words can be in no tile: one name that no word has stands for it
                on = np.flatnonzero(covered)
                gap = np.zeros(len(on), bool)
                gap[1:] = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
                kept = np.insert(name[on], np.flatnonzero(gap), np.arange(int(gap.sum())).astype(np.uint64))
                kept_row = np.insert(row[on], np.flatnonzero(gap), row[on][gap])
                yield record_batch(
                    doc=doc[i:j][rows], tag=tag[i:j][rows],
                    seeds=lists(s.view(np.int64), np.searchsorted(r, rows, "right")),
                    names=lists(kept.view(np.int64), np.searchsorted(kept_row, rows, "right")),
                )

    found = stage(source.mapInArrow(hits, "doc long, tag int, seeds array<long>, names array<long>"), "hits")
    pairs = found.select("doc", "tag", F.explode("seeds").alias("seed")).join(seeds, "seed").select("doc", "tag", "item").distinct()
    whole = found.dropDuplicates(["doc", "tag"]).select("doc", "tag", F.col("names").alias("x"))
    both = pairs.join(whole, ["doc", "tag"]).join(items.select("item", F.col("names").alias("y")), "item").select("doc", "tag", "item", "x", "y")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, matched, tiles = [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                d, i = (c.values.to_numpy().view(np.uint64) for c in (x, y))
                t = tile(d, i, min(min_match, len(i)))
                n.append(len(i))
                matched.append(sum(s for _, _, s in t))
                tiles.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), batch.column("item"), *[pa.array(c, pa.int64()) for c in (n, matched, tiles)]], ["doc", "tag", "item", "n_words", "matched", "n_tiles"]
            )

    kind = items.schema["item"].dataType.simpleString()
    scored = both.mapInArrow(tiled, f"doc long, tag int, item {kind}, n_words long, matched long, n_tiles long")
    return scored.withColumn("coverage", F.col("matched") / F.col("n_words")).where(F.col("coverage") >= threshold)


def _item_words(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                edges = np.searchsorted(row, np.arange(j - i + 1))
                rows = np.flatnonzero(np.diff(edges))
                width = np.minimum(np.diff(edges)[rows], min_match)
                seeds = [_seeds(name[edges[r] : edges[r + 1]], np.zeros(edges[r + 1] - edges[r], np.int64), int(n))[0] for r, n in zip(rows, width, strict=True)]
                yield record_batch(
                    item=batch.column(0).take(pa.array(rows + i)),
                    names=lists(name.view(np.int64), edges[rows + 1]),
                    seeds=lists(np.concatenate([*seeds, np.zeros(0, np.uint64)]).view(np.int64), np.cumsum([len(s) for s in seeds])),
                    width=width.astype(np.int32),
                )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` reports; same columns, texts are not moved."""
    bad = stage(contaminated(docs, benchmark, key=key, text=text, **options).select("doc", "tag").distinct(), "contaminated")
    flags = bad.select(F.xxhash64("doc", "tag").alias("__bad")).distinct()
    own = F.xxhash64(F.coalesce(whole_number_key(docs, key), F.lit(-(1 << 63))), F.pmod(F.xxhash64(docs[text]), F.lit(1 << 31)).cast("int"))
    mark = "__docs"
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(mark), own.alias("__bad"))
    clean, asked = _bitmap.split(named, "__bad", flags)
    return clean.unionByName(asked.join(flags, "__bad", "left_anti").select(mark, "__bad")).select(f"{mark}.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "matched", "n_tiles", "coverage")
