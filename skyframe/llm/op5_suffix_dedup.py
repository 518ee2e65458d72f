"""Removal of byte strings that were there before, by distributed prefix doubling.

Ranks of the strings that begin at a position are refined at growing lengths, and positions whose rank is unique go:

1. 32 bytes. Not every position needs one: each window of ``length`` bytes has an anchor, the 32 bytes in it with the
   least hash, and equal windows have equal anchors at equal places. Windows in a row share anchors, so these are few.
   Spark counts the anchors' ranks; unique ones go, and with them all windows around them.
2. The anchors left are sorted by the whole run of windows around them: equal runs have one first place, and the windows
   of all others are repeats.
3. The first runs go on with pairs of ranks: the anchor with the bytes to its left, and with those to its right, up to
   about twice its length. A window holds one of the two, so where both are unique the run goes.
4. ``length`` bytes: the windows that are left are ranked whole; all but the first of each rank are repeats.

Ranks are 64-bit hashes, so a round is one grouping by hash and no sorted numbering of the whole corpus is needed. Between
rounds, bounded bitmaps tell each pass over the texts which positions go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import _bitmap
from skyframe.llm._common import drop_stage, mix, powers, prefix_sums, record_batch, span_hash, small_batches, stage, table, text_chunks, whole_number_key

#: Windows that one vectorised step handles at a time.
SLICE = 1 << 20
_LOWEST = -(1 << 63)


def _slices(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes, rows with windows in them, and each one's first window, the end of its windows and its own begin there.

    Long rows come in parts; a part's places are counted from its first byte.
    """
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return
    lo, hi = offsets[rows], offsets[rows + 1] - length + 1
    for a in range(0, len(data) - length + 1, SLICE):
        b = min(a + SLICE, len(data) - length + 1)
        i, j = np.searchsorted(hi, a, "right"), np.searchsorted(lo, b)
        if i < j:
            yield data[a : b + length - 1], rows[i:j], np.maximum(lo[i:j], a) - a, np.minimum(hi[i:j], b) - a, lo[i:j] - a


def _runs(data: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Windows in a row with one anchor: their row, first place, number, and hashes."""
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    name = mix((sums[gram:] - sums[:-gram]) * powers(len(data))[1][:n])
    # the leftmost least hash: 40 bits of it, then the place
    low = name * np.uint64(0x5851F42D4C957F2D)
    low &= ~np.uint64((1 << 24) - 1)
    low |= np.arange(n, dtype=np.uint64)
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    inside = np.zeros(len(low) + 1, np.int8)
    inside[lo] += 1
    inside[hi] -= 1
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[lo] = True
    p = np.flatnonzero(new & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    at = np.searchsorted(lo, p, "right") - 1
    count = np.minimum(np.append(p[1:], len(low)), hi[at]) - p
    a = (low[p] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return {"sums": sums, "p": p, "anchor": a, "count": count, "row": rows[at], "place": p - begin[at], "name": name[a]}


def _sides(run: dict[str, np.ndarray], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the anchor with the bytes before it and after it, and which of the two a run's windows hold."""
    half = (length - gram) // 2
    p, a, last = run["p"], run["anchor"], run["p"] + run["count"] - 1
    has_left, has_right = p <= a - half, last >= a - half
    left, right = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    left[has_left] = span_hash(run["sums"], a[has_left] - half, a[has_left] + gram)
    # a window from a - half on ends at a + length - half, at the earliest
    right[has_right] = span_hash(run["sums"], a[has_right], a[has_right] + length - half) ^ np.uint64(1)
    return left, right, np.stack([has_left, has_right])


def _key(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, side: int) -> np.ndarray:
    x = mix(doc.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    x = mix(x ^ tag.astype(np.int64).view(np.uint64))
    return mix(x ^ (place.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(side)))


def _over(docs: DataFrame, length: int, gram: int, handle, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in text_chunks(batch.column(2), SLICE):
                for part in _slices(data, offsets, length):
                    runs = _runs(*part, length, gram)
                    yield handle(doc[i:j][runs["row"]], tag[i:j][runs["row"]], runs)

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (bytes left).

    A byte goes if a string of ``length`` bytes of its document covers it that also starts earlier: in a document with a
    smaller key, or before in the same document. Strings overlap, never cross documents, and are judged on the input.

    * null and empty texts, and texts shorter than ``length``: nothing goes. Very long texts are handled in slices.
    * rows with one key and different texts are ordered by a hash of the text; repeated rows count as one document, so
      each of them keeps what the document keeps. A null key comes before all others.
    * an empty table gives no rows; other columns are not read. ``length`` is 8 at least.
    """
    if length < 8:
        raise ValueError("length must be 8 at least")
    small_batches(docs.sparkSession)
    gram = max(4, length // 3 - 1)
    source = docs.select(
        F.coalesce(whole_number_key(docs, key), F.lit(_LOWEST)).alias("doc"), F.pmod(F.xxhash64(docs[text]), F.lit(1 << 31)).cast("int").alias("tag"), docs[text].cast("binary").alias("text")
    )
    long_enough = source.where(F.octet_length("text") >= length)

    # 1: anchors
    def anchors(doc, tag, runs):
        name, n = np.unique(runs["name"], return_counts=True)
        return record_batch(name=name.view(np.int64), n=n)

    again = stage(_over(long_enough, length, gram, anchors, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"), "anchors")
    known = _bitmap.build(again, F.col("name"))
    drop_stage(again)

    # 2: runs of windows around them
    def runs_of(doc, tag, runs):
        keep = np.flatnonzero(_bitmap.contains(known, runs["name"]))
        left, right, has = _sides(runs, length, gram)
        first = runs["place"]
        end = first + runs["count"] - 1 + length
        whole = span_hash(runs["sums"], runs["p"], runs["p"] + runs["count"] - 1 + length)
        # a run that the chunk itself has at an earlier place is a repeat; repeats that touch are one range
        order = keep[np.lexsort((first[keep], tag[keep], doc[keep], whole[keep]))]
        new = np.ones(len(order), bool)
        new[1:] = whole[order[1:]] != whole[order[:-1]]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = (doc[order] == doc[lead]) & (tag[order] == tag[lead]) & (first[order] == first[lead])
        asked, again = np.sort(order[same]), np.sort(order[~same])
        apart = np.ones(len(again), bool)
        apart[1:] = (runs["row"][again[1:]] != runs["row"][again[:-1]]) | (first[again[1:]] > end[again[:-1]])
        begin = np.flatnonzero(apart)
        last = again[np.append(begin[1:] - 1, len(again) - 1)] if len(again) else again
        begin = again[begin]
        both = np.concatenate([asked, begin])
        is_range = np.arange(len(both)) >= len(asked)
        return record_batch(
            run=pa.array(whole[both].view(np.int64), mask=is_range),
            doc=doc[both],
            tag=tag[both],
            start=first[both],
            n=(np.concatenate([end[asked], end[last]]) - first[both]).astype(np.int32),
            left=pa.array(left[both].view(np.int64), mask=is_range | ~has[0][both]),
            right=pa.array(right[both].view(np.int64), mask=is_range | ~has[1][both]),
        )

    runs = stage(_over(long_enough, length, gram, runs_of, "run long, doc long, tag int, start long, n int, left long, right long"), "runs")
    place = F.struct("doc", "tag", "start")
    firsts = stage(
        runs.where("run is not null").groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.max("left").alias("left"), F.max("right").alias("right")), "firsts"
    )
    span = ["doc", "tag", "start", (F.col("start") + F.col("n")).alias("end")]
    repeated = runs.where("run is not null").select("run", "doc", "tag", "start", "n").join(firsts.where("times > 1").select("run", "first"), "run")
    later = repeated.where(place != F.col("first")).select(*span).unionByName(runs.where("run is null").select(*span))

    # 3: pairs of ranks, of first runs alone
    sides = firsts.select(F.col("first.*"), F.posexplode(F.array("left", "right")).alias("side", "rank")).where("rank is not null")
    shared = sides.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    going_on = stage(sides.join(shared, "rank").select("doc", "tag", "start", "side").mapInArrow(_keys, "key long"), "sides")
    asked = _bitmap.build(going_on, F.col("key"))
    drop_stage(going_on)

    earlier = stage(later, "later")
    drop_stage(runs, firsts)

    # 4: whole windows
    def windows(doc, tag, runs):
        half = (length - gram) // 2
        out = []
        for side in (0, 1):
            on = np.flatnonzero(_bitmap.contains(known, runs["name"]) & _bitmap.contains(asked, _key(doc, tag, runs["place"], side)))
            first, last = runs["p"][on], runs["p"][on] + runs["count"][on] - 1
            a = runs["anchor"][on]
            lo, hi = (first, np.minimum(last, a - half)) if side == 0 else (np.maximum(first, a - half), last)
            n = np.maximum(hi - lo + 1, 0)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((np.repeat(on, n), at))
        which, at = np.concatenate([out[0][0], out[1][0]]), np.concatenate([out[0][1], out[1][1]])
        return record_batch(
            window=span_hash(runs["sums"], at, at + length).view(np.int64), doc=doc[which], tag=tag[which], start=at - runs["p"][which] + runs["place"][which]
        )

    ranked = stage(_over(long_enough, length, gram, windows, "window long, doc long, tag int, start long"), "windows")
    # dealt by range, so that one rank may fill many tasks; whether a task begins within a rank, the tasks' ends tell
    by = ["window", "doc", "tag", "start"]
    told = ranked.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_told, "kind int, window long, doc long, tag int, start long, lead_doc long, lead_tag int, lead_start long")
    begins, ends = told.where("kind = 1"), told.where("kind = 2").select("window", F.struct("lead_doc", "lead_tag", "lead_start").alias("lead"))
    cut_off = begins.join(ends.groupBy("window").agg(F.min("lead").alias("lead")), "window").where(F.struct("doc", "tag", "start") != F.col("lead"))
    repeats = told.where("kind = 0").select("doc", "tag", "start").unionByName(cut_off.select("doc", "tag", "start")).select("doc", "tag", "start", (F.col("start") + length).alias("end"))

    spans = stage(earlier.unionByName(repeats).groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found")).mapInArrow(_merge, "doc long, tag int, spans array<struct<start:long,end:long>>"), "spans")
    drop_stage(earlier, ranked)
    touched = _bitmap.build(spans.select("doc", "tag").mapInArrow(_doc_keys, "key long"), F.col("key"))

    @F.arrow_udf("boolean")
    def may_be_touched(doc: pa.Array, tag: pa.Array) -> pa.Array:
        d = doc.to_numpy()
        return pa.array(_bitmap.contains(touched, _key(d, tag.to_numpy(), np.zeros(len(d), np.int64), 0)))

    kind = docs.schema[key].dataType.simpleString()
    marked = docs.select(
        docs[key].alias("key"), F.coalesce(whole_number_key(docs, key), F.lit(_LOWEST)).alias("doc"), F.pmod(F.xxhash64(docs[text]), F.lit(1 << 31)).cast("int").alias("tag"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text")
    ).withColumn("touched", may_be_touched("doc", "tag"))
    whole = marked.where(~F.col("touched")).select("key", F.col("text").alias("kept"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.octet_length("text").cast("long").alias("n_bytes"))
    cut = marked.where("touched").join(spans, ["doc", "tag"], "left").select("key", "text", "spans").mapInArrow(_cut, f"key {kind}, kept binary, spans array<struct<start:long,end:long>>, n_bytes long")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return whole.unionByName(cut).select(F.col("key").alias(key), "n_bytes", F.coalesce("spans", none).alias("spans"), "kept")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tag, start, side = (batch.column(c).to_numpy() for c in range(4))
        key = np.where(side == 0, _key(doc, tag, start, 0), _key(doc, tag, start, 1))
        yield record_batch(key=key.view(np.int64))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by rank and place: (0) those not at their rank's first place in this task, (1) those of the first
    rank that are, as the rank may have begun before, and (2) the last rank with its first place here."""
    lead, first = None, None
    for batch in batches:
        window, doc, tag, start = (batch.column(c).to_numpy() for c in range(4))
        n = len(window)
        if not n:
            continue
        first = window[0] if first is None else first
        new = np.ones(n, bool)
        new[1:] = window[1:] != window[:-1]
        new[0] = lead is None or lead[0] != window[0]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        heads = [np.where(at < 0, lead[k] if lead else 0, c[np.maximum(at, 0)]) for k, c in ((1, doc), (2, tag), (3, start))]
        same = (doc == heads[0]) & (tag == heads[1]) & (start == heads[2])
        lead = (window[-1], *(h[-1] for h in heads))
        for kind, on in ((0, np.flatnonzero(~same)), (1, np.flatnonzero(same & (window == first)))):
            if len(on):
                yield _kind(kind, window[on], doc[on], tag[on], start[on], *(h[on] for h in heads))
    if lead is not None:
        yield _kind(2, *([x] for x in (*lead, *lead[1:])))


def _kind(kind: int, window, doc, tag, start, lead_doc, lead_tag, lead_start) -> pa.RecordBatch:
    big, small = pa.int64(), pa.int32()
    columns = ((np.full(len(window), kind), small), (window, big), (doc, big), (tag, small), (start, big), (lead_doc, big), (lead_tag, small), (lead_start, big))
    names = ["kind", "window", "doc", "tag", "start", "lead_doc", "lead_tag", "lead_start"]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in columns], names)


def _doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        yield record_batch(key=_key(doc, tag, np.zeros(len(doc), np.int64), 0).view(np.int64))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of each document to their unions."""
    for batch in batches:
        out = []
        for found in batch.column("found"):
            start, end = (found.values.field(k).to_numpy() for k in (0, 1))
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(start[new], reach[np.append(new[1:] - 1, len(start) - 1)], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(out, _SPANS)], ["doc", "tag", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data = text.as_buffer().to_pybytes()
            at, parts = 0, []
            for s in spans.as_py() or ():
                parts.append(data[at : s["start"]])
                at = s["end"]
            parts.append(data[at:])
            kept.append(b"".join(parts))
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(kept, pa.binary()), batch.column("spans"), pa.array(sizes, pa.int64())], ["key", "kept", "spans", "n_bytes"]
        )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
