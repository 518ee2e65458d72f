"""Fuzzy repeated passages by collinear chaining of shared word k-mers.

Documents share a passage where they share k-mers in the same order. Of every few k-mers one is taken, by its hash, so
equal passages give equal seeds. Seeds that only one place has go first, and so do seeds too lonely for a passage. Every
other occurrence is matched with the seed's first one, not with all, so a passage that thousands of documents share costs
one match per occurrence. The matches of two documents are merged along diagonals, chained with gap costs through a
Fenwick tree, and the chains are aligned word by word.

The first owner of a seed need not be the owner of the passage around it. So occurrences that no passage covers by
then are matched once more, two at a time that are as far apart as in a passage, with the first document that has both.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm import _bitmap
from skyframe.llm._common import drop_stage, grams, lists, mix, record_batch, settled, small_batches, stage, table, text_chunks, whole_number_key, words

K, WINDOW = 6, 10
#: Words in both documents together that one gap in a chain may have.
MAX_GAP = 60
#: Per word of a gap in either document: the longest gap costs what one seed earns.
GAP_COST = K / MAX_GAP
#: Seeds that 45 words in a row have at least, as seeds are WINDOW words apart at most.
SEEDS = 4
#: Words looked at beyond a chain's ends: the next number, and last whole texts, where an alignment gets far.
MARGINS = (64, 1024, 1 << 30)
#: Matched words that the growth of an end may fall behind its best: six words in a row that differ on both sides.
DROP = 24


def _seeds(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-mers that are the leftmost least of some WINDOW k-mers in a row; all of them where a row has fewer.

    A k-mer that comes again at once, as in a word said fifty times, counts its repeats: so two such runs match in order.
    """
    h, at = _chosen(name, row)
    return _numbered(h, at, row), at


def _numbered(h: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    order = np.lexsort((at, h, row[at]))
    x, p, r = h[order], at[order], row[at[order]]
    again = np.zeros(len(h), bool)
    again[1:] = (x[1:] == x[:-1]) & (r[1:] == r[:-1]) & (p[1:] - p[:-1] <= 2 * WINDOW)
    number = np.arange(len(h)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(h)))) if len(h) else np.zeros(0, np.int64)
    h = h.copy()
    h[order] = np.where(number > 0, mix(x + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), x)
    return h


def _chosen(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, at = grams(name, row, K)
    if not len(h):
        return h, at
    low = mix(h ^ np.uint64(0x2545F4914F6CDD1D)) & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
    r = row[at]
    if len(h) < WINDOW:
        return h, at
    best = low[: len(low) - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        best = np.minimum(best, low[k : k + len(best)])
    inside = r[: len(best)] == r[WINDOW - 1 :]
    chosen = np.zeros(len(h), bool)
    chosen[(best[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)] = True
    per_row = np.bincount(r)
    chosen |= per_row[r] < WINDOW
    return h[chosen], at[chosen]


def _doc_key(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) ^ tag.astype(np.int64).view(np.uint64))


def _over(docs: DataFrame, handle, schema: str, only=None) -> DataFrame:
    """``handle(doc, tag, row, place, name)`` of each chunk's words; ``place`` is a word's number in its row.

    ``only``: a bitmap of documents; the words of others are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(_bitmap.contains(only, _doc_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()))))
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, offsets in text_chunks(batch.column(2)):
                _, _, row, name = words(data, offsets)
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(j - i))[row] if len(row) else row
                yield handle(doc[i:j], tag[i:j], row, place, name)

    return docs.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 45, similarity: float = 0.8) -> DataFrame:
    """``(doc, tag, start, end, source, source_start, source_end, matched, similarity)``: passages that came before.

    ``doc`` and ``source`` are keys (whole numbers), ``start`` and ``end`` numbers of words (runs of characters that are no
    ASCII white space, A-Z lower-cased). The source is a document with a smaller key. At least ``min_words`` words of a
    passage match words of the source in order, and these are at least ``similarity`` of the longer side. A document
    that repeats a passage is named with a source of it, not with each of its sources. Not found are passages whose
    seeds, one by one, come first from documents that are not alike enough themselves, if fewer than four within some forty
    words are left whole outside of what other passages cover, or if these, two by two, come first from such documents too. ``tag`` tells rows with
    one key and different texts apart.

    * null, empty and short texts have no passages; repeated rows are one document; a null key comes before all others.
    * passages inside one document only are not looked for. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = _identified(docs, key, text)
    near, far = _pair_range(min_words)

    def all_seeds(doc, tag, row, place, name):
        plain, at = _chosen(name, row)
        h = _numbered(plain, at, row)
        h, n = np.unique(np.concatenate([h, plain[h != plain]]), return_counts=True)
        return record_batch(seed=h.view(np.int64), n=n)

    again = stage(_over(source, all_seeds, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed"), "seeds")
    known = _bitmap.build(again, F.col("seed"))
    drop_stage(again)

    def places(doc, tag, row, place, name):
        h, at = _seeds(name, row)
        keep = np.flatnonzero(_bitmap.contains(known, h))
        h, at = h[keep], at[keep]
        # seeds with no other one near enough to make a passage with
        on = _in_stretch(row[at], place[at], near)
        h, at = h[on], at[on]
        ends = np.searchsorted(row[at], np.arange(len(doc)), "right")
        some = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
        return record_batch(doc=doc[some], tag=tag[some], seed=lists(h.view(np.int64), ends[some]), pos=lists(place[at].astype(np.int32), ends[some]))

    marks = stage(_over(source, places, "doc long, tag int, seed array<long>, pos array<int>"), "marks")
    seeds = marks.select("doc", "tag", F.explode(F.arrays_zip("seed", "pos")).alias("x")).select("doc", "tag", "x.seed", "x.pos")
    first = seeds.groupBy("seed").agg(F.min(F.struct("doc", "tag", "pos")).alias("f"))
    other = (F.col("doc") != F.col("f.doc")) | (F.col("tag") != F.col("f.tag"))
    owner = [F.col("f.doc").alias("source"), F.col("f.tag").alias("source_tag")]
    matches = settled(seeds.join(first, "seed").where(other).select("doc", "tag", *owner, "pos", F.col("f.pos").alias("source_pos")), "matches")
    chains = settled(_chains(matches, min_words), "chains")
    found = _aligned(source, chains.where("main"), similarity, min_words)

    spans = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = F.exists("spans", lambda s: (s["start"] <= F.col("pos")) & (s["end"] >= F.col("pos") + K))
    left = matches.select("doc", "tag", "pos").join(spans, ["doc", "tag"], "left").where(~F.coalesce(covered, F.lit(False))).select("doc", "tag", "pos")
    open_ = _bitmap.build(left.mapInArrow(_occurrences, "key long"), F.col("key"))
    drop_stage(matches)

    def asked(doc, tag, row, seed, pos):
        on = np.flatnonzero(_bitmap.contains(open_, _occurrence(doc[row], tag[row], pos)))
        on = on[_crowded(row[on], pos[on], far)]
        pair, i, j = _pairs(row[on], seed[on], pos[on], near, far)
        return pair, on[i], on[j]

    asking = settled(_marked(marks, asked), "asking")
    wanted = _bitmap.build(asking.select("pair").distinct(), F.col("pair"))

    def offered(doc, tag, row, seed, pos):
        return _pairs(row, seed, pos, near, far, wanted)

    first = _marked(marks, offered).groupBy("pair").agg(F.min(F.struct("doc", "tag", "a", "b")).alias("f"))
    both = asking.join(first, "pair").where(other)
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("pos"), F.col(f"f.{c}").alias("source_pos")) for c in "ab"])).alias("x")
    more = settled(_chains(both.select("doc", "tag", *owner, ends).select("doc", "tag", "source", "source_tag", "x.pos", "x.source_pos").distinct(), min_words), "chains")
    # what lay within a longer chain, if that has come to nothing
    within = F.exists("spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")))
    shorter = chains.where("not main").join(spans, ["doc", "tag"], "left").where(~F.coalesce(within, F.lit(False))).drop("spans")
    # growth need not go far into what is covered
    ends = F.transform(F.filter("spans", lambda s: s["start"] < F.col("start")), lambda s: s["end"])
    begins = F.transform(F.filter("spans", lambda s: s["end"] > F.col("end")), lambda s: s["start"])
    again = more.unionByName(shorter).join(spans, ["doc", "tag"], "left").withColumns({"lo": F.greatest("lo", F.array_max(ends)), "hi": F.least("hi", F.array_min(begins))})
    rest = _aligned(source, again.drop("spans"), similarity, min_words)
    parts = stage(found.unionByName(rest), "passages")
    joined = _aligned(source, _joined(parts), similarity, min_words)
    out = stage(_outermost(parts.unionByName(joined)).drop("source_tag"), "passages")
    drop_stage(found, rest, asking, marks, chains, more, parts, joined)
    return out


_PAIR = ["doc", "tag", "source", "source_tag"]


def _joined(passages: DataFrame) -> DataFrame:
    """Passages of the same two documents that overlap in both, as one chain each."""
    w = Window.partitionBy(*_PAIR).orderBy("start", "source_start", "end", "source_end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.col("start") > F.max("end").over(before)) | (F.col("source_start") > F.max("source_end").over(before)), F.lit(True))
    numbered = passages.withColumn("apart", apart.cast("int")).withColumn("number", F.sum("apart").over(w))
    lo, hi = F.min("start"), F.max("end")
    whole = numbered.groupBy(*_PAIR, "number").agg(
        lo.alias("start"), hi.alias("end"), F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end"), lo.alias("lo"), hi.alias("hi"), F.count("*").alias("n")
    )
    return whole.where("n > 1").drop("n", "number").withColumn("main", F.lit(True))


def _outermost(passages: DataFrame) -> DataFrame:
    """Without passages that lie within another one of the same two documents, in both."""
    w = Window.partitionBy(*_PAIR).orderBy("start", "source_start", F.desc("end"), F.desc("source_end")).rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("end") <= F.max("end").over(w)) & (F.col("source_end") <= F.max("source_end").over(w))
    return passages.withColumn("inside", F.coalesce(inside, F.lit(False))).where("not inside").drop("inside")


def _pair_range(min_words: int) -> tuple[int, int]:
    """Words between two seeds of a passage: enough that what they span may grow to one, and no more than a gap over that."""
    near = max(1, min_words - 2 * (K + WINDOW) - K)
    return near, near + MAX_GAP // 2 + K


def _in_stretch(row: np.ndarray, pos: np.ndarray, near: int) -> np.ndarray:
    """Seeds in stretches, without a gap that no chain crosses, which are as long as the seeds of a passage are."""
    if not len(row):
        return np.zeros(0, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > MAX_GAP + K)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    return np.flatnonzero(np.repeat(pos[end] - pos[begin] >= near, end - begin + 1))


def _crowded(row: np.ndarray, pos: np.ndarray, far: int) -> np.ndarray:
    """Seeds that stand with others as every passage without an edit has them: SEEDS of them within ``far`` words."""
    k = SEEDS - 1
    together = (row[k:] == row[: len(row) - k]) & (pos[k:] - pos[: len(pos) - k] <= far) if len(row) > k else np.zeros(0, bool)
    count = np.zeros(len(row) + 1, np.int64)
    begin = np.flatnonzero(together)
    np.add.at(count, begin, 1)
    np.add.at(count, begin + k + 1, -1)
    return np.flatnonzero(np.cumsum(count[:-1]) > 0)


def _marked(marks: DataFrame, handle) -> DataFrame:
    """``handle(doc, tag, row, seed, pos)`` of a batch gives pairs of seeds by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc, tag = part.column(0).to_numpy(), part.column(1).to_numpy()
                row = np.repeat(np.arange(len(doc)), pa.compute.list_value_length(part.column(2)).to_numpy())
                pos = part.column(3).flatten().to_numpy()
                pair, i, j = handle(doc, tag, row, part.column(2).flatten().to_numpy().view(np.uint64), pos)
                yield record_batch(pair=pair.view(np.int64), doc=doc[row[i]], tag=tag[row[i]], a=pos[i], b=pos[j])

    return marks.mapInArrow(run, "pair long, doc long, tag int, a int, b int")


def _pairs(row: np.ndarray, seed: np.ndarray, pos: np.ndarray, near: int, far: int, wanted=None):
    """Names and places of all pairs of seeds of one row that are ``near`` to ``far`` words apart."""
    name, left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, len(row)):
        apart = np.where(row[k:] == row[:-k], pos[k:] - pos[:-k], far + 1)
        if not (apart <= far).any():
            break
        i = np.flatnonzero((apart >= near) & (apart <= far))
        x = mix(mix(seed[i] ^ np.uint64(0xA0761D6478BD642F)) ^ seed[i + k])
        if wanted is not None:
            on = _bitmap.contains(wanted, x)
            i, x = i[on], x[on]
        name.append(x)
        left.append(i)
        right.append(i + k)
    return np.concatenate(name), np.concatenate(left), np.concatenate(right)


def _occurrence(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(_doc_key(doc, tag) ^ pos.astype(np.int64).view(np.uint64))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield record_batch(key=_occurrence(*(batch.column(c).to_numpy() for c in range(3))).view(np.int64))


def _chains(matches: DataFrame, min_words: int) -> DataFrame:
    """Chains from ``matches`` of one seed each: (doc, tag, source, source_tag, pos, source_pos).

    A document's matches are no more than its words. ``lo`` and ``hi`` are where the chains of the same two documents before
    and behind end and begin. ``main``: within no longer range of the document that is chained too.
    """
    columns = ["doc", "tag", "source", "source_tag", "pos", "source_pos"]
    dealt = matches.repartition("doc", "tag").sortWithinPartitions(*columns).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, of_doc = None, [], []

        def ended() -> None:
            nonlocal held
            if held:
                pos, spos = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (0, 1))
                kept = sorted(c for c in chain(pos, spos) if min(c[1] - c[0], c[3] - c[2]) + 2 * (K + WINDOW) >= min_words)
                before = np.maximum.accumulate([0, *(c[1] for c in kept)]).tolist()
                after = [*(c[0] for c in kept[1:]), _FAR]
                of_doc.extend((*at, *c, lo, hi) for c, lo, hi in zip(kept, before, after))
                held = []

        def flushed() -> list[tuple]:
            out, reach = [], -1
            for c in sorted(of_doc, key=lambda c: (c[4], -c[5])):
                out.append((*c, c[5] > reach))
                reach = max(reach, c[5])
            of_doc.clear()
            return out

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in columns]
            n = len(cols[0])
            new = np.zeros(n, bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            edges = np.concatenate([[0], np.flatnonzero(new), [n]]) if n else np.zeros(1, np.int64)
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                this = tuple(int(c[a]) for c in cols[:4])
                if this != at:
                    ended()
                    if at is None or this[:2] != at[:2]:
                        out += flushed()
                    at = this
                held.append(tuple(c[a:b].copy() for c in cols[4:]))
            yield _batch(out, _CHAIN)
        ended()
        yield _batch(flushed(), _CHAIN)

    return dealt.mapInArrow(run, _CHAIN)


def _aligned(source: DataFrame, passages: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """Passages from chains."""
    passages = stage(passages.drop("main").distinct(), "asked")
    involved = passages.select("doc", "tag").union(passages.select("source", "source_tag")).distinct()
    asked = _bitmap.build(involved.mapInArrow(_keys, "key long"), F.col("key"))

    def texts(doc, tag, row, place, name):
        n = np.bincount(row, minlength=len(doc))
        return record_batch(doc=doc, tag=tag, names=lists((name >> np.uint64(32)).astype(np.uint32).view(np.int32), np.cumsum(n)))

    named = settled(_over(source, texts, "doc long, tag int, names array<int>", asked).groupBy("doc", "tag").agg(F.first("names").alias("names")), "names")
    right = named.select(F.col("doc").alias("source"), F.col("tag").alias("source_tag"), F.col("names").alias("theirs"))

    def looked_at(asked: DataFrame, margin: int) -> DataFrame:
        mine = F.greatest(F.col("start") - margin, F.lit(0))
        theirs = F.greatest(F.col("source_start") - margin, F.lit(0))
        left = asked.join(named, ["doc", "tag"]).select(*asked.columns, F.slice("names", mine + 1, F.col("end") - mine + margin).alias("x"))
        both = left.join(right, ["source", "source_tag"]).select(*asked.columns, "x", F.slice("theirs", theirs + 1, F.col("source_end") - theirs + margin).alias("y"))

        keys = asked.columns

        def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = {k: batch.column(k).to_numpy() for k in keys}
                out = []
                for i in range(batch.num_rows):
                    x, y = (batch.column(k)[i].values.to_numpy() for k in ("x", "y"))
                    a, b = max(c["start"][i] - margin, 0), max(c["source_start"][i] - margin, 0)
                    p0, p1, s0, s1, n, back, on = align(x, y, c["start"][i] - a, c["end"][i] - a, c["source_start"][i] - b, c["source_end"][i] - b, similarity)
                    # growth well beyond a chain's ends may go on behind what was looked at, if that holds no other chain
                    more = bool(
                        (a > c["lo"][i] and (back[0] > margin // 2 or (b > 0 and back[1] > margin // 2)))
                        or (c["end"][i] + margin < c["hi"][i] and len(x) == c["end"][i] - a + margin and on[0] > margin // 2)
                        or (c["end"][i] + margin < c["hi"][i] and len(y) == c["source_end"][i] - b + margin and on[1] > margin // 2)
                    )
                    like = n / max(p1 - p0, s1 - s0, 1)
                    if more or (n >= min_words and like >= similarity):
                        out.append((*(c[k][i] for k in keys), p0 + a, p1 + a, s0 + b, s1 + b, n, like, more))
                yield _batch(out, _ALIGNED)

        return settled(both.mapInArrow(aligned, _ALIGNED), "aligned")

    rounds = [looked_at(passages, MARGINS[0])]
    for margin in MARGINS[1:]:
        further = rounds[-1].where("more").select(*passages.columns)
        if further.isEmpty():
            break
        rounds.append(looked_at(further, margin))
    ended = [r.where("not more") for r in rounds]
    result = ["doc", "tag", F.col("p0").alias("start"), F.col("p1").alias("end"), "source", "source_tag", F.col("s0").alias("source_start"), F.col("s1").alias("source_end"), "matched", "similarity"]
    # several chains of two documents may grow to one passage
    found = stage(reduce(DataFrame.unionByName, ended).select(*result).distinct(), "passages")
    drop_stage(passages, named, *rounds)
    return found


_LOWEST = -(1 << 63)
_FAR = 1 << 40
_PASSAGE = "doc long, tag int, source long, source_tag int, start long, end long, source_start long, source_end long, lo long, hi long"
_CHAIN = f"{_PASSAGE}, main boolean"
_ALIGNED = f"{_PASSAGE}, p0 long, p1 long, s0 long, s1 long, matched long, similarity double, more boolean"


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    doc, tag = _names(docs, key, text)
    return docs.select(doc.alias("doc"), tag.alias("tag"), docs[text].alias("text"))


def _names(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(whole_number_key(docs, key), F.lit(_LOWEST)), F.pmod(F.xxhash64(docs[text]), F.lit(1 << 31)).cast("int")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(named)], [n for n, _ in named])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield record_batch(key=_doc_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))


def chain(pos: np.ndarray, spos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Passages ``(start, end, source_start, source_end)`` of chained k-mer matches, best chains first, without overlap.

    Matches on one diagonal that follow closely make one block. A chain earns its blocks' words and pays for the words in
    its gaps. A Fenwick tree over the blocks' ends in the source gives the best one to go before a block. What lies before
    a gap is worth one seed there, however long it is: so the best one never is too far away, and hides no nearer one.
    """
    order = np.lexsort((pos, pos - spos))
    p, s = pos[order], spos[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] - s[1:] != p[:-1] - s[:-1]) | (p[1:] - p[:-1] > K + WINDOW)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(p)) - 1
    p0, p1, s0, s1 = p[begin], p[stop] + K, s[begin], s[stop] + K
    order = np.lexsort((s0, p0))
    p0, p1, s0, s1 = (x[order].tolist() for x in (p0, p1, s0, s1))
    n = len(p0)
    if n == 1:
        return [(p0[0], p1[0], s0[0], s1[0])]
    ends = sorted(set(s1))
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    waiting, entered = sorted(range(n), key=p1.__getitem__), 0
    score, back = [0.0] * n, [-1] * n
    for i in range(n):
        while entered < n and p1[waiting[entered]] <= p0[i]:
            j = waiting[entered]
            entered += 1
            value, k = (K + GAP_COST * (p1[j] + s1[j]), j), bisect_left(ends, s1[j]) + 1
            while k < len(tree):
                tree[k] = max(tree[k], value)
                k += k & -k
        best, k = (-np.inf, -1), bisect_right(ends, s0[i])
        while k:
            best = max(best, tree[k])
            k -= k & -k
        score[i] = float(p1[i] - p0[i])
        j = best[1]
        if best[0] >= GAP_COST * (p0[i] + s0[i]):
            gap = GAP_COST * (p0[i] - p1[j] + s0[i] - s1[j])
            if score[j] > gap:
                score[i], back[i] = score[i] + score[j] - gap, j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        j, top = i, i
        while j >= 0 and not used[j]:
            used[j], top, j = True, j, back[j]
        out.append((p0[top], p1[i], s0[top], s1[i]))
    return out


def align(x: np.ndarray, y: np.ndarray, p0: int, p1: int, s0: int, s1: int, similarity: float = 0.8) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """Grows the chained ranges at both ends, over edits too, and counts the words matched in order.

    Of the ends that either side may have, the pair with most matched words is taken that holds ``similarity``; the chained
    range stays where none does. Last come the words of x and y that the best growth took at either side.
    """
    p1, s1 = min(p1, len(x)), min(s1, len(y))
    left, right = _grown(x[:p0][::-1], y[:s0][::-1]), _grown(x[p1:], y[s1:])
    inner = _in_order(x[p0:p1], y[s0:s1])
    n, m, best = p1 - p0, s1 - s0, (-1, 0, 0, 0)
    for a in range(len(left) - 1, -1, -1):  # matched words only fall from here
        total = inner + int(left[a, 2]) + right[:, 2]
        if total[-1] < best[0]:
            break
        longer = np.maximum(n + left[a, 0] + right[:, 0], m + left[a, 1] + right[:, 1])
        ok = np.flatnonzero(total >= similarity * longer)
        if len(ok):
            best = max(best, (int(total[ok[-1]]), -int(longer[ok[-1]]), a, int(ok[-1])))
    matched, _, a, b = best if best[0] >= 0 else (inner, 0, 0, 0)
    return p0 - int(left[a, 0]), p1 + int(right[b, 0]), s0 - int(left[a, 1]), s1 + int(right[b, 1]), matched, left[left[:, 3].argmax()], right[right[:, 3].argmax()]


def _grown(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``(words of x, words of y, matched, score)``: how far an alignment from the beginning of both gets with 0, 1, 2, ... edits.

    An edit is a word that only one side has, and costs two matched words; the search ends at DROP below the best score.
    """
    m = min(len(x), len(y))
    differ = x[:m] != y[:m]
    n = int(differ.argmax()) if differ.any() else m
    out, best = [(0, 0, 0, 0)], n
    if n:
        out.append((n, n, n, n))
    if n == len(x) or n == len(y):
        return np.array(out)
    a, b = x[n:].tolist(), y[n:].tolist()
    reach, last_i, last_j = {0: 0}, len(a), len(b)
    matched = 0
    for d in range(1, last_i + last_j + 1):
        if n + matched - 2 * d < best - DROP:
            break
        now, top = {}, (matched, 0, 0)
        for k in range(-d, d + 1, 2):
            i = max(reach.get(k - 1, -2) + 1, reach.get(k + 1, -1))
            j = i - k
            if i < 0 or j < 0 or i > last_i or j > last_j:
                continue
            while i < last_i and j < last_j and a[i] == b[j]:
                i += 1
                j += 1
            now[k] = i
            top = max(top, ((i + j - d) // 2, i, j))
        ahead = max((2 * i - k for k, i in now.items()), default=0)
        # diagonals far behind the one that is furthest do not catch up
        reach = {k: i for k, i in now.items() if 2 * i - k >= ahead - 4 * DROP}
        if not now:
            break
        if top[0] > matched:
            matched = top[0]
            out.append((n + top[1], n + top[2], n + matched, n + matched - 2 * d))
            best = max(best, n + matched - 2 * d)
    return np.array(out)


def _in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a row of the table of lengths is one number, a bit for each word of b."""
    n, m = 0, min(len(a), len(b))
    for _ in range(2):  # what begins both, then what ends both
        differ = a[:m] != b[:m]
        k = int(differ.argmax()) if differ.any() else m
        n, m, a, b = n + k, m - k, a[k:][::-1], b[k:][::-1]
    if not m:
        return n
    at: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << j
    row = whole = (1 << len(b)) - 1
    for w in a.tolist():
        if hit := row & at.get(w, 0):
            row = (row + hit | row - hit) & whole
    return n + len(b) - row.bit_count()


def cut_passages(docs: DataFrame, passages: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of all ``passages`` (of :func:`repeated_passages`) taken out of ``text``; same columns.

    The first document with a passage keeps it. White space behind a removed word goes with it. Only texts that have
    passages are moved; the others stay in their tasks. A text of which nothing is left becomes empty.
    """
    spans = passages.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    touched = _bitmap.build(passages.select("doc", "tag").distinct().mapInArrow(_keys, "key long"), F.col("key"))

    @F.arrow_udf("boolean")
    def may_be_touched(doc: pa.Array, tag: pa.Array) -> pa.Array:
        return pa.array(_bitmap.contains(touched, _doc_key(doc.to_numpy(), tag.to_numpy())))

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for i, j, data, offsets in text_chunks(texts):
            starts, _, row, _ = words(data, offsets)
            edges = np.searchsorted(row, np.arange(j - i + 1))
            for r in range(j - i):
                found = spans[i + r].as_py()
                whole = data[offsets[r] : offsets[r + 1]]
                if texts[i + r].as_py() is None:
                    out.append(None)
                    continue
                keep = np.ones(len(whole), bool)
                at = np.append(starts[edges[r] : edges[r + 1]], offsets[r + 1]) - offsets[r]
                for s in found or ():
                    keep[at[s["start"]] : at[min(s["end"], len(at) - 1)]] = False
                out.append(whole[keep].tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    mark = "__sf"
    numbered = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(mark), *[c.alias(n) for c, n in zip(_names(docs, key, text), ("doc", "tag"), strict=True)])
    flagged = numbered.withColumn("touched", may_be_touched("doc", "tag"))
    whole = flagged.where(~F.col("touched")).select(f"{mark}.*")
    cut = flagged.where("touched").join(spans, ["doc", "tag"], "left").select(mark, without(F.col(mark)[text], F.col("spans")).alias("__text"))
    return whole.unionByName(cut.select(*[(F.col("__text") if c == text else F.col(mark)[c]).alias(c) for c in docs.columns]))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "end", F.col("source").alias("source_doc_id"), "source_start", "source_end", "matched", "similarity")
