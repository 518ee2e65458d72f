"""Toxicity by class-conditional Kneser-Ney models of words and word pairs.

Every expression (a word, or a word given the one after it) has a log-likelihood under the toxic and under the ordinary
texts. As Kneser and Ney count the lower order, a word counts once for each distinct word that it stands in front of, so
a word of one text and its many copies stays rare. Both classes back off to the same counts: a word's share of all
contexts, whichever the class. Expressions seen less than ``rare`` times are left to this shared backoff, under which both
classes agree and the ratio is 1. Counts are those of a bounded sample of distinct labelled texts, the same number of each class.

The most frequent expressions travel to the executors as sorted arrays of a bounded size. All others stay a table, which
the distinct expressions of each text that may be in it are joined with; sums over both parts make the score, so the
bound changes where an expression is looked up and not what it counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import _bitmap
from skyframe.llm._common import ALNUM_SEPARATOR, crc_mod, drop_stage, lists, mix, record_batch, small_batches, stage, table, text_chunks, words

DISCOUNT = 0.75
#: A key is the number of a frequent word and 42 bits of the name of the word after it (0: it is the last).
_AFTER = 42
_LOW = (1 << 32) - 1
#: A word with this many contexts counts half of its log ratio when the strongest word is looked for.
TRUST = 16
#: Labels are broadcast up to this many; more are joined, and the labelled texts written once.
BROADCAST_LABELS = 4_000_000


@dataclass
class ToxicityModel:
    """Sorted names of frequent words and pairs with their log ratios: plain, and with one document of a class less."""

    word: np.ndarray
    word_ratio: np.ndarray  # 3 x words
    pair: np.ndarray
    pair_ratio: np.ndarray  # 3 x pairs
    weights: np.ndarray  # of 1, strongest expression, mean over the text
    prior: float
    trust: np.ndarray  # of a word's log ratio, 0 to 1
    rest: DataFrame | None = None  # all other expressions: key, d0-d2 (log ratio), s0-s2 (strength)
    in_rest: Broadcast | None = None  # bitmap of their keys

    def sent(self) -> ToxicityModel:
        return replace(self, rest=None, in_rest=None)

    def expressions(self, row: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of a chunk: its place among the words here (-1: none), its key with the word after it, that word."""
        at = np.minimum(np.searchsorted(self.word, name), max(len(self.word) - 1, 0))
        known = self.word[at] == name if len(self.word) else np.zeros(len(name), bool)
        at = np.where(known, at, -1)
        after = np.zeros(len(name), np.uint64)
        after[:-1] = np.where(row[1:] == row[:-1], _short(name[1:]), np.uint64(0))
        return at, np.where(known, (at << _AFTER) | after.view(np.int64), -1), after

    def pairs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key among the pairs here, and whether it is one."""
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        return at, (self.pair[at] == key) & (key >= 0) if len(self.pair) else np.zeros(len(key), bool)

    def features(self, row: np.ndarray, name: np.ndarray, rows: int, less: np.ndarray) -> np.ndarray:
        """Strongest word and length-normalised sum of each row; ``less``: 0 plain, 1 + c without one of class c."""
        at, key, _ = self.expressions(row, name)
        kind = less[row]
        ratio, strong = np.zeros(len(name)), np.zeros(len(name))
        if len(self.word):
            ratio = np.where(at >= 0, self.word_ratio[kind, at], 0.0)
            strong = ratio * self.trust[at]
        if len(self.pair):
            pair, known = self.pairs(key)
            ratio = np.where(known, self.pair_ratio[kind, pair], ratio)
        out = np.zeros((rows, 2))
        np.maximum.at(out[:, 0], row, strong)
        n = np.bincount(row, minlength=rows)
        out[:, 1] = np.bincount(row, ratio, minlength=rows) / np.maximum(n, 1)
        return out

    def elsewhere(self, row: np.ndarray, name: np.ndarray, in_rest: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, key and number of the distinct expressions of each row that may stand in ``rest``."""
        at, key, after = self.expressions(row, name)
        word, pair = np.flatnonzero(at < 0), np.flatnonzero(~self.pairs(key)[1])
        key = np.concatenate([name[word], _pair_name(name[pair], after[pair])])
        row = np.concatenate([row[word], row[pair]])
        some = _bitmap.contains(in_rest, key)
        row, key = row[some], key[some]
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(first)
        return row[first], key[first].view(np.int64), np.diff(np.append(first, len(row)))

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -500, 500)))


def _short(name: np.ndarray) -> np.ndarray:
    return (name >> np.uint64(64 - _AFTER)) | np.uint64(1)


def _pair_name(name: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(name * np.uint64(0x9E3779B97F4A7C15) + after)


def _ratios(n0, n1, t0, t1, weight0, weight1, shared) -> np.ndarray:
    """log p(toxic) - log p(ordinary), with discounted counts over their totals plus the weighted shared backoff; the
    same with a document of class 0 and of class 1 taken away. ``weight`` and ``shared`` may differ by class."""
    s0, s1 = shared
    out = []
    for a, b in ((0, 0), (1, 0), (0, 1)):
        p0 = np.maximum(n0 - a - DISCOUNT, 0) / t0 + weight0 * s0
        p1 = np.maximum(n1 - b - DISCOUNT, 0) / t1 + weight1 * s1
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.log(p1) - np.log(p0)
        out.append(np.nan_to_num(r, nan=0.0, posinf=20.0, neginf=-20.0))
    return np.array(out, np.float32)


def _distinct(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    order = np.lexsort((name, row))
    r, x = row[order], name[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return order[first]


def _count(labelled: DataFrame, keys) -> DataFrame:
    """Documents of each class by key; ``keys(row, name)`` gives (row, key) of a chunk, keys distinct within a row.

    The two counts travel in one word, 32 bits each, and are summed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, offsets in text_chunks(batch.column(0)):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                row, key = keys(row, name)
                held.append((key, toxic[i:j][row]))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    yield _tally(held)
                    held = []
        if held:
            yield _tally(held)

    counted = labelled.select("text", "toxic").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.select("key", F.col("n").bitwiseAND(_LOW).alias("n0"), F.shiftrightunsigned("n", 32).alias("n1"))


def _tally(held) -> pa.RecordBatch:
    key, toxic = np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held])
    distinct, back = np.unique(key, return_inverse=True)
    n1 = np.bincount(back, weights=toxic, minlength=len(distinct)).astype(np.int64)
    return record_batch(key=distinct, n=(n1 << 32) + np.bincount(back, minlength=len(distinct)) - n1)


def _frequent(counts: DataFrame, rare: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The most frequent keys with ``rare`` documents or more, at most ``most``, and how many documents each has at least."""
    n = F.col("n0") + F.col("n1")
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(n)) - 11)).cast("long")
    sizes = counts.where(n >= rare).groupBy((n - n % step).alias("n")).agg(F.count("*").alias("keys")).collect()
    total, least = 0, rare
    for r in sorted(sizes, key=lambda r: -r["n"]):
        total += r["keys"]
        if total > most:
            least = min((s["n"] for s in sizes if s["n"] > r["n"]), default=1 << 62)
            break
    t = counts.where(n >= least).toArrow()
    key, n0, n1 = (t.column(c).to_numpy() for c in ("key", "n0", "n1"))
    order = np.argsort(key)
    return key[order], n0[order].astype(float), n1[order].astype(float), least


def _rarer(counts: DataFrame, rare: int, least: int) -> DataFrame:
    return counts.where((F.col("n0") + F.col("n1") >= rare) & (F.col("n0") + F.col("n1") < least))


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` / 2 distinct texts of each class, by hash (all, where a class has fewer), and ``share``: of the class's distinct texts.

    Copies are told by their hash before texts are moved, so a text of a third of all rows is one of many.
    """
    bits = 1 << 30
    slot = F.pmod(F.xxhash64("text"), F.lit(bits))
    found = {r["toxic"]: r["n"] for r in rows.select("toxic", F.xxhash64("text").alias("name")).distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most / 2 / n) for c, n in found.items()}
    of = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return rows.where(slot < F.ceil(of * bits)).groupBy("text", "toxic").agg(F.lit(1)).select("text", "toxic")


def fit_toxicity(labelled: DataFrame, *, text: str = "text", label: str = "toxic", rare: int = 4, most: int = 2_000_000, fit_texts: int = 40_000, calibrate_texts: int = 20_000) -> ToxicityModel:
    """Fits both models on rows of ``labelled`` whose text and label are not null (label: 0 ordinary, else toxic).

    They are fitted on a bounded sample: distinct texts, about ``fit_texts`` / 2 of each class, chosen by hash; a class with fewer gives all it has.
    A text counts once in a class, however many copies it has. The share of toxic rows is counted over all rows. Of the sample's
    words and pairs the ``most`` frequent ones each are broadcast; if there are more, the rest stays a staged table of the model. ``most`` does not change scores.
    The last step, a logistic curve over two figures per text, is fitted on about ``calibrate_texts`` of these texts, each scored without its own
    counts, and each class weighted as all rows have it.
    """
    spark = labelled.sparkSession
    rows = labelled.select(labelled[text].alias("text"), (labelled[label] != 0).cast("int").alias("toxic")).where("text is not null and toxic is not null")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    none = np.zeros(0, np.int64)
    if len(sizes) < 2:
        return ToxicityModel(none.astype(np.uint64), np.zeros((3, 0)), none, np.zeros((3, 0)), None, prior, np.zeros(0))
    rows = stage(_sampled(rows, fit_texts), "fitted")

    def single(row, name):
        at = _distinct(row, name)
        return row[at], name[at].view(np.int64)

    counted = stage(_count(rows, single), "words")
    key, _, _, least = _frequent(counted, rare, most)
    others = stage(_rarer(counted, rare, least).select(F.col("key").alias("w")), "other_words") if least > rare else None
    drop_stage(counted)
    word = np.sort(key.view(np.uint64))
    model = ToxicityModel(word, np.zeros((3, len(word)), np.float32), none, np.zeros((3, 0)), np.zeros(3), prior, np.zeros(len(word)))
    known = spark.sparkContext.broadcast(model)

    def pairs(row, name):
        _, key, _ = known.value.expressions(row, name)
        some = np.flatnonzero(key >= 0)
        at = some[_distinct(row[some], key[some])]
        return row[at], key[at]

    counted = stage(_count(rows, pairs), "pairs")
    seen_in = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    by_word = lambda counts, w: counts.groupBy(w.alias("w")).agg(seen_in("n0"), seen_in("n1"), F.count("*").alias("n"))
    contexts = by_word(counted, F.shiftright("key", _AFTER)).toArrow()
    at = contexts.column("w").to_numpy()
    k0, k1, k = np.zeros(len(word)), np.zeros(len(word)), np.ones(len(word))
    k0[at], k1[at], k[at] = (contexts.column(c).to_numpy() for c in ("n0", "n1", "n"))
    sums = np.array([k0.sum(), k1.sum(), k.sum(), len(word)])
    if others is not None:
        other_pairs = stage(_count_others(rows, known, others), "other_pairs")
        other_contexts = stage(by_word(other_pairs, F.col("w")), "other_contexts")
        more = other_contexts.agg(F.sum("n0"), F.sum("n1"), F.sum("n"), F.count("*")).first()
        sums += np.array([x or 0 for x in more])
    t0, t1, weight = max(sums[0], 1.0), max(sums[1], 1.0), DISCOUNT * sums[3] / (max(sums[0], 1.0) + max(sums[1], 1.0))

    def of_words(k0, k1, k):
        """Log ratios, trust, and probability under each class of words by their contexts."""
        shared, frequent = k / sums[2], k0 + k1 >= rare
        ratio = np.where(frequent, _ratios(k0, k1, t0, t1, weight, weight, (shared, shared)), np.float32(0))
        p = [np.maximum(n - DISCOUNT, 0) / t + weight * shared for n, t in ((k0, t0), (k1, t1))]
        return ratio, np.where(frequent, k / (k + TRUST), 0.0), *p

    def of_pairs(m0, m1, c0, c1, cn, p0, p1):
        share = DISCOUNT * cn / np.maximum(c0 + c1, 1)
        return _ratios(m0, m1, np.maximum(c0, 1), np.maximum(c1, 1), share, share, (p0, p1))

    model.word_ratio, model.trust, p0, p1 = of_words(k0, k1, k)
    pair, m0, m1, least = _frequent(counted, rare, most)
    w, v = pair >> _AFTER, pair & ((1 << _AFTER) - 1)
    # what stood in front of each word that is frequent enough
    after = counted.select(F.col("key").bitwiseAND((1 << _AFTER) - 1).alias("v"), "n0", "n1")
    name = np.unique(np.append(_short(word), np.uint64(0)).view(np.int64))
    if others is not None:
        after = after.unionByName(other_pairs.select("v", "n0", "n1"))
    before = after.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.count("*").alias("cn"))
    if others is None and least == rare:
        asked = np.intersect1d(v, name)
    else:
        names = spark.createDataFrame(pa.table({"v": name}))
        if others is not None:
            names = names.union(others.select(F.shiftrightunsigned("w", 64 - _AFTER).bitwiseOR(F.lit(1).cast("long"))))
        before, asked = stage(before.join(names, "v", "left_semi"), "before"), np.unique(v)
    found = before.join(F.broadcast(spark.createDataFrame(pa.table({"v": asked}))), "v").toArrow()
    order = np.argsort(found.column("v").to_numpy())
    name, c0, c1, cn = (found.column(c).to_numpy()[order] for c in ("v", "c0", "c1", "cn"))
    at = np.minimum(np.searchsorted(name, v), max(len(name) - 1, 0))
    told = name[at] == v if len(name) else np.zeros(len(v), bool)
    model.pair, w, at = pair[told], w[told], at[told]
    model.pair_ratio = of_pairs(m0[told], m1[told], c0[at], c1[at], cn[at], p0[w], p1[w])

    if others is not None or least > rare:
        sent = spark.sparkContext.broadcast((word, p0, p1, model.word_ratio))

        def of_sent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word, p0, p1, ratio = sent.value
            for batch in batches:
                key, n0, n1 = (batch.column(c).to_numpy() for c in range(3))
                w, v = key >> _AFTER, key & ((1 << _AFTER) - 1)
                yield record_batch(w=word[w].view(np.int64), v=v, n0=n0, n1=n1, p0=p0[w], p1=p1[w], d0=ratio[0, w], d1=ratio[1, w], d2=ratio[2, w])

        rest_pairs = _rarer(counted, rare, least).select("key", "n0", "n1").mapInArrow(of_sent_words, "w long, v long, n0 long, n1 long, p0 double, p1 double, d0 float, d1 float, d2 float")
        if others is not None:

            def of_other_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    n0, n1, n = (batch.column(c).to_numpy().astype(float) for c in range(1, 4))
                    (d0, d1, d2), trust, p0, p1 = of_words(n0, n1, n)
                    yield record_batch(w=batch.column(0), d0=d0, d1=d1, d2=d2, trust=trust, p0=p0, p1=p1)

            other_words = stage(other_contexts.mapInArrow(of_other_words, "w long, d0 float, d1 float, d2 float, trust double, p0 double, p1 double"), "other_ratios")
            of_others = other_pairs.where(F.col("n0") + F.col("n1") >= rare).join(other_words.drop("trust"), "w")
            rest_pairs = rest_pairs.unionByName(of_others)

        def beyond_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What a pair adds to the log ratio of its first word alone."""
            for batch in batches:
                w, v = (batch.column(c).to_numpy().view(np.uint64) for c in range(2))
                x = [batch.column(c).to_numpy().astype(float) for c in range(2, 12)]
                r = of_pairs(*x[:7]).astype(float)
                d0, d1, d2 = (r[i] - x[7 + i] for i in range(3))
                yield record_batch(key=_pair_name(w, v).view(np.int64), d0=d0, d1=d1, d2=d2)

        columns = ("w", "v", "n0", "n1", "c0", "c1", "cn", "p0", "p1", "d0", "d1", "d2")
        rest = rest_pairs.join(before, "v").select(*columns).mapInArrow(beyond_word, "key long, d0 double, d1 double, d2 double")
        rest = rest.select("*", *[F.lit(0.0).alias(f"s{i}") for i in range(3)])
        if others is not None:
            rest = rest.union(other_words.select(F.col("w").alias("key"), *[F.col(f"d{i}").cast("double") for i in range(3)], *[F.col(f"d{i}") * F.col("trust") for i in range(3)]))
        model.rest = stage(rest.where("d0 <> 0 or d1 <> 0 or d2 <> 0"), "rest")
        model.in_rest = _bitmap.build(model.rest, F.col("key"))
        drop_stage(before, *([others, other_pairs, other_contexts, other_words] if others is not None else []))
    drop_stage(counted)

    few = rows if calibrate_texts >= fit_texts else _sampled(rows, calibrate_texts)
    measured = _measured(few.select("text", "toxic"), model, "text", F.col("toxic") + 1)
    seen = measured.select(F.col("toxic").cast("long").alias("toxic"), F.col(_MEASURED)[0].alias("a"), F.col(_MEASURED)[1].alias("b")).toArrow()
    toxic = seen.column("toxic").to_numpy()
    weight = np.array([sizes[c] / max(int((toxic == c).sum()), 1) for c in (0, 1)])[toxic]
    model.weights = _logistic(np.column_stack([seen.column("a").to_numpy(), seen.column("b").to_numpy()]), toxic, prior, weight / weight.mean() if len(weight) else weight)
    drop_stage(rows)
    return model


def _count_others(labelled: DataFrame, known: Broadcast, others: DataFrame) -> DataFrame:
    """Documents of each class by pair (w, v), for the first words that stand in ``others``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, offsets in text_chunks(batch.column(0)):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                at, _, after = known.value.expressions(row, name)
                some = np.flatnonzero(at < 0)
                some = some[_distinct(row[some], _pair_name(name[some], after[some]))]
                n = np.where(toxic[i:j][row[some]] != 0, 1 << 32, 1)
                yield record_batch(w=name[some].view(np.int64), v=after[some].view(np.int64), n=n)

    pairs = labelled.select("text", "toxic").mapInArrow(run, "w long, v long, n long").join(others, "w", "left_semi")
    counted = pairs.groupBy("w", "v").agg(F.sum("n").alias("n"))
    return counted.select("w", "v", F.col("n").bitwiseAND(_LOW).alias("n0"), F.shiftrightunsigned("n", 32).alias("n1"))


_MEASURED = "__measured"


def _measured(rows: DataFrame, model: ToxicityModel, text: str, kind) -> DataFrame:
    """``rows`` with an array of strongest word and length-normalised sum over all expressions (``kind``: 0 plain, 1 + c
    without one document of class c). Equal texts are looked up in the rest of the model once."""
    shared, in_rest = rows.sparkSession.sparkContext.broadcast(model.sent()), model.in_rest

    @F.arrow_udf("array<double>")
    def here(texts: pa.Array, kind: pa.Array) -> pa.Array:
        out, kind = [np.zeros((0, 3))], kind.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, offsets in text_chunks(texts):
            _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
            n = np.bincount(row, minlength=j - i)
            out.append(np.column_stack([shared.value.features(row, name, j - i, kind[i:j]), n]))
        flat = np.concatenate(out)
        return lists(flat.ravel(), np.arange(1, len(flat) + 1) * 3)

    kept = rows.columns
    if model.rest is None:
        return rows.select(*[rows[c] for c in kept], here(rows[text], kind.cast("int")).alias(_MEASURED))
    # two hashes name a text
    named = rows.select(F.struct(*[rows[c] for c in kept]).alias("__row"), rows[text].alias("__text"), kind.cast("int").alias("__kind"))
    named = named.select("*", F.xxhash64("__text").alias("__a"), F.xxhash64(F.lit(1), "__text").alias("__b"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 4)])
            batch = batch.take(pa.array(np.sort(np.unique(names, axis=0, return_index=True)[1])))  # copies beside each other
            a, b, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 4))
            for i, j, data, offsets in text_chunks(batch.column(0)):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                row, key, n = shared.value.elsewhere(row, name, in_rest)
                yield record_batch(__a=a[i:j][row], __b=b[i:j][row], __kind=kind[i:j][row], key=key, n=n)

    asked = named.where("__text is not null").select("__text", "__a", "__b", "__kind").mapInArrow(elsewhere, "__a long, __b long, __kind int, key long, n long")
    of_kind = lambda c: F.element_at(F.array(*[F.col(f"{c}{i}") for i in range(3)]), F.col("__kind") + 1)
    there = asked.join(model.rest, "key").select("key", "__a", "__b", "__kind", (F.col("n") * of_kind("d")).alias("d"), of_kind("s").alias("s"))
    # what copies ask for is counted once; rows stay where the join by key has put them
    there = there.groupBy("key", "__a", "__b", "__kind").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    there = there.groupBy("__a", "__b", "__kind").agg(F.sum("d").alias("__total"), F.max("s").alias("__strong"))
    both = named.withColumn("__here", here("__text", "__kind")).drop("__text").join(there, ["__a", "__b", "__kind"], "left")
    strong = F.greatest(F.col("__here")[0], F.coalesce("__strong", F.lit(0.0)))
    mean = F.col("__here")[1] + F.coalesce("__total", F.lit(0.0)) / F.greatest(F.col("__here")[2], F.lit(1.0))
    return both.select("__row.*", F.array(strong, mean).alias(_MEASURED))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, weight: np.ndarray) -> np.ndarray | None:
    """Newton's method for a weighted logistic regression with a light ridge; rows in a fixed order, as they arrive in any."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    x, y, weight = np.column_stack([np.ones(len(y)), x])[order], y[order], weight[order]
    w = np.array([np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), 0.0, 0.0])
    ridge = np.diag([1e-6, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", column: str = "toxicity") -> DataFrame:
    """Adds a score from 0 to 1 (1: toxic) to every row, from its whole text alone; a narrow job without a shuffle
    unless the model has a table of further expressions, which are joined then.

    * null and empty texts and texts without a word: the score of a text in which nothing speaks for either class.
    * a model fitted on one class or on nothing: the share of toxic labels (0 without any).
    * repeated rows get equal scores; an existing column of that name is replaced; very long texts are scored whole.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    if model.rest is not None and model.weights is not None:
        w0, w1, w2 = map(float, model.weights)
        # a text column that is to be replaced is still read
        rows = docs.select(*[docs[c] for c in kept], docs[text].alias("__scored"))
        measured = _measured(rows, model, "__scored", F.lit(0))
        z = F.lit(w0) + F.col(_MEASURED)[0] * w1 + F.col(_MEASURED)[1] * w2
        return measured.select(*kept, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias(column))
    shared = docs.sparkSession.sparkContext.broadcast(model.sent())

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            out = [np.zeros(0)]
            for i, j, data, offsets in text_chunks(texts):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                out.append(shared.value.probability(shared.value.features(row, name, j - i, np.zeros(j - i, np.int64))))
            yield pa.array(np.concatenate(out))

    return docs.select(*[docs[c] for c in kept], score(docs[text]).alias(column))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod(F.col("doc_id"), 5) != 0)
    if labels.count() <= BROADCAST_LABELS:
        labelled = docs.join(F.broadcast(labels), "doc_id")
    else:
        labelled = stage(docs.join(labels, "doc_id"), "labelled")
    model = fit_toxicity(labelled)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
