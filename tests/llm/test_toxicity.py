"""Toxicity against a plain Python version of the two models, and with next to nothing of the model broadcast."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import op6_toxicity as op6

RARE = 2


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(60)])
    weight = 1 / np.arange(1, 61)
    for i in range(n):
        toxic = int(i % 3 == 0)
        at = rng.choice(60, rng.integers(1, 40), p=weight / weight.sum())
        said = [*vocabulary[at], *(["you", "ROTTER"] if toxic and rng.random() < 0.8 else []), *(["You", "two"] if rng.random() < 0.3 else [])]
        yield i, ", ".join(said), toxic


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def plain_features(labelled, asked):
    """(strongest, mean) of each (text, kind), as the module's docstring tells it, with dicts."""
    documents = Counter(w for _, t, _ in labelled for w in set(words(t)))
    vocabulary = {w for w, n in documents.items() if n >= RARE}
    pairs = defaultdict(lambda: [0, 0])
    for _, t, toxic in labelled:
        ws = words(t)
        for p in {(a, b) for a, b in zip(ws, [*ws[1:], None], strict=False) if a in vocabulary}:
            pairs[p][toxic] += 1
    k, before = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
    for (w, v), n in pairs.items():
        for c in (0, 1):
            k[w][c] += n[c] > 0
            before[v][c] += n[c]
        k[w][2] += 1
        before[v][2] += 1
    t, every = [sum(x[c] for x in k.values()) for c in (0, 1)], sum(x[2] for x in k.values())
    weight = op6.DISCOUNT * len(vocabulary) / sum(t)

    def ratio(n, totals, backoff, kind):
        less = [int(kind == 1), int(kind == 2)]
        p = [max(n[c] - less[c] - op6.DISCOUNT, 0) / totals[c] + backoff[c] for c in (0, 1)]
        return math.log(p[1]) - math.log(p[0])

    def of_word(w, kind):
        if w not in vocabulary or k[w][0] + k[w][1] < RARE:
            return 0.0, 0.0
        r = ratio(k[w], t, [weight * k[w][2] / every] * 2, kind)
        return r, r * k[w][2] / (k[w][2] + op6.TRUST)

    def of_pair(w, v, kind):
        if w not in vocabulary or sum(pairs.get((w, v), (0, 0))) < RARE or not (v is None or v in vocabulary):
            return of_word(w, kind)[0]
        share = op6.DISCOUNT * before[v][2] / (before[v][0] + before[v][1])
        p = [share * (max(k[w][c] - op6.DISCOUNT, 0) / t[c] + weight * k[w][2] / every) for c in (0, 1)]
        return ratio(pairs[w, v], [max(x, 1) for x in before[v][:2]], p, kind)

    for text, kind in asked:
        ws = words(text)
        yield max([0.0, *(of_word(w, kind)[1] for w in ws)]), sum(of_pair(a, b, kind) for a, b in zip(ws, [*ws[1:], None], strict=False)) / max(len(ws), 1)


@pytest.fixture(scope="module")
def labelled():
    return list(texts(150, 1))


@pytest.mark.parametrize("most", [500_000, 7, 0])
def test_against_plain_version(spark, labelled, most):
    model = op6.fit_toxicity(spark.createDataFrame(labelled, "doc_id long, text string, toxic int"), rare=RARE, most=most)
    assert len(model.word) <= most and len(model.pair) <= most and (model.rest is None) == (most > 1000)
    asked = [(t, i % 3) for i, t, _ in [*texts(60, 2), *texts(5, 2)]] + [("", 0), ("none of these", 0), ("w0", 0), ("w0", 0)]
    rows = spark.createDataFrame([(i, t, k, "x") for i, (t, k) in enumerate(asked)], "i long, text string, kind int, key string")
    got = {r["i"]: r[op6._MEASURED] for r in op6._measured(rows, model, "text", F.col("kind")).collect()}
    for i, want in enumerate(plain_features(labelled, asked)):
        assert got[i][:2] == pytest.approx(want, abs=1e-4), asked[i]


def test_the_bound_changes_no_score(spark, labelled):
    corpus = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    asked = [*[(i, t) for i, t, _ in texts(60, 3)], (90, None), (91, ""), (91, "rotter"), (91, "rotter"), (None, "w1 " * 70_000 + "rotter w3 " * 5)]
    rows = spark.createDataFrame([(i, t, 7, "x") for i, t in asked], "doc_id long, text string, n long, key string").withColumn("toxicity", F.lit("old"))
    scores = []
    for most in (500_000, 9):
        out = op6.score_toxicity(rows, op6.fit_toxicity(corpus, rare=RARE, most=most))
        assert out.columns == ["doc_id", "text", "n", "key", "toxicity"]
        scores.append(sorted((str(r["doc_id"]), str(r["text"]), r["toxicity"]) for r in out.collect()))
    assert [x[:2] for x in scores[0]] == [x[:2] for x in scores[1]] and len(scores[0]) == len(asked)
    assert [x[2] for x in scores[0]] == pytest.approx([x[2] for x in scores[1]], abs=1e-4)
    assert op6.score_toxicity(rows.limit(0), op6.fit_toxicity(corpus, rare=RARE, most=9)).count() == 0
