"""Op 12 against a plain walk through all orders, with odd rows and a case of more parts than one."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from skyframe.llm import op12_filter_audit as op12

SCHEMA = "doc_id long, text string, lang string, mask int, n int, letters string, key long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, lang)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    fails = []
    for d, t, lang in rows:
        t = t or ""
        w = [x for x in t.translate({c: 32 for c in range(9, 14)}).split(" ") if x]
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        fails.append((lang or "", {x for x, v in f.items() if v}, d))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        mine = [(f, d) for p, f, d in fails if p == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [d for f, d in mine if x in f and not f & before]
                shapley[part, x] += len(gone)
                out[part, "".join(order), k + 1] = (
                    sum(not f & (before | {x}) for f, _ in mine), len(gone), sum(x in f and bool(f & before) for f, _ in mine),
                    sum(f == {x} for f, _ in mine), sum(d in good for d in gone), sum(d in toxic for d in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, lang, 1, 2, "x", 9) for d, t, lang in rows], SCHEMA).repartition(5)
    got = op12.filter_audit(docs, spark.createDataFrame(labels, LABELS), op12._filters(F.col("text")), "E")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}


LONG = " ".join(f"w{i}" for i in range(120))


def test_against_all_orders(spark):
    rows = [(1, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (4, "A B C", "en"), (5, "a a\t\x0ba a", "de"), (6, None, "en"), (7, "", "en"), (8, "50 % OFF", ""), (9, LONG + " #", "en"), (10, "Größe ÄÄÄ " * 60, "de")]
    rows += [(None, LONG, "en"), (None, "a b", "fr"), (2, LONG, "de"), (1, LONG, "fr"), (11, "x " * 200_000, "en"), (12, "a b", "fr"), (13, "a b", "fr")]
    rows += [(i, "the same again " * 40, "en" if i % 3 else "es") for i in range(100, 400)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (101, 1, 1), (103, 1, 0), (999, 1, 1)]
    assert audit(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "a", None)]
    assert audit(spark, rows, []) == brute(rows, [])


def test_any_set_of_filters(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "xy", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    got = op12.filter_audit(docs, spark.createDataFrame([], LABELS), {"p": F.length("text") > 1, "q": F.col("text").contains("x")}).collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in got} == {("pq", 1): (2, 1, 0, 1), ("pq", 2): (1, 1, 1, 3), ("qp", 1): (1, 2, 0, 3), ("qp", 2): (1, 0, 1, 1)}
    with pytest.raises(ValueError):
        op12.filter_audit(docs, docs, {x: F.lit(True) for x in "abcdefg"})
