"""Small cases of every operator: nulls, empty tables and texts, repeated rows, ties, clashing names, long texts."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import _common
from skyframe.llm import op1_jaccard_join as op1
from skyframe.llm import op2_license_scan as op2
from skyframe.llm import op3_decontamination as op3
from skyframe.llm import op4_substring_dedup as op4
from skyframe.llm import op5_suffix_dedup as op5
from skyframe.llm import op6_toxicity as op6
from skyframe.llm import op7_packing as op7
from skyframe.llm import op8_top_k as op8
from skyframe.llm import op9_language_id as op9
from skyframe.llm import op10_url_filter as op10

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, tag int, doc string"


def docs(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 7, 7, "x") for i, t in rows], SCHEMA)


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!"), (None, "lone words here"), (5, "two words"), (5, "two words")]


def test_jaccard_odd_rows(spark):
    got = [tuple(r) for r in op1.jaccard_join(docs(spark, ODD), n=3, threshold=(9, 10)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 1, None), (5, 1, 5), (5, 1, 5)], key=str)
    assert op1.jaccard_join(docs(spark, []), n=3).count() == 0


def test_jaccard_against_brute_force(spark):
    base = [prose(60, s).split() for s in range(4)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = "edit%d" % rng.integers(0, 3)
        rows.append((i, " ".join(w)))
    rows.append((99, prose(4000, 9)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 10 * both >= 9 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op1.jaccard_join(docs(spark, rows), n=3, threshold=(9, 10)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(150):
        s = rng.integers(0, 1 << 63, rng.integers(20, 400)).astype(np.uint64)
        sets += [np.unique(s), np.unique(np.concatenate([s[2:], s[:1]]))]
    n, bits, root = np.array([len(s) for s in sets]), [op1._bitmap(s) for s in sets], np.arange(len(sets))
    order = np.argsort(n, kind="stable")
    n, bits, sets = n[order], [bits[i] for i in order], [sets[i] for i in order]
    found = {frozenset(map(int, p)) for i, j in op1.tree_pairs(n, bits, root, 8, 10) for p in zip(i, j, strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                assert frozenset((a, b)) in found
    assert len(found) < len(sets) * 3


def test_licenses(spark):
    text = "x y " + "Licensed under the Apache License,\n Version 2.0. more " + prose(30, 1) + " Released under the MIT-License; Released under MIT License"
    got = op2.scan_licenses(docs(spark, [*ODD, (8, text)])).collect()
    assert [(r["doc_id"], r["license"], r["start"], r["end"]) for r in sorted(got, key=lambda r: r["start"])] == [
        (8, "Apache-2.0", 2, 10), (8, "MIT", 41, 46), (8, "MIT", 46, 50)
    ]
    assert op2.scan_licenses(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        op2.scan_licenses(docs(spark, []), {"none": "!"})


def test_licenses_in_either_order():
    def find(text):
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, row, name = op2.words(data, np.array([0, len(data)]), op2.ALNUM_SEPARATOR)
        return [x for k, *x in op2._Templates({"MIT": op2._template_words(op2.TEMPLATES["MIT"])}).find(name, row, 0.8)]

    assert find("Released under MIT License; Released under the MIT License") == [[0, 4, 0.8], [4, 9, 1.0]]
    assert find("Released under the MIT License. Released under MIT License") == [[0, 5, 1.0], [5, 9, 0.8]]


def test_licenses_against_brute_force(spark):
    """Every place that holds a word of a template is tried, in every text, without a count of words before."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        w = prose(int(rng.integers(0, 40)), i).split()
        for t in rng.choice(list(op2.TEMPLATES), 3):
            x = op2.TEMPLATES[t].split()
            for _ in range(int(rng.integers(0, len(x) // 5 + 2))):
                x[int(rng.integers(0, len(x)))] = ["the", "of", "license", "", "odd word"][int(rng.integers(0, 5))]
            w += [*x, *prose(int(rng.integers(0, 9)), i + 100).split(), *(["the", "software", "license"] * int(rng.integers(0, 4)))]
        rows.append((i, " ".join(w)))
    rows.append((50, "the of and or in software license " * 3000 + op2.TEMPLATES["ISC"]))
    got = sorted((r["doc_id"], r["license"], r["start"], r["end"], r["coverage"]) for r in op2.scan_licenses(docs(spark, rows)).collect())
    want = []
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        name = op2.words(data, np.array([0, len(data)]), op2.ALNUM_SEPARATOR)[3].tolist()
        for k, template in op2.TEMPLATES.items():
            b = op2._template_words(template).tolist()
            need, p, known = -(-8 * len(b) // 10), 0, Counter(b)
            while p < len(name):
                window = name[p : p + len(b) + len(b) // 2 + 2]
                # no alignment matches more words than both have
                if name[p] in known and sum((Counter(window) & known).values()) >= need and (found := op2.occurrence(window, b, need)):
                    want.append((i, k, p + found[0], p + found[1], found[2] / len(b)))
                    p += found[1]
                else:
                    p += 1
    assert got == sorted(want) and len(got) > 60 and {r[1] for r in got} == set(op2.TEMPLATES)


def test_patience_equals_a_plain_alignment_on_permutations():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.permutation(12).tolist(), rng.permutation(12).tolist()
        best = np.zeros((13, 13), int)
        for i in range(12):
            for j in range(12):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        got = op2.patience(a, b)
        assert len(got) == best[-1, -1] or len(got) >= best[-1, -1] - 1
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_decontamination(spark):
    item = prose(40, 3)
    w = item.split()
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "four words of it")], "item_id long, text string")
    moved = " ".join([prose(50, 4), *w[20:], prose(9, 5), *w[:20], prose(50, 6)])
    rows = [*ODD, (10, item), (11, moved), (12, prose(400, 7)), (13, " ".join(w[:15])), (14, "a b FOUR words, of it c")]
    found = op3.contaminated(docs(spark, rows), bench)
    assert sorted((r["doc"], r["item"], r["n_tiles"], r["coverage"]) for r in found.collect()) == [(10, 1, 1, 1.0), (11, 1, 2, 1.0), (14, 4, 1, 1.0)]
    clean = op3.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns and clean.count() == len(rows) - 3
    assert op3.contaminated(docs(spark, []), bench).count() == 0
    assert op3.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_tiles_are_greedy():
    doc, item = np.array([1, 2, 3, 9, 4, 5, 6, 7, 8], np.uint64), np.array([4, 5, 6, 7, 1, 2, 3, 8], np.uint64)
    assert op3.tile(doc, item, 3) == [(4, 0, 4), (0, 4, 3)]
    assert op3.tile(doc, item, 5) == []


def test_passages(spark):
    p = prose(60, 1).split()
    fuzzy = p[:30] + ["new"] + p[31:45] + p[46:]
    rows = [*ODD, (10, " ".join([prose(40, 2), *p, prose(40, 3)])), (11, " ".join([prose(20, 4), *fuzzy])), (12, prose(300, 5)), (13, prose(300, 6)), (14, prose(20, 7) + " " + " ".join(p[:30]))]
    found = op4.repeated_passages(docs(spark, rows))
    got = found.collect()
    assert [(r["doc"], r["source"], r["start"], r["end"]) for r in got] == [(11, 10, 20, 79)] and got[0]["matched"] == 58
    cut = {r["doc_id"]: r["text"] for r in op4.cut_passages(docs(spark, rows), found).where("doc_id > 5").collect()}
    assert cut[11].split() == rows[-4][1].split()[:20] and cut[10] == rows[-5][1] and cut[12] == rows[-3][1]
    assert op4.cut_passages(docs(spark, rows), found).count() == len(rows)
    assert op4.repeated_passages(docs(spark, [])).count() == 0


def test_chain_follows_order_and_gaps():
    pos = np.array([0, 5, 10, 200, 12, 40])
    spos = np.array([100, 105, 110, 300, 5, 140])
    assert op4.chain(pos, spos)[0] == (0, 46, 100, 146)
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8]); b = np.array([1, 2, 9, 4, 5, 7, 8])
    assert op4._in_order(a, b) == 6
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 40)), rng.integers(0, 6, rng.integers(0, 40))
        assert op4._in_order(a, b) == in_order(a.tolist(), b.tolist())


def test_chain_asks_near_blocks_behind_a_long_run():
    far = np.arange(0, 495, 5)
    near = np.concatenate([np.arange(k, k + 9) for k in range(800, 860, 15)])
    pos, spos = np.concatenate([far, near]), np.concatenate([far, near + (near - 800) // 15])
    assert sorted(op4.chain(pos, spos)) == [(0, 496, 0, 496), (800, 859, 800, 862)]


def test_passages_whose_seeds_have_other_owners(spark):
    p = prose(60, 11).split()
    halves = [" ".join(p[:30]), " ".join(p[30:])]
    around = lambda k, t: f"{prose(50, 100 + k)} {t} {prose(50, 200 + k)}"
    rows = [(1, around(1, halves[0])), (2, around(2, halves[1])), (3, around(3, " ".join(p))), (4, around(4, halves[0])), (5, around(5, halves[1])), (6, around(6, " ".join(p)))]
    rows += [(7, around(7, " ".join(p[:45]))), (8, around(8, " ".join(p[8:53]))), (9, around(9, " ".join(p[:44])))]
    got = {(r["doc"], r["source"], r["start"], r["end"]) for r in op4.repeated_passages(docs(spark, rows)).collect()}
    # brute force: whoever has 45 words in a row of an earlier document is named, with all of these words
    texts = {i: t.split() for i, t in rows}
    for i, t in texts.items():
        before = {tuple(u[k : k + 45]) for j, u in texts.items() if j < i for k in range(len(u) - 44)}
        want = {w for k in range(len(t) - 44) if tuple(t[k : k + 45]) in before for w in range(k, k + 45)}
        assert want == {w for d, _, a, b in got if d == i for w in range(a, b)}, i
    assert (6, 3, 50, 110) in got


def in_order(a, b):
    """Longest common subsequence, by the book."""
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_passages_against_all_pairs(spark):
    """Planted fuzzy passages, some behind a long common one: all pairs of texts, aligned window by window, tell which words repeat."""
    rng = np.random.default_rng(12)
    passages = [prose(int(n), 300 + k).split() for k, n in enumerate(rng.integers(50, 90, 8))]
    long = prose(500, 299).split()
    texts = {}
    for i in range(1, 41):
        w = prose(int(rng.integers(5, 60)), 400 + i).split()
        if i % 5 == 0:
            w += long + prose(80, 500 + i).split()
        p = list(passages[i % 8])
        for _ in range(int(rng.integers(0, len(p) // 12 + 1))):
            k = int(rng.integers(0, len(p)))
            p[k : k + 1] = [[], ["new%d" % k], [p[k], "more%d" % k]][int(rng.integers(0, 3))]
        texts[i] = [*w, *p, *prose(int(rng.integers(5, 60)), 600 + i).split()]
    found = op4.repeated_passages(docs(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()
    said = {(r["doc"], w) for r in found for w in range(r["start"], r["end"])}
    for r in found:
        x, y = texts[r["doc"]][r["start"] : r["end"]], texts[r["source"]][r["source_start"] : r["source_end"]]
        assert r["source"] < r["doc"] and r["matched"] <= in_order(x, y) and r["matched"] >= max(45, 0.8 * max(len(x), len(y)))
    want = set()
    for i, x in texts.items():
        for j, y in texts.items():
            if j < i and len(set(x) & set(y)) >= 45:
                # the words of a window of 56 that 45 words or more of a window of the other text match
                at = {w: k for k, w in enumerate(y)}
                for a in range(0, len(x) - 55, 4):
                    near = [at[w] for w in x[a : a + 56] if w in at]
                    if len(near) >= 45 and in_order(x[a : a + 56], y[min(near) : min(near) + 56]) >= 45:
                        want |= {(i, a + k) for k, w in enumerate(x[a : a + 56]) if w in at}
    assert len(want) > 2000 and len(want - said) <= 0.02 * len(want)


def test_align_grows_over_edits():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(50, 100))
        p = np.arange(n)
        q = p.copy()
        q[rng.choice(n, n // 12, replace=False)] = 7000 + np.arange(n // 12)
        x, y = np.concatenate([np.arange(1000, 1064), p, np.arange(2000, 2064)]), np.concatenate([np.arange(3000, 3064), q, np.arange(4000, 4064)])
        same = np.flatnonzero((p[:-5] == q[:-5]) & np.array([(p[i : i + 6] == q[i : i + 6]).all() for i in range(n - 5)]))
        if not len(same):
            continue
        at = int(rng.choice(same)) + 64
        p0, p1, s0, s1, matched, *_ = op4.align(x, y, at, at + 6, at, at + 6)
        # brute force: the most words equal within any range around the chained one that is alike enough
        equal = np.concatenate([[0], np.cumsum(x == y)])
        best = max(int(equal[b] - equal[a]) for a in range(at + 1) for b in range(at + 6, len(x) + 1) if equal[b] - equal[a] >= 0.8 * (b - a))
        assert matched >= best and matched >= 0.8 * max(p1 - p0, s1 - s0)


def test_passages_with_edits_near_their_ends(spark):
    p = prose(60, 1).split()
    q = p.copy()
    q[10], q[50] = "one", "other"
    rows = [(1, " ".join([prose(80, 2), *p, prose(80, 3)])), (2, " ".join([prose(90, 4), *q, prose(90, 5)]))]
    long = prose(900, 8).split()
    edited = [w if i % 9 or 350 < i < 550 else "w%d" % i for i, w in enumerate(long)]
    rows += [(3, " ".join(long)), (4, " ".join(edited))]
    got = {(r["doc"], r["source"]): (r["start"], r["end"], r["matched"]) for r in op4.repeated_passages(docs(spark, rows)).collect()}
    assert got == {(2, 1): (90, 150, 58), (4, 3): (1, 900, 900 - sum(a != b for a, b in zip(long, edited, strict=True)))}


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("length", [8, 20, 100])
def test_repeats_against_brute_force(spark, length):
    p = prose(40, 1)
    rows = [(1, None), (2, ""), (3, "é" * 150), (4, prose(9, 2) + p), (5, p), (6, p[50:] + prose(30, 3) + p[:130]), (7, "ab" * 300), (9, p), (None, "q" + p[10:140])]
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]]) for r in op5.remove_repeats(docs(spark, rows), length=length).collect()}
    want = brute_repeats(rows, length)
    for i, t in rows:
        kept, n, spans = got[i]
        assert kept == want[i] and n == len((t or "").encode())
        assert n - len(kept) == sum(b - a for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert op5.remove_repeats(docs(spark, []), length=length).count() == 0
    twice = op5.remove_repeats(docs(spark, [(1, p), (1, p)]), length=length)
    assert {bytes(r["kept"]) for r in twice.collect()} == {brute_repeats([(1, p)], length)[1]}


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(40, i) + (" you rotter " + prose(20, i + 9999) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    labelled = spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    model = op6.fit_toxicity(labelled)
    asked = docs(spark, [*ODD, (20, prose(50, 777) + " ROTTER!!"), (21, prose(50, 778))]).withColumn("toxicity", F.lit("old"))
    got = {r["doc_id"]: r["toxicity"] for r in op6.score_toxicity(asked, model).collect()}
    assert got[20] > 0.5 > got[21] and got[1] == got[2] and all(0 <= x <= 1 for x in got.values())
    one = op6.fit_toxicity(labelled.where("toxic = 0"))
    assert {r["toxicity"] for r in op6.score_toxicity(asked, one).collect()} == {0.0}
    none = op6.fit_toxicity(labelled.limit(0))
    assert op6.score_toxicity(docs(spark, []), none).count() == 0


def test_packing_round_trip(spark):
    rows = [*ODD, (30, prose(3000, 1)), (31, "<|endoftext|> and  odd  \n\n spaces　here  "), *[(100 + i, prose(i, i)) for i in range(60)]]
    out = op7.pack(docs(spark, rows), vocabulary=op7.default_vocabulary(), capacity=512).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op7.default_vocabulary())
    want = {}
    for i, x in rows:
        want.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        got = sorted((r["start"], tuple(r["ids"])) for r in by_doc[i])
        assert sorted(x for _, p in got for x in p) == sorted(x for d in ids for x in d)
        if len(ids) == 1:
            assert [x for _, p in got for x in p] == ids[0]
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(len(d) for ids in want.values() for d in ids)
    assert len(by_seq) <= -(-total // 512) + 1
    assert op7.pack(docs(spark, []), vocabulary=op7.default_vocabulary()).count() == 0
    digests = op7.packed_digests(docs(spark, [(31, rows[8][1])])).first()
    assert digests["ids_crc32"] == zlib.crc32(np.array(want[31][0], "<u4").tobytes())


def test_fill_swaps_the_smallest_for_a_tighter_pair():
    fills = op7.plan_fill({6: 1, 3: 1, 2: 2}, 10)
    assert sum(times for _, times in fills) == 2 and dict(fills[0][0]) == {6: 1, 2: 2}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=6) * 10.0 ** rng.integers(-1, 2)).tolist()) for i in range(400)]
    rows += [(500, None), (501, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (502, [None] * 6), (None, [1.0] * 6), (600, [0.0] * 6), (700, rows[3][1]), (701, rows[3][1]), (800, [])]
    v = op8.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in op8.top_k(v, v.where("vec_id % 100 = 0"), 10, block_rows=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    valid = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in rows if i is not None and i not in (500, 501, 502)}
    valid[800] = np.zeros(6, int)
    for q in [i for i in valid if i % 100 == 0]:
        best = sorted(((-int(valid[q] @ x), i) for i, x in valid.items() if i != q))[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    few = v.where("vec_id in (0, 1, 2)")
    assert op8.top_k(few, few.where("vec_id = 0"), 10).count() == 2
    assert op8.top_k(v.limit(0), v.limit(0), 10).count() == 0
    huge = op8.quantised(spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 0.0])], "vec_id long, embedding array<double>"))
    assert [r["score"] for r in op8.top_k(huge, huge.where("vec_id = 0"), 2).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]


def test_language(spark):
    a, b = "the cat and the dog were running over there ", "le chat et le chien couraient dans la rue "
    rng = np.random.default_rng(4)
    mixed = lambda t: " ".join(rng.permutation(t.split()))
    rows = [(i, mixed(a * 5), "en") for i in range(30)] + [(100 + i, mixed(b * 5), "fr") for i in range(40)] + [(300, None, "xx"), (301, "hm", None)]
    model = op9.fit_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("fr", "en")
    asked = docs(spark, [*ODD, (10, mixed(a)), (11, mixed(b)), (12, "1234 ?!")])
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in op9.identify_languages(asked, model).collect()}
    assert got[10][0] == "en" and got[11][0] == "fr" and got[12] == ("und", 0.0) and got[1] == ("und", 0.0) and got[2] == ("und", 0.0)
    strict = {r["doc_id"]: r["lang_pred"] for r in op9.identify_languages(asked, model, min_margin=10.0).collect()}
    assert set(strict.values()) == {"und"}
    empty = op9.fit_dictionaries(docs(spark, []))
    assert {r["lang_pred"] for r in op9.identify_languages(asked, empty).collect()} == {"und"}
    assert op9.identify_languages(docs(spark, []), model).count() == 0


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "Example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "a.example.org", "/en/12"), ("allow", "b.com", "/x"), ("block", "b.com", "/x")]
    urls = {
        "http://A.Example.org/en/12?q": "allow", "http://example.org/en/19": "block", "http://example.org/en/2": "allow", "https://x.example.org/es/": "block",
        "http://example.org/es": "allow", "http://notexample.org/es/": "allow", "ftp://q.b.com/xyz": "block", "http://c.net/": "keep", "no url": "keep", "": "keep", "http://example.org": "keep",
    }
    pages = spark.createDataFrame([(k, "old") for k in urls] + [(None, "old")], "url string, verdict string")
    got = {r["url"]: r for r in op10.filter_urls(pages, rules, default="keep").collect()}
    assert {k: got[k]["verdict"] for k in urls} == urls
    assert got[None]["verdict"] == "keep" and (got[None]["host"], got[None]["path"], got[None]["rule"]) == ("", "", None)
    assert got["http://A.Example.org/en/12?q"]["rule"] == "a.example.org/en/12"
    assert op10.filter_urls(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        op10.filter_urls(pages, rules, max_trie_bytes=10)


def test_jaccard_groups_with_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(op1, "MANY_PAIRS", 0)
    base = prose(80, 1).split()
    rows = [(i, " ".join([*base[: 80 - i % 3], "end%d" % i])) for i in range(40)] + [(90, prose(80, 2))]
    got = {r["doc_id"]: r["component_id"] for r in op1.jaccard_join(docs(spark, rows), n=3, threshold=(9, 10)).collect()}
    assert got == {i: 90 if i == 90 else 0 for i, _ in rows}


def test_jaccard_groups_hand_on_fewer_rows_than_pairs(spark, monkeypatch):
    """Near copies that bitmaps cannot tell from links, and of which few are: their pairs stay in the groups."""
    made, write = [], op1.stage

    def counted(df, name, **options):
        out = write(df, name, **options)
        if name in ("pairs", "links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(op1, "stage", counted)
    base, m = prose(480, 1).split(), 150
    rows = []
    for i in range(m):
        w = list(base)
        w[32 * (i % 15) : 32 * (i % 15) + 30 : 3] = ["edit%d" % i] * 10
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(478)} for _, t in rows]
    root, near = list(range(m)), 0
    for a in range(m):
        for b in range(a):
            both = len(sets[a] & sets[b])
            near += 10 * both >= 7 * (len(sets[a]) + len(sets[b]) - both)
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in op1.jaccard_join(docs(spark, rows), n=3, threshold=(8, 10)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 10 and near > 40 * m
    assert max(made) < 20 * m


def test_jaccard_whole_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op1, "MANY_PAIRS", 0)
    monkeypatch.setattr(op1, "BLOCK_SHINGLES", 1_000)
    base = prose(80, 1).split()
    rows = [(i, " ".join([*base[i : i + 60]])) for i in range(20)] + [(90, prose(60, 2)), (91, "")]
    got = {r["doc_id"]: r["component_id"] for r in op1.jaccard_join(docs(spark, rows), n=3, threshold=(9, 10)).collect()}
    assert got == {i: i if i >= 90 else 0 for i, _ in rows}


def test_substring_dedup_forgets_shuffles_before_the_next(spark, monkeypatch):
    """Shuffle files of the join of seeds are gone when passages are aligned, and do not add to the disk taken then."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", str(disk.getAllFiles().toString())))
    made, left, write, chains = set(), [], _common.stage, op4._chains

    def written(df, name, **options):
        before = shuffles()
        out = write(df, name, **options)
        if name == "matches":
            made.update(shuffles() - before)
        return out

    def counted(matches, min_words):
        end = time.time() + 3
        while made & shuffles() and time.time() < end:
            time.sleep(0.1)
        left.append(made & shuffles())
        return chains(matches, min_words)

    p = prose(70, 9)
    rows = docs(spark, [(i, f"{prose(20, i)} {p} {prose(20, 50 + i)}") for i in range(1, 5)])
    monkeypatch.setattr(_common, "stage", written)
    monkeypatch.setattr(op4, "stage", written)
    monkeypatch.setattr(op4, "_chains", counted)
    assert op4.repeated_passages(rows).count() == 3
    assert made and not left[0]
