"""The stages of the pipeline on small inputs, and the whole of it against plain Python."""

import sys

import numpy as np
import pytest

import corpus_pipeline as cp

from .test_small import ODD, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __doc string, __own long"
ITEM = prose(40, 3)


def table(spark, rows, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "xx"), None, len(t or ""), "d", k) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_go_by_id_and_text(spark, sf_dir):
    a, b = prose(60, 1), prose(60, 2)
    near = a + " and"
    rows = [*ODD, (10, a), (50, a), (50, b), (60, near), (70, b), (70, b), (None, prose(50, 5)), (80, prose(50, 5))]
    got = kept(cp.near_duplicates(spark, table(spark, rows), sf_dir))
    assert got == sorted([*ODD[:-1], (10, a), (50, b), (None, prose(50, 5))], key=str)
    assert cp.near_duplicates(spark, table(spark, []), sf_dir).count() == 0
    twice = cp.near_duplicates(spark, table(spark, [(5, a), (5, a)]), sf_dir).collect()
    assert [r["__own"] for r in twice] == [0] and twice[0].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")}


def test_every_stage_takes_odd_rows(spark, sf_dir):
    for rows in ([], ODD, [(i, None) for i in range(3)]):
        for name, step in cp.STAGES:
            df = step(spark, table(spark, rows), sf_dir)
            n = df.count()
            if name in ("substring_dedup", "benchmark_decontamination"):
                assert kept(df) == sorted(rows, key=str)
            if name == "packing":
                assert n == len(rows)
            else:
                assert df.columns == table(spark, []).columns


def test_texts_of_which_nothing_is_left_go(spark, sf_dir):
    p = prose(70, 9)
    got = dict(kept(cp.substring_dedup(spark, table(spark, [(1, p), (2, p), (3, f"{prose(5, 1)} {p} {prose(5, 2)}"), (4, " "), (5, None)]), sf_dir)))
    assert got.keys() == {1, 3, 4, 5} and got[3].split() == (prose(5, 1) + " " + prose(5, 2)).split()


def test_run_against_plain_python(spark, tmp_path):
    """Clean documents stay whole; of copies, near copies, passages, benchmark texts and other languages only the first or none is packed."""
    at, rng = str(tmp_path), np.random.default_rng(7)
    words_ = {"xx": prose(300, 21).split(), "yy": [w.upper().translate(str.maketrans("ABCDEFGHIJKLMNOP", "qrstuvwxyzbcdfgh")) for w in prose(300, 22).split()]}
    text = lambda lang, n: " ".join(rng.choice(words_[lang], n))
    rows, lang = [], {}
    for i in range(60):
        lang[i] = "xx" if i % 3 else "yy"
        rows.append((i, text(lang[i], int(rng.integers(60, 90)))))
    clean = dict(rows)
    passage = text("xx", 70)
    rows += [(100, clean[4]), (101, clean[5] + " x"), (102, f"{text('xx', 30)} {passage} {text('xx', 30)}"), (103, f"{text('xx', 30)} {passage} {text('xx', 30)}")]
    item = text("xx", 40)
    rows += [(104, f"{text('xx', 40)} {item} {text('xx', 40)}"), (105, "?! 12"), (106, None), (107, "")]
    by_id = dict(rows)
    table(spark, rows, lang).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out = cp.run(spark, at).collect()

    want = {i: by_id[i] for i in by_id if i not in (100, 101, 104, 105, 106, 107)}
    w = by_id[103].split()
    want[103] = " ".join([*w[:30], *w[100:]])
    from tokenizers import Tokenizer

    from skyframe.llm.op7_packing import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    sizes = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
    assert {r["doc_id"]: r["length"] for r in out} == sizes
    assert len({r["sequence_id"] for r in out}) <= -(-sum(sizes.values()) // 2048) + 1


def test_the_rest_imports_without_the_pipeline(monkeypatch):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len([q for q in __spark_entry__.queries() if q.startswith("op")]) == 10
    assert sys.modules["corpus_pipeline"].STAGES[0][0] == "language_id"
