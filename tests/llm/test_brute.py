"""Decontamination, language identification and toxicity's sample against plain versions; the held-out rules of the queries."""

import random
import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from skyframe.llm import op3_decontamination as op3
from skyframe.llm import op6_toxicity as op6
from skyframe.llm import op9_language_id as op9

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def tiles(doc, item, least):
    """Greedy string tiling word by word: the longest match of unmarked words, the first in the document, then in the item."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < least:
            return out
        out.append(n)
        free_d[d : d + n] = free_i[i : i + n] = [False] * n


def test_decontamination_against_plain_tiling(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([3, 8, 20, 45])))) for k in range(12)] + [(50, ""), (51, None), (52, "w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(60):
        text = say(rng.randrange(5, 40))
        for _ in range(rng.randrange(3)):
            said = items[rng.randrange(12)][1].split()
            cut = rng.randrange(len(said) + 1)
            parts = [said[cut:], said[:cut]] if rng.random() < 0.5 else [said[: cut + 4], said[cut + 5 :]]
            for part in parts:
                at = rng.randrange(len(text) + 1)
                text[at:at] = [w.upper() if rng.random() < 0.1 else w for w in part]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(60, None), (61, ""), (62, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (63, docs[0][1]), (3, docs[3][1])]
    want = set()
    for d, text in docs:
        for i, item in items:
            iw = words(item)
            if iw:
                found = tiles(words(text), iw, min(5, len(iw)))
                if sum(found) >= 0.5 * len(iw):
                    want.add((d, i, len(iw), sum(found), len(found)))
    got = op3.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc"], r["item"], r["n_words"], r["matched"], r["n_tiles"]) for r in got.collect()} == want and len(want) > 20


def test_languages_against_plain_compression(spark):
    rng = random.Random(2)
    letters = {"aa": "abcde ", "bb": "defgh ", "cc": "ghijk "}
    say = lambda k, n: "".join(rng.choice(letters[k]) for _ in range(n)).strip() or "a"
    model = op9.fit_dictionaries(spark.createDataFrame([(say(k, 300), k) for k in letters for _ in range(30)], "text string, lang string"))
    texts = [say(k, n) for k in letters for n in (1, 3, 40, 5_000)] + ["ÄÖ é", "123", "", None, say("aa", 30).upper(), "d"]
    got = [(r["lang_pred"], r["lang_score"]) for r in op9.identify_languages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string"), model).orderBy("i").collect()]
    for text, (lang, score) in zip(texts, got):
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (lang, score) == ("und", 0.0)
            continue
        sizes = []
        for content in model.contents:
            parameters = zstandard.ZstdCompressionParameters.from_level(op9.LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0)
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
            data = text.lower().encode()
            sizes.append(sum(len(coder.compress(data[a : a + op9.PIECE_BYTES])) for a in range(0, len(data), op9.PIECE_BYTES)))
        assert lang == model.languages[sizes.index(min(sizes))]
        assert score == pytest.approx(1 / sum(2 ** ((min(sizes) - s) / 2) for s in sizes), rel=1e-6)


def test_toxicity_of_very_many_copies(spark):
    """Copies of one text neither fill the sample nor take a class out of it."""
    rng = random.Random(7)
    ordinary = [" ".join(rng.choice(["sun", "rain", "wind", "tree", "house", "road"]) for _ in range(12)) for _ in range(300)]
    rows = [(t, 0) for t in ordinary] + [(t + " you rotter", 1) for t in ordinary[:40]] + [(ordinary[0], 0)] * 4_000 + [(None, 1), ("x", None)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    sample = op6._sampled(labelled.where("text is not null and toxic is not null"), 100)
    held = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert held[1] == 40 and 20 < held[0] < 90 and sample.distinct().count() == sum(held.values())
    model = op6.fit_toxicity(labelled, rare=2, fit_texts=200, calibrate_texts=100)
    assert model.prior == pytest.approx(40 / 4_340)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([ordinary[0], ordinary[200], ordinary[201] + " you rotter", "", None])], "i long, text string")
    score = [r["toxicity"] for r in op6.score_toxicity(asked, model).orderBy("i").collect()]
    assert score[2] > 0.5 > max(score[0], score[1], score[3], score[4])


@pytest.mark.parametrize(("query", "modulus", "left_out"), [(op6.op6_toxicity, 5, 0), (op9.op9_language_id, 4, 2)])
def test_held_out_rows(spark, query, modulus, left_out):
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == left_out) and 0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    got, want = ({r["doc_id"]: r["score"] for r in op6.op6_toxicity(spark, at).collect()} for at in (str(tmp_path), SF))
    assert got == pytest.approx(want)
