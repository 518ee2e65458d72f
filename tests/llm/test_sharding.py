"""Op 13: places by a plain walk of the same network, laws, odd rows, files."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyframe.llm import op13_sharding as op13

SCHEMA = "doc_id long, text string, shard string, Slot int, part int, at int"


def plain_place(number, n, seed):
    side = 1
    while side * side < n:
        side += 1
    while True:
        a, b = divmod(number, side)
        for factor, summand in op13.round_keys(seed):
            a, b = b, (a + pow(b * factor + summand, 2, op13.PRIME)) % side
        number = a * side + b
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_places_are_a_walked_network(spark, n):
    home, slot = op13.place(F.col("id"), n, 16, 7)
    rows = spark.range(n).select("id", home.alias("shard"), slot.alias("slot")).withColumn("back", op13.row_at(F.col("shard"), F.col("slot"), n, 16, 7)).collect()
    assert {r["id"]: r["slot"] * 16 + r["shard"] for r in rows} == {i: plain_place(i, n, 7) for i in range(n)}
    assert all(r["back"] == r["id"] for r in rows)
    assert sorted(r["slot"] * 16 + r["shard"] for r in rows) == list(range(n))


def test_places_of_very_many_rows(spark):
    n = 10**15 + 7
    home, slot = op13.place(F.col("id"), n, 16, 7)
    rows = spark.range(n - 50, n).select("id", home.alias("shard"), slot.alias("slot")).withColumn("back", op13.row_at(F.col("shard"), F.col("slot"), n, 16, 7)).collect()
    assert all(r["back"] == r["id"] and 0 <= r["slot"] * 16 + r["shard"] < n for r in rows)
    assert rows[0]["slot"] * 16 + rows[0]["shard"] == plain_place(n - 50, n, 7)
    assert spark.range(1).select(op13.row_at(F.lit(15), F.lit(n), n, 16, 7).alias("r")).first()["r"] is None


def test_a_shuffle_looks_like_one(spark):
    n = 20_000
    home, slot = op13.place(F.col("id"), n, 16, 1)
    at = [r["at"] for r in spark.range(n).orderBy("id").select((slot * 16 + home).alias("at")).collect()]
    up = sum(b > a for a, b in zip(at, at[1:]))
    assert abs(up / n - 0.5) < 0.02
    blocks = Counter((i // 2000, a // 2000) for i, a in enumerate(at))
    assert all(abs(blocks[i, j] - 200) < 80 for i in range(10) for j in range(10))


def law(rows):
    """Slots are gapless from 0 in every shard and counts are at most one apart."""
    of = {}
    for r in rows:
        of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in of.values())
    counts = [len(of.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1


def test_odd_rows(spark):
    odd = [(None, "x"), (None, None), (1, None), (2, ""), (3, "a" * 300_000)] + [(5, "again and again")] * 400 + [(i, f"t{i}") for i in range(10, 300)]
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in odd], SCHEMA)
    got = op13.shard(docs, [F.col("doc_id"), F.xxhash64("text")])
    assert got.columns == ["doc_id", "text", "part", "at", "shard", "slot"]
    rows = got.collect()
    law(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(odd, key=str)
    again = op13.shard(docs.repartition(7), [F.col("doc_id"), F.xxhash64("text")]).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert op13.shard(docs.where("false"), [F.col("doc_id")]).collect() == []


def test_query_over_whole_table(spark, tmp_path):
    at = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = op13.op13_sharding(spark, at).collect()
    law(rows)
    numbers = {d: i for i, d in enumerate(sorted(docs))}
    assert {r["doc_id"]: r["slot"] * 16 + r["shard"] for r in rows} == {d: plain_place(numbers[d], len(docs), op13.SEED) for d in docs}
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode()) + 1 for r in rows)


def test_files_of_shards(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    op13.write_shards(docs, [F.col("doc_id")], str(tmp_path / "out"), shards=4, rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r["count"] for r in back.groupBy("shard").count().collect()} == {25}
    assert max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) == 10
