"""Filter interaction audit: what each filter of a set removes in every order of the set, by a recursive common table expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm._common import stage, table

#: All prefixes of the orders of six filters over all their masks are 125,000 rows; of seven, more than Spark's recursion may return.
MOST_FILTERS = 6
MEASURES = ("n", "good", "toxic")

#: A level takes every prefix of the level before, adds each letter whose bit is not applied, and judges each mask cell in it.
STEPS_SQL = """
WITH RECURSIVE steps(filter_order, applied, letter, mask, kept, removed, redundant, unique_fails) AS (
  SELECT '', 0, '', mask, true, false, false, false FROM {cells}
  UNION ALL
  SELECT concat(filter_order, next.letter), applied | next.bit, next.letter, c.mask,
         c.mask & (applied | next.bit) = 0,
         c.mask & next.bit != 0 AND c.mask & applied = 0,
         c.mask & next.bit != 0 AND c.mask & applied != 0,
         c.mask = next.bit
  FROM steps s JOIN {cells} c ON s.mask = c.mask
  LATERAL VIEW explode(filter(c.letters, x -> applied & x.bit = 0)) unused AS next
)
SELECT filter_order, letter, mask, kept, removed, redundant, unique_fails FROM steps WHERE applied > 0
"""


def mask_cells(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], duplicates: str | None, *, key: str, text: str, part: str) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of every part that fail just the filters of a mask, bit i for the i-th letter.

    Copies meet as rows of one text's digest, a part and a mask, summed before they are shuffled, so a text of a third of
    all documents is a row from each task. The least key and what it counts travel along as a struct, so no document is
    joined with its group.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    bits = {letter: 1 << i for i, letter in enumerate([*failures, *([duplicates] if duplicates else [])])}
    fails = sum((F.when(failed, bits[letter]).otherwise(0) for letter, failed in failures.items()), F.lit(0))
    facts = docs.select(docs[key].alias("key"), F.coalesce(docs[part], F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("same"), fails.cast("int").alias("fails"))
    marks = labels.groupBy(labels[key].alias("key")).agg(*[F.max(F.coalesce(labels[source] == 1, F.lit(False)).cast("long")).alias(name) for source, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = facts.groupBy("key", "part", "same", "fails").agg(F.count(F.lit(1)).alias("n")).join(marks, "key", "left")
    rows = rows.select("key", "part", "same", "fails", "n", *[(F.col("n") * F.coalesce(m, F.lit(0))).alias(m) for m in ("good", "toxic")])
    if not duplicates:
        return rows.groupBy("part", F.col("fails").alias("mask")).agg(*[F.sum(m).alias(m) for m in MEASURES])
    named = F.col("key").isNotNull()
    copies = rows.groupBy("same", "part", "fails").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        *[F.coalesce(F.sum(F.when(named, F.col(m))), F.lit(0)).alias(f"named_{m}") for m in MEASURES],
        F.min(F.when(named, F.struct("key", *MEASURES))).alias("least"),
    )
    copies = copies.withColumn("stays", F.coalesce(F.col("least.key") == F.min("least.key").over(Window.partitionBy("same")), F.lit(False)))
    later = {m: F.col(f"named_{m}") - F.when(F.col("stays"), F.col(f"least.{m}")).otherwise(0) for m in MEASURES}
    halves = F.array(
        F.struct(F.col("fails").alias("mask"), *[(F.col(m) - later[m]).alias(m) for m in MEASURES]),
        F.struct(F.col("fails").bitwiseOR(F.lit(bits[duplicates])).alias("mask"), *[later[m].alias(m) for m in MEASURES]),
    )
    cells = copies.select("part", F.inline(halves)).where("n > 0")
    return cells.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def filter_audit(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], duplicates: str | None = None, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each step of each order of filters does in every part of ``docs``, one row for each part, order and step.

    ``failures`` maps letters to columns that are true where a document fails; ``duplicates`` is the letter of one more filter
    that fails a document whose text a document of a smaller key has as well, in whatever part and whether removed or not.
    ``kept`` counts documents left after the step, ``removed`` those that it takes out, ``redundant`` those that fail its
    filter but went before, ``unique_fails`` those that fail no other; ``good_lost`` and ``toxic_lost`` are the removed ones
    that ``labels`` marks; ``shapley`` sums what the step's filter removes over all orders.

    Null texts are empty, a null part is the empty one, a condition that is null is not failed. A document without a key
    fails ``duplicates`` never and makes no other fail; rows that repeat a key and its text are copies of one rank, of which
    none makes another fail. Of several labels of a key, any 1 counts. Other columns are not looked at; no documents, no rows.
    The recursion goes over masks that occur, at most 2 to the number of filters, so its size does not depend on the table's.
    """
    letters = [*failures, *([duplicates] if duplicates else [])]
    if not 0 < len(letters) <= MOST_FILTERS or any(len(x) != 1 for x in letters) or len(set(letters)) < len(letters):
        raise ValueError(f"one to {MOST_FILTERS} filters are named by a letter each, not {letters}")
    cells = stage(mask_cells(docs, labels, failures, duplicates, key=key, text=text, part=part), "cells")
    known = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(letters)])
    masks = stage(cells.select("mask").distinct().withColumn("letters", known), "masks")
    steps = stage(docs.sparkSession.sql(STEPS_SQL, cells=masks), "steps")
    counted = F.broadcast(steps).join(cells, "mask").groupBy("part", "filter_order", "letter")
    took = {"kept": ("kept", "n"), "removed": ("removed", "n"), "redundant": ("redundant", "n"), "unique_fails": ("unique_fails", "n"), "good_lost": ("removed", "good"), "toxic_lost": ("removed", "toxic")}
    counted = counted.agg(*[F.sum(F.when(F.col(flag), F.col(m)).otherwise(0)).alias(name) for name, (flag, m) in took.items()])
    orders = steps.where(F.length("filter_order") == len(letters)).select(F.col("filter_order").alias("whole")).distinct()
    orders = orders.select("whole", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("filter_order", F.expr("left(whole, step)"))
    told = counted.join(F.broadcast(orders), "filter_order")
    told = told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return told.select("part", F.col("whole").alias("filter_order"), "step", *took, "shapley")


def _filters(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 10 * F.length(whole),
        "D": whole.rlike("[#$%&*|]"),
    }


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit(docs, table(spark, sf_dir, "labels"), _filters(F.col("text")), "E")


OP12_SQL = r"""
WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), masks AS (
  SELECT part, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM words LEFT JOIN labels USING (doc_id)
), orders(filter_order, applied) AS (
  SELECT '', 0
  UNION ALL
  SELECT filter_order || letter, applied | bit FROM orders JOIN letters ON applied & bit = 0
), steps AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE position(l.letter IN filter_order) < step) AS applied
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5) JOIN letters ON letter = filter_order[step]
), told AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
         sum(CASE WHEN mask & (applied | bit) = 0 THEN 1 ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 THEN 1 ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied <> 0 THEN 1 ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN 1 ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 AND good = 1 THEN 1 ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & applied = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""
