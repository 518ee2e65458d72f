"""A training corpus from documents: each stage reads what the one before it kept.

Stages take ``(spark, docs, sf_dir)``. The driver writes each result as Parquet and rereads it; :func:`run` does the same
in the shared folder. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import _bitmap
from skyframe.llm._common import crc_mod, stage, table
from skyframe.llm.op1_jaccard_join import jaccard_join
from skyframe.llm.op3_decontamination import decontaminate
from skyframe.llm.op4_substring_dedup import cut_passages, repeated_passages
from skyframe.llm.op7_packing import packed_digests
from skyframe.llm.op9_language_id import UNDETERMINED, fit_dictionaries, identify_languages

#: Encodings this near to each other say nothing about the language.
LANGUAGE_MARGIN = 0.0005


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no learned language: null, without a letter, or as short in two languages' encodings."""
    model = fit_dictionaries(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    named = identify_languages(docs, model, min_margin=LANGUAGE_MARGIN, columns=("__lang", "__score"))
    return named.where(F.col("__lang") != UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group linked by 0.8 of its five-word shingles or more.

    A document is an id with a text: of two texts with one id, each is judged by itself. Ids come in order, no id before
    all others. Rows repeated with id and text count once, and the least of them stays. Texts without a word are like
    no other text and stay. Only rows that may have to go are moved.
    """
    own = F.struct("doc_id", F.xxhash64("text").alias("tag"))
    groups = stage(jaccard_join(docs.select(own.alias("own"), "text"), key="own", n=5, threshold=(4, 5)), "groups")
    going = groups.where(~F.col("own").eqNullSafe(F.col("component_id"))).select(F.xxhash64("own").alias("__own")).distinct()
    repeated = groups.groupBy(F.xxhash64("own").alias("__own")).count().where("count > 1").select("__own")
    named = docs.select(F.struct(*docs.columns).alias("__doc"), F.xxhash64(own).alias("__own"))
    sure, asked = _bitmap.split(named, "__own", going.union(repeated))
    left = asked.join(going, "__own", "left_anti").groupBy("__own").agg(F.min("__doc").alias("__doc"))
    return sure.select("__doc").unionByName(left.select("__doc")).select("__doc.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out of texts that an earlier document has as well; a text of which nothing is left goes.

    The first document keeps a passage, by id, no id before all others; texts that were null or blank before stay.
    """
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    cut = cut_passages(docs.withColumn("__blank", blank), repeated_passages(docs))
    return cut.where(F.col("__blank") | ~blank).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of the words of an item of ``benchmark``; null and empty texts cover none and stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, null texts as empty ones, into sequences of 2048 tokens; one row for each piece."""
    return packed_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Compression, chaining, tiling and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
