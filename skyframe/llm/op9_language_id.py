"""Language identification by compression: the language whose dictionary shortens a text most."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyframe.llm._common import crc_mod, release, small_batches, table

UNDETERMINED = "und"
#: A text is encoded in pieces, so that the dictionary and not the text's own beginning explains each of them.
PIECE_BYTES = 2_048
LEVEL = 6


@dataclass(frozen=True)
class LanguageDictionaries:
    """One raw-content zstandard dictionary per language, the language with most labelled rows first."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]


def fit_dictionaries(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    max_excerpts: int = 1_000,
    excerpt_chars: int = 400,
    max_chars: int = 32 << 20,
) -> LanguageDictionaries:
    """Takes a bounded sample: ``max_excerpts`` excerpts of ``excerpt_chars`` letters per language, in hash order.

    Counting languages reads the ``lang`` column alone; the excerpts come from a share of the rows that follows from
    these counts, so nothing that grows with the table is shuffled or collected. Rows with a null text or language
    teach nothing. Every language that has a letter in its texts is learned; all dictionaries together hold at most
    ``max_chars`` letters, or one excerpt each. The same rows give the same dictionaries, whatever their order.
    """
    rows = labelled.select(labelled[lang].alias("lang"), labelled[text].alias("text")).where("lang is not null and text is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return LanguageDictionaries((), ())
    max_excerpts = max(1, min(max_excerpts, max_chars // (excerpt_chars * len(found))))
    bits = 1 << 40
    share = {r["lang"]: min(bits, int(4.0 * max_excerpts / r["count"] * bits) + 1) for r in found}
    shares = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    order = F.pmod(F.xxhash64("text"), F.lit(bits))
    start = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - excerpt_chars))
    sample = (
        rows.where(order < shares[F.col("lang")])
        .select("lang", order.alias("order"), F.lower(F.substring("text", start.cast("int"), F.lit(excerpt_chars))).alias("excerpt"))
        .where(F.col("excerpt").rlike(r"\p{L}"))
        .groupBy("lang", "excerpt")
        .agg(F.min("order").alias("order"))
    )
    first = Window.partitionBy("lang").orderBy("order", "excerpt")
    kept = sample.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max_excerpts).select("lang", "k", "excerpt").collect()
    texts: dict[str, list[tuple[int, str]]] = {r["lang"]: [] for r in found}
    for r in kept:
        texts[r["lang"]].append((r["k"], r["excerpt"]))
    names = [r["lang"] for r in found if texts[r["lang"]]]
    # the nearest content costs the shortest offsets; the order within a dictionary is that of the sample
    return LanguageDictionaries(tuple(names), tuple("\n".join(t for _, t in sorted(texts[k])).encode() for k in names))


def encoded_sizes(texts: Iterable[str], compressors: Sequence[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes of each text under each dictionary."""
    out = []
    for t in texts:
        data = t.lower().encode("utf-8", "surrogatepass")
        pieces = [data[a : a + PIECE_BYTES] for a in range(0, len(data), PIECE_BYTES)]
        out.append([sum(len(c.compress(p)) for p in pieces) for c in compressors])
    return np.array(out, float).reshape(-1, len(compressors))


def identify_languages(
    docs: DataFrame, model: LanguageDictionaries, *, text: str = "text", min_margin: float = 0.0, columns: tuple[str, str] = ("lang_pred", "lang_score")
) -> DataFrame:
    """Adds the predicted language and a score from 0 to 1; a narrow job without a shuffle over whole texts.

    ``min_margin``: the language is ``und`` where the best encoding is not shorter than the second by this share of
    its bytes. The dictionaries (languages x excerpts, bounded when they are fitted) are broadcast.

    * null text, empty text, a text without a letter, or a model without languages: ``und`` with score 0.
    * ties: the language with more labelled rows; a single language always wins.
    * very long texts are encoded piece by piece, in constant memory beside the text itself.
    * repeated rows and other columns are kept; columns of the two names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = shared.value.languages
        compressors = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0, write_checksum=0),
            )
            for c in shared.value.contents
        ]
        for texts in columns:
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            told = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)) if names else np.zeros(0, np.int64)
            if len(told):
                sizes = encoded_sizes((texts[i].as_py() for i in told.tolist()), compressors)
                best = sizes.argmin(axis=1)
                least = sizes[np.arange(len(told)), best]
                if len(names) > 1:
                    margin = (np.partition(sizes, 1, axis=1)[:, 1] - least) / np.maximum(least, 1)
                else:
                    margin = np.ones(len(told))
                # a byte more is a factor of two in odds, held back by half as bytes of a text depend on each other
                sure = 1 / np.exp2(np.maximum(least[:, None] - sizes, -60) / 2).sum(axis=1)
                ok = margin >= min_margin
                lang[told[ok]] = np.array(names, object)[best[ok]]
                score[told[ok]] = sure[ok]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])
            release()

    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in columns}]
    lettered: Column = F.when(docs[text].rlike(r"\p{L}"), docs[text])
    judged = docs.select(*[docs[c] for c in kept], judge(lettered).alias("__judged"))
    return judged.select(*[judged[c] for c in kept], F.col("__judged.lang").alias(columns[0]), F.col("__judged.score").alias(columns[1]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_dictionaries(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    named = identify_languages(docs.drop("lang"), model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
