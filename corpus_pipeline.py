"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes
each stage's rows as Parquet below spark.checkpoint.dir and reads them back for the next one. All
but the last stage return the columns of documents. Language, line and near-duplicate parts cannot
all be said in SQL (estimation, component search and piece merging iterate), so ORACLE_SQL is None
and the stages are tested against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import decontam, langid, lines, minhash, sentencepieces
from flowlens.llm.tables import settle, table, unused

#: Words of a shingle and hundredths of similarity of near duplicates.
SHINGLE, PERCENT = 5, 80
PIECE_MODEL = "piece_bpe_32k.model"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language; texts that are null or have no letter go.

    The model learns from the labelled rows of `documents`; the label of a row is never an input of
    its own prediction. Nothing else is dropped and no column changes. Without labels nothing can be
    recognised, and every text with a letter stays.
    """
    model = langid.train(table(spark, sf_dir, "documents"), key=F.xxhash64("doc_id"))
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score, shares = unused(docs, "found_lang", "found_score", "found_shares")
    found = langid.identify(docs, model, pred_col=lang, score_col=score, shares_col=shares)
    return found.where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of the texts; no document goes. n_chars follows the new text."""
    cleaned = lines.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return cleaned.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates, word shingles of five at 80 %.

    An id stands for one document: its repeated rows stay or go together, and it stays if any of
    them is kept. Rows without an id stay, as do texts without words.
    """
    found = minhash.near_duplicates(docs, width=SHINGLE, percent=PERCENT)
    verdict = found.groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = settle(verdict.where(~F.col("kept")).select("doc_id"), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which the words hit by benchmark windows are a twentieth of all words or more.

    Repeated rows of an id go together if one of them is contaminated; rows without an id stay.
    """
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = settle(found.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether decoding gives the text back."""
    encoded = sentencepieces.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(PIECE_MODEL))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
