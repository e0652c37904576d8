"""Registered queries of this subpackage over the test tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import (
    audit,
    decontam,
    langid,
    lines,
    minhash,
    quality,
    runs,
    secrets,
    sentencepieces,
    substrings,
    token_counts,
    topk,
    toxicity,
)
from flowlens.llm.tables import documents, table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return sentencepieces.digests(sentencepieces.encode_decode(docs, public_tokenizers.path(PIECE_MODEL)))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def _fold(id_col: str, folds: int):
    """Fold of an id; null ids have none."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = _fold("doc_id", 3)
    model = langid.train(docs.where(fold != 1), key=F.xxhash64("doc_id"))
    found = langid.identify(docs.select("doc_id", "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    counted = token_counts.count_tokens(docs, public_tokenizers.path(BYTE_VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(table(spark, sf_dir, "documents"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = _fold("doc_id", 4)
    network = toxicity.train(docs.join(labels.where(fold != 2), "doc_id"), key=F.xxhash64("doc_id"))
    scored = toxicity.score(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), network)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_topk": op2_topk,
    "op3_langid": op3_langid,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_substring": op7_substring,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_quality": op11_quality,
    "op12_audit": op12_audit,
    "op13_runs": op13_runs,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op2_topk": topk.oracle_sql(k=20, every=20),
    "op5_line_dedup": lines.oracle_sql(),
    "op6_minhash": minhash.oracle_sql(width=2, percent=80),
    "op7_substring": substrings.oracle_sql(),
    "op8_secrets": secrets.oracle_sql(),
    "op10_decontamination": decontam.oracle_sql(),
    "op12_audit": audit.oracle_sql(),
    "op13_runs": runs.oracle_sql(),
}
