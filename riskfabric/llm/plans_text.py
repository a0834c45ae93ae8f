"""Queries over whole texts: licenses, secrets, tokens, language, quality."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm import binary, bpe, langid, licenses, quality, secrets, text_sql
from riskfabric.llm.common import table
from riskfabric.session import scratch


def tokenizer_definition(name: str) -> str:
    """The tokenizer's JSON, read by the driver and sent with the tasks; the files stay where they are installed."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.with_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("_spans", lambda s: s["kind"] != secrets.RANDOM)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *[count(b[0]) for b in secrets.BASE], F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                       secrets.span_text(F.col("_spans")).alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_definition("word_bpe_49k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    shards = binary.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_definition("byte_bpe_50k.json"), folder)
    return binary.read_documents(spark, folder, shards)


QUERIES = {"op1_license_scan": op1_license_scan, "op2_secret_scan": op2_secret_scan, "op4_bpe": op4_bpe, "op6_language": op6_language,
           "op9_quality": op9_quality, "op10_token_files": op10_token_files}
ORACLES = {"op1_license_scan": text_sql.license_sql(), "op2_secret_scan": text_sql.secret_sql()}
