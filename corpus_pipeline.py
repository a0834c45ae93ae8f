"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

language (6) drops what has no identifiable language, near_duplicates (7) keeps one document of each group, decontaminate (3)
drops documents that contain a benchmark item, redact_secrets (2) replaces secrets in the texts, tokenize (4) encodes what is
left. All but the last return the columns they got, whatever further columns there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm import bpe, decontam, langid, nearcopies, secrets, simhash
from riskfabric.llm.common import row_key, small_or_shuffled, table, unused
from riskfabric.llm.plans_text import tokenizer_definition
from riskfabric.session import cut, discard, scratch
#: Rows of a 32-letter key up to which a side is broadcast (about 4 MB).
KEYS = 50_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: null texts and texts without a letter. Languages are learned from the stage's own input.

    Where no row has a language nothing can be learned, and all texts with a letter stay.
    """
    prototypes = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    guess = unused(docs, "_guess")
    judged = docs.withColumn(guess, langid.predicted(docs["text"], prototypes))
    return judged.filter(F.col(guess)["lang_pred"] != langid.UNKNOWN).drop(guess)


def _without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows whose key is not among the dropped ones (a column of their distinct keys, no other)."""
    gone = dropped.toDF(unused(docs, "_gone"))
    return docs.join(small_or_shuffled(gone, KEYS), F.col(key) == F.col(gone.columns[0]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = None) -> DataFrame:
    """Keeps one row of each group: that of the smallest id (rows without an id come last), of these the one with the least digest of id and text.

    Decisions are by row, so different texts of one id, or without an id, are judged each by its own group. Groups are those of op7; with
    `similarity`, of all texts whose five-word shingles have that Jaccard similarity.
    """
    key = unused(docs, "_row")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    own = keyed.select(F.col("doc_id"), F.col("text"), F.col(key).alias("_key"))
    if similarity is None:
        classes = simhash.near_duplicates(own, key_col="_key")
    else:
        # Rows are told apart by number, since ids may repeat or lack.
        numbered = cut(own.withColumn("_number", F.monotonically_increasing_id()))
        found = nearcopies.near_copies(numbered.select(F.col("_number").alias("doc_id"), "text"), threshold=similarity)
        classes = numbered.drop("text").join(found.select(F.col("doc_id").alias("_number"), F.col("component_id").alias("group")), "_number")
    classes = cut(classes.select("doc_id", "_key", "group"))
    first = classes.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_first"))
    dropped = cut(classes.join(first, "group").filter(F.col("_key") != F.col("_first")).select("_key").distinct())
    repeated = cut(classes.groupBy("_key").count().filter("count > 1").select("_key").join(dropped, "_key", "left_anti"))
    kept = _without(keyed, key, dropped)
    several = unused(keyed, "_several")
    # Rows of one key are equal in id and text; they meet by key and one of them stays.
    copies = kept.join(small_or_shuffled(repeated.toDF(several), KEYS), F.col(key) == F.col(several), "left_semi").dropDuplicates([key])
    return _without(kept, key, repeated).unionByName(copies).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text contains a benchmark item, whatever their id."""
    key = unused(docs, "_row")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    found = decontam.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _without(keyed, key, cut(found.select("doc_id").distinct())).drop(key)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark, and n_chars by the new length where the text changed."""
    spans = unused(docs, "_found")
    found = secrets.with_secrets(docs, into=spans)
    changed = F.size(spans) > 0
    out = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(spans)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode(docs, tokenizer_definition("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets), ("tokenize", tokenize)]

# Language profiles, XXH64 fingerprints and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
