"""Binary artefact analysis: reputation, feature defaults, fused verdict, linking of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that mark a hash as bad.
BAD_TOKENS = ("malicious", "infected", "eicar", "compromised", "7777")
THREAT_NAME = "Win32.Malware.SimulatedBackdoor"

# Defaults of the five features.
FEATURE_DEFAULTS = {
    "entropy": 4.5, "num_imports": 20, "num_sections": 4, "packer_detected": False, "signature_valid": True,
}


def is_bad_hash(file_hash: Column, tokens: tuple[str, ...] = BAD_TOKENS) -> Column:
    cleaned = F.lower(F.trim(file_hash))
    bad = F.lit(False)
    for token in tokens:
        bad = bad | F.contains(cleaned, F.lit(token))
    return F.coalesce(bad, F.lit(False))


def hash_reputation(df: DataFrame, file_hash: str = "hash", tokens: tuple[str, ...] = BAD_TOKENS) -> DataFrame:
    bad = is_bad_hash(F.col(file_hash), tokens)
    return df.withColumns(
        {
            "status": F.when(bad, "MALICIOUS").otherwise("CLEAN"),
            "threat_name": F.when(bad, F.lit(THREAT_NAME)),
            "trust_factor": F.when(bad, 0).otherwise(100),
            "scanner_detections": F.when(bad, 42).otherwise(0),
            "total_scanners": F.lit(60),
        }
    )


def with_feature_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in FEATURE_DEFAULTS.items()})


def fused_verdict(status: Column, malware_detected: Column) -> Column:
    return (F.coalesce(status, F.lit("UNKNOWN")) == "MALICIOUS") | F.coalesce(malware_detected, F.lit(False))


def link_reports(reports: DataFrame, components: DataFrame, models: DataFrame) -> DataFrame:
    """Edges from a component, or failing that a model, with the report's target purl; of several with one purl the least id."""
    c = components.groupBy(F.col("purl").alias("target_purl")).agg(F.min("id").alias("_c"))
    m = models.groupBy(F.col("purl").alias("target_purl")).agg(F.min("id").alias("_m"))
    return (
        reports.join(c, "target_purl", "left").join(m, "target_purl", "left")
        .withColumn("src", F.coalesce("_c", "_m"))
        .filter(F.col("src").isNotNull())
        .select("src", F.concat(F.lit("BinaryAnalysisReport:report:binary/"), "hash").alias("dst"),
                F.lit("HAS_ANALYSIS_REPORT").alias("type"))
    )
