"""Risk scores, levels, factor texts and the prioritisation of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.functions.numeric import clamp, half_up

# Rating, vulnerability and depth weights of the heuristic, and its bounds.
WEIGHT_RATING, WEIGHT_CVE, WEIGHT_VENDOR = 0.4, 15.0, 4.0
RISK_FLOOR, RISK_CEILING = 5.0, 95.0
DEFAULT_VENDOR_RATING = 80.0

# Contributing-factor texts.
LOW_RATING = "Low average ecosystem security rating: %.1f"
ACTIVE_CVES = "%d active vulnerabilities detected in downstream packages"
DEEP_CHAIN = "Deep multi-tier dependency chain detected (%d vendors deep)"
HIGH_CASCADE = "High vulnerability propagation probability (%.1f%%) due to shared libraries"
HEALTHY = "No critical risk indicators detected. Baseline ecosystem healthy."

# Recommended-action texts.
QUARANTINE = "CRITICAL: Quarantined artifact/binary immediately. Deny execution on all %d affected systems."
BLOCK_UNSIGNED = "HIGH: Signature or build provenance validation failed. Block deployments until signature can be verified."
WATCH_DEVICES = "MEDIUM: Monitor deployments on %d devices and schedule update patches."
KEEP_UPDATED = "LOW: Keep dependency version updated."


def exploit_severity(score: Column) -> Column:
    return F.when(score > 0.85, "CRITICAL").when(score > 0.7, "HIGH").when(score > 0.4, "MEDIUM").otherwise("LOW")


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def heuristic_risk(rating: Column, cves: Column, vendors: Column) -> Column:
    raw = (F.lit(100.0) - rating) * WEIGHT_RATING + cves * WEIGHT_CVE + vendors * WEIGHT_VENDOR
    return clamp(raw, RISK_FLOOR, RISK_CEILING)


def cascade_probability(cves: Column, vendors: Column) -> Column:
    raw = F.lit(0.05) + F.least(vendors, F.lit(8)) * 0.05 + F.least(cves, F.lit(4)) * 0.15
    return F.least(raw, F.lit(0.99))


def risk_interval(risk: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), risk - 15.0), F.least(F.lit(100.0), risk + 15.0)


def contributing_factors(rating: Column, cves: Column, vendors: Column, cascade: Column) -> Column:
    texts = F.array_compact(F.array(
        F.when(rating < 70, F.format_string(LOW_RATING, rating)),
        F.when(cves > 0, F.format_string(ACTIVE_CVES, cves)),
        F.when(vendors > 2, F.format_string(DEEP_CHAIN, vendors)),
        F.when(cascade > 0.4, F.format_string(HIGH_CASCADE, cascade * 100)),
    ))
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(HEALTHY)))


def attribute_linear(rating: Column, cves: Column, vendors: Column) -> dict[str, Column]:
    """Contribution of each feature to the linear surrogate, rounded to 2 places."""
    return {
        "Ecosystem Rating Risk": half_up((F.lit(100.0) - rating) * WEIGHT_RATING),
        "Active CVE Risk": half_up(cves * WEIGHT_CVE),
        "Supply Chain Depth": half_up(vendors * WEIGHT_VENDOR),
    }


def predict_vendors(profiles: DataFrame) -> DataFrame:
    """Heuristic prediction per vendor from its subgraph profile (avg_rating, active_cves, vendor_count)."""
    rating, cves, vendors = F.col("avg_rating"), F.col("active_cves"), F.col("vendor_count")
    scored = profiles.withColumns({"risk": heuristic_risk(rating, cves, vendors), "cascade": cascade_probability(cves, vendors)})
    low, high = risk_interval(F.col("risk"))
    return scored.withColumns(
        {
            "risk_low": low, "risk_high": high, "risk_level": risk_level(F.col("risk")),
            "nth_party_affected": F.greatest(F.lit(0), vendors - 1),
            "factors": contributing_factors(rating, cves, vendors, F.col("cascade")),
        }
    )


def priority_score(exploit: Column, has_provenance: Column, malicious: Column, devices: Column) -> Column:
    """min(100, 50 x exploit + 20 without provenance + 100 per malicious report + 30 per device)."""
    base = exploit * 50.0 + F.when(has_provenance, 0.0).otherwise(20.0)
    return half_up(F.least(F.lit(100.0), base + malicious * 100.0 + devices * 30.0))


def recommended_actions(malicious: Column, has_provenance: Column, devices: Column) -> Column:
    texts = F.array_compact(F.array(
        F.when(malicious, F.format_string(QUARANTINE, devices)),
        F.when(~has_provenance, F.lit(BLOCK_UNSIGNED)),
        F.when((devices > 0) & ~malicious, F.format_string(WATCH_DEVICES, devices)),
    ))
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(KEEP_UPDATED)))


def artefact_impact(reports: DataFrame, runs: DataFrame, key: str = "comp_id") -> tuple[DataFrame, DataFrame]:
    """Reports and devices per artefact, each aggregated on its own so neither multiplies the other.

    `runs` holds distinct (device, artefact) edges; both aggregates combine map-side, so a hot artefact
    costs one partial row per task.
    """
    by_report = reports.groupBy(key).agg(
        F.count(F.lit(1)).alias("reports"),
        F.bool_or("is_malicious").alias("any_malicious"),
        F.sum(F.col("is_malicious").cast("long")).alias("malicious_reports"),
    )
    by_device = runs.groupBy(key).agg(F.count(F.lit(1)).alias("devices"))
    return by_report, by_device


def prioritize(artefacts: DataFrame, reports: DataFrame, runs: DataFrame, key: str = "comp_id") -> DataFrame:
    """Priority score, malicious flag and recommended actions for every artefact."""
    by_report, by_device = artefact_impact(reports, runs, key)
    joined = artefacts.join(by_report, key, "left").join(by_device, key, "left")
    malicious = F.coalesce("malicious_reports", F.lit(0))
    devices = F.coalesce("devices", F.lit(0))
    exploit = F.coalesce("exploit_score", F.lit(0.0))
    trusted = F.coalesce("has_provenance", F.lit(False))
    return joined.select(
        *artefacts.columns,
        priority_score(exploit, trusted, malicious, devices).alias("priority_score"),
        F.coalesce("any_malicious", F.lit(False)).alias("malicious_detected"),
        devices.alias("devices_affected"),
        F.coalesce("reports", F.lit(0)).alias("report_count"),
        recommended_actions(F.coalesce("any_malicious", F.lit(False)), trusted, devices).alias("actions"),
    )


def dp_release(df: DataFrame, ident: str, score: str, secret: str, release: str, epsilon: float = 1.0, sensitivity: float = 100.0) -> DataFrame:
    """Laplace noise by inverse CDF, clamped to 0..100; the raw score does not leave.

    The draw is a digest, keyed by the secret, of the release's name, the row's id and the score. A retry of a release gives the same value, so it
    cannot be averaged away by asking again; another release, or another score, has a draw of its own, so the difference of two
    releases tells no more of the scores than two noisy values do. Each release spends `epsilon`.
    """
    scale = sensitivity / epsilon
    exact = F.floor(F.col(score) * 1e6 + 0.5).cast("long").cast("string")
    digits = F.substring(F.sha2(F.concat_ws("/", F.lit(secret), F.lit(release), F.col(ident).cast("string"), exact), 256), 1, 12)
    drawn = df.withColumn("_u", F.conv(digits, 16, 10).cast("double") / float(16**12) - 0.5)
    noise = -F.lit(scale) * F.signum("_u") * F.log(F.lit(1.0) - F.abs("_u") * 2.0)
    noisy = F.when(F.col(score).isNotNull(), clamp(F.col(score) + noise, 0.0, 100.0))
    return drawn.withColumn(f"dp_{score}", noisy).drop(score, "_u")
