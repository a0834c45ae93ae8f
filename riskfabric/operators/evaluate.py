"""Model evaluation: confusion metrics, AUC, Brier, shadow comparison, robustness, uncertainty summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.functions.numeric import clamp
from riskfabric.operators.scan import KeyedScan

PROMOTION_GAIN = 0.02
PROMOTION_F1 = 0.85
ROBUST_PERCENT = 80.0


def _ratio(num: Column, den: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion(y: str, prob: str, threshold: float = 0.5, prefix: str = "") -> list[Column]:
    said = F.col(prob) >= threshold
    real = F.col(y) == 1
    return [
        F.count_if(said & real).alias(f"{prefix}tp"),
        F.count_if(said & ~real).alias(f"{prefix}fp"),
        F.count_if(~said & real).alias(f"{prefix}fn"),
        F.avg(F.pow(F.col(prob) - F.col(y), F.lit(2.0))).alias(f"{prefix}brier"),
    ]


def scores(prefix: str = "") -> dict[str, Column]:
    tp, fp, fn = (F.col(f"{prefix}{c}") for c in ("tp", "fp", "fn"))
    return {
        f"{prefix}precision": _ratio(tp, tp + fp),
        f"{prefix}recall": _ratio(tp, tp + fn),
        f"{prefix}f1_score": _ratio(tp * 2, tp * 2 + fp + fn),
    }


def binary_metrics(df: DataFrame, y: str, prob: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and Brier in one pass, optionally per group."""
    return df.groupBy(*(by or [])).agg(*confusion(y, prob, threshold)).withColumns(scores())


def roc_auc(df: DataFrame, y: str, prob: str, **scan: float) -> DataFrame:
    """Rank-sum AUC with ties averaged; 0.5 when only one class is present.

    Rows collapse to distinct scores first; the running count over them is a chunked scan, not one global sort.
    """
    by_score = df.groupBy(F.col(prob).alias("_s")).agg(
        F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) != 1).alias("_n"))
    ranked = KeyedScan(by_score, [], ["_s"], **scan).prefix_sum(F.col("_n"), "_below", inclusive=False).done()
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    total = ranked.agg(wins.alias("w"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    auc = F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(0.5)).otherwise(F.col("w") / (F.col("p") * F.col("n")))
    return total.select(auc.alias("roc_auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def compare_shadow(df: DataFrame, y: str, primary: str, shadow: str, gain: float = PROMOTION_GAIN,
                   threshold: float = 0.5) -> DataFrame:
    """Primary and shadow model on the same rows in one pass; promote when F1 rises by more than `gain`."""
    both = df.agg(*confusion(y, primary, threshold, "primary_"), *confusion(y, shadow, threshold, "shadow_"))
    scored = both.withColumns({**scores("primary_"), **scores("shadow_")})
    better = F.col("shadow_f1_score") - F.col("primary_f1_score")
    return scored.withColumn("improvement", better).withColumn("recommend_promotion", better > gain)


def promotion_gate(metrics: DataFrame, floor: float = PROMOTION_F1) -> DataFrame:
    """The outcome of each run: `promoted`, or not."""
    return metrics.withColumn("promoted", F.col("f1_score") > floor)


def perturb(features: Column, gradient: Column, epsilon: float) -> Column:
    """Move each feature by epsilon along the sign of its gradient, kept inside 0..1."""
    return F.zip_with(features, gradient, lambda x, g: clamp(x + F.signum(g) * epsilon, 0.0, 1.0))


def robustness(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Share of predictions that stay the same; an empty set counts as fully robust."""
    agg = df.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(before == after).alias("_same"))
    score = F.when(F.col("total_samples") == 0, F.lit(100.0)).otherwise(F.col("_same") * 100.0 / F.col("total_samples"))
    return agg.select(
        "total_samples", score.alias("robustness_score"), (F.lit(100.0) - score).alias("evasion_success_rate"),
        F.when(score >= ROBUST_PERCENT, "PASS").otherwise("FAIL_REQUIRES_RETRAINING").alias("status"))


def mc_summary(samples: DataFrame, model: str, value: str, low: float, high: float) -> DataFrame:
    """Mean, sample deviation (0 for a single pass) and clamped 95 % interval per model."""
    return _interval(samples.groupBy(model).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("passes")), low, high)


def mc_ensemble(per_model: DataFrame, low: float, high: float) -> DataFrame:
    """Mean of the means; deviation from the mean of the variances."""
    pooled = per_model.agg(
        F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("std"), F.sum("passes").alias("passes"))
    return _interval(pooled, low, high)


def _interval(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.withColumn("ci_low", F.greatest(F.lit(low), F.col("mean") - F.col("std") * 1.96)).withColumn(
        "ci_high", F.least(F.lit(high), F.col("mean") + F.col("std") * 1.96))


def bce(y: Column, prob: Column, floor: float = 1e-12) -> Column:
    p = clamp(prob, floor, 1.0 - floor)
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def track_outcomes(predictions: DataFrame, breaches: DataFrame, asset: str, ts_us: str, prob: str,
                   threshold: float = 0.5, days: int = 30, **scan: float) -> tuple[DataFrame, DataFrame]:
    """High-risk predictions with a breach of the same asset within `days`, and breaches so announced.

    Existence is all that counts, so each side looks only at the nearest row of the other: one union and one
    ordered scan per direction, never prediction x breach pairs.
    """
    span = days * 86_400_000_000
    risky = predictions.filter(F.col(prob) >= threshold).select(
        F.col(asset).alias("asset"), F.col(ts_us).alias("t"), F.lit(0).alias("is_breach"))
    events = risky.unionByName(breaches.select(
        F.col(asset).alias("asset"), F.col(ts_us).alias("t"), F.lit(1).alias("is_breach")))
    at = F.when(F.col("is_breach") == 1, F.col("t"))
    ahead = KeyedScan(events, ["asset"], ["t", "is_breach"], descending=True, **scan).last_value(at, "next_breach").done()
    flagged = ahead.filter(F.col("is_breach") == 0).select(
        "asset", "t", F.coalesce(F.col("next_breach") - F.col("t") <= span, F.lit(False)).alias("true_positive"))
    said = F.when(F.col("is_breach") == 0, F.col("t"))
    behind = KeyedScan(events, ["asset"], ["t", "is_breach"], **scan).last_value(said, "last_warning").done()
    caught = behind.filter(F.col("is_breach") == 1).select(
        "asset", "t", F.coalesce(F.col("t") - F.col("last_warning") <= span, F.lit(False)).alias("announced"))
    return flagged, caught
