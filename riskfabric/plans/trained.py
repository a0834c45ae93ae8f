"""Registered queries: trained models (section 2.8 of the survey). Training is random, so rows are checked, not values."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.operators import binary, evaluate, models
from riskfabric.plans.registry import query
from riskfabric.plans.streams import telemetry_batch
from riskfabric.session import cut
from riskfabric.streaming import jobs


def featured(t: Lake):
    rows = jobs.window_features(telemetry_batch(t), window="1 hour", slide="1 hour")
    return rows.withColumn("row_key", F.xxhash64("window_start", "asset_id"))


@query("m1_isolation_forest")
def m1(t: Lake):
    """The fitted forest: nodes per tree and the depth-weighted share of leaves."""
    rows = featured(t)
    forest = models.IsolationForest.fit(rows, models.TELEMETRY_FEATURES, "row_key")
    table = t.spark.createDataFrame(forest.nodes)
    return table.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"))


@query("m2_anomaly_scores")
def m2(t: Lake):
    rows = featured(t)
    forest = models.IsolationForest.fit(rows, models.TELEMETRY_FEATURES, "row_key")
    return forest.predict(rows).select("window_start", "asset_id", "anomaly_score", "is_anomaly")


@query("m3_malware_verdicts")
def m3(t: Lake):
    scored = models.predict_malware(models.train_malware(t.spark), binary.hash_reputation(t.binary_scans))
    verdict = binary.fused_verdict(F.col("status"), F.col("malware_detected"))
    return scored.select("l_orderkey", "l_linenumber", "hash", "malware_probability", "confidence", "malware_detected", verdict.alias("is_malicious"))


@query("m4_threat_classifier")
def m4(t: Lake):
    """Held-out metrics of the classifier on the labelled documents, low quality being the threat, and of the forest on the same rows."""
    text = F.col("text")
    features = ("size", "words", "capitals", "marks")
    rows = t.labels.join(t.documents, "doc_id").select(
        "doc_id", (1 - F.col("quality")).alias("is_attack"), F.length(text).cast("double").alias("size"), F.size(F.split(text, " ")).cast("double").alias("words"),
        (F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.length(text), F.lit(1))).alias("capitals"),
        (F.length(F.regexp_replace(text, "[\\p{L}\\p{N}\\s]", "")) / F.greatest(F.length(text), F.lit(1))).alias("marks"))
    train, test = models.split_rows(cut(rows), "doc_id")
    scored = models.predict_threats(models.train_threats(train, "is_attack", features), test)
    forest = models.IsolationForest.fit(train, features, "doc_id", contamination=0.1)
    flagged = forest.predict(test).withColumnRenamed("is_anomaly", "prob")
    parts = [evaluate.binary_metrics(df, "is_attack", "prob").withColumn("model", F.lit(name))
             for name, df in (("random_forest", scored), ("isolation_forest", flagged))]
    return parts[0].unionByName(parts[1])


@query("m5_schedule_delays")
def m5(t: Lake):
    """Delays for the held-out events, next to what the rule of the history says."""
    value = F.col("value")
    decisions = t.events.select(
        "event_id", F.col("user_id").cast("string").alias("target"), "ts", F.when(value >= 60, 3.0).when(value >= 25, 2.0).otherwise(1.0).alias("priority"),
        F.col("event_type").isin("error", "purchase").alias("hit"), F.least(value, F.lit(60.0)).alias("applied"))
    history = models.delay_history(decisions, "event_id", "target", "ts", "hit", "applied")
    train, test = models.split_rows(cut(history), "event_id")
    return models.suggest_delay(models.train_delay(train), test).select("event_id", "delay", F.col("label").alias("observed"))


@query("m8_reward_model")
def m8(t: Lake):
    """Rewards of the held-out vectors."""
    rows = t.embeddings.withColumn("human_label", (F.col("label") < 5).cast("int"))
    train, test = models.split_rows(rows, "vec_id")
    return models.predict_reward(models.train_reward(train, "embedding", "human_label"), test, "embedding").select("vec_id", "human_label", "reward")
