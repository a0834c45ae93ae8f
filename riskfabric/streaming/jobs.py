"""Streaming jobs: windows, anomaly filter, ingest to graph, correlation, triggers, shadow scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators import govern, joins, normalize, quality, textscan, windows
from riskfabric.sources.graphstore import GraphStore
from riskfabric.sources.matchindex import MatchIndex

WATERMARK, WINDOW, SLIDE = "10 minutes", "5 minutes", "1 minute"


def window_features(df: DataFrame, watermark: str = WATERMARK, window: str = WINDOW, slide: str = SLIDE) -> DataFrame:
    """Sliding event-time features per asset; the same plan on a batch and on a stream.

    The connection rate is the mean of the counts and unique addresses are summed, as downstream models expect. The state of a stream holds the
    windows of a micro-batch and those still open, so large inputs must come in time order and in bounded micro-batches.
    """
    timed = df.withWatermark("timestamp", watermark) if df.isStreaming else df
    grouped = timed.groupBy(F.window("timestamp", window, slide), "asset_id").agg(
        F.avg("connection_count").alias("avg_connection_rate"),
        F.sum("cve_criticality").alias("cve_criticality_sum"),
        F.sum("unique_ips").alias("unique_ips_contacted"),
        F.avg("centrality").alias("degree_centrality"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *grouped.columns[1:])


def anomalies(features: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Windows the scorer marks with is_anomaly = 1.0."""
    return score(features).filter(F.col("is_anomaly") == 1.0)


SIGNAL_RULES: list[tuple[str, Callable[[], Column]]] = [
    ("payload too large", lambda: quality.payload_fits(F.col("value"))),
    ("message payload is not a valid JSON object", lambda: quality.is_json_object(F.col("value"))),
]


def enrich(signals: DataFrame, salt: str) -> DataFrame:
    """Entity, adjusted score, actors, and hashed device addresses of parsed signals."""
    named = signals.withColumns({
        "entity": normalize.entity_name(), "score": normalize.adjusted_score(),
        "actors": textscan.extract_actors(F.col("content")), "cves": F.col("cve_detections")})
    return normalize.minimize(named, salt, hashed=("ip_address",))


def ingest_batch(store: GraphStore, dlq: str, schema: str, salt: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: raw text -> quarantine, or -> enrich, minimise, fan out, append graph deltas."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        good, bad = quality.split_valid(rows, [(m, rule()) for m, rule in SIGNAL_RULES], F.lit("signal_stream"), F.col("value"))
        bad.write.mode("overwrite").json(f"{dlq}/run={store.run}/batch={batch_id}")
        parsed = good.select(F.from_json("value", schema).alias("s")).select("s.*")
        nodes, edges = windows.signals_to_graph(enrich(parsed, salt))
        store.append(batch_id, nodes=(nodes.withColumn("seen", F.col("ts_us")), ["id"]),
                     edges=(edges.withColumn("seen", F.col("ts_us")), ["src", "dst", "type"]))
        rows.unpersist()

    return handle


def correlate_batch(root: str, out: str, run: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: match arriving assets against the newest version of the inventory index; a batch fits nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        index = MatchIndex.newest(batch.sparkSession, root)
        index.match(batch).withColumn("inventory", F.lit(index.version)).write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")

    return handle


def graph_update_batch(store: GraphStore) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: normalised events to asset nodes, idempotent by run and batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.concat("asset_type", F.lit(":"), F.coalesce("value", F.lit("unknown"))).alias("id"),
            F.col("asset_type").alias("label"), F.col("norm_severity").alias("severity"), "event_type",
            "ts_us", "signal_id", F.col("ts_us").alias("seen"))
        store.append(batch_id, assets=(rows, ["id"]))

    return handle


def trigger_batch(actions: str, escalations: str, run: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler: blocking actions to one sink, escalations to the other."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = govern.trigger_actions(batch).persist()
        rows.filter(F.col("action") == "block_vendor").write.mode("overwrite").parquet(f"{actions}/run={run}/batch={batch_id}")
        rows.filter(F.col("action") == "escalate").write.mode("overwrite").parquet(f"{escalations}/run={run}/batch={batch_id}")
        rows.unpersist()

    return handle


def shadow_scan(assets: DataFrame, edges: DataFrame, out: str) -> None:
    """One scheduled scan; ids follow from the assets, so a repeat replaces equal rows."""
    shadow = joins.shadow_candidates(assets, edges).persist()
    exposures, links = joins.shadow_exposures(shadow)
    exposures.write.mode("overwrite").parquet(f"{out}/exposures")
    links.write.mode("overwrite").parquet(f"{out}/edges")
    shadow.unpersist()
