"""Streaming sources and sinks. Kafka where a broker is configured, text files of JSON lines otherwise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskfabric.sources.schemas import ASSET, SIGNAL, TELEMETRY


#: What a micro-batch takes at most where the caller sets no limit, by transport.
LIMITS = {"kafka": {"maxOffsetsPerTrigger": "5000000"}, "text": {"maxFilesPerTrigger": "1000"}}

RETAIN, RETAINED = "spark.sql.streaming.minBatchesToRetain", 10


def read_values(spark: SparkSession, options: Mapping[str, str], fmt: str = "kafka") -> DataFrame:
    """One string column `value` per record, whatever the transport; a micro-batch is bounded."""
    reader = spark.readStream.format(fmt).options(**(LIMITS.get(fmt, {}) | dict(options)))
    if fmt == "kafka":
        return reader.load().select(F.col("value").cast("string").alias("value"))
    return reader.load()


def kafka_options(brokers: str, topic: str, starting: str, **more: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": starting, **more}


def read_signals(spark: SparkSession, brokers: str | None = None, topic: str = "raw-signals", path: str | None = None) -> DataFrame:
    """Raw signals: value, parsed struct `s`, and `error` for what is no JSON object. Committed records only."""
    if path is not None:
        raw = read_values(spark, {"path": path}, "text")
    else:
        raw = read_values(spark, kafka_options(brokers, topic, "latest", **{"kafka.isolation.level": "read_committed"}))
    return decode(raw, SIGNAL)


def decode(raw: DataFrame, schema: str) -> DataFrame:
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return raw.withColumns({
        "s": F.from_json("value", schema),
        "error": F.when(~is_object, F.lit("message payload is not a valid JSON object"))})


def read_telemetry(spark: SparkSession, brokers: str | None = None, topic: str = "signals", path: str | None = None, **more: str) -> DataFrame:
    """Parsed telemetry; `more` options go to the source."""
    if path is not None:
        raw = read_values(spark, {"path": path, **more}, "text")
    else:
        raw = read_values(spark, kafka_options(brokers, topic, "latest", **more))
    return raw.select(F.from_json("value", TELEMETRY).alias("data")).select("data.*")


def read_asset_events(spark: SparkSession, brokers: str | None = None, topic: str = "fusion-events", path: str | None = None) -> DataFrame:
    """Asset events from the beginning of the topic; undecodable records keep their text and an error."""
    if path is not None:
        raw = read_values(spark, {"path": path}, "text")
    else:
        raw = read_values(spark, kafka_options(brokers, topic, "earliest"))
    return decode(raw, ASSET)


def keyed_json(df: DataFrame, key: str) -> DataFrame:
    """(key, value) with the whole row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_json_stream(df: DataFrame, key: str, checkpoint: str, fmt: str = "kafka", **options: str) -> DataStreamWriter:
    """Append writer of keyed JSON with a checkpoint; start() is left to the caller."""
    return keyed_json(df, key).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).options(**options)


def write_events(df: DataFrame, primary, fallback_path: str) -> str:
    """Publish a batch through `primary(df)`; when the sink is down, keep it as JSON files instead."""
    try:
        primary(df)
        return "primary"
    except Exception as exc:  # any failure of an outside sink
        df.withColumn("publish_error", F.lit(str(exc)[:200])).write.mode("append").json(fallback_path)
        return "fallback"


def drain(df: DataFrame, folder: str, fmt: str = "parquet", mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into files, and read the files back. Of the state, RETAINED micro-batches are kept."""
    if df.sparkSession.conf.get(RETAIN) == "100":  # Spark's own number
        df.sparkSession.conf.set(RETAIN, str(RETAINED))
    query = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start(f"{folder}/out"))
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).format(fmt).load(f"{folder}/out")


def drain_batches(df: DataFrame, folder: str, handle) -> None:
    """Run `handle(batch, batch_id)` over what is there now, checkpointed."""
    query = (df.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
