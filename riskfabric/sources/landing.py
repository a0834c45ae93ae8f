"""Batch landing and publishing: envelopes, multi-signal payloads, exports, outbound shapes, ledger and run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.sources.schemas import LEDGER, RUN_LOG

# Sections of a multi-signal payload, in landing order.
SECTIONS = ("sbom", "rating", "telemetry", "network_scan", "mbom", "binary_scan")


def envelope_results(df: DataFrame) -> DataFrame:
    """Publishable pull-job results as JSON; rows with errors or without payload are not published.

    Input: source_name, job_id, timestamp, request_params map, response_status, payload, errors.
    """
    good = df.filter(F.col("errors").isNull() & (F.length("payload") > 0))
    message = F.to_json(F.struct(
        F.col("source_name").alias("source"), F.lit("passive_ingestion").alias("type"), "job_id", "timestamp",
        F.struct("request_params", "response_status").alias("provenance"), F.col("payload").alias("data")))
    return good.select("job_id", message.alias("value"))


def land_multisignal(df: DataFrame, payload: str = "payload") -> DataFrame:
    """`signals`: the non-empty sections of each payload in order; `error` for unusable or empty payloads."""
    doc = F.try_parse_json(payload)

    def present(section: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{section}", "variant"))
        return F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False))

    out = df.withColumn("_v", doc).withColumn(
        "signals", F.array_compact(F.array(*[F.when(present(s), F.lit(s)) for s in SECTIONS])))
    score = F.try_variant_get("_v", "$.rating.security_score", "int")
    bad_score = present("rating") & ~F.coalesce(score.between(0, 100), F.lit(False))
    error = (
        F.when(F.col("_v").isNull(), "payload is not JSON")
        .when(bad_score, "rating.security_score out of range")
        .when(F.size("signals") == 0, "No signals provided for ingestion."))
    return out.withColumn("error", error).drop("_v")


#: Quotes within a field are doubled, as CSV readers expect; backslashes stay as they are and fields may hold line ends.
CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def export_assets(df: DataFrame, path: str, fmt: str) -> None:
    """JSON lines, or CSV with properties as JSON text; one file per task, as the data is laid out."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.withColumn("properties", F.to_json("properties")).write.mode("overwrite").options(**CSV).csv(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def to_stix(df: DataFrame) -> DataFrame:
    """Object rows of a STIX bundle; a bundle file is the rows of one partition, not one list on one task."""
    return df.select("type", "id", "value", F.col("created_at").alias("created"), F.col("updated_at").alias("modified"))


def shape_outbound(df: DataFrame, kind: str) -> DataFrame:
    """Insight rows as the JSON body an outside system takes: siem, log, incident or issue."""
    if kind == "siem":
        body = F.struct(F.struct(*df.columns).alias("event"), F.lit("_json").alias("sourcetype"))
    elif kind == "log":
        body = F.struct(*df.columns)
    elif kind == "incident":
        body = F.struct(F.col("title").alias("short_description"), F.col("description"),
                        F.lit("1").alias("urgency"), F.lit("2").alias("impact"))
    elif kind == "issue":
        text = F.struct(F.lit("text").alias("type"), F.col("description").alias("text"))
        paragraph = F.struct(F.lit("paragraph").alias("type"), F.array(text).alias("content"))
        doc = F.struct(F.lit("doc").alias("type"), F.lit(1).alias("version"), F.array(paragraph).alias("content"))
        body = F.struct(F.struct(
            F.struct(F.col("project").alias("key")).alias("project"), F.col("title").alias("summary"), doc.alias("description"),
            F.struct(F.lit("Bug").alias("name")).alias("issuetype")).alias("fields"))
    else:
        raise ValueError(f"unknown outbound kind {kind}")
    return df.select(F.to_json(body).alias("value"), *[c for c in df.columns if c.endswith("_id")])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger blocks with the event kept as the canonical text that was hashed."""
    return spark.read.schema(LEDGER).json(path)


def log_run(spark: SparkSession, path: str, run_id: str, job: str, state: str, rows: int | None = None, error: str | None = None) -> None:
    """Append one START, COMPLETE or FAIL row."""
    row = [(run_id, job, state, datetime.now(), rows, error)]
    spark.createDataFrame(row, RUN_LOG).write.mode("append").parquet(path)


def logged(path: str, job: str, handle):
    """Wrap a foreachBatch handler: START before, COMPLETE or FAIL after, the batch id as run id."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, run_id = batch.sparkSession, f"{job}-{batch_id}"
        log_run(spark, path, run_id, job, "START")
        try:
            handle(batch, batch_id)
        except Exception as exc:
            log_run(spark, path, run_id, job, "FAIL", error=str(exc)[:500])
            raise
        log_run(spark, path, run_id, job, "COMPLETE")

    return run
