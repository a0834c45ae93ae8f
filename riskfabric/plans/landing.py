"""Registered queries: sources, sinks and documents (sections 2.1 and P7-P12 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.operators import bom, quality
from riskfabric.plans.registry import query
from riskfabric.session import scratch
from riskfabric.sources import graphstore, landing, schemas, streams

# --- streams over JSON lines: the given table goes out as text and comes back through the stream reader ------------

RAW = """SELECT signal_id, source, type, repo, package, version, dependencies_count, cve_id, severity, actor, content, ip_address,
  CAST(ts_us AS DOUBLE) / 1000000 AS timestamp FROM signals"""


def as_lines(df, folder: str, spoil=None, compression: str = "none") -> str:
    """JSON text files of the rows; `spoil` marks rows written as broken text."""
    text = F.to_json(F.struct(*df.columns))
    if spoil is not None:
        text = F.when(spoil, F.concat(F.lit("broken "), text)).otherwise(text)
    df.select(text.alias("value")).write.mode("overwrite").text(folder, compression=compression)
    return folder


#: Rows of a file of a feed, and files that a micro-batch takes.
FILE_ROWS, BATCH_FILES = 125_000, 8


def as_feed(df, folder: str, time: str) -> str:
    """The rows as lines in files that hold and arrive in order of `time`, as a feed would, so that micro-batches of a few files find none late."""
    files = max(1, -(-df.count() // FILE_ROWS))
    as_lines(df.repartitionByRange(files, time), folder, compression="gzip")
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    written = sorted((f.getPath().getName(), f.getPath()) for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    last = fs.getFileStatus(path).getModificationTime()
    for i, (_, file) in enumerate(written):  # the file source goes by the time of modification, and tasks end in any order
        fs.setTimes(file, last - 1000 * (len(written) - i), -1)
    return folder


SPOILED = "source = 'npm' AND dependencies_count > 90"


@query("s1_read_signals", f"""
SELECT CASE WHEN {SPOILED} THEN NULL ELSE source END AS source,
 CASE WHEN {SPOILED} THEN NULL ELSE coalesce(repo, package, ip_address, nullif(actor, ''), '') END AS subject,
 CASE WHEN {SPOILED} THEN 'message payload is not a valid JSON object' END AS error, count(*) AS n FROM signals GROUP BY ALL""")
def s1(t: Lake):
    folder = scratch(t.spark, "s1")
    spoil = (F.col("source") == "npm") & (F.col("dependencies_count") > 90)
    as_lines(t.sql(RAW), f"{folder}/in", spoil)
    rows = streams.drain(streams.read_signals(t.spark, path=f"{folder}/in"), folder)
    good = F.col("error").isNull()
    subject = F.coalesce("s.repo", "s.package", "s.ip_address", F.nullif(F.col("s.actor"), F.lit("")), F.lit(""))
    return rows.select(F.when(good, F.col("s.source")).alias("source"), F.when(good, subject).alias("subject"), "error").groupBy(
        "source", "subject", "error").agg(F.count(F.lit(1)).alias("n"))


FEED = "SELECT asset_id, timestamp, connection_count, cve_criticality, unique_ips, centrality FROM telemetry"


@query("s2_read_telemetry", "SELECT asset_id, connection_count, cve_criticality, unique_ips, centrality FROM telemetry")
def s2(t: Lake):
    folder = scratch(t.spark, "s2")
    as_lines(t.sql(FEED), f"{folder}/in")
    return streams.drain(streams.read_telemetry(t.spark, path=f"{folder}/in"), folder).drop("timestamp")


@query("s3_read_asset_events", "SELECT id, type, value, name, cert_hash FROM assets_ext")
def s3(t: Lake):
    folder = scratch(t.spark, "s3")
    rows = t.assets_ext.select("id", "type", "value", "name", F.create_map(F.lit("cert_hash"), F.col("cert_hash")).alias("properties"))
    as_lines(rows, f"{folder}/in")
    events = streams.drain(streams.read_asset_events(t.spark, path=f"{folder}/in"), folder)
    return events.filter(F.col("error").isNull()).select("s.id", "s.type", "s.value", "s.name", F.col("s.properties")["cert_hash"].alias("cert_hash"))


@query("s4_write_json_stream", "SELECT asset_id AS key, asset_id, connection_count FROM telemetry")
def s4(t: Lake):
    folder = scratch(t.spark, "s4")
    as_lines(t.sql(FEED), f"{folder}/in")
    stream = streams.read_telemetry(t.spark, path=f"{folder}/in")
    writer = streams.write_json_stream(stream, "asset_id", f"{folder}/checkpoint", fmt="json", path=f"{folder}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    back = t.spark.read.schema("key string, value string").json(f"{folder}/out")
    body = F.from_json("value", schemas.TELEMETRY)
    return back.select("key", body["asset_id"].alias("asset_id"), body["connection_count"].alias("connection_count"))


@query("s5_write_events_fallback", "SELECT signal_id, source, 'sink is down' AS publish_error FROM signals")
def s5(t: Lake):
    folder = scratch(t.spark, "s5")

    def down(df):
        raise ConnectionError("sink is down")

    rows = t.signals.select("signal_id", "source")
    streams.write_events(rows, down, f"{folder}/fallback")
    return t.spark.read.schema("signal_id bigint, source string, publish_error string").json(f"{folder}/fallback")


PULLS = """SELECT event_id AS job_id, concat('connector-', event_type) AS source_name, CAST(EPOCH_US(ts) AS DOUBLE) / 1000000 AS timestamp, event_type,
  CASE WHEN event_type = 'error' THEN 'Max retries exceeded.' END AS errors, CASE WHEN value >= 2 THEN props ELSE '' END AS payload, 200 AS response_status FROM events"""


@query("s6_envelope_results", f"""
SELECT job_id, source_name AS source, 'passive_ingestion' AS type, 200 AS status, payload AS data FROM ({PULLS}) p WHERE errors IS NULL AND payload <> ''""")
def s6(t: Lake):
    rows = t.sql(PULLS).withColumn("request_params", F.create_map(F.lit("method"), F.lit("GET")))
    out = landing.envelope_results(rows)
    body = F.from_json("value", "source string, type string, provenance struct<response_status: int>, data string")
    return out.select("job_id", body["source"].alias("source"), body["type"].alias("type"),
                      body["provenance"]["response_status"].alias("status"), body["data"].alias("data"))


MULTI = """SELECT comp_id, CASE kind
 WHEN 'SMALL' THEN concat('{"sbom":{"bomFormat":"CycloneDX","components":[]},"rating":{"vendor_name":"', brand, '","security_score":', comp_id % 150, ',"risk_tier":"Low"}}')
 WHEN 'LARGE' THEN concat('{"telemetry":{"device_id":"d-', comp_id, '","active_connections":3},"network_scan":{"ip_address":"10.0.0.1"},"sbom":null}')
 WHEN 'PROMO' THEN '{"mbom":{"model_name":"m"},"binary_scan":{"hash":"x"}}'
 WHEN 'MEDIUM' THEN '{"sbom":{},"provenance":{"signature":"s"}}' WHEN 'ECONOMY' THEN '{}' ELSE 'no json' END AS payload FROM components"""


@query("s7_land_multisignal", """
SELECT comp_id, CASE kind WHEN 'SMALL' THEN 'sbom,rating' WHEN 'LARGE' THEN 'telemetry,network_scan' WHEN 'PROMO' THEN 'mbom,binary_scan' ELSE '' END AS signals,
 CASE WHEN kind = 'SMALL' AND comp_id % 150 > 100 THEN 'rating.security_score out of range' WHEN kind IN ('MEDIUM', 'ECONOMY') THEN 'No signals provided for ingestion.'
  WHEN kind = 'STANDARD' THEN 'payload is not JSON' END AS error FROM components""")
def s7(t: Lake):
    out = landing.land_multisignal(t.sql(MULTI))
    return out.select("comp_id", F.concat_ws(",", "signals").alias("signals"), "error")


@query("s8_split_valid", """
SELECT signal_id, source, CASE WHEN type = 'vulnerability' AND severity IS NULL THEN 'severity missing' WHEN type = 'sbom' AND dependencies_count > 95 THEN 'dependency count out of range' END AS error FROM signals""")
def s8(t: Lake):
    folder = scratch(t.spark, "s8")
    rules = [("severity missing", (F.col("type") != "vulnerability") | F.col("severity").isNotNull()),
             ("dependency count out of range", (F.col("type") != "sbom") | (F.col("dependencies_count") <= 95))]
    good, bad = quality.split_valid(t.signals, rules, F.col("source"), F.to_json(F.struct("signal_id")))
    quality.write_quarantine(bad, folder)
    kept = t.spark.read.schema("error string, payload string, source string").json(folder)
    return good.select("signal_id", "source", F.lit(None).cast("string").alias("error")).unionByName(
        kept.select(F.get_json_object("payload", "$.signal_id").cast("long").alias("signal_id"), "source", "error"))


def asset_rows(t: Lake):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t.components.select(
        F.concat(F.lit("asset--"), "comp_id").alias("id"), F.lit("software").alias("type"), F.col("purl").alias("value"), "name",
        stamp.alias("created_at"), stamp.alias("updated_at"), F.create_map(F.lit("brand"), F.col("brand"), F.lit("note"), F.concat(F.lit('a "quoted", \\ noted\nline of '), "kind")).alias("properties"))


@query("s9_export_assets", r"""SELECT concat('asset--', comp_id) AS id, name, concat('{"brand":"', brand, '","note":"a \"quoted\", \\ noted\nline of ', kind, '"}') AS properties FROM components""")
def s9(t: Lake):
    folder = scratch(t.spark, "s9")
    landing.export_assets(asset_rows(t), f"{folder}/csv", "csv")
    back = t.spark.read.options(**landing.CSV).schema(
        "id string, type string, value string, name string, created_at string, updated_at string, properties string").csv(f"{folder}/csv")
    return back.select("id", "name", "properties")


@query("s10_to_stix", "SELECT 'software' AS type, concat('asset--', comp_id) AS id, purl AS value, '2024-01-01' AS created, '2024-01-01' AS modified FROM components")
def s10(t: Lake):
    return landing.to_stix(asset_rows(t)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("created", "modified")})


@query("s11_graph_store", """
SELECT concat('v', vendor_id) AS id, 'Vendor' AS label, 'node' AS part FROM vendors
 UNION ALL SELECT concat('v', src, '>v', dst) AS id, 'SUPPLIES' AS label, 'edge' AS part FROM supplies""")
def s11(t: Lake):
    store = graphstore.GraphStore(t.spark, scratch(t.spark, "s11"), "snapshot")
    nodes = t.vendors.select(F.concat(F.lit("v"), "vendor_id").alias("id"), F.lit("Vendor").alias("label"), "cves")
    edges = t.supplies.select(F.concat(F.lit("v"), "src").alias("src"), F.concat(F.lit("v"), "dst").alias("dst"), F.lit("SUPPLIES").alias("type"), "weight")
    store.save(nodes, edges)
    n, e = store.load()
    return n.select("id", "label", F.lit("node").alias("part")).unionByName(
        e.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.col("type").alias("label"), F.lit("edge").alias("part")))


@query("s12_shape_outbound", """
SELECT insight_id, 'siem' AS kind, title AS subject FROM insights UNION ALL SELECT insight_id, 'incident', title FROM insights UNION ALL SELECT insight_id, 'issue', title FROM insights
 UNION ALL SELECT insight_id, 'log', title FROM insights""")
def s12(t: Lake):
    rows = t.insights.select("insight_id", "title", F.concat("type", F.lit(": "), "severity").alias("description"), F.lit("SEC").alias("project"))
    paths = {"siem": "$.event.title", "incident": "$.short_description", "issue": "$.fields.summary", "log": "$.title"}
    parts = [landing.shape_outbound(rows, k).select("insight_id", F.lit(k).alias("kind"), F.get_json_object("value", p).alias("subject"))
             for k, p in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s13_run_log", "SELECT job, state, CAST(1 AS BIGINT) AS n FROM (VALUES ('ingest', 'START'), ('ingest', 'COMPLETE')) v(job, state), (SELECT count(*) AS c FROM signals) s WHERE c > 0")
def s13(t: Lake):
    folder = scratch(t.spark, "s13")
    as_lines(t.sql(RAW), f"{folder}/in")

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    streams.drain_batches(streams.read_signals(t.spark, path=f"{folder}/in"), folder, landing.logged(f"{folder}/runs", "ingest", handle))
    return t.spark.read.schema(schemas.RUN_LOG).parquet(f"{folder}/runs").groupBy("job", "state").agg(F.count(F.lit(1)).alias("n"))


@query("s14_read_ledger", """
SELECT event_id AS index, concat('{"amount": ', CAST(floor(value * 100) AS BIGINT), ', "type": "', event_type, '"}') AS event FROM events""")
def s14(t: Lake):
    folder = scratch(t.spark, "s14")
    event = F.concat(F.lit('{"amount": '), F.floor(F.col("value") * 100), F.lit(', "type": "'), "event_type", F.lit('"}'))
    t.events.select(F.col("event_id").alias("index"), event.alias("event"), F.lit("0").alias("prev_hash"), F.lit("0").alias("hash")).write.json(folder)
    return landing.read_ledger(t.spark, folder).select("index", "event")


# --- documents ----------------------------------------------------------------------------------------------------

SBOMS = """SELECT comp_id, kind, CASE kind
 WHEN 'SMALL' THEN concat('{"bomFormat":"cycloneDX","specVersion":"1.4","metadata":{"component":{"name":"', brand, '"}},"components":[{"name":"', name, '","version":"', version, '","purl":"', purl,
   '","bom-ref":"r', comp_id, '","supplier":{"name":"S ', brand, '"}},"junk",{"version":null,"supplier":"plain"}]}')
 WHEN 'LARGE' THEN concat('{"bomFormat":"CycloneDX","components":"none","serialNumber":"sn-', comp_id, '"}')
 WHEN 'PROMO' THEN concat('{"spdxVersion":"SPDX-2.3","name":"', brand, '","documentNamespace":"ns","packages":[{"name":"', name, '","versionInfo":"', version, '","SPDXID":"SPDXRef-', comp_id,
   '","supplier":"', brand, '","externalRefs":[{"referenceType":"cpe","referenceLocator":"x"},{"referenceType":"purl","referenceLocator":"', purl, '"}]},{"name":"bare"}]}')
 WHEN 'MEDIUM' THEN concat('{"vendor":"', brand, '","bomFormat":7}') WHEN 'STANDARD' THEN concat('[', comp_id, ']') ELSE 'not json' END AS payload, name, version, purl, brand FROM components"""


@query("p7_sbom_format", """
SELECT comp_id, CASE kind WHEN 'SMALL' THEN 'CycloneDX' WHEN 'LARGE' THEN 'CycloneDX' WHEN 'PROMO' THEN 'SPDX' WHEN 'MEDIUM' THEN 'Unknown' END AS format,
 CASE kind WHEN 'SMALL' THEN '1.4' WHEN 'LARGE' THEN 'unknown' WHEN 'PROMO' THEN 'SPDX-2.3' ELSE 'Unknown' END AS spec_version,
 CASE kind WHEN 'SMALL' THEN brand WHEN 'LARGE' THEN 'Unknown Vendor' WHEN 'PROMO' THEN brand WHEN 'MEDIUM' THEN brand ELSE 'Unknown' END AS vendor,
 CASE kind WHEN 'LARGE' THEN concat('sn-', comp_id) WHEN 'PROMO' THEN 'ns' END AS serial_number, kind IN ('STANDARD', 'ECONOMY') AS rejected FROM components""")
def p7(t: Lake):
    out = bom.parse_sbom(t.sql(SBOMS))
    return out.select("comp_id", "format", "spec_version", "vendor", "serial_number", F.col("error").isNotNull().alias("rejected"))


@query("p8_cyclonedx_components", """
SELECT comp_id, name, version, purl, concat('r', comp_id) AS bom_ref, concat('S ', brand) AS supplier FROM components WHERE kind = 'SMALL'
 UNION ALL SELECT comp_id, 'unknown', '', NULL, NULL, 'plain' FROM components WHERE kind = 'SMALL'""")
def p8(t: Lake):
    rows = bom.sbom_components(t.sql(SBOMS).select("comp_id", "payload")).filter(F.col("format") == "CycloneDX")
    return rows.select("comp_id", "name", "version", "purl", "bom_ref", "supplier")


@query("p9_spdx_packages", """
SELECT comp_id, name, version, purl, concat('SPDXRef-', comp_id) AS bom_ref, brand AS supplier FROM components WHERE kind = 'PROMO'
 UNION ALL SELECT comp_id, 'bare', '0.0.0', NULL, NULL, NULL FROM components WHERE kind = 'PROMO'""")
def p9(t: Lake):
    rows = bom.sbom_components(t.sql(SBOMS).select("comp_id", "payload")).filter(F.col("format") == "SPDX")
    return rows.select("comp_id", "name", "version", "purl", "bom_ref", "supplier")


PROVENANCE = """SELECT comp_id, CASE kind WHEN 'SMALL' THEN concat('{"signature":"ok","predicateType":"https://SLSA.dev/v1","predicate":{"buildType":"x","builder":{"id":"b', comp_id, '"}}}')
 WHEN 'LARGE' THEN '{"signature":"bad-signature"}' WHEN 'PROMO' THEN '{"predicateType":"slsa","predicate":{"buildType":"SLSA-build"}}'
 WHEN 'MEDIUM' THEN '{"predicateType":"other","predicate":{"builder":"text"}}' WHEN 'STANDARD' THEN '{}' END AS provenance FROM components"""


@query("p11_validate_provenance", """
SELECT comp_id, kind IN ('SMALL', 'PROMO', 'MEDIUM') AS has_provenance, kind IN ('SMALL', 'PROMO', 'MEDIUM') AS signature_verified, CASE WHEN kind IN ('SMALL', 'PROMO') THEN 3 END AS slsa_level,
 CASE WHEN kind = 'SMALL' THEN concat('b', comp_id) END AS builder_id, CASE WHEN kind = 'LARGE' THEN 'Invalid cryptographic signature in provenance.' END AS error FROM components""")
def p11(t: Lake):
    return bom.validate_provenance(t.sql(PROVENANCE)).drop("provenance")


MBOMS = """SELECT comp_id, CASE kind WHEN 'SMALL' THEN concat('{"model_name":"', name, '","version":"', version, '","architecture":{"name":"decoder","parameters":', comp_id, ',"layers_count":0,"layers":32},
   "datasets":[{"name":"d1","size_gb":1.5,"hash":"h', comp_id, '"},null,"x"],"dependencies":[{"name":"torch","version":"2.0"},{"package_name":"numpy"}],"signature_verified":true}')
 WHEN 'PROMO' THEN concat('{"name":"', name, '","architecture":"broken","datasets":{"a":1}}') WHEN 'LARGE' THEN '[]' ELSE 'no json' END AS payload FROM components"""


@query("p12_mbom_models", """
SELECT comp_id, name AS model_name, CASE kind WHEN 'SMALL' THEN version ELSE '0.0.0' END AS version, CASE kind WHEN 'SMALL' THEN 'decoder' ELSE 'unknown_arch' END AS architecture,
 CASE kind WHEN 'SMALL' THEN comp_id END AS parameters_count, CASE kind WHEN 'SMALL' THEN 32 END AS layers_count, 'PyTorch' AS framework, kind = 'SMALL' AS signature_verified
FROM components WHERE kind IN ('SMALL', 'PROMO')""")
def p12(t: Lake):
    return bom.parse_mbom(t.sql(MBOMS), "comp_id")[0]


@query("p12_mbom_datasets", """SELECT comp_id, 'd1' AS name, 1.5e0 AS size_gb, CAST(NULL AS VARCHAR) AS license, concat('h', comp_id) AS hash_sha256, CAST(NULL AS VARCHAR) AS source_url FROM components WHERE kind = 'SMALL'""")
def p12_datasets(t: Lake):
    return bom.parse_mbom(t.sql(MBOMS), "comp_id")[1]


@query("p12_mbom_dependencies", """
SELECT comp_id, 'torch' AS package_name, '2.0' AS version, CAST(NULL AS VARCHAR) AS purl, CAST(NULL AS VARCHAR) AS license FROM components WHERE kind = 'SMALL'
 UNION ALL SELECT comp_id, 'numpy', '0.0.0', NULL, NULL FROM components WHERE kind = 'SMALL'""")
def p12_dependencies(t: Lake):
    return bom.parse_mbom(t.sql(MBOMS), "comp_id")[2]
