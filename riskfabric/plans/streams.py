"""Registered queries: streaming jobs (section 2.7 of the survey), run over the tables written out as JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.functions.numeric import half_up
from riskfabric.operators import models, normalize
from riskfabric.plans.joins import ASSETS_ALL, HOST_EDGES, MATCHED, SHADOW
from riskfabric.plans.landing import BATCH_FILES, FEED, RAW, as_feed, as_lines
from riskfabric.plans.registry import query, rounded
from riskfabric.plans.scalar import TRIGGER_SQL
from riskfabric.plans.windows import GRAPH_NODES, SCANNED, WORKFLOW, listed, open_ports
from riskfabric.session import scratch
from riskfabric.sources import graphstore, matchindex, streams
from riskfabric.streaming import jobs, throttle, workflow
from riskfabric.streaming.ordered import PROVIDER, ROCKSDB

WINDOWED = f"""w AS (SELECT asset_id, (ts_us // 60000000 - i) * 60000000 AS start_us, connection_count, cve_criticality, unique_ips, centrality
   FROM telemetry, (VALUES (0), (1), (2), (3), (4)) v(i)),
 f AS (SELECT start_us, asset_id, {rounded('avg(connection_count)')} AS avg_connection_rate, {rounded('sum(cve_criticality)')} AS cve_criticality_sum,
   CAST(sum(unique_ips) AS BIGINT) AS unique_ips_contacted, {rounded('avg(centrality)')} AS degree_centrality FROM w GROUP BY start_us, asset_id)"""


def shown(features):
    return features.select(
        F.unix_micros("window_start").alias("start_us"), "asset_id", "unique_ips_contacted",
        *[half_up(F.col(c), 6).alias(c) for c in ("avg_connection_rate", "cve_criticality_sum", "degree_centrality")])


def telemetry_batch(t: Lake):
    return t.sql(FEED).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@query("t2_window_features", f"WITH {WINDOWED} SELECT * FROM f")
def t2(t: Lake):
    return shown(jobs.window_features(telemetry_batch(t)))


@query("t2_window_features_stream", f"WITH {WINDOWED} SELECT * FROM f WHERE start_us + 300000000 <= (SELECT max(ts_us) FROM telemetry) - 600000000")
def t2_stream(t: Lake):
    folder = scratch(t.spark, "t2")
    as_lines(t.sql(FEED), f"{folder}/in")
    return shown(streams.drain(jobs.window_features(streams.read_telemetry(t.spark, path=f"{folder}/in")), folder))


MIDDLE = "2024-01-15 00:00:00"
MIDDLE_US = 1705276800000000


@query("t1_watermark_drops_late", f"""WITH {WINDOWED.replace('FROM telemetry,', f'FROM (SELECT * FROM telemetry WHERE ts_us >= {MIDDLE_US}) t,')}
SELECT * FROM f WHERE start_us + 300000000 <= (SELECT max(ts_us) FROM telemetry) - 600000000""")
def t1(t: Lake):
    """The newer half arrives first; every row of the older half is then behind the watermark."""
    folder = scratch(t.spark, "t1")
    rows = t.sql(FEED)
    recent = F.col("timestamp") >= F.lit(MIDDLE).cast("timestamp_ntz")
    as_lines(rows.filter(recent), f"{folder}/in/a")
    source = f"{folder}/in/*"
    stream = lambda: jobs.window_features(streams.read_telemetry(t.spark, path=source))
    streams.drain(stream(), folder)
    as_lines(rows.filter(~recent), f"{folder}/in/b")
    return shown(streams.drain(stream(), folder))


@query("t3_stream_anomalies")
def t3(t: Lake):
    folder = scratch(t.spark, "t3")
    batch = jobs.window_features(telemetry_batch(t)).withColumn("row_key", F.xxhash64("window_start", "asset_id"))
    forest = models.IsolationForest.fit(batch, models.TELEMETRY_FEATURES, "row_key")
    as_feed(t.sql(FEED), f"{folder}/in", "timestamp")
    t.spark.conf.set(PROVIDER, ROCKSDB)  # the windows of a micro-batch are five to a row and would fill the heap
    stream = jobs.window_features(streams.read_telemetry(t.spark, path=f"{folder}/in", maxFilesPerTrigger=str(BATCH_FILES)))
    return streams.drain(jobs.anomalies(stream, forest.predict), folder)


@query("t4_normalize_stream", """
SELECT source, CASE WHEN source IN ('github','pypi','npm') THEN 'software' WHEN source = 'network_scanner' THEN 'ipv4-addr' ELSE 'unknown' END AS asset_type,
  CASE source WHEN 'github' THEN repo WHEN 'pypi' THEN package WHEN 'npm' THEN package WHEN 'network_scanner' THEN ip_address ELSE 'unknown' END AS value,
  CASE WHEN source IN ('pypi','npm') THEN lower(coalesce(severity,'unknown')) ELSE 'info' END AS norm_severity, count(*) AS n FROM signals GROUP BY ALL""")
def t4(t: Lake):
    folder = scratch(t.spark, "t4")
    as_lines(t.sql(RAW), f"{folder}/in")
    parsed = streams.read_signals(t.spark, path=f"{folder}/in").filter(F.col("error").isNull()).select("s.*")
    rows = streams.drain(normalize.normalize_signals(parsed), folder)
    return rows.groupBy("source", "asset_type", "value", "norm_severity").agg(F.count(F.lit(1)).alias("n"))


WIRE = """SELECT signal_id, ts_us, source, type, repo, package, version, dependencies_count, cve_id, severity, actor, content, ip_address, cve_count FROM signals"""
WIRE_SCHEMA = """signal_id bigint, ts_us bigint, source string, type string, repo string, package string, version string, dependencies_count int, cve_id string,
 severity string, actor string, content string, ip_address string, open_ports array<int>, cve_detections array<string>"""


def wire(t: Lake, folder: str) -> str:
    listed = F.transform(F.sequence(F.lit(1), F.col("cve_count")), lambda i: F.concat(F.lit("CVE-2024-"), (F.lit(1000) + i).cast("string")))
    rows = t.sql(WIRE).withColumn("open_ports", open_ports()).withColumn("cve_detections", F.when(F.col("cve_count") > 0, listed)).drop("cve_count")
    return as_lines(rows, f"{folder}/in")


HASHED = GRAPH_NODES.replace("concat('Device:', ip_address)", "concat('Device:', sha256(concat(ip_address, 'pepper')))")
FUSED_NODES = f"""SELECT id, min(label) AS label, min(ts_us) AS first_seen, max(ts_us) AS last_seen,
  arg_max(score, CAST(ts_us AS HUGEINT) * 1000000 + signal_id) FILTER (score IS NOT NULL) AS security_score, {SCANNED} FROM nodes GROUP BY id"""


def ingested(t: Lake, name: str, replays: int = 1):
    folder = scratch(t.spark, name)
    path = wire(t, folder)
    for i in range(replays):
        # A fresh checkpoint stands for a restart that has lost its progress; it delivers everything again, cut otherwise.
        store = graphstore.GraphStore(t.spark, f"{folder}/graph", f"run{i}")
        handle = jobs.ingest_batch(store, f"{folder}/dlq", WIRE_SCHEMA, "pepper")
        cutting = {"maxFilesPerTrigger": str(3 - i)} if i < 3 else {}
        streams.drain_batches(streams.read_values(t.spark, {"path": path, **cutting}, "text"), f"{folder}/run{i}", handle)
    return listed(store.current("nodes", ["id"], ["ts_us", "signal_id"], "seen"))


@query("t5_ingest_to_graph", f"WITH {HASHED} {FUSED_NODES}")
def t5(t: Lake):
    return ingested(t, "t5")


@query("t11_replayed_ingest", f"WITH {HASHED} {FUSED_NODES}")
def t11(t: Lake):
    return ingested(t, "t11", replays=2)


@query("t6_correlate_stream", f"{MATCHED} SELECT ext_id, int_id, {rounded('score')} AS score, method FROM matches")
def t6(t: Lake):
    folder = scratch(t.spark, "t6")
    as_lines(t.assets_ext.select("id", "ord", "value", "name", "cert_hash"), f"{folder}/in")
    raw = streams.read_values(t.spark, {"path": f"{folder}/in"}, "text")
    arriving = raw.select(F.from_json("value", "id string, ord bigint, value string, name string, cert_hash string").alias("s")).select("s.*")
    matchindex.MatchIndex.build(t.assets_int, f"{folder}/index")
    streams.drain_batches(arriving, folder, jobs.correlate_batch(f"{folder}/index", f"{folder}/out", "run0"))
    return t.spark.read.parquet(f"{folder}/out").select("ext_id", "int_id", half_up(F.col("score"), 6).alias("score"), "method")


@query("t7_graph_updates", """
WITH n AS (SELECT signal_id, ts_us, CASE WHEN source IN ('github','pypi','npm') THEN 'software' WHEN source = 'network_scanner' THEN 'ipv4-addr' ELSE 'unknown' END AS label,
  CASE source WHEN 'github' THEN repo WHEN 'pypi' THEN package WHEN 'npm' THEN package WHEN 'network_scanner' THEN ip_address ELSE 'unknown' END AS value,
  CASE WHEN source IN ('pypi','npm') THEN lower(coalesce(severity,'unknown')) ELSE 'info' END AS severity FROM signals)
SELECT concat(label, ':', value) AS id, min(ts_us) AS first_seen, max(ts_us) AS last_seen, arg_max(severity, CAST(ts_us AS HUGEINT) * 1000000 + signal_id) AS severity FROM n GROUP BY label, value""")
def t7(t: Lake):
    folder = scratch(t.spark, "t7")
    path = wire(t, folder)
    store = graphstore.GraphStore(t.spark, f"{folder}/graph", "run0")
    parsed = streams.read_values(t.spark, {"path": path}, "text").select(F.from_json("value", WIRE_SCHEMA).alias("s")).select("s.*")
    streams.drain_batches(normalize.normalize_signals(parsed), folder, jobs.graph_update_batch(store))
    return store.current("assets", ["id"], ["ts_us", "signal_id"], "seen").select("id", "first_seen", "last_seen", "severity")


@query("t8_trigger_stream", TRIGGER_SQL)
def t8(t: Lake):
    folder = scratch(t.spark, "t8")
    as_lines(t.insights.select("insight_id", "title", "type", "severity", "vendor_id"), f"{folder}/in")
    raw = streams.read_values(t.spark, {"path": f"{folder}/in"}, "text")
    insights = raw.select(F.from_json("value", "insight_id bigint, title string, type string, severity string, vendor_id string").alias("s")).select("s.*")
    streams.drain_batches(insights, folder, jobs.trigger_batch(f"{folder}/actions", f"{folder}/escalations", "run0"))
    both = t.spark.read.parquet(f"{folder}/actions").unionByName(t.spark.read.parquet(f"{folder}/escalations"))
    return both.select("insight_id", "vendor_id", "action", "reason")


REQUESTS = "SELECT event_id, concat('target-', user_id) AS target, concat('10.0.0.', CAST(JSON_TEXT(props, '$.k') AS INT) % 10) AS ip, EPOCH_US(ts) AS ts_us FROM events"
CAP, RATE = 3.0, 1 / 7200


def bucket_sql(source: str, key: str, name: str) -> str:
    """CTEs stepping the bucket row by row: `{name}`(event_id, ok)."""
    return f"""{name}_n AS (SELECT event_id, {key} AS k, ts_us, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, event_id) AS i FROM {source}),
 {name}_r AS (SELECT event_id, k, ts_us, i, {CAP}e0 - 1 AS tokens, true AS ok FROM {name}_n WHERE i = 1
  UNION ALL SELECT n.event_id, n.k, n.ts_us, n.i, CASE WHEN x >= 1 THEN x - 1 ELSE x END, x >= 1 FROM (
    SELECT n.*, least({CAP}e0, r.tokens + CAST(n.ts_us - r.ts_us AS DOUBLE) * {RATE!r} / 1e6) AS x FROM {name}_r r JOIN {name}_n n ON n.k = r.k AND n.i = r.i + 1) n),
 {name} AS (SELECT event_id, ok FROM {name}_r)"""


@query("t9_throttle", f"WITH RECURSIVE req AS ({REQUESTS}), {bucket_sql('req', 'target', 'b')} SELECT event_id, ok AS allowed FROM b")
def t9(t: Lake):
    out = throttle.throttle(t.sql(REQUESTS), "target", ["ts_us", "event_id"], CAP, RATE)
    return out.select("event_id", "allowed")


@query("t9_throttle_stream", f"WITH RECURSIVE req AS ({REQUESTS}), {bucket_sql('req', 'target', 'b')} SELECT event_id, ok AS allowed FROM b")
def t9_stream(t: Lake):
    rows = t.sql(REQUESTS).select("event_id", "target", "ts_us")

    def decided(raw):
        events = raw.select(F.from_json("value", "event_id bigint, target string, ts_us bigint").alias("s")).select("s.*")
        return throttle.throttle_stream(events, "target", "event_id", "ts_us", CAP, RATE, "1 day", DAY_MS)

    out = in_halves(t, "t9", rows, "ts_us", decided, {"target": F.lit("heartbeat")})
    return out.filter("target <> 'heartbeat'").select("event_id", "allowed")


DAY_MS = 24 * throttle.HOUR_MS


def in_halves(t: Lake, name: str, rows, ts_us: str, stream, heartbeat: dict, run=streams.drain):
    """Two runs of a stream over one checkpoint: the older rows, then the newer ones, each in no order; the first of them starts the second run's clock.

    The last row is a heartbeat two days behind all others, which takes the watermark past them.
    """
    folder = scratch(t.spark, name)
    middle, last = rows.agg(F.percentile_approx(ts_us, 0.5), F.max(ts_us)).first()
    late = [c for c in rows.columns if c != ts_us and c not in heartbeat]
    end = t.spark.range(1).select(F.lit((last or 0) + 2 * DAY_MS * 1000).alias(ts_us), *[v.alias(c) for c, v in heartbeat.items()], *[
        F.lit(-1).cast(rows.schema[c].dataType).alias(c) for c in late])
    as_lines(rows.filter(F.col(ts_us) <= F.lit(middle)), f"{folder}/in/a")
    read = lambda: stream(streams.read_values(t.spark, {"path": f"{folder}/in/*"}, "text"))
    run(read(), folder)
    as_lines(rows.filter(F.col(ts_us) > F.lit(middle)), f"{folder}/in/b")
    as_lines(end, f"{folder}/in/c")
    return run(read(), folder)


@query("t9_throttle_jobs", f"""WITH RECURSIVE req AS ({REQUESTS}), {bucket_sql('req', 'target', 'b')},
 passed AS (SELECT req.* FROM req JOIN b ON b.event_id = req.event_id WHERE ok), {bucket_sql('passed', 'ip', 'c')}
SELECT b.event_id, CASE WHEN NOT b.ok THEN 'target_limit' WHEN c.ok THEN 'executed' ELSE 'ip_limit' END AS decision FROM b LEFT JOIN c ON c.event_id = b.event_id""")
def t9_jobs(t: Lake):
    return throttle.throttle_jobs(t.sql(REQUESTS), "target", "ip", ["ts_us", "event_id"], limits=(CAP, RATE)).select("event_id", "decision")


@query("t10_shadow_scan", f"SELECT id AS src, concat('exposure--shadow-it--', id) AS dst FROM ({SHADOW}) s")
def t10(t: Lake):
    folder = scratch(t.spark, "t10")
    for _ in range(2):  # two scheduled scans leave the rows of one
        jobs.shadow_scan(t.sql(ASSETS_ALL), t.sql(HOST_EDGES), folder)
    return t.spark.read.parquet(f"{folder}/edges").select("src", "dst")


@query("w9_workflow_stream", f"""
WITH e AS ({WORKFLOW}), s AS (SELECT workflow_id, min(at_us) FILTER (kind = 'start') AS t0 FROM e GROUP BY workflow_id),
 a AS (SELECT s.workflow_id, t0, (SELECT min(at_us) FROM e WHERE e.workflow_id = s.workflow_id AND kind = 'advance' AND at_us > t0) AS t1 FROM s),
 b AS (SELECT *, (SELECT min(at_us) FROM e WHERE e.workflow_id = a.workflow_id AND kind = 'evidence' AND at_us > t1) AS t2 FROM a)
SELECT workflow_id, CASE WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS step_index,
 CASE WHEN t0 IS NULL THEN 'PENDING' WHEN t2 IS NOT NULL THEN 'COMPLETED' WHEN t1 IS NOT NULL THEN 'WAITING_EVIDENCE' ELSE 'IN_PROGRESS' END AS state FROM b""")
def w9_stream(t: Lake):
    def states(raw):
        events = raw.select(F.from_json("value", "workflow_id bigint, at_us bigint, kind string").alias("s")).select("s.*")
        return workflow.workflow_stream(events, "workflow_id", "at_us", "kind", [False, True], "1 day", slice_ms=DAY_MS)

    rows = in_halves(t, "w9", t.sql(WORKFLOW), "at_us", states, {"workflow_id": F.lit(-1), "kind": F.lit("note")}, latest)
    last = rows.filter("workflow_id >= 0").groupBy("workflow_id")
    return last.agg(F.max_by("step_index", "batch").alias("step_index"), F.max_by("state", "batch").alias("state"))


def latest(states, folder: str):
    """All updates with their batch; within a batch a workflow that crosses slices has several, the last of which has the furthest step."""
    def keep(batch, batch_id):
        final = batch.groupBy("workflow_id").agg(F.max("step_index").alias("step_index"), F.max_by("state", F.struct("step_index", F.col("state") != "PENDING")).alias("state"))
        final.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    (states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep)
     .trigger(availableNow=True).start().awaitTermination())
    return states.sparkSession.read.parquet(f"{folder}/out")
