"""Registered queries: windows, rankings and set operations (section 2.5 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.functions.numeric import half_up
from riskfabric.operators import aggregates, fusion, ledger, normalize, remediate, textscan, windows
from riskfabric.plans.registry import query, rounded
from riskfabric.plans.scalar import PENALTY_SQL

VERSIONS = """SELECT user_id, event_id, EPOCH_US(ts) AS ts_us, CASE WHEN value > 20 THEN event_type END AS last_type, value AS last_value,
  CASE WHEN event_type = 'view' THEN props END AS view_props, event_type IN ('click', 'view') AS is_old FROM events"""


@query("w1_upsert_nodes", f"""
SELECT user_id, min(ts_us) AS first_seen, max(ts_us) AS last_seen, arg_max(last_type, ts_us * 1000000 + event_id) FILTER (last_type IS NOT NULL) AS last_type,
  arg_max(last_value, ts_us * 1000000 + event_id) AS last_value, arg_max(view_props, ts_us * 1000000 + event_id) FILTER (view_props IS NOT NULL) AS view_props
FROM (SELECT user_id, event_id, CAST(ts_us AS HUGEINT) AS big, ts_us, last_type, last_value, view_props FROM ({VERSIONS}) v) x GROUP BY user_id""".replace("ts_us * 1000000 + event_id", "big * 1000000 + event_id"))
def w1(t: Lake):
    rows = t.sql(VERSIONS).withColumn("seen", F.col("ts_us"))
    old, new = rows.filter("is_old").drop("is_old"), rows.filter("NOT is_old").drop("is_old")
    return windows.upsert(old, new, ["user_id"], ["ts_us", "event_id"], "seen")


LOG = """SELECT user_id, EPOCH_US(ts) AS ts_us, event_id,
  concat('{"details": {"target_asset": "asset-', JSON_TEXT(props, '$.k'), '"}, "target": "vendor-', user_id, '", "type": "', event_type, '"}') AS event FROM events"""
GENESIS = '{"type": "GENESIS"}'
CHAIN = f"""placed AS (SELECT user_id, event, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS index FROM ({LOG}) l),
 chain AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS index, '{GENESIS}' AS event, repeat('0', 64) AS prev_hash, sha256(concat('{{"event": {GENESIS}, "index": 0, "prev_hash": "', repeat('0', 64), '"}}')) AS hash FROM placed
   UNION ALL SELECT p.user_id, p.index, p.event, c.hash, sha256(concat('{{"event": ', p.event, ', "index": ', p.index, ', "prev_hash": "', c.hash, '"}}'))
   FROM chain c JOIN placed p ON p.user_id = c.user_id AND p.index = c.index + 1)"""


def chain(t: Lake):
    return ledger.build_chain(t.sql(LOG), "user_id", ["ts_us", "event_id"], "event")


@query("w3_build_chain", f"WITH RECURSIVE {CHAIN} SELECT user_id, index, event, prev_hash, hash FROM chain")
def w3(t: Lake):
    return chain(t)


TAMPERED = "contains(event, 'asset-17\"') AND contains(event, 'purchase')"


@query("w2_verify_chain", f"""WITH RECURSIVE {CHAIN}, ok AS (SELECT user_id, index, NOT ({TAMPERED}) AS ok FROM chain)
SELECT user_id, bool_and(ok) AS valid, count(*) AS blocks, min(index) FILTER (NOT ok) AS first_bad FROM ok GROUP BY user_id""")
def w2(t: Lake):
    changed = F.contains("event", F.lit('asset-17"')) & F.contains("event", F.lit("purchase"))
    edited = chain(t).withColumn("event", F.when(changed, F.replace(F.col("event"), F.lit("purchase"), F.lit("refund"))).otherwise(F.col("event")))
    return ledger.verify_chain(edited, ["user_id"])


@query("u3_custody_log", f"""WITH RECURSIVE {CHAIN} SELECT user_id, index, hash, true AS integrity_verified FROM chain
WHERE json_extract_string(event, '$.target') = 'asset-42' OR json_extract_string(event, '$.details.target_asset') = 'asset-42'""")
def u3(t: Lake):
    return ledger.custody_log(chain(t), ["user_id"], "asset-42").select("user_id", "index", "hash", "integrity_verified")


@query("w5_rolling_zscore", f"""WITH w AS (SELECT event_id, cve_criticality AS x, avg(cve_criticality) OVER p AS m, stddev_samp(cve_criticality) OVER p AS s FROM telemetry
  WINDOW p AS (PARTITION BY asset_id ORDER BY ts_us, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN s > 0 THEN {rounded('(x - m) / s', 4)} END AS zscore FROM w""")
def w5(t: Lake):
    rows = t.telemetry.select("event_id", "asset_id", "ts_us", "cve_criticality")
    out = windows.rolling_zscore(rows, "asset_id", ["ts_us", "event_id"], "cve_criticality", 10)
    return out.select("event_id", half_up(F.col("zscore"), 4).alias("zscore"))


@query("w6_source_health", """
WITH e AS (SELECT event_id, source AS src, ts_us, CASE WHEN severity IN ('HIGH','CRITICAL','MEDIUM') OR cve_count > 0 OR dependencies_count > 20 THEN 1 ELSE 0 END AS f FROM (SELECT signal_id AS event_id, * FROM signals) s),
 g AS (SELECT *, sum(1 - f) OVER (PARTITION BY src ORDER BY ts_us, event_id) AS island FROM e),
 r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY src, island ORDER BY ts_us, event_id) AS BIGINT) AS failures_in_row FROM g),
 s AS (SELECT *, CASE WHEN failures_in_row >= 5 THEN 'OPEN' ELSE 'CLOSED' END AS state_after FROM r),
 l AS (SELECT *, lag(state_after) OVER (PARTITION BY src ORDER BY ts_us, event_id) AS before, lag(ts_us) OVER (PARTITION BY src ORDER BY ts_us, event_id) AS before_ts FROM s)
SELECT event_id, failures_in_row, state_after, CASE WHEN before = 'OPEN' THEN CASE WHEN ts_us - before_ts > 60000000 THEN 'HALF_OPEN' ELSE 'OPEN' END ELSE 'CLOSED' END AS state_before FROM l""")
def w6(t: Lake):
    signs = (F.col("severity").isin("HIGH", "CRITICAL", "MEDIUM"), F.col("cve_count") > 0, F.col("dependencies_count") > 20)
    failed = F.coalesce(signs[0], F.lit(False)) | F.coalesce(signs[1], F.lit(False)) | F.coalesce(signs[2], F.lit(False))
    rows = t.signals.select(F.col("signal_id").alias("event_id"), "source", "ts_us", failed.alias("failed"))
    out = windows.source_health(rows, "source", ["ts_us", "event_id"], F.col("failed"), "ts_us")
    return out.select("event_id", "failures_in_row", "state_after", "state_before")


OUTCOMES = """SELECT concat(type, '_', severity) AS state, CASE WHEN user_id % 2 = 0 THEN 'pb_generic_investigate' WHEN type = 'vulnerability' THEN 'pb_patch_guidance_01' ELSE 'pb_supply_chain_comm' END AS pb_id,
  ts_us, insight_id, CASE WHEN target_endpoint IS NOT NULL AND user_id % 3 > 0 THEN 1 ELSE 0 END AS reward FROM insights"""
FOLD = f"""o AS (SELECT *, row_number() OVER (PARTITION BY state, pb_id ORDER BY ts_us, insight_id) AS i, count(*) OVER (PARTITION BY state, pb_id) AS n FROM ({OUTCOMES}) x),
 q AS (SELECT state, pb_id, sum(0.2e0 * reward * pow(0.8e0, n - i)) + 0.5e0 * pow(0.8e0, max(n)) AS q, count(*) AS updates FROM o GROUP BY state, pb_id)"""


def learned(t: Lake):
    return remediate.fold_q(t.sql(OUTCOMES), ["state", "pb_id"], ["ts_us", "insight_id"], "reward")


@query("w7_fold_values", f"WITH {FOLD} SELECT state, pb_id, {rounded('q')} AS q, updates FROM q")
def w7(t: Lake):
    return learned(t).withColumn("q", half_up(F.col("q"), 6))


@query("w8_pick_playbook", f"""WITH {FOLD}, pb(pos, pb_id, want_type, want_severity) AS (VALUES (0, 'pb_network_isolate_01', 'vulnerability', 'critical'), (1, 'pb_patch_guidance_01', 'vulnerability', 'high'),
  (1, 'pb_patch_guidance_01', 'vulnerability', 'critical'), (2, 'pb_generic_investigate', NULL, NULL), (3, 'pb_soar_escalation', 'complex_incident', 'critical'), (4, 'pb_supply_chain_comm', 'supply_chain_breach', 'high'),
  (4, 'pb_supply_chain_comm', 'supply_chain_breach', 'critical'), (5, 'pb_supply_chain_controls', 'vendor_portal_vulnerability', 'high')),
 m AS (SELECT insight_id, pb.pb_id, pos, coalesce(q.q, 0.5e0) AS v FROM insights JOIN pb ON (want_type IS NULL OR want_type = type) AND (want_severity IS NULL OR want_severity = severity)
   LEFT JOIN q ON q.state = concat(type, '_', severity) AND q.pb_id = pb.pb_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY insight_id ORDER BY v DESC, pos) AS rn FROM m)
SELECT insight_id, pb_id, {rounded('v')} AS q FROM r WHERE rn = 1""")
def w8(t: Lake):
    picked = remediate.pick_playbooks(t.insights, learned(t), explore=0.0)
    return picked.select("insight_id", "pb_id", half_up(F.col("q"), 6).alias("q"))


# Each order line votes on the insight of its number, in the order of the lines.
VOTES = """SELECT l_orderkey AS insight_id, l_linenumber AS voted_at, CASE WHEN l_returnflag = 'N' AND l_discount < 0.05 THEN 'LEGAL' WHEN l_returnflag = 'A' AND l_discount < 0.03 THEN 'CFO' ELSE 'SOC_ANALYST' END AS role,
  CASE WHEN l_quantity > 45 THEN 'reject' WHEN l_quantity > 10 THEN 'approve' ELSE 'comment' END AS decision FROM lineitem"""
#: The playbooks that ask for something; without the general one some insights find none.
RULED = tuple(pb for pb in remediate.PLAYBOOKS if pb.match_rules)
PROCESSED = f"""{FOLD}, pb(pos, pb_id, kind, roles, want_type, want_severity) AS (VALUES
  (0, 'pb_network_isolate_01', 'automated', ['SOC_ANALYST', 'LEGAL'], 'vulnerability', ['critical']), (1, 'pb_patch_guidance_01', 'guided', CAST([] AS VARCHAR[]), 'vulnerability', ['high', 'critical']),
  (3, 'pb_soar_escalation', 'automated', ['SOC_ANALYST'], 'complex_incident', ['critical']), (4, 'pb_supply_chain_comm', 'automated', CAST([] AS VARCHAR[]), 'supply_chain_breach', ['high', 'critical']),
  (5, 'pb_supply_chain_controls', 'automated', CAST([] AS VARCHAR[]), 'vendor_portal_vulnerability', ['high'])),
 best AS (SELECT i.insight_id, pb.pb_id, kind, roles, row_number() OVER (PARTITION BY i.insight_id ORDER BY coalesce(q.q, 0.5e0) DESC, pos) AS rn
   FROM insights i JOIN pb ON want_type = type AND list_contains(want_severity, severity) LEFT JOIN q ON q.state = concat(type, '_', severity) AND q.pb_id = pb.pb_id),
 votes AS (SELECT insight_id, role, min(voted_at) FILTER (decision = 'approve') AS ok, min(voted_at) FILTER (decision = 'reject') AS refused FROM ({VOTES}) v GROUP BY insight_id, role),
 given AS (SELECT b.insight_id, count(ok) AS n, max(ok) AS last, list(role ORDER BY role) FILTER (ok IS NOT NULL) AS had FROM best b JOIN votes v ON v.insight_id = b.insight_id AND list_contains(roles, role) WHERE rn = 1 GROUP BY b.insight_id),
 refused AS (SELECT insight_id, min(refused) AS refused FROM votes GROUP BY insight_id),
 j AS (SELECT i.*, concat(type, '_', severity) AS state, b.pb_id, kind, roles, coalesce(n, 0) AS n, last, had, r.refused,
   CASE b.pb_id WHEN 'pb_network_isolate_01' THEN asset_id IS NOT NULL WHEN 'pb_supply_chain_comm' THEN vendor_id IS NOT NULL WHEN 'pb_supply_chain_controls' THEN target_endpoint IS NOT NULL ELSE true END AS works
   FROM insights i LEFT JOIN best b ON b.insight_id = i.insight_id AND rn = 1 LEFT JOIN given g ON g.insight_id = i.insight_id LEFT JOIN refused r ON r.insight_id = i.insight_id),
 processed AS (SELECT *, CASE WHEN pb_id IS NULL THEN 'NO_PLAYBOOK_FOUND' WHEN kind = 'guided' THEN 'WORKFLOW_STARTED'
   WHEN len(roles) > 0 AND refused IS NOT NULL AND (n < len(roles) OR refused <= last) THEN 'REJECTED' WHEN len(roles) > 0 AND n = 0 THEN 'AWAITING_APPROVAL'
   WHEN n < len(roles) THEN 'AWAITING_FURTHER_APPROVAL' WHEN works THEN 'AUTOMATED_SUCCESS' ELSE 'AUTOMATED_FAILED' END AS status FROM j)"""


def processed(t: Lake):
    return remediate.process_insights(t.insights, learned(t), t.sql(VOTES).withColumnRenamed("voted_at", "at"), RULED, explore=0.0)


@query("w8_insight_outcomes", f"""WITH {PROCESSED}
SELECT insight_id, pb_id, state, status, CASE WHEN status LIKE 'AWAITING%' THEN array_to_string(list_sort(list_filter(roles, lambda r: NOT list_contains(coalesce(had, []), r))), ',') ELSE '' END AS remaining,
  CASE WHEN status LIKE 'AUTOMATED%' THEN ts_us END AS done_at, CASE status WHEN 'AUTOMATED_SUCCESS' THEN 1 WHEN 'AUTOMATED_FAILED' THEN 0 END AS reward FROM processed""")
def w8_outcomes(t: Lake):
    out = processed(t).select("insight_id", "pb_id", "state", "status", "remaining", "done_at", "reward")
    return out.withColumn("remaining", F.concat_ws(",", "remaining"))


@query("w7_learn_outcomes", f"""WITH {PROCESSED},
 ran AS (SELECT state, pb_id, CASE WHEN works THEN 1 ELSE 0 END AS reward, row_number() OVER (PARTITION BY state, pb_id ORDER BY ts_us, insight_id) AS i, count(*) OVER (PARTITION BY state, pb_id) AS n
   FROM processed WHERE status LIKE 'AUTOMATED%'),
 more AS (SELECT state, pb_id, sum(0.2e0 * reward * pow(0.8e0, n - i)) AS a, count(*) AS m FROM ran GROUP BY state, pb_id)
SELECT coalesce(q.state, more.state) AS state, coalesce(q.pb_id, more.pb_id) AS pb_id, {rounded('coalesce(q, 0.5e0) * pow(0.8e0, coalesce(m, 0)) + coalesce(a, 0)')} AS q, coalesce(updates, 0) + coalesce(m, 0) AS updates
FROM q FULL JOIN more ON q.state = more.state AND q.pb_id = more.pb_id""")
def w7_learn(t: Lake):
    return remediate.learn_outcomes(learned(t), processed(t)).withColumn("q", half_up(F.col("q"), 6))


WORKFLOW = """SELECT user_id AS workflow_id, EPOCH_US(ts) AS at_us, CASE WHEN value <= 70 THEN 'note' WHEN event_type = 'signup' THEN 'start'
    WHEN event_type = 'error' THEN 'advance' WHEN event_type = 'purchase' THEN 'evidence' ELSE 'note' END AS kind FROM events"""


@query("w9_workflow_state", f"""
WITH e AS ({WORKFLOW}), s AS (SELECT workflow_id, min(at_us) FILTER (kind = 'start') AS t0 FROM e GROUP BY workflow_id),
 a AS (SELECT s.workflow_id, t0, (SELECT min(at_us) FROM e WHERE e.workflow_id = s.workflow_id AND kind = 'advance' AND at_us > t0) AS t1 FROM s),
 b AS (SELECT *, (SELECT min(at_us) FROM e WHERE e.workflow_id = a.workflow_id AND kind = 'evidence' AND at_us > t1) AS t2 FROM a)
SELECT workflow_id, CASE WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS step_index,
 CASE WHEN t0 IS NULL THEN 'PENDING' WHEN t2 IS NOT NULL THEN 'COMPLETED' WHEN t1 IS NOT NULL THEN 'WAITING_EVIDENCE' ELSE 'IN_PROGRESS' END AS state FROM b""")
def w9(t: Lake):
    return windows.workflow_state(t.sql(WORKFLOW), "workflow_id", "at_us", "kind", [False, True])


@query("l2_page_components", "SELECT comp_id, name, kind FROM components WHERE kind = 'LARGE' ORDER BY comp_id LIMIT 100 OFFSET 20")
def l2(t: Lake):
    listed = remediate.listing(t.components, text={"kind": "large"})
    return windows.page(listed, "comp_id", limit=100, offset=20).select("comp_id", "name", "kind")


JOBS = "SELECT o_orderkey, o_custkey AS target, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, EPOCH_US(o_orderdate) AS scheduled_for FROM orders"


@query("l3_job_order", f"SELECT o_orderkey, row_number() OVER (PARTITION BY target ORDER BY priority, scheduled_for, o_orderkey) AS position FROM ({JOBS}) j")
def l3(t: Lake):
    return windows.job_order(t.sql(JOBS), "target", ["priority", "scheduled_for", "o_orderkey"]).select("o_orderkey", "position")


@query("l4_recent_messages", "SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) r WHERE rank <= 4")
def l4_recent(t: Lake):
    return windows.recent_k(t.conversations, "conv_id", "turn", 4).select("conv_id", "turn", "rank")


PROBES = "SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0"
NORM = "sqrt(list_sum(list_transform({0}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))"


@query("l4_top_k_similar", f"""
WITH qv AS (SELECT e.vec_id AS query, e.embedding AS v FROM embeddings e JOIN ({PROBES}) p ON p.vec_id = e.vec_id),
 s AS (SELECT query, vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(v[i] AS DOUBLE))) / ({NORM.format('embedding')} * {NORM.format('v')}), 9) AS score
   FROM embeddings JOIN qv ON vec_id <> query), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, {rounded('score')} AS score, rank FROM r WHERE rank <= 5""")
def l4(t: Lake):
    out = windows.top_k_similar(t.embeddings, t.embeddings.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5)
    return out.withColumn("score", half_up(F.col("score"), 6))


FUSED = f"""SELECT signal_id, ts_us, type, coalesce(nullif(repo,''), nullif(package,''), nullif(actor,''), 'Unknown_Entity') AS entity, package, version, content, ip_address, cve_count,
  greatest(0, 70 - {PENALTY_SQL}) AS score FROM signals"""


def open_ports():
    """Ports of a scan, as many as it has findings and one more."""
    return F.slice(F.array(*map(F.lit, (80, 443, 22, 3306, 8080))), F.lit(1), F.col("cve_count") + 1)


def fused_signals(t: Lake):
    rows = t.signals.withColumns({
        "open_ports": open_ports(),
        "entity": normalize.entity_name(), "score": normalize.adjusted_score(),
        "actors": textscan.extract_actors(F.col("content")),
        "cves": F.when(F.col("cve_count") > 0, F.transform(
            F.sequence(F.lit(1), F.col("cve_count")), lambda i: F.concat(F.lit("CVE-2024-"), (F.lit(1000) + i).cast("string"))))})
    return windows.signals_to_graph(rows)


ACTOR_LIST = "(VALUES ('APT29'), ('Lazarus'), ('Equation Group'), ('Sandworm')) act(actor)"
GRAPH_NODES = f"""f AS ({FUSED}), nodes AS (SELECT concat('Identity:', entity) AS id, 'Identity' AS label, score, ts_us, signal_id, NULL AS ports, NULL AS found FROM f
 UNION ALL SELECT concat('SoftwareComponent:pkg:generic/', package, '@', CASE WHEN type = 'vulnerability' THEN 'unknown' ELSE coalesce(version, '0.0.0') END), 'SoftwareComponent', NULL, ts_us, signal_id, NULL, NULL FROM f WHERE type IN ('sbom','vulnerability') AND package IS NOT NULL
 UNION ALL SELECT concat('Device:', ip_address), 'Device', NULL, ts_us, signal_id, coalesce(array_to_string([80, 443, 22, 3306, 8080][1:cve_count + 1], ','), ''), coalesce(array_to_string(list_transform(range(1, cve_count + 1), lambda i: concat('CVE-2024-', 1000 + i)), ','), '') FROM f WHERE type = 'network_scan' AND ip_address IS NOT NULL
 UNION ALL SELECT concat('ThreatActor:', actor), 'ThreatActor', NULL, ts_us, signal_id, NULL, NULL FROM f JOIN {ACTOR_LIST} ON contains(lower(content), lower(actor)) WHERE type = 'report'
 UNION ALL SELECT concat('Vulnerability:CVE-2024-', 1000 + i), 'Vulnerability', NULL, ts_us, signal_id, NULL, NULL FROM f JOIN (VALUES (1), (2), (3)) s(i) ON i <= cve_count WHERE type = 'network_scan')"""


SCANNED = """arg_max(ports, CAST(ts_us AS HUGEINT) * 1000000 + signal_id) FILTER (ports IS NOT NULL) AS open_ports,
  arg_max(found, CAST(ts_us AS HUGEINT) * 1000000 + signal_id) FILTER (found IS NOT NULL) AS cves"""


@query("u1_graph_nodes", f"""WITH {GRAPH_NODES}
SELECT id, min(label) AS label, min(ts_us) AS first_seen, max(ts_us) AS last_seen, arg_max(score, CAST(ts_us AS HUGEINT) * 1000000 + signal_id) FILTER (score IS NOT NULL) AS security_score, {SCANNED} FROM nodes GROUP BY id""")
def u1_nodes(t: Lake):
    nodes, _ = fused_signals(t)
    nodes = nodes.withColumn("seen", F.col("ts_us"))
    return listed(windows.upsert(nodes.limit(0), nodes, ["id"], ["ts_us", "signal_id"], "seen"))


def listed(nodes):
    """Lists of a device as text."""
    as_text = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(",", F.col(c).cast("array<string>"))).alias(c)
    return nodes.select(*[as_text(c) if c in ("open_ports", "cves") else c for c in nodes.columns])


@query("u1_graph_edges", f"""WITH f AS ({FUSED}), edges AS (SELECT concat('Identity:', entity) AS src,
  concat('SoftwareComponent:pkg:generic/', package, '@', CASE WHEN type = 'vulnerability' THEN 'unknown' ELSE coalesce(version, '0.0.0') END) AS dst, 'DEVELOPED' AS type, ts_us FROM f WHERE type IN ('sbom','vulnerability') AND package IS NOT NULL
 UNION ALL SELECT concat('ThreatActor:', actor), concat('Identity:', entity), 'TARGETS', ts_us FROM f JOIN {ACTOR_LIST} ON contains(lower(content), lower(actor)) WHERE type = 'report'
 UNION ALL SELECT concat('Device:', ip_address), concat('Vulnerability:CVE-2024-', 1000 + i), 'HAS_VULNERABILITY', ts_us FROM f JOIN (VALUES (1), (2), (3)) s(i) ON i <= cve_count WHERE type = 'network_scan')
SELECT src, dst, type, min(ts_us) AS first_seen, max(ts_us) AS last_seen, CASE WHEN type = 'TARGETS' THEN 0.85e0 ELSE 1e0 END AS confidence FROM edges GROUP BY src, dst, type""")
def u1_edges(t: Lake):
    _, edges = fused_signals(t)
    edges = edges.withColumn("seen", F.col("ts_us"))
    return windows.upsert(edges.limit(0), edges, ["src", "dst", "type"], ["ts_us", "signal_id"], "seen")


# --- sections of fused signals -----------------------------------------------------------------------------------------

COMPONENT_SECTION = """SELECT brand AS entity, name, version, CASE WHEN kind <> 'MEDIUM' THEN purl END AS purl, 'CycloneDX' AS format, exploit_score, comp_id, kind FROM components WHERE kind <> 'LARGE'"""
MODEL_SECTION = "SELECT brand AS entity, name AS model_name, version, has_provenance, kind FROM components WHERE kind = 'LARGE'"
REPORT_SECTION = """SELECT DISTINCT c.purl AS target_purl, r.hash, false AS is_malicious FROM reports_bin r JOIN components c ON c.comp_id = r.comp_id WHERE kind IN ('SMALL', 'MEDIUM')"""


def sections(t: Lake):
    """Component, model and report sections bound to parts; vulnerabilities as listed for the part."""
    cves = t.component_vulns.groupBy("comp_id").agg(F.collect_set("cve").alias("cves"))
    parts = t.sql(COMPONENT_SECTION).join(cves, "comp_id", "left")
    nested = F.array(F.struct(F.concat(F.lit("set-"), "entity").alias("name")))
    needs = F.array(F.struct(F.concat(F.lit("lib-"), "entity").alias("package_name"), F.col("version"), F.lit(None).cast("string").alias("purl")))
    models = t.sql(MODEL_SECTION).select("entity", "model_name", "version", F.col("has_provenance").alias("signature_verified"), nested.alias("datasets"), needs.alias("dependencies"))
    n1, e1 = fusion.component_rows(parts)
    n2, e2 = fusion.model_rows(models)
    n3, e3 = fusion.report_rows(t.sql(REPORT_SECTION), n1.unionByName(n2))
    return n1.unionByName(n2).unionByName(n3), e1.unionByName(e2).unionByName(e3)


SECTIONS = f"""cs AS (SELECT *, concat('SoftwareComponent:', coalesce(purl, concat('pkg:generic/', name, '@', version))) AS c FROM ({COMPONENT_SECTION}) x),
 ms AS (SELECT *, concat('AIModel:pkg:ml/', model_name, '@', version) AS m FROM ({MODEL_SECTION}) x),
 rs AS (SELECT *, concat('BinaryAnalysisReport:report:binary/', hash) AS r FROM ({REPORT_SECTION}) x),
 vs AS (SELECT cs.c, concat('Vulnerability:', v.cve) AS v FROM cs JOIN component_vulns v ON v.comp_id = cs.comp_id)"""


@query("u1_section_nodes", f"""WITH {SECTIONS}, scored AS (SELECT c, max(exploit_score) AS score FROM cs WHERE c IN (SELECT c FROM vs) GROUP BY c)
SELECT DISTINCT concat('Identity:', entity) AS id, 'Identity' AS label, NULL::DOUBLE AS exploit_score, NULL AS severity, NULL::BOOLEAN AS signature_verified, NULL::BOOLEAN AS is_malicious FROM (SELECT entity FROM cs UNION SELECT entity FROM ms) e
UNION ALL SELECT DISTINCT cs.c, 'SoftwareComponent', s.score, CASE WHEN s.score > 0.85 THEN 'CRITICAL' WHEN s.score > 0.7 THEN 'HIGH' WHEN s.score > 0.4 THEN 'MEDIUM' WHEN s.score IS NOT NULL THEN 'LOW' END, NULL, NULL FROM cs LEFT JOIN scored s ON s.c = cs.c
UNION ALL SELECT DISTINCT v, 'Vulnerability', NULL, NULL, NULL, NULL FROM vs
UNION ALL SELECT m, 'AIModel', NULL, NULL, bool_or(has_provenance), NULL FROM ms GROUP BY m
UNION ALL SELECT DISTINCT concat('Dataset:pkg:dataset/set-', entity), 'Dataset', NULL, NULL, NULL, NULL FROM ms
UNION ALL SELECT DISTINCT concat('SoftwareComponent:pkg:generic/lib-', entity, '@', version), 'SoftwareComponent', NULL, NULL, NULL, NULL FROM ms
UNION ALL SELECT r, 'BinaryAnalysisReport', NULL, NULL, NULL, bool_or(is_malicious) FROM rs GROUP BY r""")
def u1_section_nodes(t: Lake):
    return fusion.fold_nodes(sections(t)[0])


@query("u1_section_edges", f"""WITH {SECTIONS}
SELECT DISTINCT concat('Identity:', entity) AS src, c AS dst, 'DEVELOPED' AS type, format AS source FROM cs
UNION ALL SELECT DISTINCT c, v, 'HAS_VULNERABILITY', NULL FROM vs
UNION ALL SELECT DISTINCT concat('Identity:', entity), m, 'DEVELOPED', 'MBOM' FROM ms
UNION ALL SELECT DISTINCT m, concat('Dataset:pkg:dataset/set-', entity), 'TRAINED_ON', NULL FROM ms
UNION ALL SELECT DISTINCT m, concat('SoftwareComponent:pkg:generic/lib-', entity, '@', version), 'DEPENDS_ON', NULL FROM ms
UNION ALL SELECT DISTINCT cs.c, r, 'HAS_ANALYSIS_REPORT', NULL FROM rs JOIN cs ON cs.c = concat('SoftwareComponent:', rs.target_purl)""")
def u1_section_edges(t: Lake):
    return sections(t)[1].distinct()


@query("a3_section_counts", f"""WITH {SECTIONS},
 n AS (SELECT entity, count(*) AS components, 0 AS models, 0 AS binaries FROM cs GROUP BY entity UNION ALL SELECT entity, 0, count(*), 0 FROM ms GROUP BY entity
  UNION ALL SELECT c.brand, 0, 0, count(DISTINCT r.hash) FROM rs r JOIN components c ON c.purl = r.target_purl GROUP BY c.brand)
SELECT entity, CAST(1 + 2 * sum(components) + 3 * sum(models) + sum(binaries) AS BIGINT) AS nodes_affected FROM n GROUP BY entity""")
def a3_sections(t: Lake):
    """Nodes touched by fusing all sections of an entity."""
    counts = t.components.groupBy(F.col("brand").alias("entity")).agg(
        F.count_if(F.col("kind") != "LARGE").alias("components"), F.count_if(F.col("kind") == "LARGE").alias("models"))
    owners = t.components.select("purl", F.col("brand").alias("entity"))
    binaries = t.sql(REPORT_SECTION).join(owners, F.col("target_purl") == F.col("purl")).groupBy("entity").agg(F.count(F.lit(1)).alias("binaries"))
    none = F.lit(0)
    return counts.join(binaries, "entity", "left").select("entity", aggregates.affected_counts(
        F.col("components"), F.col("models"), F.col("binaries"), none, none).cast("long").alias("nodes_affected"))
