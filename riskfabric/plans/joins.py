"""Registered queries: joins (section 2.3 of the survey) and the prioritisation built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.functions.numeric import half_up
from riskfabric.functions.tfidf import char_wb, fit_idf, term_counts, vectors
from riskfabric.operators import binary, evaluate, govern, joins, match, remediate, risk, textscan
from riskfabric.plans.registry import query, rounded
from riskfabric.plans.scalar import BAD_SQL, PARSED, REQUIREMENTS

# --- prioritisation -------------------------------------------------------------------------------------------

IMPACT = f"""WITH rep AS (SELECT comp_id, count(*) AS reports, bool_or({BAD_SQL}) AS any_malicious,
    CAST(sum(CASE WHEN {BAD_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS malicious_reports FROM reports_bin GROUP BY comp_id),
  dev AS (SELECT comp_id, count(*) AS devices FROM runs GROUP BY comp_id)"""

PRIORITY = f"""{IMPACT}, risk AS (SELECT c.comp_id, c.name, c.purl, c.has_provenance, c.exploit_score,
    coalesce(any_malicious, false) AS malicious_detected, coalesce(devices, 0) AS devices_affected, coalesce(reports, 0) AS report_count,
    {rounded('least(100, exploit_score * 50 + CASE WHEN has_provenance THEN 0 ELSE 20 END + coalesce(malicious_reports, 0) * 100e0 + coalesce(devices, 0) * 30e0)', 2)} AS priority_score
  FROM components c LEFT JOIN rep ON rep.comp_id = c.comp_id LEFT JOIN dev ON dev.comp_id = c.comp_id),
  risks AS (SELECT *, concat_ws(' | ',
    CASE WHEN malicious_detected THEN concat('CRITICAL: Quarantined artifact/binary immediately. Deny execution on all ', devices_affected, ' affected systems.') END,
    CASE WHEN NOT has_provenance THEN 'HIGH: Signature or build provenance validation failed. Block deployments until signature can be verified.' END,
    CASE WHEN devices_affected > 0 AND NOT malicious_detected THEN concat('MEDIUM: Monitor deployments on ', devices_affected, ' devices and schedule update patches.') END,
    CASE WHEN has_provenance AND NOT malicious_detected AND devices_affected = 0 THEN 'LOW: Keep dependency version updated.' END) AS actions FROM risk)"""


def scanned_reports(t: Lake):
    return t.reports_bin.select("comp_id", "hash", binary.is_bad_hash(F.col("hash")).alias("is_malicious"))


def prioritized(t: Lake):
    parts = t.components.select("comp_id", "name", "purl", "has_provenance", "exploit_score")
    out = risk.prioritize(parts, scanned_reports(t), t.runs)
    return out.withColumn("actions", F.concat_ws(" | ", "actions"))


@query("a2_artefact_impact", f"""{IMPACT}
SELECT coalesce(rep.comp_id, dev.comp_id) AS comp_id, reports, any_malicious, malicious_reports, devices
FROM rep FULL JOIN dev ON rep.comp_id = dev.comp_id""")
def a2(t: Lake):
    by_report, by_device = risk.artefact_impact(scanned_reports(t), t.runs)
    return by_report.join(by_device, "comp_id", "full")


@query("j7_risk_prioritization", f"{PRIORITY} SELECT comp_id, malicious_detected, devices_affected, report_count, priority_score FROM risks")
def j7(t: Lake):
    return prioritized(t).select("comp_id", "malicious_detected", "devices_affected", "report_count", "priority_score")


@query("p25_priority_score", f"{PRIORITY} SELECT comp_id, exploit_score, has_provenance, priority_score FROM risks")
def p25(t: Lake):
    return prioritized(t).select("comp_id", "exploit_score", "has_provenance", "priority_score")


@query("p26_recommended_actions", f"{PRIORITY} SELECT comp_id, actions FROM risks")
def p26(t: Lake):
    return prioritized(t).select("comp_id", "actions")


@query("l1_prioritized_risks", f"{PRIORITY} SELECT * FROM risks ORDER BY priority_score DESC, purl")
def l1(t: Lake):
    return prioritized(t).orderBy(F.desc("priority_score"), "purl")


# --- matching -------------------------------------------------------------------------------------------------

EXACT = """hits AS (SELECT e.id AS ext_id, i.id AS int_id, row_number() OVER (PARTITION BY e.id ORDER BY i.ord, i.id) AS rn
  FROM assets_ext e JOIN assets_int i ON (e.value <> '' AND e.value = i.value) OR (e.cert_hash <> '' AND e.cert_hash = i.cert_hash)),
 exact AS (SELECT ext_id, int_id, 1e0 AS score FROM hits WHERE rn = 1)"""

CHAR_GRAMS = r"""flatten(list_transform(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 0),
  lambda w: flatten(list_transform(range(2, least(4, length(w) + 2) + 1), lambda n: list_transform(range(1, length(w) + 2 - n + 2), lambda i: substr(concat(' ', w, ' '), i, n))))))"""


def tfidf_sql(corpus: str, asked: str, terms: str) -> str:
    """CTEs: `pair(q, c, score)` over two inputs (k, text), every shared term joined."""
    return f"""
 ct AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({terms}) AS term FROM ({corpus}) s) x GROUP BY k, term),
 qt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({terms}) AS term FROM ({asked}) s) x GROUP BY k, term),
 idf AS (SELECT term, ln((1e0 + (SELECT count(*) FROM ({corpus}) s)) / (1e0 + count(*))) + 1 AS idf FROM ct GROUP BY term),
 cn AS (SELECT k, sqrt(sum(tf * idf * tf * idf)) AS n FROM ct JOIN idf ON ct.term = idf.term GROUP BY k),
 qn AS (SELECT k, sqrt(sum(tf * idf * tf * idf)) AS n FROM qt JOIN idf ON qt.term = idf.term GROUP BY k),
 dots AS (SELECT qt.k AS q, ct.k AS c, sum(qt.tf * idf.idf * ct.tf * idf.idf) AS d FROM qt JOIN ct ON qt.term = ct.term JOIN idf ON idf.term = ct.term GROUP BY qt.k, ct.k),
 pair AS (SELECT q, c, round(d / (qn.n * cn.n), 9) AS score FROM dots JOIN qn ON qn.k = q JOIN cn ON cn.k = c)"""


FUZZY = f"""{tfidf_sql("SELECT id AS k, concat(value, ' ', name) AS text FROM assets_int", "SELECT id AS k, concat(value, ' ', name) AS text FROM assets_ext", CHAR_GRAMS)},
 best AS (SELECT q AS ext_id, c AS int_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, i.ord) AS rn
   FROM pair JOIN assets_int i ON i.id = c)"""

MATCHED = f"""WITH {EXACT}, {FUZZY},
 matches AS (SELECT ext_id, int_id, score, 'exact' AS method FROM exact UNION ALL
   SELECT ext_id, int_id, score, 'fuzzy' AS method FROM best WHERE rn = 1 AND score >= 0.85 AND ext_id NOT IN (SELECT ext_id FROM exact))"""


@query("j1_match_exact", f"WITH {EXACT} SELECT * FROM exact")
def j1(t: Lake):
    return match.match_exact(t.assets_ext, t.assets_int)


@query("j2_match_fuzzy", f"WITH {FUZZY} SELECT ext_id, int_id, {rounded('score')} AS score FROM best WHERE rn = 1 AND score >= 0.85")
def j2(t: Lake):
    return match.match_fuzzy(t.assets_ext, t.assets_int).withColumn("score", half_up(F.col("score"), 6))


@query("w4_best_candidate", f"WITH {FUZZY} SELECT ext_id, int_id, {rounded('score')} AS score FROM best WHERE rn = 1 AND score >= 0.5")
def w4(t: Lake):
    return match.match_fuzzy(t.assets_ext, t.assets_int, 0.5).withColumn("score", half_up(F.col("score"), 6))


@query("j3_fuse_assets", f"""{MATCHED}
SELECT coalesce(i.id, e.id) AS id, coalesce(i.type, e.type) AS type, e.id AS discovered_as, i.id IS NOT NULL AS matched,
  coalesce(i.owner, e.owner) AS owner, coalesce(i.zone, e.zone) AS zone, coalesce(i.cert_hash, e.cert_hash) AS cert_hash
FROM assets_ext e LEFT JOIN matches m ON m.ext_id = e.id LEFT JOIN assets_int i ON i.id = m.int_id""")
def j3(t: Lake):
    ext, internal = t.assets_ext, t.assets_int
    fused, _ = match.fuse_assets(ext, internal, match.match_assets(ext, internal), ["owner", "zone", "cert_hash"])
    return fused


@query("j3_resolves_to_edges", f"{MATCHED} SELECT ext_id AS src, int_id AS dst, 'resolves_to' AS type, {rounded('score')} AS confidence FROM matches")
def j3_edges(t: Lake):
    ext, internal = t.assets_ext, t.assets_int
    _, edges = match.fuse_assets(ext, internal, match.match_assets(ext, internal), [])
    return edges.withColumn("confidence", half_up(F.col("confidence"), 6))


NAMES = "SELECT DISTINCT title AS text FROM web_assets"


@query("j4_resolve_identities", f"""
WITH RECURSIVE {tfidf_sql(f"SELECT text AS k, text FROM ({NAMES}) n", f"SELECT text AS k, text FROM ({NAMES}) n", CHAR_GRAMS)},
 edge AS (SELECT q AS a, c AS b FROM pair WHERE score >= 0.85 AND q <> c UNION SELECT c, q FROM pair WHERE score >= 0.85 AND q <> c),
 reach AS (SELECT text AS name, text AS other FROM ({NAMES}) n UNION SELECT reach.name, edge.b FROM reach JOIN edge ON edge.a = reach.other)
SELECT name, min(other) AS resolved, min(other) <> name AS merged FROM reach GROUP BY name""")
def j4(t: Lake):
    return match.resolve_identities(t.web_assets, "title")


# --- feeds, reports, exposures ----------------------------------------------------------------------------------

@query("j5_match_vulns", """
WITH by_purl AS (SELECT purl, count(*) AS n, min(cve) AS cve FROM component_vulns GROUP BY purl),
 by_name AS (SELECT name, count(*) AS n, min(cve) AS cve FROM component_vulns GROUP BY name)
SELECT c.comp_id, CASE WHEN p.purl IS NOT NULL THEN 'purl' WHEN b.name IS NOT NULL THEN 'name' END AS matched_by,
  coalesce(p.n, b.n, 0) AS cve_count, coalesce(p.cve, b.cve) AS first_cve
FROM components c LEFT JOIN by_purl p ON p.purl = c.purl LEFT JOIN by_name b ON b.name = lower(c.name)""")
def j5(t: Lake):
    parts = t.components.select("comp_id", "purl", "name")
    return joins.match_vulns(parts, t.component_vulns).select("comp_id", "matched_by", "cve_count", "first_cve")


TARGETS = """SELECT r.hash, CASE c.kind WHEN 'PROMO' THEN concat('pkg:ml/', c.name, '-', c.comp_id, '@', c.version)
  WHEN 'LARGE' THEN concat('pkg:other/', c.comp_id) ELSE c.purl END AS target_purl FROM reports_bin r JOIN components c ON r.comp_id = c.comp_id"""


@query("j6_link_reports", f"""
SELECT CASE WHEN c.purl IS NOT NULL THEN concat('SoftwareComponent:', c.purl) ELSE concat('AIModel:', m.purl) END AS src,
  concat('BinaryAnalysisReport:report:binary/', t.hash) AS dst, 'HAS_ANALYSIS_REPORT' AS type
FROM ({TARGETS}) t LEFT JOIN (SELECT purl FROM components WHERE kind <> 'PROMO') c ON c.purl = t.target_purl
LEFT JOIN (SELECT concat('pkg:ml/', name, '-', comp_id, '@', version) AS purl FROM components WHERE kind = 'PROMO') m ON m.purl = t.target_purl
WHERE c.purl IS NOT NULL OR m.purl IS NOT NULL""")
def j6(t: Lake):
    parts = t.components.filter("kind <> 'PROMO'").select("purl", F.concat(F.lit("SoftwareComponent:"), "purl").alias("id"))
    model = F.concat(F.lit("pkg:ml/"), "name", F.lit("-"), "comp_id", F.lit("@"), "version")
    models = t.components.filter("kind = 'PROMO'").select(model.alias("purl"), F.concat(F.lit("AIModel:"), model).alias("id"))
    return binary.link_reports(t.sql(TARGETS), parts, models)


ASSETS_ALL = "SELECT id, type, value, name FROM assets_int UNION ALL SELECT id, type, value, name FROM assets_ext"
HOST_EDGES = """SELECT e.id AS src, f.first_id AS dst, 'resolves_to' AS type FROM assets_ext e
   JOIN (SELECT name, min(id) AS first_id FROM assets_int GROUP BY name) f ON f.name = e.name WHERE e.name LIKE '%.com'
 UNION ALL SELECT f.first_id AS src, e.id AS dst, 'hosts' AS type FROM assets_ext e
   JOIN (SELECT name, min(id) AS first_id FROM assets_int GROUP BY name) f ON f.name = e.name WHERE e.name LIKE '%.net'"""
SHADOW = f"""SELECT id, type, value, name FROM ({ASSETS_ALL}) a WHERE type IN ('ipv4-addr', 'domain-name')
  AND id NOT IN (SELECT CASE type WHEN 'resolves_to' THEN src ELSE dst END FROM ({HOST_EDGES}) h)"""


@query("j8_shadow_assets", f"{SHADOW} ORDER BY id")
def j8(t: Lake):
    return joins.shadow_assets(t.sql(ASSETS_ALL), t.sql(HOST_EDGES))


@query("j8_shadow_candidates", SHADOW)
def j8_all(t: Lake):
    return joins.shadow_candidates(t.sql(ASSETS_ALL), t.sql(HOST_EDGES))


@query("j9_shadow_exposures", f"""
SELECT id AS src, concat('exposure--shadow-it--', id) AS exposure_id, 'Unmanaged Shadow IT Asset' AS title, 'HIGH' AS severity,
  concat('Asset ', value, ' (', type, ') was discovered externally but is not present in internal telemetry systems (Splunk/Sentinel).') AS description,
  'has_exposure' AS type, 0.9e0 AS confidence FROM ({SHADOW}) s""")
def j9(t: Lake):
    exposures, edges = joins.shadow_exposures(joins.shadow_candidates(t.sql(ASSETS_ALL), t.sql(HOST_EDGES)))
    return edges.withColumnRenamed("dst", "exposure_id").join(exposures.withColumnRenamed("id", "exposure_id"), "exposure_id").select(
        "src", "exposure_id", "title", "severity", "description", "type", "confidence")


# --- policy joins ---------------------------------------------------------------------------------------------

@query("j10_match_playbooks", """
SELECT insight_id, pb_id FROM insights JOIN (VALUES
  ('pb_network_isolate_01', 'vulnerability', 'critical'), ('pb_patch_guidance_01', 'vulnerability', 'high'),
  ('pb_patch_guidance_01', 'vulnerability', 'critical'), ('pb_generic_investigate', NULL, NULL),
  ('pb_soar_escalation', 'complex_incident', 'critical'), ('pb_supply_chain_comm', 'supply_chain_breach', 'high'),
  ('pb_supply_chain_comm', 'supply_chain_breach', 'critical'), ('pb_supply_chain_controls', 'vendor_portal_vulnerability', 'high')
) p(pb_id, want_type, want_severity) ON (want_type IS NULL OR want_type = type) AND (want_severity IS NULL OR want_severity = severity)""")
def j10(t: Lake):
    return remediate.match_playbooks(t.insights).select("insight_id", "pb_id")


ACCESS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'analyst' WHEN 'view' THEN 'auditor' WHEN 'error' THEN 'scanner' WHEN 'purchase' THEN 'admin' ELSE 'visitor' END AS role1,
  CASE WHEN value > 20 THEN 'auditor' WHEN value > 5 THEN 'analyst' ELSE 'visitor' END AS role2,
  CASE CAST(JSON_TEXT(props, '$.k') AS INT) % 6 WHEN 0 THEN 'read:reports' WHEN 1 THEN 'write:exposures' WHEN 2 THEN 'delete:assets' WHEN 3 THEN 'generate:pdf' WHEN 4 THEN 'write:scans' ELSE 'execute:job' END AS action,
  concat('asset:', user_id) AS resource FROM events"""


@query("j11_decide_access", f"""
WITH pol(role, effect, pattern) AS (VALUES ('admin','allow','^.*$'), ('auditor','allow','^read:.*$'), ('auditor','allow','^generate:.*$'),
  ('auditor','deny','^write:.*$'), ('auditor','deny','^delete:.*$'), ('auditor','deny','^execute:.*$'),
  ('analyst','allow','^read:.*$'), ('analyst','allow','^write:exposures$'), ('analyst','allow','^write:remediations$'), ('analyst','deny','^delete:assets$'),
  ('scanner','allow','^read:assets$'), ('scanner','allow','^write:exposures$'), ('scanner','allow','^write:scans$')),
 req AS ({ACCESS})
SELECT event_id, action, coalesce(bool_or(effect = 'allow') AND NOT bool_or(effect = 'deny'), false) AS allowed
FROM req LEFT JOIN pol ON (pol.role = role1 OR pol.role = role2) AND regexp_matches(action, pattern) GROUP BY event_id, action""")
def j11(t: Lake):
    rows = t.sql(ACCESS)
    return rows.select("event_id", "action", govern.access_allowed(
        F.array("role1", "role2"), F.col("action"), F.col("resource")).alias("allowed"))


AUDITS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'inter_service_call' WHEN 'view' THEN 'agent_execution' WHEN 'error' THEN 'graph_mutation'
    WHEN 'purchase' THEN 'read_risk_intelligence' ELSE 'export' END AS action,
  CASE WHEN value < 1 THEN 'somebody' ELSE 'authority' END AS iss,
  CASE user_id % 4 WHEN 0 THEN 'semantic_fusion' WHEN 1 THEN 'governance' WHEN 2 THEN 'predictive_inference' ELSE 'data_ingestion' END AS sub,
  CASE WHEN value > 3 THEN 'agent' ELSE 'service' END AS role,
  CASE CAST(JSON_TEXT(props, '$.k') AS INT) % 4 WHEN 0 THEN 'discovery_agent' WHEN 1 THEN 'risk_evaluator_agent' WHEN 2 THEN 'remediation_agent' ELSE 'other_agent' END AS agent_type,
  CASE CAST(JSON_TEXT(props, '$.k') AS INT) % 5 WHEN 0 THEN 'data_ingestion' WHEN 1 THEN 'semantic_fusion' WHEN 2 THEN 'predictive_inference' WHEN 3 THEN 'agentic_execution' ELSE 'governance' END AS src_service,
  CASE user_id % 3 WHEN 0 THEN 'semantic_fusion' WHEN 1 THEN 'stateful_graph' ELSE 'predictive_inference' END AS dest_service,
  CASE user_id % 5 WHEN 0 THEN 'discover_vendor' WHEN 1 THEN 'read_sbom' WHEN 2 THEN 'predict_risk' WHEN 3 THEN 'trigger_remediation' ELSE 'query_subgraph' END AS agent_task,
  concat('asset-', CAST(JSON_TEXT(props, '$.k') AS INT) % 3) AS target_asset FROM events"""


@query("j12_decide_policy", f"""
WITH req AS ({AUDITS}),
 flows(s, d, why) AS (VALUES ('data_ingestion','semantic_fusion','Valid inter-service data flow.'), ('semantic_fusion','stateful_graph','Valid database write flow.'),
  ('predictive_inference','stateful_graph','Valid database read flow.'), ('agentic_execution','predictive_inference','Valid inference query flow.'),
  ('agentic_execution','semantic_fusion','Valid telemetry flow.')),
 tasks(a, t) AS (VALUES ('discovery_agent','discover_vendor'), ('discovery_agent','read_sbom'), ('risk_evaluator_agent','query_subgraph'), ('risk_evaluator_agent','predict_risk'),
  ('remediation_agent','trigger_remediation'), ('remediation_agent','verify_remediation')),
 names(a, short, title) AS (VALUES ('discovery_agent','discovery agent','Discovery Agent'), ('risk_evaluator_agent','risk evaluator','Risk Evaluator'), ('remediation_agent','remediation agent','Remediation Agent')),
 j AS (SELECT req.*, flows.why, tasks.t AS ok_task, names.short, names.title, action = 'agent_execution' AND target_asset NOT IN ('asset-0','asset-1') AS blocked FROM req
  LEFT JOIN flows ON flows.s = src_service AND flows.d = dest_service LEFT JOIN tasks ON tasks.a = agent_type AND tasks.t = agent_task LEFT JOIN names ON names.a = agent_type)
SELECT event_id, NOT blocked AND iss = 'authority' AND CASE action WHEN 'inter_service_call' THEN why IS NOT NULL OR src_service = 'governance'
   WHEN 'agent_execution' THEN role = 'agent' AND ok_task IS NOT NULL WHEN 'graph_mutation' THEN sub IN ('semantic_fusion','governance')
   WHEN 'read_risk_intelligence' THEN sub IN ('predictive_inference','agentic_execution','governance') ELSE false END AS allowed,
 CASE WHEN blocked THEN concat('Target asset ', target_asset, ' is not in the approved allow-list.') WHEN iss <> 'authority' THEN 'Invalid issuer claim.'
  WHEN action = 'inter_service_call' THEN coalesce(why, CASE WHEN src_service = 'governance' THEN 'Governance override.' ELSE concat('Unauthorized service-to-service flow: ', src_service, ' -> ', dest_service) END)
  WHEN action = 'agent_execution' THEN CASE WHEN role <> 'agent' THEN 'Caller role is not an agent.' WHEN ok_task IS NOT NULL THEN concat('Authorized task for ', short, '.')
     WHEN title IS NOT NULL THEN concat(title, ' unauthorized for task: ', agent_task) ELSE concat('Unknown agent type: ', agent_type) END
  WHEN action = 'graph_mutation' THEN CASE WHEN sub IN ('semantic_fusion','governance') THEN 'Service authorized to mutate graph state.' ELSE concat('Service ', sub, ' cannot write to graph.') END
  WHEN action = 'read_risk_intelligence' THEN CASE WHEN sub IN ('predictive_inference','agentic_execution','governance') THEN 'Service authorized to read risk intelligence.' ELSE concat('Service ', sub, ' cannot read risk intelligence.') END
  ELSE concat('Unknown action: ', action) END AS reason FROM j""")
def j12(t: Lake):
    return govern.decide_policy(t.sql(AUDITS), "authority", ("asset-0", "asset-1")).select("event_id", "allowed", "reason")


def control_rules():
    open_db = (F.col("type") == "DATABASE") & ~F.col("encrypted")
    return {("SOC2", "CC6.1"): (open_db, F.concat(F.lit("Asset "), "id", F.lit(" is not encrypted.")))}


DATABASES = "SELECT concat('asset--', comp_id) AS id, CASE WHEN kind IN ('LARGE','PROMO') THEN 'DATABASE' ELSE 'software' END AS type, name, has_provenance AS encrypted FROM components"
STATUS = f"""st AS (SELECT f AS framework, c AS control_id, CASE WHEN c = 'CC6.1' THEN (SELECT count(*) FROM ({DATABASES}) d WHERE type = 'DATABASE' AND NOT encrypted) ELSE 0 END AS violations
 FROM (VALUES ('SOC2','CC6.1'), ('SOC2','CC6.6'), ('SOC2','CC6.7'), ('ISO27001','A.9.1.1'), ('ISO27001','A.10.1.1'), ('GDPR','Article_32')) v(f, c))"""


@query("j13_evaluate_controls", f"""WITH {STATUS} SELECT framework, control_id, CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status, violations,
 CASE WHEN violations = 0 THEN 'All evaluated assets meet the requirement.' END AS evidence FROM st""")
def j13(t: Lake):
    return govern.evaluate_controls(t.sql(DATABASES), control_rules())


@query("j13_control_evidence", f"""SELECT 'SOC2' AS framework, 'CC6.1' AS control_id, concat('Asset ', id, ' is not encrypted.') AS evidence FROM ({DATABASES}) d WHERE type = 'DATABASE' AND NOT encrypted""")
def j13_evidence(t: Lake):
    return govern.control_evidence(t.sql(DATABASES), control_rules())


@query("a5_framework_status", f"""WITH {STATUS} SELECT framework, control_id, CASE WHEN bool_or(violations > 0) THEN 'FAIL' ELSE 'PASS' END AS status, CAST(sum(violations) AS BIGINT) AS violations
FROM st GROUP BY GROUPING SETS ((framework, control_id), (framework))""")
def a5(t: Lake):
    return govern.framework_status(govern.evaluate_controls(t.sql(DATABASES), control_rules()))


# --- time, ids, ranges ------------------------------------------------------------------------------------------

OUTCOME = "86400000000 * 2"


@query("j14_track_outcomes", f"""
SELECT 'prediction' AS side, asset_id AS asset, ts_us AS t, EXISTS (SELECT 1 FROM telemetry b WHERE b.asset_id = p.asset_id AND b.cve_criticality >= 60 AND b.ts_us BETWEEN p.ts_us AND p.ts_us + {OUTCOME}) AS hit
FROM telemetry p WHERE connection_count >= 90 UNION ALL
SELECT 'breach' AS side, asset_id AS asset, ts_us AS t, EXISTS (SELECT 1 FROM telemetry b WHERE b.asset_id = p.asset_id AND b.connection_count >= 90 AND p.ts_us BETWEEN b.ts_us AND b.ts_us + {OUTCOME}) AS hit
FROM telemetry p WHERE cve_criticality >= 60""")
def j14(t: Lake):
    rows = t.telemetry
    said = rows.select("asset_id", "ts_us", (F.col("connection_count") / 100.0).alias("prob"))
    breaches = rows.filter(F.col("cve_criticality") >= 60)
    flagged, caught = evaluate.track_outcomes(said, breaches, "asset_id", "ts_us", "prob", threshold=0.9, days=2)
    return flagged.select(F.lit("prediction").alias("side"), "asset", "t", F.col("true_positive").alias("hit")).unionByName(
        caught.select(F.lit("breach").alias("side"), "asset", "t", F.col("announced").alias("hit")))


@query("j15_detection_details", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.09)""")
def j15(t: Lake):
    ids = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.details_of(ids, t.orders, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("j16_audit_requirements", f"""
SELECT comp_id, p.package, version, fixed_in, list_transform(string_split(version, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 0)) <
   list_transform(string_split(fixed_in, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 0)) AS below_fix
FROM ({PARSED}) p JOIN (VALUES ('pyjwt','2.8.0'), ('urllib3','1.26.17'), ('requests','2.31.0'), ('hvac','1.1.0')) a(package, fixed_in) ON a.package = p.package""")
def j16(t: Lake):
    advisories = t.spark.createDataFrame(list(textscan.ADVISORIES.items()), "package string, affected string")
    found = textscan.audit_requirements(textscan.parse_requirements(t.sql(REQUIREMENTS), "line"), F.broadcast(advisories))
    return found.select("comp_id", "package", "version", "fixed_in", "below_fix")


RATINGS = """SELECT event_id, user_id, EPOCH_US(ts) AS ts_us, CASE WHEN event_type IN ('click','view','purchase') THEN CAST(JSON_TEXT(props, '$.k') AS INT) END AS rating FROM events"""


@query("j17_ratings_asof", f"""
WITH r AS (SELECT *, last_value(rating IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM ({RATINGS}) x)
SELECT event_id, coalesce(l, 70) AS score, CASE WHEN rating IS NOT NULL THEN 'provider' WHEN l IS NOT NULL THEN 'cache' ELSE 'fallback' END AS origin,
 CASE WHEN l IS NULL THEN 'Medium' WHEN l > 80 THEN 'Low' WHEN l > 60 THEN 'Medium' ELSE 'High' END AS risk_tier FROM r""")
def j17(t: Lake):
    return joins.ratings_asof(t.sql(RATINGS), "user_id", ["ts_us", "event_id"], "rating").select("event_id", "score", "origin", "risk_tier")


KNOWN = "SELECT vendor_id AS id FROM vendors WHERE security_score >= 20"


@query("j18_edge_endpoints", f"""
SELECT src, dst, CASE WHEN src NOT IN (SELECT id FROM ({KNOWN}) k) THEN 'source missing' WHEN dst NOT IN (SELECT id FROM ({KNOWN}) k) THEN 'target missing' END AS error FROM supplies""")
def j18(t: Lake):
    good, bad = joins.insertable_edges(t.supplies, t.sql(KNOWN))
    return good.select("src", "dst", F.lit(None).cast("string").alias("error")).unionByName(bad.select("src", "dst", "error"))


TRIPLETS = """n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS size FROM embeddings),
 nxt AS (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS other FROM (SELECT DISTINCT label FROM embeddings) d),
 trip AS (SELECT a.vec_id AS anchor, p.vec_id AS positive, g.vec_id AS negative, a.label FROM n a JOIN nxt ON nxt.label = a.label
  JOIN n p ON p.label = a.label AND p.i = (a.i + 1) % a.size JOIN n g ON g.label = nxt.other AND g.i = a.i % g.size WHERE a.size > 1 AND nxt.other <> a.label)"""


@query("j19_mine_triplets", f"WITH {TRIPLETS} SELECT * FROM trip")
def j19(t: Lake):
    return joins.mine_triplets(t.embeddings, "vec_id", "label")


REGISTRY = "SELECT host, count(*) AS pages, min(scheme) AS scheme FROM web_assets GROUP BY host"


@query("j20_enrich_by_domain", f"""
SELECT w.page_id, w.host, r.pages, r.scheme AS first_scheme FROM web_assets w LEFT JOIN ({REGISTRY} HAVING count(*) > 3) r ON r.host = w.host""")
def j20(t: Lake):
    registry = t.sql(REGISTRY + " HAVING count(*) > 3").withColumnRenamed("scheme", "first_scheme")
    return joins.enrich_by_domain(t.web_assets.select("page_id", "host"), registry, "host")


ADDRESSES = "SELECT event_id, concat('10.0.', JSON_TEXT(props, '$.k'), '.', user_id % 250) AS ip FROM events"
RANGES = "SELECT n_name AS network, 167772160 + n_nationkey * 1024 AS lo, 167772160 + n_nationkey * 1024 + 767 AS hi FROM nation"


@query("j20_enrich_by_range", f"""
SELECT event_id, ip, network FROM ({ADDRESSES}) a LEFT JOIN ({RANGES}) r
 ON 167772160 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) BETWEEN lo AND hi""")
def j20_range(t: Lake):
    return joins.enrich_by_range(t.sql(ADDRESSES), t.sql(RANGES), "ip")


# --- requirement mapping --------------------------------------------------------------------------------------

def _controls_sql() -> str:
    rows = ", ".join(f"({i}, '{d}')" for i, (_, _, d) in enumerate(govern.CONTROLS))
    return f"SELECT position AS k, description AS text FROM (VALUES {rows}) v(position, description)"


# The English stop words that occur in the control texts; any other word of a document is outside the vocabulary.
CONTROL_STOP_WORDS = "'and', 'have', 'been', 'to', 'of', 'the', 'against', 'from', 'its', 'be', 'on', 'for'"
WORD_TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN (" + CONTROL_STOP_WORDS + "))"


def requirement_sql(k: int) -> str:
    return f"""WITH {tfidf_sql(_controls_sql(), "SELECT doc_id AS k, text FROM requirements_txt", WORD_TERMS)},
 top AS (SELECT q AS doc_id, c, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM pair WHERE score > 0)
SELECT doc_id, c AS control_no, {rounded('score')} AS score, rank FROM top WHERE rank <= {k}"""


def mapped(t: Lake, k: int):
    out = match.map_requirements(t.requirements_txt, "doc_id", "text", govern.controls(t.spark).select("position", "description"), k)
    return out.select("doc_id", F.col("position").alias("control_no"), half_up(F.col("score"), 6).alias("score"), "rank")


@query("m7_requirement_scores", requirement_sql(6))
def m7(t: Lake):
    return mapped(t, 6)


@query("l5_top_controls", requirement_sql(2))
def l5(t: Lake):
    return mapped(t, 2)


ASSET_TEXT = "SELECT id AS k, concat(value, ' ', name) AS text FROM assets_int"


@query("m6_char_tfidf", f"""WITH {tfidf_sql(ASSET_TEXT, ASSET_TEXT, CHAR_GRAMS)}
SELECT ct.k AS id, ct.term, {rounded('tf * idf / n')} AS weight FROM ct JOIN idf ON idf.term = ct.term JOIN cn ON cn.k = ct.k""")
def m6(t: Lake):
    rows = t.sql("SELECT id, concat(value, ' ', name) AS text, 1 AS copies FROM assets_int")
    counts = term_counts(rows, "id", "text", char_wb())
    vecs = vectors(counts, fit_idf(counts, rows, "id", "copies"), "id")
    return vecs.select("id", F.inline("vec")).select("id", "term", half_up(F.col("w"), 6).alias("weight"))
