"""Registered queries: projections, filters, scans of text (section 2.2 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.functions.numeric import dot, half_up
from riskfabric.operators import aggregates, binary, evaluate, govern, ledger, normalize, quality, remediate, risk, textscan
from riskfabric.plans.registry import query, rounded


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("p1_normalize_signals", """
SELECT signal_id, source,
  CASE WHEN source IN ('github','pypi','npm') THEN 'software' WHEN source = 'network_scanner' THEN 'ipv4-addr' ELSE 'unknown' END AS asset_type,
  CASE source WHEN 'github' THEN repo WHEN 'pypi' THEN package WHEN 'npm' THEN package WHEN 'network_scanner' THEN ip_address ELSE 'unknown' END AS value,
  CASE source WHEN 'github' THEN 'commit_scan' WHEN 'pypi' THEN 'vulnerability' WHEN 'npm' THEN 'sbom' WHEN 'network_scanner' THEN 'port_scan' ELSE 'generic_signal' END AS event_type,
  CASE WHEN source IN ('pypi','npm') THEN lower(coalesce(severity,'unknown')) ELSE 'info' END AS norm_severity
FROM signals""")
def p1(t: Lake):
    return normalize.normalize_signals(t.signals).select(
        "signal_id", "source", "asset_type", "value", "event_type", "norm_severity")


HOSTS = """SELECT c_custkey, c_name AS host, CASE WHEN c_acctbal > 0 THEN concat('10.1.', c_nationkey, '.', c_custkey) END AS ip,
 c_mktsegment AS os, md5(c_name) AS mac FROM customer"""


@query("p2_normalize_hosts", f"""
SELECT concat('asset--splunk--', host) AS id, 'host' AS type, host AS value, concat('Splunk Host: ', host) AS name,
  os, mac, ip AS ip_address, CASE WHEN ip IS NULL THEN 3 ELSE 4 END AS n_props FROM ({HOSTS}) h""")
def p2(t: Lake):
    out = normalize.normalize_hosts(t.sql(HOSTS))
    p = F.col("properties")
    return out.select("id", "type", "value", "name", p["os"].alias("os"), p["mac"].alias("mac"),
                      p["ip_address"].alias("ip_address"), F.size(p).alias("n_props"))


@query("p3_normalize_resources", """
SELECT concat('asset--sentinel--', replace(url, '/', '-')) AS id, 'cloud-resource' AS type, url AS value,
  concat('Azure Resource: ', title) AS name, scheme AS azure_type, host AS location FROM web_assets""")
def p3(t: Lake):
    rows = t.web_assets.select(F.col("url").alias("resource_id"), F.col("title").alias("name"),
                               F.col("scheme").alias("azure_type"), F.col("host").alias("location"))
    out = normalize.normalize_resources(rows)
    return out.select("id", "type", "value", "name", F.col("properties")["azure_type"].alias("azure_type"),
                      F.col("properties")["location"].alias("location"))


USERS = """SELECT concat('CN=', c_name, ',OU=', c_mktsegment) AS dn, c_name AS cn, lower(c_name) AS username,
 concat(lower(c_name), '@corp') AS upn, c_mktsegment AS grp, CAST(512 + c_custkey % 4 AS INT) AS flags FROM customer"""


@query("p4_normalize_users", f"""
SELECT dn, cn, username, upn, grp AS groups, (flags & 2) <> 0 AS is_disabled FROM ({USERS}) u""")
def p4(t: Lake):
    rows = t.sql(USERS).withColumn("groups", F.array("grp"))
    return normalize.normalize_users(rows).withColumn("groups", F.concat_ws("|", "groups"))


MESSAGES = """SELECT event_id, concat('devices/', user_id) AS topic, CAST(event_id % 3 AS INT) AS qos,
 CASE WHEN event_type = 'error' THEN concat('not json ', props) ELSE props END AS payload FROM events"""


@query("p5_parse_device_messages", f"""
SELECT event_id, topic, qos, CAST(json_extract_string(payload, '$.k') AS INT) AS k
FROM ({MESSAGES}) m WHERE json_valid(payload)""")
def p5(t: Lake):
    out = normalize.parse_device_messages(t.sql(MESSAGES))
    return out.select("event_id", "topic", "qos", F.try_variant_get("decoded", "$.k", "int").alias("k"))


@query("p6_explode_registers", """
SELECT vec_id AS host, CAST(100 + p - 1 AS INT) AS address, CAST(floor(embedding[p] * 1000) AS BIGINT) AS register_value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) e""")
def p6(t: Lake):
    blocks = t.embeddings.select(
        F.col("vec_id").alias("host"), F.lit(100).alias("start_address"),
        F.transform("embedding", lambda v: F.floor(v * F.lit(1000.0).cast("float"))).alias("data"))
    return normalize.explode_registers(blocks).select("host", "address", "register_value")


@query("p10_sanitize_text", """
SELECT doc_id, substr(coalesce(text, ''), 1, 1024) AS clean, length(text) > 1024 AS truncated FROM documents""")
def p10(t: Lake):
    return t.documents.select("doc_id", normalize.sanitize(F.col("text")).alias("clean"),
                              (F.length("text") > 1024).alias("truncated"))


@query("p13_package_urls", """
SELECT comp_id, CASE WHEN brand IN ('Brand#1','Brand#2','Brand#3') THEN purl ELSE concat('pkg:generic/', name, '@', version) END AS component_purl,
  concat('pkg:ml/', name, '@', version) AS model_purl, concat('pkg:dataset/', name) AS dataset_purl FROM components""")
def p13(t: Lake):
    given = F.when(F.col("brand").isin("Brand#1", "Brand#2", "Brand#3"), F.col("purl"))
    name, version = F.col("name"), F.col("version")
    return t.components.select(
        "comp_id", normalize.purl(name, version, given).alias("component_purl"),
        normalize.purl(name, version, kind="ml").alias("model_purl"),
        normalize.purl(name, version, kind="dataset").alias("dataset_purl"))


@query("p14_entity_name", """
SELECT signal_id, coalesce(nullif(repo,''), nullif(package,''), nullif(actor,''), 'Unknown_Entity') AS entity FROM signals""")
def p14(t: Lake):
    return t.signals.select("signal_id", normalize.entity_name().alias("entity"))


@query("p15_rating_tier", """
SELECT vendor_id, security_score, CASE WHEN security_score > 80 THEN 'Low' WHEN security_score > 60 THEN 'Medium' ELSE 'High' END AS risk_tier FROM vendors""")
def p15(t: Lake):
    return t.vendors.select("vendor_id", "security_score", normalize.rating_tier(F.col("security_score")).alias("risk_tier"))


PENALTY_SQL = """CASE WHEN type = 'vulnerability' THEN CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 ELSE 0 END
 WHEN type = 'report' THEN 15 WHEN type = 'sbom' AND dependencies_count > 30 THEN 5 ELSE 0 END"""


@query("p16_adjusted_score", f"""
SELECT signal_id, greatest(0, 70 - {PENALTY_SQL}) AS default_score,
  greatest(0, (CASE WHEN cve_count IS NULL THEN 20 ELSE 70 END) - {PENALTY_SQL}) AS rated_score FROM signals""")
def p16(t: Lake):
    rating = F.when(F.col("cve_count").isNull(), 20)
    return t.signals.select("signal_id", normalize.adjusted_score().alias("default_score"),
                            normalize.adjusted_score(rating).alias("rated_score"))


CONTACTS = """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE concat(c_name, '@mail.test') END AS author,
 CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS device_id, concat('10.0.0.', c_nationkey) AS ip_address FROM customer"""


@query("p17_minimize_pii", f"""
SELECT c_custkey, CASE WHEN contains(author, '@') THEN 'REDACTED_PII' ELSE author END AS author,
  CASE WHEN length(device_id) > 0 THEN sha256(concat(device_id, 'pepper')) ELSE device_id END AS device_id,
  sha256(concat(ip_address, 'pepper')) AS ip_address FROM ({CONTACTS}) c""")
def p17(t: Lake):
    return normalize.minimize(t.sql(CONTACTS), "pepper", hashed=("device_id", "ip_address"), authors=("author",))


@query("p18_redact_params", """
SELECT event_id, event_type AS method, '***REDACTED***' AS api_key FROM events""")
def p18(t: Lake):
    params = F.create_map(F.lit("method"), F.col("event_type"), F.lit("api_key"), F.col("props"))
    out = t.events.select("event_id", normalize.redact_params(params).alias("params"))
    return out.select("event_id", F.col("params")["method"].alias("method"), F.col("params")["api_key"].alias("api_key"))


@query("p19_extract_cves", r"""
SELECT doc_id, cve FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'CVE-\d{4}-\d{4,7}'))) AS cve FROM reports_txt) x""")
def p19(t: Lake):
    return t.reports_txt.select("doc_id", F.explode(textscan.extract_cves(F.col("text"))).alias("cve"))


@query("p20_extract_actors", """
SELECT doc_id, actor FROM reports_txt
JOIN (SELECT unnest(['APT29','Lazarus','Equation Group','Sandworm']) AS actor) g ON contains(lower(text), lower(actor))""")
def p20(t: Lake):
    return t.reports_txt.select("doc_id", F.explode(textscan.extract_actors(F.col("text"))).alias("actor"))


@query("p21_exploit_severity", """
SELECT comp_id, exploit_score, CASE WHEN exploit_score > 0.85 THEN 'CRITICAL' WHEN exploit_score > 0.7 THEN 'HIGH'
  WHEN exploit_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM components""")
def p21(t: Lake):
    return t.components.select("comp_id", "exploit_score", risk.exploit_severity(F.col("exploit_score")).alias("severity"))


BAD_SQL = " OR ".join(f"contains(lower(trim(hash)), '{x}')" for x in binary.BAD_TOKENS)


@query("p22_hash_reputation", f"""
SELECT comp_id, hash, CASE WHEN {BAD_SQL} THEN 'MALICIOUS' ELSE 'CLEAN' END AS status,
  CASE WHEN {BAD_SQL} THEN 'Win32.Malware.SimulatedBackdoor' END AS threat_name,
  CASE WHEN {BAD_SQL} THEN 0 ELSE 100 END AS trust_factor,
  CASE WHEN {BAD_SQL} THEN 42 ELSE 0 END AS scanner_detections FROM reports_bin""")
def p22(t: Lake):
    return binary.hash_reputation(t.reports_bin).drop("total_scanners")


SCAN_DEFAULTS_SQL = """coalesce(entropy, 4.5) AS entropy, coalesce(num_imports, 20) AS num_imports,
 coalesce(num_sections, 4) AS num_sections, coalesce(packer_detected, false) AS packer_detected,
 coalesce(signature_valid, true) AS signature_valid"""


@query("p23_binary_features", f"""
SELECT l_orderkey, l_linenumber, l_suppkey, comp_id, {rounded('coalesce(entropy, 4.5)')} AS entropy, coalesce(num_imports, 20) AS num_imports,
  coalesce(num_sections, 4) AS num_sections, coalesce(packer_detected, false) AS packer_detected,
  coalesce(signature_valid, true) AS signature_valid FROM binary_scans""")
def p23(t: Lake):
    out = binary.with_feature_defaults(t.binary_scans)
    return out.withColumn("entropy", half_up(F.col("entropy"), 6)).drop("hash")


@query("p24_fused_verdict", f"""
SELECT l_orderkey, l_linenumber, hash, ({BAD_SQL}) OR (coalesce(entropy, 4.5) > 7 AND coalesce(packer_detected, false)) AS is_malicious
FROM binary_scans""")
def p24(t: Lake):
    rows = binary.with_feature_defaults(binary.hash_reputation(t.binary_scans))
    model = (F.col("entropy") > 7) & F.col("packer_detected")
    return rows.select("l_orderkey", "l_linenumber", "hash", binary.fused_verdict(F.col("status"), model).alias("is_malicious"))


@query("p27_risk_level", """
SELECT vendor_id, CASE WHEN security_score >= 75 THEN 'CRITICAL' WHEN security_score >= 50 THEN 'HIGH'
  WHEN security_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM vendors""")
def p27(t: Lake):
    return t.vendors.select("vendor_id", risk.risk_level(F.col("security_score")).alias("level"))


HEUR = "greatest(5, least(95, (100 - CAST(security_score AS DOUBLE)) * 0.4e0 + cves * 15e0 + tier * 4e0))"
CASC = "least(0.99e0, 0.05e0 + least(tier, 8) * 0.05e0 + least(cves, 4) * 0.15e0)"


@query("p28_heuristic_risk", f"""
SELECT vendor_id, {rounded(HEUR)} AS risk, {rounded(CASC)} AS cascade,
  {rounded(f'greatest(0, {HEUR} - 15)')} AS risk_low, {rounded(f'least(100, {HEUR} + 15)')} AS risk_high FROM vendors""")
def p28(t: Lake):
    r = risk.heuristic_risk(F.col("security_score"), F.col("cves"), F.col("tier"))
    low, high = risk.risk_interval(r)
    return t.vendors.select(
        "vendor_id", half_up(r, 6).alias("risk"),
        half_up(risk.cascade_probability(F.col("cves"), F.col("tier")), 6).alias("cascade"),
        half_up(low, 6).alias("risk_low"), half_up(high, 6).alias("risk_high"))


@query("p29_contributing_factors", f"""
SELECT vendor_id, CASE WHEN f = '' THEN 'No critical risk indicators detected. Baseline ecosystem healthy.' ELSE f END AS factors FROM (
  SELECT vendor_id, concat_ws(' | ',
    CASE WHEN security_score < 70 THEN printf('Low average ecosystem security rating: %.1f', CAST(security_score AS DOUBLE)) END,
    CASE WHEN cves > 0 THEN concat(cves, ' active vulnerabilities detected in downstream packages') END,
    CASE WHEN tier > 2 THEN concat('Deep multi-tier dependency chain detected (', tier, ' vendors deep)') END,
    CASE WHEN {CASC} > 0.4 THEN concat('High vulnerability propagation probability (', printf('%.1f', {CASC} * 100), '%) due to shared libraries') END) AS f
  FROM vendors) x""")
def p29(t: Lake):
    cves, vendors = F.col("cves"), F.col("tier")
    factors = risk.contributing_factors(F.col("security_score").cast("double"), cves, vendors, risk.cascade_probability(cves, vendors))
    return t.vendors.select("vendor_id", F.concat_ws(" | ", factors).alias("factors"))


@query("p30_attribute_linear", f"""
SELECT vendor_id, {rounded('(100 - CAST(security_score AS DOUBLE)) * 0.4e0', 2)} AS rating_risk,
  {rounded('cves * 15e0', 2)} AS cve_risk, {rounded('tier * 4e0', 2)} AS depth_risk FROM vendors""")
def p30(t: Lake):
    parts = risk.attribute_linear(F.col("security_score"), F.col("cves"), F.col("tier"))
    names = ("rating_risk", "cve_risk", "depth_risk")
    return t.vendors.select("vendor_id", *[c.alias(n) for n, c in zip(names, parts.values())])


DRAWN = "CAST(CAST(concat('0x', substr(sha256(concat({0})), 1, 12)) AS BIGINT) AS DOUBLE) / 281474976710656e0"


@query("p31_dp_release", f"""WITH u AS (SELECT *, {DRAWN.format("'release/first/', vendor_id, '/', CAST(floor(security_score * 1e6 + 0.5) AS BIGINT)")} - 0.5e0 AS u FROM vendors)
SELECT vendor_id, name, tier, cves, {rounded('greatest(0e0, least(100e0, security_score - 100e0 * sign(u) * ln(1 - abs(u) * 2)))')} AS dp_security_score FROM u""")
def p31(t: Lake):
    out = risk.dp_release(t.vendors, "vendor_id", "security_score", "release", "first", epsilon=1.0)
    return out.withColumn("dp_security_score", half_up(F.col("dp_security_score"), 6))


@query("p32_payload_guard", """
SELECT doc_id, octet_length(encode(text)) AS payload_bytes, octet_length(encode(text)) <= 10485760 AS accepted FROM documents""")
def p32(t: Lake):
    return t.documents.select("doc_id", F.octet_length("text").alias("payload_bytes"),
                              quality.payload_fits(F.col("text")).alias("accepted"))


@query("p33_range_checks", """
SELECT vendor_id, CASE WHEN NOT (score BETWEEN 0 AND 100) THEN 'score out of range'
  WHEN NOT (confidence BETWEEN 0 AND 1) THEN 'confidence out of range'
  WHEN NOT starts_with(payload, '{') THEN 'payload is not an object' END AS error
FROM (SELECT s_suppkey AS vendor_id, s_acctbal / 80 AS score, s_acctbal / 5000 AS confidence,
  CASE WHEN s_nationkey < 5 THEN concat('[', s_suppkey, ']') ELSE concat('{"v":', s_suppkey, '}') END AS payload FROM supplier) x""")
def p33(t: Lake):
    rows = t.supplier.select(
        F.col("s_suppkey").alias("vendor_id"), (F.col("s_acctbal") / 80).alias("score"),
        (F.col("s_acctbal") / 5000).alias("confidence"),
        F.when(F.col("s_nationkey") < 5, F.concat(F.lit("["), "s_suppkey", F.lit("]")))
        .otherwise(F.concat(F.lit('{"v":'), "s_suppkey", F.lit("}"))).alias("payload"))
    checked = quality.with_errors(rows, [
        ("score out of range", quality.in_range(F.col("score"), 0, 100)),
        ("confidence out of range", quality.in_range(F.col("confidence"), 0, 1)),
        ("payload is not an object", quality.is_json_object(F.col("payload")))])
    return checked.select("vendor_id", "error")


@query("p34_source_allow_list", """
SELECT signal_id, source, source IN ('github','npm','threat_feed') AS allowed FROM signals""")
def p34(t: Lake):
    ok = quality.allowed_source(F.col("source"), ("github", "npm", "threat_feed"))
    return t.signals.select("signal_id", "source", ok.alias("allowed"))


@query("p35_outbound_policy", """
SELECT insight_id, action, lower(severity) <> 'critical' AND action = 'block_vendor' AS permitted
FROM (SELECT insight_id, upper(severity) AS severity, CASE WHEN type = 'complex_incident' THEN 'open_ticket' ELSE 'block_vendor' END AS action FROM insights) x""")
def p35(t: Lake):
    rows = t.insights.select("insight_id", F.upper("severity").alias("severity"),
                             F.when(F.col("type") == "complex_incident", "open_ticket").otherwise("block_vendor").alias("action"))
    return rows.select("insight_id", "action", govern.outbound_permitted(F.col("action"), F.col("severity")).alias("permitted"))


WINDOWS = """SELECT event_id, ts, CASE event_type WHEN 'click' THEN '09:00:00' WHEN 'view' THEN '22:00:00' WHEN 'error' THEN '08:30:00' END AS lo,
 CASE event_type WHEN 'click' THEN '17:00:00' WHEN 'view' THEN '06:00:00' WHEN 'signup' THEN '12:00:00' END AS hi FROM events"""


@query("p36_time_window", f"""
SELECT event_id, CASE WHEN lo <= hi THEN now >= lo AND now <= hi ELSE now >= lo OR now <= hi END AS inside FROM (
 SELECT event_id, strftime(ts, '%H:%M:%S') AS now, coalesce(lo, '00:00:00') AS lo, coalesce(hi, '23:59:59') AS hi FROM ({WINDOWS}) w) x""")
def p36(t: Lake):
    return t.sql(WINDOWS).select("event_id", normalize.in_time_window(F.col("ts"), F.col("lo"), F.col("hi")).alias("inside"))


@query("p37_backoff", """
SELECT event_id, least(pow(2e0, event_id % 9), 60e0) AS connector_delay, pow(2e0, event_id % 9) AS scheduler_delay FROM events""")
def p37(t: Lake):
    attempt = F.col("event_id") % 9
    return t.events.select("event_id", normalize.backoff(attempt).alias("connector_delay"),
                           normalize.backoff(attempt, cap=None).alias("scheduler_delay"))


def _line_scan(pattern_no: int) -> str:
    return (f"SELECT doc_id, line_no, {pattern_no} AS pattern_no, substr(trim(line), 1, 60) AS excerpt FROM lines "
            f"WHERE regexp_matches(line, {sql_str(textscan.SECRET_PATTERNS[pattern_no - 1])})")


@query("p38_scan_secrets", f"""
WITH lines AS (SELECT * FROM (SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS INT) AS line_no
   FROM (SELECT doc_id, string_split_regex(text, {sql_str(textscan.LINE_BREAK)}) AS ls FROM documents) a) b
   WHERE NOT (contains(lower(line),'example') OR contains(lower(line),'localhost') OR contains(lower(line),'test')))
{_line_scan(1)} UNION ALL {_line_scan(2)}""")
def p38(t: Lake):
    return textscan.scan_secrets(t.documents, "text", ["doc_id"])


PAGE_PATTERNS = {**textscan.UNSAFE_PATTERNS, "tracker": r"\btrack\s*\("}


def _unsafe(kind: str, pattern: str) -> str:
    lit = sql_str(pattern)
    return f"""SELECT page_id, '{kind}' AS kind, 1 + length(pre) - length(replace(pre, chr(10), '')) AS line_no FROM (
      SELECT page_id, concat(array_to_string(list_concat(flatten(list_transform(range(1, i), lambda x: [ps[x], ms[x]])), [ps[i]]), '')) AS pre FROM (
        SELECT page_id, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT page_id, string_split_regex(html, {lit}) AS ps, regexp_extract_all(html, {lit}) AS ms FROM pages) a) b) c"""


@query("p39_scan_unsafe", " UNION ALL ".join(_unsafe(k, p) for k, p in PAGE_PATTERNS.items()))
def p39(t: Lake):
    return textscan.scan_unsafe(t.pages, "html", ["page_id"], PAGE_PATTERNS)


REQUIREMENTS = """SELECT comp_id, CASE WHEN brand = 'Brand#5' THEN concat('# ', name) WHEN brand = 'Brand#6' THEN '  '
 WHEN brand = 'Brand#7' THEN name
 ELSE concat(CASE kind WHEN 'SMALL' THEN 'PyJWT' WHEN 'LARGE' THEN 'urllib3 ' WHEN 'PROMO' THEN 'requests' WHEN 'MEDIUM' THEN 'hvac' ELSE 'numpy' END,
   CASE WHEN has_provenance THEN '==' ELSE '>=' END, ' ', version) END AS line FROM components"""

PARSED = f"""SELECT comp_id, lower(trim(parts[1])) AS package, trim(parts[2]) AS version FROM (
  SELECT comp_id, string_split_regex(trim(line), '==|>=|<=|<|>') AS parts FROM ({REQUIREMENTS}) r
  WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) p WHERE len(parts) >= 2"""


@query("p40_parse_requirements", PARSED)
def p40(t: Lake):
    return textscan.parse_requirements(t.sql(REQUIREMENTS), "line").select("comp_id", "package", "version")


MESSAGES_TXT = """SELECT conv_id, turn, concat(text, CASE role WHEN 'assistant' THEN ' Resolved SBOM. Risk Level: LOW'
 WHEN 'user' THEN ' mitigation plan' ELSE ' Compliance verified' END) AS text, CAST(length(text) % 100 AS DOUBLE) / 100 AS cascade FROM conversations"""


@query("p41_tag_messages", f"""
SELECT conv_id, turn, concat_ws('|',
  CASE WHEN contains(text,'Resolved') OR contains(text,'SBOM') THEN 'Discovery step completed.' END,
  CASE WHEN contains(text,'Risk Level') THEN 'Risk assessment performed.' END,
  CASE WHEN contains(text,'mitigation plan') THEN 'Remediation triggered.' END,
  CASE WHEN contains(text,'Compliance verified') THEN 'Compliance check passed.' END) AS tags, cascade > 0.8 AS needs_approval
FROM ({MESSAGES_TXT}) m""")
def p41(t: Lake):
    return t.sql(MESSAGES_TXT).select(
        "conv_id", "turn", F.concat_ws("|", textscan.tag_messages(F.col("text"))).alias("tags"),
        textscan.needs_approval(F.col("cascade")).alias("needs_approval"))


@query("p42_plan_actions", """
WITH mailed AS (SELECT *, CASE WHEN severity = 'high' THEN concat('desk@', vendor_id, '.example') END AS vendor_email FROM insights),
 picked AS (SELECT m.*, p.pb_id, p.name FROM mailed m JOIN (VALUES
  ('pb_network_isolate_01', '', 'vulnerability', ['critical']), ('pb_patch_guidance_01', 'Guided Patching Workflow', 'vulnerability', ['high', 'critical']),
  ('pb_generic_investigate', 'Generic Investigation', NULL, NULL), ('pb_soar_escalation', '', 'complex_incident', ['critical']),
  ('pb_supply_chain_comm', '', 'supply_chain_breach', ['high', 'critical']), ('pb_supply_chain_controls', '', 'vendor_portal_vulnerability', ['high'])
 ) p(pb_id, name, want_type, want_severity) ON (want_type IS NULL OR want_type = type) AND (want_severity IS NULL OR list_contains(want_severity, severity))),
 aimed AS (SELECT *, CASE pb_id WHEN 'pb_network_isolate_01' THEN coalesce(asset_id, 'Unknown') WHEN 'pb_soar_escalation' THEN 'Cortex XSOAR'
   WHEN 'pb_supply_chain_comm' THEN coalesce(vendor_email, concat('security@', coalesce(vendor_id, 'Unknown Vendor'), '.com'))
   WHEN 'pb_supply_chain_controls' THEN coalesce(target_endpoint, 'Unknown Endpoint') ELSE 'Human Operator' END AS target FROM picked)
SELECT insight_id, pb_id, target, CASE pb_id WHEN 'pb_network_isolate_01' THEN 'Network Segmentation' WHEN 'pb_soar_escalation' THEN 'SOAR Escalation'
   WHEN 'pb_supply_chain_comm' THEN 'Vendor Communication' WHEN 'pb_supply_chain_controls' THEN 'Apply Compensating Control' ELSE 'Guided Workflow' END AS action,
  CASE pb_id WHEN 'pb_network_isolate_01' THEN concat('Would isolate asset ', target, ' with level ''strict''. Connections to/from this asset would be dropped.')
   WHEN 'pb_soar_escalation' THEN concat('Would create an incident ticket in Cortex XSOAR for ''', coalesce(title, 'Unknown Incident'), ''' and trigger downstream SOAR playbooks.')
   WHEN 'pb_supply_chain_comm' THEN concat('Would email the ''breach_notification'' template to ', target, ' representing vendor ''', coalesce(vendor_id, 'Unknown Vendor'), '''.')
   WHEN 'pb_supply_chain_controls' THEN concat('Would apply ''waf_strict_filtering'' temporarily blocking/filtering traffic to ', target, '.')
   ELSE concat('Would initiate a step-by-step guided workflow requiring human interaction for playbook: ', name, '.') END AS impact,
  CASE pb_id WHEN 'pb_network_isolate_01' THEN '{"isolation_level": "strict"}' WHEN 'pb_soar_escalation' THEN '{"escalation_level": "critical", "platform": "Cortex XSOAR"}'
   WHEN 'pb_supply_chain_comm' THEN '{"template_type": "breach_notification"}' WHEN 'pb_supply_chain_controls' THEN '{"control_type": "waf_strict_filtering"}' ELSE '{}' END AS params,
  CASE pb_id WHEN 'pb_network_isolate_01' THEN asset_id IS NOT NULL WHEN 'pb_supply_chain_comm' THEN vendor_id IS NOT NULL
   WHEN 'pb_supply_chain_controls' THEN target_endpoint IS NOT NULL ELSE true END AS success
FROM aimed""")
def p42(t: Lake):
    mailed = t.insights.withColumn("vendor_email", F.when(F.col("severity") == "high", F.concat(F.lit("desk@"), "vendor_id", F.lit(".example"))))
    planned = remediate.plan_actions(remediate.match_playbooks(mailed))
    return planned.select("insight_id", "pb_id", "action", "target", "impact", "params", "success")


@query("p43_list_components", """
SELECT comp_id, name, kind FROM components WHERE lower(kind) = lower('Economy') AND exploit_score > 0.85""")
def p43(t: Lake):
    found = remediate.listing(t.components, text={"kind": "Economy"})
    return found.filter(risk.exploit_severity(F.col("exploit_score")) == "CRITICAL").select("comp_id", "name", "kind")


@query("p44_adversarial_perturbation", f"""
SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i:
   floor(greatest(0e0, least(1e0, CAST(embedding[i] AS DOUBLE) + 0.05e0 * sign(0.5e0 - CAST(embedding[i] AS DOUBLE)))) * 1e6 + 0.5))) AS checksum
FROM embeddings""")
def p44(t: Lake):
    x = F.transform("embedding", lambda v: v.cast("double"))
    gradient = F.transform(x, lambda v: F.lit(0.5) - v)
    moved = evaluate.perturb(x, gradient, 0.05)
    return t.embeddings.select(
        "vec_id", F.aggregate(moved, F.lit(0.0), lambda a, v: a + F.floor(v * 1e6 + 0.5)).alias("checksum"))


@query("p45_linear_score", f"""
SELECT vec_id, {rounded('list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * (CAST(i AS DOUBLE) / 64)))')} AS score
FROM embeddings""")
def p45(t: Lake):
    weights = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i.cast("double") / 64)
    return t.embeddings.select("vec_id", half_up(dot(F.col("embedding"), weights), 6).alias("score"))


SHARE = "CAST(concat('0x', substr(sha256(concat_ws('/', 11, vendor_id, {0})), 1, 12)) AS BIGINT) % 1000003"


@query("p46_split_shares", f"""WITH d AS (SELECT vendor_id, security_score, {SHARE.format(0)} AS a, {SHARE.format(1)} AS b FROM vendors)
SELECT vendor_id, 0 AS party, a AS share FROM d UNION ALL SELECT vendor_id, 1, b FROM d
UNION ALL SELECT vendor_id, 2, ((security_score - a - b) % 1000003 + 1000003) % 1000003 FROM d""")
def p46(t: Lake):
    return aggregates.split_shares(t.vendors, "vendor_id", "security_score", parties=3, seed=11)


@query("p47_block_hash", """
SELECT event_id, sha256(body) AS hash FROM (
  SELECT event_id, concat('{"event": {"amount": ', CAST(floor(value * 100) AS BIGINT), ', "type": "', event_type, '"}, "index": ', event_id, ', "prev_hash": "', repeat('0', 64), '"}') AS body FROM events) x""")
def p47(t: Lake):
    event = F.concat(F.lit('{"amount": '), F.floor(F.col("value") * 100), F.lit(', "type": "'), "event_type", F.lit('"}'))
    rows = t.events.select("event_id", event.alias("event"))
    return rows.select("event_id", ledger.block_hash(
        F.col("event"), F.col("event_id"), F.lit(ledger.GENESIS_PREV)).alias("hash"))


TRIGGER_SQL = """SELECT insight_id, vendor_id, CASE WHEN lower(severity) <> 'critical' THEN 'block_vendor' ELSE 'escalate' END AS action,
  CASE WHEN lower(severity) <> 'critical' THEN concat('Automated block via riskfabric: ', title) END AS reason
FROM insights WHERE type = 'critical_vendor_vulnerability' AND vendor_id IS NOT NULL"""


@query("p48_trigger_rule", TRIGGER_SQL)
def p48(t: Lake):
    return govern.trigger_actions(t.insights).select("insight_id", "vendor_id", "action", "reason")
