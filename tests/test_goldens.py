"""Known inputs with known answers, operator by operator."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from riskfabric.operators import (
    aggregates, binary, bom, evaluate, govern, graph, joins, ledger, match, models, normalize, quality, remediate, risk,
    textscan, windows,
)
from riskfabric.sources import landing, schemas


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- signals ------------------------------------------------------------------------------------------------------

def signals(spark, *rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(
        F.from_json("value", schemas.SIGNAL).alias("s")).select("s.*")


def test_signal_shapes(spark):
    df = signals(spark, {"source": "github", "repo": "a/b"}, {"source": "npm", "package": "react", "severity": "HIGH"},
                 {"source": "pypi", "package": "flask"}, {"source": "network_scanner", "ip_address": "10.0.0.1"}, {"source": "x"})
    got = [tuple(r) for r in normalize.normalize_signals(df).select("asset_type", "value", "event_type", "norm_severity").collect()]
    assert got == [
        ("software", "a/b", "commit_scan", "info"), ("software", "react", "sbom", "high"),
        ("software", "flask", "vulnerability", "unknown"), ("ipv4-addr", "10.0.0.1", "port_scan", "info"),
        ("unknown", "unknown", "generic_signal", "info")]


def test_adjusted_scores(spark):
    df = signals(spark, {"type": "vulnerability", "severity": "CRITICAL"}, {"type": "vulnerability", "severity": "HIGH"},
                 {"type": "vulnerability"}, {"type": "report"}, {"type": "sbom", "dependencies_count": 31},
                 {"type": "sbom", "dependencies_count": 30}, {"type": "sbom"})
    got = [r[0] for r in df.select(normalize.adjusted_score()).collect()]
    assert got == [40, 50, 70, 55, 65, 70, 70]
    assert one(signals(spark, {"type": "report"}).select(normalize.adjusted_score(F.lit(10))))[0] == 0


def test_entity_name_skips_empty(spark):
    df = signals(spark, {"repo": "", "package": "p"}, {"actor": "a"}, {})
    assert [r[0] for r in df.select(normalize.entity_name()).collect()] == ["p", "a", "Unknown_Entity"]


def test_minimize(spark):
    import hashlib

    df = spark.createDataFrame([("dev@x.io", "mac-1"), ("Dev", ""), (None, None)], "author string, device string")
    rows = normalize.minimize(df, "salt", hashed=("device",), authors=("author",)).collect()
    assert rows[0].author == "REDACTED_PII"
    assert rows[0].device == hashlib.sha256(b"mac-1salt").hexdigest()
    assert tuple(rows[1]) == ("Dev", "")
    assert tuple(rows[2]) == (None, None)


def test_minimize_components_and_params(spark):
    df = spark.sql("SELECT array(named_struct('name','a','author','a@b.c'), named_struct('name','b','author','team')) AS comps, "
                   "map('api_key','s3cret','page','1') AS params")
    row = one(df.select(normalize.minimize_components(F.col("comps")).alias("c"), normalize.redact_params(F.col("params")).alias("p")))
    assert [c.author for c in row.c] == ["REDACTED_PII", "team"]
    assert row.p == {"api_key": "***REDACTED***", "page": "1"}


def test_time_window_across_midnight(spark):
    df = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2024-01-01 23:30:00', '22:00:00', '06:00:00'), (timestamp_ntz'2024-01-01 12:00:00', '22:00:00', '06:00:00'),
      (timestamp_ntz'2024-01-01 12:00:00', '09:00:00', NULL), (timestamp_ntz'2024-01-01 08:00:00', '09:00:00', '17:00:00') AS t(ts, lo, hi)""")
    got = [r[0] for r in df.select(normalize.in_time_window(F.col("ts"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [True, False, True, False]


def test_users_devices_registers(spark):
    users = spark.createDataFrame([("d", "J", "jdoe", "j@x", ["g"], 512), ("d", "K", "k", None, None, 514)],
                                  "dn string, cn string, username string, upn string, groups array<string>, flags int")
    assert [r.is_disabled for r in normalize.normalize_users(users).collect()] == [False, True]
    blocks = spark.createDataFrame([("h", 100, list(range(10)))], "host string, start_address int, data array<int>")
    rows = normalize.explode_registers(blocks).orderBy("address").collect()
    assert len(rows) == 10 and rows[0].address == 100 and rows[9].register_value == 9
    msgs = spark.createDataFrame([("t/1", 0, '{"speed": 65}'), ("t/2", 1, "oops")], "topic string, qos int, payload string")
    row = one(normalize.parse_device_messages(msgs).select("topic", F.try_variant_get("decoded", "$.speed", "int").alias("v")))
    assert tuple(row) == ("t/1", 65)


def test_host_asset_has_address_only_when_present(spark):
    df = spark.createDataFrame([("h1", "10.0.0.1", "linux", "m"), ("h2", None, "linux", "m")], "host string, ip string, os string, mac string")
    a, b = normalize.normalize_hosts(df).orderBy("id").collect()
    assert a.id == "asset--splunk--h1" and a.properties["ip_address"] == "10.0.0.1"
    assert "ip_address" not in b.properties


# --- documents ----------------------------------------------------------------------------------------------------

def payloads(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, payload string")


def test_sbom_with_broken_components(spark):
    df = payloads(spark, {"bomFormat": "CycloneDX", "components": "corrupted", "metadata": {"component": {"name": "Corrupted Component"}}},
                  {"bomFormat": "CycloneDX", "components": ["junk", 7, {"name": "good-dep"}]})
    parsed = bom.parse_sbom(df).orderBy("id").collect()
    assert [(p.format, p.vendor) for p in parsed] == [("CycloneDX", "Corrupted Component"), ("CycloneDX", "Unknown Vendor")]
    row = one(bom.sbom_components(df).select("id", "name", "version"))
    assert tuple(row) == (1, "good-dep", "0.0.0")


def test_spdx_purl_and_unknown_format(spark):
    df = payloads(spark, {"spdxVersion": "SPDX-2.2", "packages": [{"name": "zlib", "versionInfo": "1.2", "externalRefs": [
        {"referenceType": "cpe", "referenceLocator": "c"}, {"referenceType": "purl", "referenceLocator": "pkg:generic/zlib@1.2"}]}]},
        {"vendor": "V"}, "[1]")
    row = one(bom.sbom_components(df).select("name", "version", "purl"))
    assert tuple(row) == ("zlib", "1.2", "pkg:generic/zlib@1.2")
    kinds = [(r.format, r.error is not None) for r in bom.parse_sbom(df).orderBy("id").collect()]
    assert kinds == [("SPDX", False), ("Unknown", False), (None, True)]


def test_provenance(spark):
    df = spark.createDataFrame([(None,), ('{"signature": "bad-signature"}',),
                                ('{"predicateType": "https://slsa.dev/provenance", "predicate": {"builder": {"id": "b1"}}}',)], "provenance string")
    a, b, c = bom.validate_provenance(df).collect()
    assert (a.has_provenance, a.error) == (False, None)
    assert b.error is not None and not b.has_provenance
    assert (c.has_provenance, c.slsa_level, c.builder_id) == (True, 3, "b1")


def test_mbom(spark):
    full = {"model_name": "Llama-3-8B-Instruct", "version": "1", "architecture": {"name": "decoder", "parameters_count": 8, "layers_count": 32},
            "datasets": [{"name": "RedPajama-V2"}], "dependencies": [{"package_name": "torch", "version": "2.1"}], "signature_verified": True}
    broken = {"model_name": "TestModel", "architecture": "nope", "datasets": [None, {"name": "good-dataset"}]}
    models_, datasets, deps = bom.parse_mbom(payloads(spark, full, broken), "id")
    a, b = models_.orderBy("id").collect()
    assert (a.model_name, a.layers_count, a.signature_verified) == ("Llama-3-8B-Instruct", 32, True)
    assert (b.model_name, b.architecture, b.framework) == ("TestModel", "unknown_arch", "PyTorch")
    assert sorted((r.id, r.name) for r in datasets.collect()) == [(0, "RedPajama-V2"), (1, "good-dataset")]
    assert [(r.id, r.package_name) for r in deps.collect()] == [(0, "torch")]


def test_multisignal_sections(spark):
    df = payloads(spark, {"sbom": {"a": 1}, "rating": {"security_score": 85}, "telemetry": {"device_id": "d"}}, {"sbom": {}},
                  {"rating": {"security_score": 185}})
    rows = landing.land_multisignal(df).orderBy("id").collect()
    assert rows[0].signals == ["sbom", "rating", "telemetry"] and rows[0].error is None
    assert rows[1].signals == [] and rows[1].error
    assert rows[2].error == "rating.security_score out of range"


def test_quarantine_row(spark):
    df = spark.createDataFrame([("ok", '{"a":1}'), ("bad", "x")], "k string, payload string")
    good, bad = quality.split_valid(df, [("Test error validation failure", quality.is_json_object(F.col("payload")))],
                                    F.lit("test_source"), F.col("payload"))
    assert [r.k for r in good.collect()] == ["ok"]
    row = one(bad)
    assert (row.source, row.error, row.payload) == ("test_source", "Test error validation failure", "x")


# --- text -----------------------------------------------------------------------------------------------------------

def test_text_extraction(spark):
    text = "apt29 used CVE-2024-1234 and CVE-2024-1234, CVE-2023-123 is too short; SANDWORM too"
    row = one(spark.createDataFrame([(text,)], "t string").select(
        textscan.extract_cves(F.col("t")).alias("c"), textscan.extract_actors(F.col("t")).alias("a")))
    assert row.c == ["CVE-2024-1234"]
    assert row.a == ["APT29", "Sandworm"]


def test_secret_and_unsafe_scans(spark):
    text = "x = 1\npassword = 'longsecret1'\ntoken = 'longsecret2' # example\n  eval\n (x)\nexec(y); exec(z)"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    hits = textscan.scan_secrets(df, "text", ["id"]).collect()
    assert [(h.line_no, h.pattern_no, h.excerpt) for h in hits] == [(2, 1, "password = 'longsecret1'")]
    found = sorted((r.kind, r.line_no) for r in textscan.scan_unsafe(df, "text", ["id"]).collect())
    assert found == [("eval_usage", 4), ("exec_usage", 6), ("exec_usage", 6)]


def test_requirements(spark):
    df = spark.createDataFrame([("# c",), ("",), ("PyJWT==2.4.0",), ("hvac >= 1.1.0",), ("plain",)], "line string")
    parsed = textscan.parse_requirements(df, "line")
    assert [(r.package, r.version) for r in parsed.collect()] == [("pyjwt", "2.4.0"), ("hvac", "1.1.0")]
    adv = spark.createDataFrame(list(textscan.ADVISORIES.items()), "package string, affected string")
    assert {r.package: r.below_fix for r in textscan.audit_requirements(parsed, adv).collect()} == {"pyjwt": True, "hvac": False}


# --- risk -----------------------------------------------------------------------------------------------------------

def test_linear_attribution_and_prediction(spark):
    df = spark.createDataFrame([(80.0, 2, 3)], "avg_rating double, active_cves int, vendor_count int")
    parts = risk.attribute_linear(F.col("avg_rating"), F.col("active_cves"), F.col("vendor_count"))
    row = one(df.select(*[c.alias(k) for k, c in parts.items()]))
    assert tuple(row) == (8.0, 30.0, 12.0)
    out = one(risk.predict_vendors(df))
    assert out.risk == 50.0 and out.risk_level == "HIGH" and abs(out.cascade - 0.5) < 1e-12
    assert (out.risk_low, out.risk_high, out.nth_party_affected) == (35.0, 65.0, 2)


def test_priorities(spark):
    parts = spark.createDataFrame([(1, "crypto-helper", 0.9, True), (2, "SmartPredictor", 0.0, False), (3, "plain", 0.0, True)],
                                  "comp_id int, name string, exploit_score double, has_provenance boolean")
    reports = spark.createDataFrame([(1, True), (1, False)], "comp_id int, is_malicious boolean")
    runs = spark.createDataFrame([(7, 1), (8, 1)], "device_id int, comp_id int")
    rows = {r.name: r for r in risk.prioritize(parts, reports, runs).collect()}
    assert rows["crypto-helper"].priority_score == 100.0 and rows["crypto-helper"].malicious_detected
    assert rows["crypto-helper"].devices_affected == 2 and rows["crypto-helper"].report_count == 2
    assert rows["SmartPredictor"].priority_score == 20.0
    assert rows["plain"].actions == ["LOW: Keep dependency version updated."]


def test_dp_release_hides_the_score(spark):
    df = spark.range(2000).withColumn("security_score", F.lit(50.0))
    out = risk.dp_release(df, "id", "security_score", "key", "first")
    assert "security_score" not in out.columns
    low, high, mean = out.agg(F.min("dp_security_score"), F.max("dp_security_score"), F.avg("dp_security_score")).first()
    assert 0.0 <= low and high <= 100.0 and 40 < mean < 60


def test_releases_do_not_reveal_a_change(spark):
    """Two releases of an id differ by the draw, not by the change of the score; a retry does not differ."""
    def released(score, release):
        df = spark.range(2000).withColumn("security_score", F.lit(score))
        return {r.id: r.dp_security_score for r in risk.dp_release(df, "id", "security_score", "key", release, epsilon=20.0).collect()}

    first, again, changed, other = released(50.0, "a"), released(50.0, "a"), released(53.0, "a"), released(50.0, "b")
    assert first == again
    for later in (changed, other):
        gaps = {round(later[i] - first[i], 6) for i in first}
        assert len(gaps) > 1900


def test_dependency_purls_are_whole(spark):
    long = "pkg:generic/" + "x" * 2000
    doc = json.dumps({"model_name": "m", "architecture": {}, "dependencies": [{"package_name": "a", "purl": long + "1"}, {"package_name": "a", "purl": long + "2"}]})
    _, _, deps = bom.parse_mbom(spark.createDataFrame([(1, doc)], "id int, payload string"), "id")
    assert sorted(r.purl for r in deps.collect()) == [long + "1", long + "2"]


def test_reputation_and_malware(spark):
    df = spark.createDataFrame([("clean_hash_123", 4.2, 15, 4, False, True), ("compromised_hash_999", 7.9, 90, 8, True, False)],
                               "hash string, entropy double, num_imports int, num_sections int, packer_detected boolean, signature_valid boolean")
    rated = binary.hash_reputation(df)
    rows = models.predict_malware(models.train_malware(spark), rated).orderBy("hash").collect()
    assert (rows[0].status, rows[0].trust_factor) == ("CLEAN", 100) and rows[0].malware_probability < 0.5
    assert (rows[1].status, rows[1].trust_factor) == ("MALICIOUS", 0) and rows[1].malware_probability > 0.5


# --- matching ---------------------------------------------------------------------------------------------------------

ASSET = "id string, ord int, type string, value string, name string, cert_hash string"


def test_exact_matches(spark):
    internal = spark.createDataFrame([("splunk--1", 1, "host", "internal-db-01", "DB Server", "abc"),
                                      ("sentinel--2", 2, "host", "10.0.0.5", "vm", None)], ASSET)
    ext = spark.createDataFrame([("shodan--123", 1, "ip", "1.1.1.1", "x", "abc"), ("censys--456", 2, "ip", "10.0.0.5", "y", None),
                                 ("shodan--999", 3, "ip", "9.9.9.9", "z", None), ("empty", 4, "ip", "", "", "")], ASSET)
    got = {r.ext_id: r.int_id for r in match.match_exact(ext, internal).collect()}
    assert got == {"shodan--123": "splunk--1", "censys--456": "sentinel--2"}
    fused, edges = match.fuse_assets(ext, internal, match.match_exact(ext, internal), ["cert_hash", "name"])
    rows = {r.discovered_as: r for r in fused.collect()}
    assert rows["shodan--123"].id == "splunk--1" and rows["shodan--123"].name == "DB Server"
    assert rows["shodan--999"].id == "shodan--999" and not rows["shodan--999"].matched
    assert edges.count() == 2


def brute_char_scores(queries, corpus):
    """Independent char n-gram TF-IDF cosine on plain Python numbers."""
    import math
    from collections import Counter

    def grams(text):
        out = Counter()
        for word in text.lower().split():
            w = f" {word} "
            for n in range(2, min(4, len(w)) + 1):
                for i in range(len(w) - n + 1):
                    out[w[i:i + n]] += 1
        return out

    docs = [grams(c) for c in corpus]
    df = Counter(g for d in docs for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(counts):
        v = {g: c * idf[g] for g, c in counts.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    vecs = [unit(d) for d in docs]
    return [[sum(x * v.get(g, 0.0) for g, x in unit(grams(q)).items()) for v in vecs] for q in queries]


def test_linker_scores(spark):
    corpus = [("internal-db-01.corp.local", "Production DB Server"), ("10.0.0.5", "Auth Service Gateway")]
    asked = [("internal-db-01", "db server"), ("random-host", "unknown")]
    scores = brute_char_scores([" ".join(a) for a in asked], [" ".join(c) for c in corpus])
    assert round(scores[0][0], 3) == 0.702 and round(max(scores[1]), 3) == 0.088
    internal = spark.createDataFrame([(f"i{i}", i, "host", *c, None) for i, c in enumerate(corpus)], ASSET)
    ext = spark.createDataFrame([(f"e{i}", i, "ip", *a, None) for i, a in enumerate(asked)], ASSET)
    assert match.match_fuzzy(ext, internal, 0.85).count() == 0
    row = one(match.match_fuzzy(ext, internal, 0.7))
    assert (row.ext_id, row.int_id, round(row.score, 3)) == ("e0", "i0", 0.702)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_fuzzy_equals_brute_force(spark, threshold):
    import random

    rng = random.Random(5)
    stems = ["alpha", "beta", "gamma", "delta", "server", "db", "web", "prod", "host", "vm"]
    texts = [" ".join(rng.choices(stems, k=rng.randint(1, 4))) + f" {rng.randint(1, 30)}" for _ in range(120)]
    corpus, asked = texts[:70] + texts[:20], texts[70:] + texts[60:75]
    internal = spark.createDataFrame([(f"i{i}", i, "host", t, "n", None) for i, t in enumerate(corpus)], ASSET)
    ext = spark.createDataFrame([(f"e{i}", i, "ip", t, "n", None) for i, t in enumerate(asked)], ASSET)
    scores = brute_char_scores([f"{t} n" for t in asked], [f"{t} n" for t in corpus])
    want = {}
    for i, row in enumerate(scores):
        best = max(range(len(row)), key=lambda j: (round(row[j], 9), -j))
        if round(row[best], 9) >= threshold:
            want[f"e{i}"] = (f"i{best}", round(row[best], 6))
    for fan in (4096, 3):
        got = {r.ext_id: (r.int_id, round(r.score, 6)) for r in match.match_fuzzy(ext, internal, threshold, fan).collect()}
        assert got == want


def test_identities_merge(spark):
    df = spark.createDataFrame([("acme corporation limited",), ("acme corporation limitedd",), ("acme corporation limiteddd",), ("globex",)], "name string")
    rows = {r.name: r for r in match.resolve_identities(df, threshold=0.8).collect()}
    assert rows["acme corporation limiteddd"].resolved == "acme corporation limited"
    assert rows["globex"].resolved == "globex" and not rows["globex"].merged


def test_requirement_maps_to_encryption(spark):
    df = spark.createDataFrame([(1, "We need to encrypt our databases"), (2, "nothing in common")], "id int, text string")
    rows = match.map_requirements(df, "id", "text", govern.controls(spark).select("position", "description"), 2).orderBy("rank").collect()
    assert rows and {r.id for r in rows} == {1} and rows[0].score > 0
    assert govern.CONTROLS[rows[0].position][1] == "A.10.1.1"


# --- governance, ledger, remediation ------------------------------------------------------------------------------------

def test_access_decisions(spark):
    df = spark.createDataFrame([(["admin"], "delete:assets", "asset:1"), (["auditor"], "read:reports", "report:1"), (["auditor"], "write:assets", "asset:1"),
                                (["analyst"], "write:exposures", "e:1"), (["analyst"], "delete:assets", "asset:1"), (["ghost"], "read:x", "y"),
                                (["admin", "auditor"], "write:x", "y")], "roles array<string>, action string, resource string")
    got = [r[0] for r in df.select(govern.access_allowed(F.col("roles"), F.col("action"), F.col("resource"))).collect()]
    assert got == [True, True, False, True, False, False, False]


def test_control_status(spark):
    assets = spark.createDataFrame([("d1", "DATABASE", False), ("d2", "DATABASE", True), ("s", "software", False)], "id string, type string, encrypted boolean")
    rules = {("SOC2", "CC6.1"): ((F.col("type") == "DATABASE") & ~F.col("encrypted"), F.concat(F.lit("Asset "), "id", F.lit(" is not encrypted.")))}
    rows = {r.control_id: r for r in govern.evaluate_controls(assets, rules).collect()}
    assert rows["CC6.1"].status == "FAIL" and rows["CC6.1"].violations == 1
    assert rows["CC6.6"].status == "PASS" and rows["CC6.6"].evidence == govern.MET
    levels = {(r.framework, r.control_id): r.status for r in govern.framework_status(govern.evaluate_controls(assets, rules)).collect()}
    assert levels[("SOC2", None)] == "FAIL" and levels[("GDPR", None)] == "PASS"
    assert [r.evidence for r in govern.control_evidence(assets, rules).collect()] == ["Asset d1 is not encrypted."]


def test_insight_to_outcome(spark):
    columns = "insight_id int, ts_us long, type string, severity string, asset_id string, vendor_id string, target_endpoint string, title string"
    isolate = ("vulnerability", "critical", "a1", None, None, None)
    cases = [(1, "supply_chain_breach", "high", None, "v", None, None), (2, "supply_chain_breach", "high", None, None, None, None), (3, "vulnerability", "high", "a", None, None, None),
             (4, "other", "low", None, None, None, None), (14, None, None, None, None, None, None)] + [(i, *isolate) for i in range(5, 13)] + [(13, "vulnerability", "critical", None, None, None, None)]
    insights = spark.createDataFrame([(c[0], 100, *c[1:]) for c in cases], columns)
    soc, legal, cfo = "SOC_ANALYST", "LEGAL", "CFO"
    votes = [(6, soc, "approve", 110), (6, cfo, "approve", 111), (6, soc, "comment", 90), (7, soc, "approve", 110), (7, soc, "approve", 105), (7, legal, "approve", 120),
             (8, soc, "approve", 110), (8, cfo, "reject", 115), (8, legal, "approve", 120), (9, soc, "approve", 110), (9, legal, "approve", 112), (9, cfo, "reject", 113),
             (10, cfo, "approve", 101), (11, cfo, "reject", 101), (12, soc, "approve", 110), (12, legal, "approve", 111), (12, legal, "reject", 111),
             (13, legal, "approve", 130), (13, soc, "approve", 140), (99, soc, "approve", 1), (None, soc, "approve", 1), (3, soc, "reject", 1)]
    ballots = spark.createDataFrame(votes, "insight_id int, role string, decision string, at long")
    ruled = tuple(pb for pb in remediate.PLAYBOOKS if pb.match_rules)
    values = spark.createDataFrame([("vulnerability_critical", "pb_network_isolate_01", 0.9, 4)], "state string, pb_id string, q double, updates long")
    done = remediate.process_insights(insights, values, ballots, ruled, explore=0.0)
    got = {r.insight_id: r for r in done.collect()}
    assert len(got) == len(cases) and {i: r.status for i, r in got.items()} == {
        1: "AUTOMATED_SUCCESS", 2: "AUTOMATED_FAILED", 3: "WORKFLOW_STARTED", 4: "NO_PLAYBOOK_FOUND", 14: "NO_PLAYBOOK_FOUND", 5: "AWAITING_APPROVAL",
        6: "AWAITING_FURTHER_APPROVAL", 7: "AUTOMATED_SUCCESS", 8: "REJECTED", 9: "AUTOMATED_SUCCESS", 10: "AWAITING_APPROVAL", 11: "REJECTED", 12: "REJECTED", 13: "AUTOMATED_FAILED"}
    assert got[6].remaining == [legal] and got[5].remaining == [legal, soc] and got[7].remaining == []
    assert {i: (r.done_at, r.reward) for i, r in got.items() if r.reward is not None} == {1: (100, 1), 2: (100, 0), 7: (120, 1), 9: (112, 1), 13: (140, 0)}
    learned = {(r.state, r.pb_id): (r.q, r.updates) for r in remediate.learn_outcomes(values, done).collect()}
    q = 0.9
    for reward in (1, 1, 0):
        q += 0.2 * (reward - q)
    assert learned[("vulnerability_critical", "pb_network_isolate_01")] == (pytest.approx(q), 7)
    assert learned[("supply_chain_breach_high", "pb_supply_chain_comm")] == (pytest.approx(0.8 * (0.8 * 0.5 + 0.2)), 2) and len(learned) == 2
    assert remediate.process_insights(insights.limit(0), values, ballots.limit(0), ruled, explore=0.0).count() == 0


def test_reports_link_to_the_least_id(spark):
    reports = spark.createDataFrame([("r1", "pkg:a"), ("r2", "pkg:m"), ("r3", "pkg:none"), ("r4", None)], "hash string, target_purl string")
    components = spark.createDataFrame([("c2", "pkg:a"), ("c1", "pkg:a"), ("c0", None)], "id string, purl string")
    models = spark.createDataFrame([("m9", "pkg:m"), ("m1", "pkg:m"), ("m0", "pkg:a")], "id string, purl string")
    linked = binary.link_reports(reports, components, models)
    assert sorted(r.src for r in linked.collect()) == ["c1", "m1"]


def test_device_ports(spark):
    rows = [(1, 10, "network_scan", "e", None, None, [], "1.2.3.4", ["CVE-2024-1001"], 5.0, [443, 22]), (2, 20, "network_scan", "e", None, None, [], "1.2.3.4", None, 5.0, None),
            (3, 15, "network_scan", "e", None, None, [], "1.2.3.5", None, 5.0, [80]), (4, 16, "commit", "e", None, None, [], "1.2.3.5", None, 5.0, [81])]
    df = spark.createDataFrame(rows, "signal_id int, ts_us long, type string, entity string, package string, version string, actors array<string>, ip_address string, cves array<string>, score double, open_ports array<int>")
    nodes, _ = windows.signals_to_graph(df)
    seen = nodes.withColumn("seen", F.col("ts_us"))
    got = {r.id: r for r in windows.upsert(seen.limit(0), seen, ["id"], ["ts_us", "signal_id"], "seen").collect()}
    assert (got["Device:1.2.3.4"].open_ports, got["Device:1.2.3.4"].cves) == ([], []) and got["Device:1.2.3.5"].open_ports == [80]
    assert got["Identity:e"].open_ports is None
    plain, _ = windows.signals_to_graph(df.drop("open_ports"))
    assert plain.filter("label = 'Device'").first().open_ports == []


@pytest.mark.parametrize("round_rows", [4, 1024])
def test_ledger_detects_every_change(spark, round_rows):
    import hashlib

    df = spark.createDataFrame([(k, i, json.dumps({"n": i}, sort_keys=True)) for k, n in (("c", 10), ("d", 3)) for i in range(n)], "chain string, t int, event string")
    chain = ledger.build_chain(df, "chain", ["t"], "event", round_rows=round_rows)
    rows = chain.filter("chain = 'c'").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(11)) and rows[0].event == ledger.GENESIS_EVENT
    before = "0" * 64
    for r in rows:
        body = json.dumps({"event": json.loads(r.event), "index": r["index"], "prev_hash": before}, sort_keys=True)
        assert r.prev_hash == before and r.hash == hashlib.sha256(body.encode()).hexdigest()
        before = r.hash
    verdict = lambda blocks: {r.chain: (r.valid, r.first_bad) for r in ledger.verify_chain(blocks, ["chain"]).collect()}
    assert verdict(chain) == {"c": (True, None), "d": (True, None)}
    mine = F.col("chain") == "c"
    at = F.col("index")
    edit = lambda i: F.when(mine & (at == i), F.lit("{}")).otherwise(F.col("event"))
    for i in (0, 1, 5, 10):
        assert verdict(chain.withColumn("event", edit(i))) == {"c": (False, i), "d": (True, None)}
    assert verdict(chain.filter(~(mine & at.between(4, 7)))) == {"c": (False, 8), "d": (True, None)}
    swapped = F.when(mine & (at == 3), 4).when(mine & (at == 4), 3).otherwise(at).cast("long")
    assert verdict(chain.withColumn("index", swapped))["c"] == (False, 3)


def test_playbooks(spark):
    df = spark.createDataFrame([(1, "vulnerability", "high"), (2, "vulnerability", "critical"), (3, "other", "low")], "insight_id int, type string, severity string")
    got = {}
    for r in remediate.match_playbooks(df).collect():
        got.setdefault(r.insight_id, []).append(r.pb_id)
    assert got[1] == ["pb_patch_guidance_01", "pb_generic_investigate"]
    assert got[2] == ["pb_network_isolate_01", "pb_patch_guidance_01", "pb_generic_investigate"]
    assert got[3] == ["pb_generic_investigate"]
    values = spark.createDataFrame([("vulnerability_high", "pb_generic_investigate", 0.9)], "state string, pb_id string, q double")
    picked = {r.insight_id: r.pb_id for r in remediate.pick_playbooks(df, values, explore=0.0).collect()}
    assert picked == {1: "pb_generic_investigate", 2: "pb_network_isolate_01", 3: "pb_generic_investigate"}
    explored = remediate.pick_playbooks(spark.range(4000).select(
        F.col("id").alias("insight_id"), F.lit("vulnerability").alias("type"), F.lit("critical").alias("severity")), values, explore=0.1)
    share = explored.filter("pb_id <> 'pb_network_isolate_01'").count() / 4000
    assert 0.03 < share < 0.11


def test_q_fold_equals_recursion(spark):
    rewards = [1, 0, 0, 1, 1, 0, 1]
    q = 0.5
    for r in rewards:
        q += 0.2 * (r - q)
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate(rewards)], "state string, t int, r int")
    assert abs(one(remediate.fold_q(df, ["state"], ["t"], "r")).q - q) < 1e-12


def test_workflow_replay(spark):
    def states(*kinds):
        df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "w int, t int, kind string")
        return one(windows.workflow_state(df, "w", "t", "kind", [False, True])).state

    assert states("start") == "IN_PROGRESS"
    assert states("start", "evidence", "advance") == "WAITING_EVIDENCE"
    assert states("start", "advance", "advance", "evidence") == "COMPLETED"
    assert states("advance") == "PENDING"


def test_approvals(spark):
    requests = spark.createDataFrame([(1, ["SOC_ANALYST", "LEGAL"]), (2, ["SOC_ANALYST"]), (3, []), (4, ["LEGAL"])], "execution_id int, approval_roles array<string>")
    votes = spark.createDataFrame([(1, "SOC_ANALYST", "approve"), (2, "SOC_ANALYST", "approve"), (4, "CFO", "approve"), (9, "LEGAL", "approve")],
                                  "execution_id int, role string, decision string")
    rows = {r.execution_id: (r.status, r.remaining) for r in remediate.approval_status(requests, votes).collect()}
    assert rows[1] == ("AWAITING_FURTHER_APPROVAL", ["LEGAL"])
    assert rows[2] == ("APPROVED", [])
    assert rows[3] == ("AWAITING_APPROVAL", ["SOC_ANALYST"])
    assert rows[4][0] == "INVALID_ROLE"
    assert rows[9][0] == "NOT_FOUND"


# --- evaluation -------------------------------------------------------------------------------------------------------

def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1, 0.1), (1, 0.9, 0.9), (1, 0.8, 0.8), (0, 0.4, 0.4), (1, 0.3, 0.7)], "y int, p double, s double")
    row = one(evaluate.binary_metrics(df, "y", "p"))
    assert row.precision == 1.0 and abs(row.recall - 2 / 3) < 1e-12 and row.brier < 0.2
    assert one(evaluate.compare_shadow(df, "y", "p", "s")).recommend_promotion
    auc = one(evaluate.roc_auc(df, "y", "p"))
    assert abs(auc.roc_auc - 5 / 6) < 1e-12
    assert one(evaluate.roc_auc(df.filter("y = 1"), "y", "p")).roc_auc == 0.5


def test_shares_round_trip(spark):
    df = spark.createDataFrame([(i, i * 37 % 101) for i in range(500)], "id int, secret int")
    shares = aggregates.split_shares(df, "id", "secret", 5, seed=1)
    assert one(aggregates.aggregate_shares(shares)).global_sum == sum(i * 37 % 101 for i in range(500)) % aggregates.MODULUS
    with pytest.raises(ValueError):
        aggregates.split_shares(df, "id", "secret", 1, seed=1)


def test_forest_finds_breaches(spark):
    rng = random.Random(4)
    found = []
    for i in range(4000):
        bad = rng.random() < 0.04
        found.append((i, rng.gauss(90 if bad else 20, 5), rng.gauss(60 if bad else 10, 4), rng.gauss(80 if bad else 15, 6), rng.random() * (1.0 if bad else 0.4), float(bad)))
    rows = spark.createDataFrame(found, "id long, avg_connection_rate double, cve_criticality_sum double, unique_ips_contacted double, degree_centrality double, is_anomaly double")
    forest = models.IsolationForest.fit(rows, models.TELEMETRY_FEATURES, "id")
    out = forest.predict(rows.withColumnRenamed("is_anomaly", "truth"))
    flagged = out.agg(F.avg("is_anomaly")).first()[0]
    recall = out.filter("truth = 1").agg(F.avg("is_anomaly")).first()[0]
    assert 0.02 < flagged < 0.08 and recall > 0.7
    assert models.predict_or_normal(None, rows).agg(F.max("is_anomaly")).first()[0] == 0.0


def test_leaf_tables_end_where_a_walk_ends(spark, monkeypatch):
    rng = random.Random(5)
    odd = [(10_000, None, 1.0, -1.0), (10_001, float("nan"), 0.0, 2.0), (10_002, float("inf"), float("-inf"), 3.0), (10_003, 2.0, 2.0, 2.0)]
    rows = spark.createDataFrame([(i, float(rng.randrange(7)), rng.random(), 4.0) for i in range(2500)] + odd, "id long, a double, b double, c double")
    forest = models.IsolationForest.fit(rows.filter("id < 2500"), ("a", "b", "c"), "id", trees=20)
    read = {r.id: r.anomaly_score for r in forest.scores(rows).collect()}
    monkeypatch.setattr(models.LeafTables, "LIMIT", 0)
    assert {r.id: r.anomaly_score for r in forest.scores(rows).collect()} == read and len(read) == 2504


# --- graph --------------------------------------------------------------------------------------------------------------

def test_profile_counts_a_shared_node_once(spark):
    reach = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 4), (2, 2, 0)], "root long, node long, depth int")
    vendors = spark.createDataFrame([(1, 80), (2, 60), (3, 40)], "vendor_id long, security_score int")
    developed = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12)], "vendor_id long, comp_id long")
    runs = spark.createDataFrame([(7, 10), (7, 11), (8, 10), (9, 12), (40_000, 11)], "device_id long, comp_id long")
    vulns = spark.createDataFrame([(10, "a"), (10, "b"), (11, "c"), (12, "d")], "comp_id long, cve string")
    got = {r.root: (r.vendor_count, r.component_count, r.device_count, r.active_cves, r.rating_sum) for r in aggregates.subgraph_profile(reach, vendors, developed, runs, vulns).collect()}
    assert got == {1: (3, 2, 3, 3, 180), 2: (1, 2, 3, 3, 60)}


def test_deep_chains_are_followed_to_the_end(spark):
    n = 12
    nodes = spark.createDataFrame([(i, 0) for i in range(n)], "id int, cves int")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "src int, dst int, weight double")
    levels, left = graph.topological_levels(nodes, edges)
    assert left == 0 and {r.id: r.level for r in levels.collect()} == {i: i for i in range(n)}
    assert graph.propagate_belief(nodes, edges).count() == n
    pairs = spark.createDataFrame([(n - 1, 0), (0, n - 1)], "target int, source int")
    effects = {r.target: r.effect for r in graph.causal_effects(nodes, edges, pairs).collect()}
    assert effects[0] == 0.0 and effects[n - 1] > 0
    loop = edges.union(spark.createDataFrame([(n - 1, 0, 1.0)], edges.schema))
    assert {r.effect for r in graph.causal_effects(nodes, loop, pairs).collect()} == {None}



def small_graph(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 2)], "id int, cves int")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (1, 3, 0.8)], "src int, dst int, weight double")
    return nodes, edges


def test_topology_golden(spark):
    rows = [("AcmeCorp", 0, [("vendor", "BetaCorp", None), ("component", "OpenSSL", "1.1.1t")]),
            ("BetaCorp", 1, [("vendor", "GammaLLC", None), ("component", "Log4j", "2.14.0")]), ("GammaLLC", 0, [("component", "SpringCore", "5.3.10")])]
    df = spark.createDataFrame(rows, "vendor_name string, cves int, dependencies array<struct<type:string,name:string,version:string>>")
    nodes, edges = graph.build_graph(df)
    summary = one(graph.graph_summary(nodes, edges))
    assert tuple(summary) == (6, 5, True)


def test_belief_by_hand(spark):
    nodes, edges = small_graph(spark)
    p = {r.id: r.p for r in graph.propagate_belief(nodes, edges).collect()}
    p1, p4 = 0.25, 0.45
    p2 = 0.05 + p1 * 0.9 - 0.05 * p1 * 0.9
    up3 = 1 - (1 - p2 * 0.5 * 0.9) * (1 - p1 * 0.8 * 0.9)
    want = {1: p1, 2: p2, 3: 0.05 + up3 - 0.05 * up3, 4: p4}
    assert all(abs(p[k] - want[k]) < 1e-12 for k in want)


def test_causal_effect_by_hand(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 0)], "id string, cves int")
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    pairs = spark.createDataFrame([("b", "a"), ("a", "b")], "target string, source string")
    rows = {(r.target, r.source): r.effect for r in graph.causal_effects(nodes, edges, pairs).collect()}
    assert abs(rows[("b", "a")] - 0.95 * 0.85) < 1e-12
    assert rows[("a", "b")] == 0.0


def test_cycle_gives_nothing(spark):
    nodes, edges = small_graph(spark)
    loop = edges.unionByName(spark.createDataFrame([(3, 1, 1.0)], edges.schema))
    assert graph.propagate_belief(nodes, loop).count() == 0
    assert not graph.is_dag(nodes, loop) and graph.is_dag(nodes, edges)


def test_pagerank_sums_to_one(spark):
    nodes, edges = small_graph(spark)
    out = graph.risk_pagerank(nodes, edges)
    assert abs(out.agg(F.sum("rank")).first()[0] - 1.0) < 1e-9
    ranks = {r.id: r.rank for r in out.collect()}
    assert ranks[3] > ranks[2]
    hub = spark.createDataFrame([(0, i, 1.0 + i % 3) for i in range(1, 60)] + [(i, 0, 1.0) for i in range(30, 60)], "src int, dst int, weight double")
    points = spark.range(60).select(F.col("id").cast("int").alias("id"), (F.col("id") % 2).cast("int").alias("cves"))
    whole = {r.id: r.rank for r in graph.risk_pagerank(points, hub).collect()}
    spread = {r.id: r.rank for r in graph.risk_pagerank(points, hub, fan=7).collect()}
    assert all(abs(whole[i] - spread[i]) < 1e-9 for i in whole)


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(361))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(361)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {i: find(i) for i in range(361)}


# --- windows and joins -------------------------------------------------------------------------------------------------

def test_upsert_is_idempotent_and_keeps_last(spark):
    old = spark.createDataFrame([("a", 1, 1, "x", None)], "id string, ts int, seen int, p string, q string")
    new = spark.createDataFrame([("a", 2, 2, None, "y"), ("a", 3, 3, "z", None), ("b", 1, 1, "w", None)], old.schema)
    once = windows.upsert(old, new, ["id"], ["ts"], "seen")
    twice = windows.upsert(old.unionByName(new), new, ["id"], ["ts"], "seen")
    want = {("a", 1, 3, "z", "y"), ("b", 1, 1, "w", None)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_source_health_states(spark):
    rows = [(i, i * 1_000_000, True) for i in range(6)] + [(6, 80_000_000, True), (7, 81_000_000, False), (8, 82_000_000, True)]
    df = spark.createDataFrame([("s", *r) for r in rows], "source string, id int, ts_us long, failed boolean")
    out = windows.source_health(df, "source", ["ts_us"], F.col("failed"), "ts_us").orderBy("id").collect()
    assert [r.state_after for r in out] == ["CLOSED"] * 4 + ["OPEN"] * 3 + ["CLOSED"] * 2
    assert [r.state_before for r in out] == ["CLOSED"] * 5 + ["OPEN", "HALF_OPEN", "OPEN", "CLOSED"]


def test_triplets_respect_categories(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)] + [(99, 7)], "vec_id int, label int")
    rows = joins.mine_triplets(df, "vec_id", "label", seed=4).collect()
    label = {r.vec_id: r.label for r in df.collect()}
    assert len(rows) == 20
    assert all(label[r.anchor] == label[r.positive] != label[r.negative] and r.anchor != r.positive for r in rows)


def test_csv_export_doubles_quotes(spark):
    import csv
    import pathlib

    from riskfabric.session import scratch

    folder = scratch(spark, "csv")
    value = 'a "b", \\ c\nd'
    df = spark.createDataFrame([("x", {"k": value})], "id string, properties map<string,string>").coalesce(1)
    landing.export_assets(df, folder, "csv")
    text = "".join(p.read_text() for p in pathlib.Path(folder.removeprefix("file:")).glob("part-*"))
    rows = list(csv.reader(text.splitlines(keepends=True)))
    assert rows[0] == ["id", "properties"] and json.loads(rows[1][1]) == {"k": value}


def test_long_package_urls_stay_apart(spark):
    long = "pkg:npm/" + "x" * 1100
    docs = [json.dumps({"bomFormat": "CycloneDX", "components": [{"name": "n" * 1100, "purl": long + end} for end in "ab"]}),
            json.dumps({"spdxVersion": "SPDX-2.3", "packages": [{"name": "n", "externalRefs": [{"referenceType": "purl", "referenceLocator": long + end}]} for end in "ab"]})]
    rows = bom.sbom_components(spark.createDataFrame([(d,) for d in docs], "payload string")).collect()
    assert sorted(r["purl"] for r in rows) == sorted([long + "a", long + "b"] * 2)
    assert {len(r["name"]) for r in rows} == {1, 1024}
