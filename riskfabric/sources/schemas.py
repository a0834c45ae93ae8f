"""Record schemas of the data model."""

from __future__ import annotations

SIGNAL = (
    "source string, type string, repo string, commit_hash string, message string, package string, version string, "
    "dependencies_count int, cve_id string, severity string, actor string, content string, ip_address string, "
    "open_ports array<int>, cve_detections array<string>, timestamp double"
)
TELEMETRY = (
    "asset_id string, timestamp timestamp, connection_count int, cve_criticality double, unique_ips int, centrality double"
)
ASSET = (
    "id string, type string, value string, name string, created_at timestamp, updated_at timestamp, "
    "properties map<string,string>"
)
RATING = "vendor_name string, security_score int, risk_tier string, last_updated string"
LEDGER = "index bigint, timestamp string, event string, prev_hash string, hash string"
RUN_LOG = "run_id string, job string, state string, at timestamp, rows bigint, error string"

# Permitted asset types, relationship types and scan states.
ASSET_TYPES = (
    "ipv4-addr", "domain-name", "x509-certificate", "url", "software", "identity", "host", "cloud-resource",
)
RELATIONSHIP_TYPES = (
    "depends_on", "hosts", "resolves_to", "has_vulnerability", "has_exposure", "discovered_in",
)
SCAN_STATES = ("pending", "running", "completed", "failed")
