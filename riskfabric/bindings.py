"""Typed views of the domain over the given tables.

Each view is one piece of SQL text. Spark runs it against the parquet files, the oracle runs the very
same text as a common table expression, so an operator and its check start from equal rows. The few
functions whose name differs between the two engines are written in capitals and substituted.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "vendors": """
        SELECT s_suppkey AS vendor_id, s_name AS name, n_regionkey AS tier,
               CAST(least(100, greatest(0, floor((s_acctbal + 1000) / 110))) AS INT) AS security_score,
               CAST(CASE WHEN s_acctbal < 1000 THEN floor((1999 - s_acctbal) / 1000) ELSE 0 END AS INT) AS cves
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "components": """
        SELECT p_partkey AS comp_id, p_name AS name, concat('1.', p_size, '.0') AS version,
               concat('pkg:generic/', replace(p_name, ' ', '-'), '-', p_partkey, '@1.', p_size, '.0') AS purl,
               p_type IN ('STANDARD', 'PROMO') AS has_provenance,
               CAST(p_size AS DOUBLE) / 50 AS exploit_score,
               p_brand AS brand, p_type AS kind
        FROM part""",
    "component_vulns": """
        SELECT comp_id, purl, lower(name) AS name, concat('CVE-2024-', 1000 + comp_id % 9000) AS cve
        FROM components WHERE kind = 'ECONOMY'""",
    "developed": "SELECT DISTINCT l_suppkey AS vendor_id, l_partkey AS comp_id FROM lineitem",
    "runs": """
        SELECT DISTINCT o_custkey AS device_id, l_partkey AS comp_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "reports_bin": """
        SELECT l_partkey AS comp_id,
               md5(concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey)) AS hash
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r""",
    "binary_scans": """
        SELECT l_orderkey, l_linenumber, l_partkey AS comp_id, l_suppkey,
               md5(concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey)) AS hash,
               CASE WHEN l_returnflag <> 'N' THEN l_discount * 60 + 2 END AS entropy,
               CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity * 2 AS INT) END AS num_imports,
               CASE WHEN l_linestatus = 'F' THEN l_linenumber + 2 END AS num_sections,
               CASE WHEN l_returnflag = 'R' THEN l_discount > 0.07 END AS packer_detected,
               CASE WHEN l_linestatus = 'O' THEN l_tax < 0.06 END AS signature_valid
        FROM lineitem""",
    "order_steps": """
        SELECT l_orderkey, l_linenumber, min(l_suppkey) AS vendor_id, min(l_quantity) AS quantity
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber""",
    "supplies": """
        SELECT a.vendor_id AS src, b.vendor_id AS dst,
               sum(b.quantity) / (50 * count(*)) AS weight
        FROM order_steps a
        JOIN order_steps b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN vendors va ON va.vendor_id = a.vendor_id
        JOIN vendors vb ON vb.vendor_id = b.vendor_id
        WHERE va.tier < vb.tier
        GROUP BY a.vendor_id, b.vendor_id""",
    "telemetry": """
        SELECT event_id, CAST(user_id AS STRING) AS asset_id, ts AS timestamp, EPOCH_US(ts) AS ts_us,
               CAST(JSON_TEXT(props, '$.k') AS INT) AS connection_count, value AS cve_criticality,
               CAST(event_id % 20 AS INT) AS unique_ips, CAST(user_id % 100 AS DOUBLE) / 100 AS centrality
        FROM events""",
    "signals": """
        SELECT event_id AS signal_id, EPOCH_US(ts) AS ts_us,
               CASE event_type WHEN 'click' THEN 'github' WHEN 'view' THEN 'npm' WHEN 'error' THEN 'pypi'
                    WHEN 'purchase' THEN 'threat_feed' ELSE 'network_scanner' END AS source,
               CASE event_type WHEN 'click' THEN 'commit' WHEN 'view' THEN 'sbom' WHEN 'error' THEN 'vulnerability'
                    WHEN 'purchase' THEN 'report' ELSE 'network_scan' END AS type,
               CASE WHEN event_type = 'click' THEN concat('org/repo-', user_id) END AS repo,
               CASE WHEN event_type IN ('view', 'error') THEN concat('pkg-', user_id) END AS package,
               CASE WHEN event_type = 'view' THEN concat('1.', JSON_TEXT(props, '$.k'), '.0') END AS version,
               CASE WHEN event_type = 'view' THEN CAST(JSON_TEXT(props, '$.k') AS INT) END AS dependencies_count,
               CASE WHEN event_type = 'error' THEN concat('CVE-2024-', 1000 + event_id % 9000) END AS cve_id,
               CASE WHEN event_type <> 'error' THEN NULL WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'HIGH'
                    WHEN value >= 10 THEN 'MEDIUM' WHEN value >= 2 THEN 'LOW' END AS severity,
               CASE WHEN event_type <> 'purchase' THEN NULL WHEN value >= 50 THEN 'APT29' WHEN value >= 20 THEN 'Lazarus'
                    WHEN value >= 5 THEN 'Unknown' ELSE '' END AS actor,
               CASE WHEN event_type = 'purchase' THEN concat('Exploit CVE-2024-', 1000 + event_id % 9000,
                    CASE WHEN value >= 20 THEN ' used by sandworm and APT29' ELSE ' seen in the wild' END) END AS content,
               CASE WHEN event_type = 'signup' THEN concat('10.0.', JSON_TEXT(props, '$.k'), '.', user_id) END AS ip_address,
               CASE WHEN event_type = 'signup' THEN CAST(event_id % 4 AS INT) END AS cve_count
        FROM events""",
    "reports_txt": """
        SELECT doc_id, source, concat(text, ' CVE-2024-', 1000 + doc_id % 9000,
               CASE lang WHEN 'en' THEN ' attributed to LAZARUS' WHEN 'fr' THEN ' by apt29 and Sandworm'
                    WHEN 'es' THEN ' equation group' ELSE '' END) AS text
        FROM documents""",
    "requirements_txt": """
        SELECT doc_id, concat(text, CASE lang WHEN 'en' THEN ' We need to encrypt our databases'
               WHEN 'fr' THEN ' Access control policy reviewed, security measures for information' WHEN 'es'
               THEN ' transmission of information to external users' ELSE '' END,
               CASE WHEN n_chars > 2000 THEN ' appropriate to the risk' ELSE '' END) AS text
        FROM documents""",
    "web_assets": """
        SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
               regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               url, html
        FROM pages""",
    "assets_int": """
        SELECT concat('asset--splunk--', page_id) AS id, page_id AS ord, 'host' AS type,
               title AS value, host AS name, md5(url) AS cert_hash, 'internal' AS owner, host AS zone
        FROM web_assets WHERE scheme = 'https'""",
    "assets_ext": """
        SELECT concat('asset--scan--', page_id) AS id, page_id AS ord, 'domain-name' AS type,
               title AS value, host AS name, md5(replace(url, 'http://', 'https://')) AS cert_hash,
               CAST(NULL AS STRING) AS owner, 'internet' AS zone
        FROM web_assets WHERE scheme <> 'https'""",
    "insights": """
        SELECT event_id AS insight_id, EPOCH_US(ts) AS ts_us, user_id,
               concat('Insight ', event_id) AS title,
               CASE event_type WHEN 'click' THEN 'vulnerability' WHEN 'view' THEN 'supply_chain_breach'
                    WHEN 'error' THEN 'critical_vendor_vulnerability' WHEN 'purchase' THEN 'vendor_portal_vulnerability'
                    ELSE 'complex_incident' END AS type,
               CASE WHEN value >= 60 THEN 'critical' WHEN value >= 25 THEN 'high' WHEN value >= 8 THEN 'medium'
                    ELSE 'low' END AS severity,
               CASE WHEN value < 120 THEN concat('asset-', user_id) END AS asset_id,
               CASE WHEN value >= 3 THEN concat('vendor-', user_id) END AS vendor_id,
               CASE WHEN value < 90 THEN concat('/api/', user_id) END AS target_endpoint
        FROM events""",
    "predictions": """
        SELECT l.doc_id AS prediction_id, l.toxic AS y, CAST(d.n_chars % 101 AS DOUBLE) / 100 AS prob,
               CAST((d.n_chars * 7) % 101 AS DOUBLE) / 100 AS prob2, d.source AS asset_id, d.lang AS model, l.quality
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}

_CTE_REF = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b")
_EPOCH = re.compile(r"EPOCH_US\(([\w.]+)\)")


def dependencies(sql: str) -> list[str]:
    """Views a text needs, in definition order, including those its views need."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTE_REF.findall(text):
            if name in VIEWS and name not in found:
                found.add(name)
                visit(VIEWS[name])

    visit(sql)
    return [name for name in VIEWS if name in found]


def oracle_text(sql: str) -> str:
    """A complete statement for the checking engine: the needed views in front of the query."""
    body = sql.strip()
    views = [f"{name} AS ({VIEWS[name]})" for name in dependencies(body)]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if head and head.group(1) else ""
    if head:
        body = body[head.end():]
        text = f"WITH {recursive}" + ",\n".join([*views, body])
    else:
        text = (f"WITH {', '.join(views)}\n" if views else "") + body
    text = text.replace("JSON_TEXT(", "json_extract_string(")
    return _EPOCH.sub(r"epoch_us(\1)", text)


class Lake:
    """The given tables and the views over them, as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        views = [f"{name} AS ({VIEWS[name]})" for name in dependencies(text)]
        full = (f"WITH {', '.join(views)}\n" if views else "") + text
        names = "|".join(TABLES)
        full = re.sub(
            rf"\b(FROM|JOIN)\s+({names})\b",
            lambda m: f"{m.group(1)} parquet.`{self.path}/{m.group(2)}.parquet`",
            full,
        )
        full = full.replace("JSON_TEXT(", "get_json_object(")
        full = _EPOCH.sub(r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", full)
        return self.spark.sql(full)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
