"""Policy decisions, compliance evaluation and evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Role policies as (effect, actions, resources).
ROLE_POLICIES = {
    "admin": [("allow", ["*"], ["*"])],
    "auditor": [
        ("allow", ["read:*", "generate:*"], ["*"]),
        ("deny", ["write:*", "delete:*", "execute:*"], ["*"]),
    ],
    "analyst": [
        ("allow", ["read:*", "write:exposures", "write:remediations"], ["*"]),
        ("deny", ["delete:assets"], ["*"]),
    ],
    "scanner": [("allow", ["read:assets", "write:exposures", "write:scans"], ["*"])],
}

# Permitted service flows, agent tasks, graph writers and readers, with the reason given.
SERVICE_FLOWS = {
    ("data_ingestion", "semantic_fusion"): "Valid inter-service data flow.",
    ("semantic_fusion", "stateful_graph"): "Valid database write flow.",
    ("predictive_inference", "stateful_graph"): "Valid database read flow.",
    ("agentic_execution", "predictive_inference"): "Valid inference query flow.",
    ("agentic_execution", "semantic_fusion"): "Valid telemetry flow.",
}
AGENT_TASKS = {
    "discovery_agent": (["discover_vendor", "read_sbom"], "Authorized task for discovery agent.", "Discovery Agent unauthorized for task: %s"),
    "risk_evaluator_agent": (["query_subgraph", "predict_risk"], "Authorized task for risk evaluator.", "Risk Evaluator unauthorized for task: %s"),
    "remediation_agent": (["trigger_remediation", "verify_remediation"], "Authorized task for remediation agent.", "Remediation Agent unauthorized for task: %s"),
}
REASONS = {
    "not_listed": "Target asset %s is not in the approved allow-list.",
    "issuer": "Invalid issuer claim.",
    "override": "Governance override.",
    "no_flow": "Unauthorized service-to-service flow: %s -> %s",
    "not_agent": "Caller role is not an agent.",
    "no_agent": "Unknown agent type: %s",
    "write": "Service authorized to mutate graph state.",
    "no_write": "Service %s cannot write to graph.",
    "read": "Service authorized to read risk intelligence.",
    "no_read": "Service %s cannot read risk intelligence.",
    "unknown": "Unknown action: %s",
}
GRAPH_WRITERS = ("semantic_fusion", "governance")
RISK_READERS = ("predictive_inference", "agentic_execution", "governance")

# Compliance controls.
CONTROLS = [
    ("SOC2", "CC6.1", "Logical access security software, infrastructure, and architectures have been implemented to protect information assets. Includes encryption of databases."),
    ("SOC2", "CC6.6", "The entity implements logical access security measures to protect against threats from sources outside its boundaries."),
    ("SOC2", "CC6.7", "The entity restricts the transmission, movement, and removal of information to authorized internal and external users and processes."),
    ("ISO27001", "A.9.1.1", "Access control policy shall be established, documented and reviewed."),
    ("ISO27001", "A.10.1.1", "A policy on the use of cryptographic controls for protection of information shall be developed and implemented. encrypt databases"),
    ("GDPR", "Article_32", "Security of processing: implementing appropriate technical and organizational measures to ensure a level of security appropriate to the risk."),
]
MET = "All evaluated assets meet the requirement."


def controls(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CONTROLS)]
    return spark.createDataFrame(rows, "position int, framework string, control_id string, description string")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _matches(target: Column, patterns: Sequence[str]) -> Column:
    """Wildcard match: a star is any text; other pattern characters keep their regex meaning."""
    if "*" in patterns:
        return F.lit(True)
    return _any([target.rlike("^" + p.replace("*", ".*") + "$") for p in patterns])


def access_allowed(roles: Column, action: Column, resource: Column,
                   policies: Mapping[str, list] = ROLE_POLICIES) -> Column:
    """Any allow of any role, unless any deny of any role; the policy set is unrolled, so no shuffle."""
    def granted(effect: str) -> Column:
        return _any([
            F.array_contains(roles, role) & _matches(action, actions) & _matches(resource, resources)
            for role, rules in policies.items() for kind, actions, resources in rules if kind == effect
        ])

    return F.coalesce(granted("allow") & ~granted("deny"), F.lit(False))


def decide_policy(df: DataFrame, issuer: str, allow_list: Sequence[str] = ()) -> DataFrame:
    """Allowed flag and reason for audited requests.

    Input columns: action, iss, sub, role, agent_type, src_service, dest_service, agent_task, target_asset.
    """
    def verdict(ok: bool, reason: str, *filled: Column | str) -> Column:
        words = [F.lit(w) if isinstance(w, str) else F.coalesce(w, F.lit("None")) for w in filled]
        text = F.format_string(reason, *words) if words else F.lit(reason)
        return F.struct(F.lit(ok).alias("allowed"), text.alias("reason"))

    def choose(cases: list[tuple[Column, Column]], default: Column) -> Column:
        return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), default)

    c, r = F.col, REASONS
    target = F.coalesce(c("target_asset"), F.lit(""))
    outside = (c("action") == "agent_execution") & (target != "") & ~target.isin(*allow_list) if allow_list else F.lit(False)
    flow = choose(
        [((c("src_service") == src) & (c("dest_service") == dest), verdict(True, why)) for (src, dest), why in SERVICE_FLOWS.items()]
        + [(c("src_service") == "governance", verdict(True, r["override"]))],
        verdict(False, r["no_flow"], c("src_service"), c("dest_service")))
    agent = choose(
        [(F.coalesce(c("role"), F.lit("")) != "agent", verdict(False, r["not_agent"]))]
        + [((c("agent_type") == kind) & c("agent_task").isin(*tasks), verdict(True, yes)) for kind, (tasks, yes, _) in AGENT_TASKS.items()]
        + [(c("agent_type") == kind, verdict(False, no, c("agent_task"))) for kind, (_, _, no) in AGENT_TASKS.items()],
        verdict(False, r["no_agent"], c("agent_type")))
    by_action = {
        "inter_service_call": flow,
        "agent_execution": agent,
        "graph_mutation": choose([(c("sub").isin(*GRAPH_WRITERS), verdict(True, r["write"]))], verdict(False, r["no_write"], c("sub"))),
        "read_risk_intelligence": choose([(c("sub").isin(*RISK_READERS), verdict(True, r["read"]))], verdict(False, r["no_read"], c("sub"))),
    }
    decision = choose(
        [(outside, verdict(False, r["not_listed"], c("target_asset"))),
         (F.coalesce(c("iss"), F.lit("")) != issuer, verdict(False, r["issuer"]))]
        + [(c("action") == name, answer) for name, answer in by_action.items()],
        verdict(False, r["unknown"], c("action")))
    return df.withColumn("_d", decision).select("*", "_d.allowed", "_d.reason").drop("_d")


def outbound_permitted(action: Column, severity: Column, blocking_enabled: bool = True,
                       human_loop: tuple[str, ...] = ("critical",)) -> Column:
    calm = ~F.lower(severity).isin(*human_loop)
    return F.coalesce((action == "block_vendor") & F.lit(blocking_enabled) & calm, F.lit(False))


def trigger_actions(insights: DataFrame, label: str = "riskfabric") -> DataFrame:
    """Vendor-blocking rows, or escalation rows where the outbound policy says no."""
    severity = F.coalesce("severity", F.lit("info"))
    hit = insights.filter((F.col("type") == "critical_vendor_vulnerability") & (F.length("vendor_id") > 0))
    permitted = outbound_permitted(F.lit("block_vendor"), severity)
    return hit.withColumn("action", F.when(permitted, "block_vendor").otherwise("escalate")).withColumn(
        "reason", F.when(permitted, F.concat(F.lit(f"Automated block via {label}: "), "title")))


def control_evidence(assets: DataFrame, rules: Mapping[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """One row per failing asset and control: rules map (framework, control) to (violation, evidence text).

    Evidence stays as rows; a control violated by a third of all assets is not gathered into one list.
    """
    hits = [
        F.when(violated, F.struct(F.lit(f).alias("framework"), F.lit(c).alias("control_id"), text.alias("evidence")))
        for (f, c), (violated, text) in rules.items()
    ]
    return assets.select(F.inline(F.array_compact(F.array(*hits))))


def evaluate_controls(assets: DataFrame, rules: Mapping[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """Status per control, with the number of violations and the default text when there is none."""
    found = control_evidence(assets, rules).groupBy("framework", "control_id").agg(F.count(F.lit(1)).alias("violations"))
    table = controls(assets.sparkSession).select("framework", "control_id")
    violations = F.coalesce("violations", F.lit(0))
    return table.join(found, ["framework", "control_id"], "left").select(
        "framework", "control_id", F.when(violations > 0, "FAIL").otherwise("PASS").alias("status"),
        violations.alias("violations"), F.when(violations == 0, F.lit(MET)).alias("evidence"))


def framework_status(statuses: DataFrame) -> DataFrame:
    """Control and framework level in one rollup; a framework fails with any of its controls."""
    rolled = statuses.rollup("framework", "control_id").agg(
        F.bool_or(F.col("status") == "FAIL").alias("failed"), F.sum("violations").alias("violations"))
    return rolled.filter(F.col("framework").isNotNull()).select(
        "framework", "control_id", F.when(F.col("failed"), "FAIL").otherwise("PASS").alias("status"), "violations")


def evidence_package(assets: DataFrame, exposures: DataFrame, framework: str) -> DataFrame:
    """Asset inventory and exposure list of one package, section by section."""
    inventory = assets.select(
        F.lit("assets_inventoried").alias("section"), F.col("id"), F.col("type").alias("kind"), F.col("name").alias("label"))
    known = exposures.select(
        F.lit("known_exposures").alias("section"), F.col("id"), F.col("severity").alias("kind"), F.col("title").alias("label"))
    return inventory.unionByName(known).withColumn("framework", F.lit(framework))
