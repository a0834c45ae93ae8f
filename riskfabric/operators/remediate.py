"""Playbook matching, value learning, action planning, approvals and listings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators.scan import KeyedScan

START_VALUE = 0.5
LEARNING_RATE = 0.2
EXPLORE_SHARE = 0.1


@dataclass(frozen=True)
class Playbook:
    pb_id: str
    name: str
    pb_type: str
    match_rules: Mapping[str, str | Sequence[str]] = field(default_factory=dict)
    steps: Sequence[Mapping] = ()
    approval_roles: Sequence[str] = ()


# The playbook table.
PLAYBOOKS = (
    Playbook("pb_network_isolate_01", "Network Isolation for Critical Vulnerabilities", "automated",
             {"severity": "critical", "type": "vulnerability"},
             steps=[{"action": "network_segmentation", "params": {"isolation_level": "strict"}}], approval_roles=["SOC_ANALYST", "LEGAL"]),
    Playbook("pb_patch_guidance_01", "Guided Patching Workflow", "guided",
             {"severity": ["high", "critical"], "type": "vulnerability"},
             steps=[{"step_id": "step_1", "instruction": "Verify the asset is in the patch management system.", "requires_evidence": False},
                    {"step_id": "step_2", "instruction": "Apply patch and provide proof of successful deployment.", "requires_evidence": True}]),
    Playbook("pb_generic_investigate", "Generic Investigation", "guided", {},
             steps=[{"step_id": "step_1", "instruction": "Review the risk insight.", "requires_evidence": False}]),
    Playbook("pb_soar_escalation", "Complex Incident SOAR Escalation", "automated",
             {"severity": "critical", "type": "complex_incident"},
             steps=[{"action": "soar_integration", "params": {"platform": "Cortex XSOAR", "escalation_level": "critical"}}], approval_roles=["SOC_ANALYST"]),
    Playbook("pb_supply_chain_comm", "Vendor Breach Notification", "automated",
             {"severity": ["high", "critical"], "type": "supply_chain_breach"},
             steps=[{"action": "vendor_communication", "params": {"template_type": "breach_notification"}}]),
    Playbook("pb_supply_chain_controls", "Apply Compensating Controls for Vendor Portal", "automated",
             {"severity": "high", "type": "vendor_portal_vulnerability"},
             steps=[{"action": "compensating_controls", "params": {"control_type": "waf_strict_filtering"}}]),
)

# Report of each action as title, impact (target, parameter or insight title), risk reduction, disruption.
ACTION_REPORTS = {
    "network_segmentation": (
        "Network Segmentation", "Would isolate asset %1$s with level '%2$s'. Connections to/from this asset would be dropped.", "High", "High"),
    "soar_integration": (
        "SOAR Escalation", "Would create an incident ticket in %1$s for '%2$s' and trigger downstream SOAR playbooks.",
        "Medium (Delegates to specialized SOAR)", "Low"),
    "vendor_communication": (
        "Vendor Communication", "Would email the '%2$s' template to %1$s representing vendor '%3$s'.", "Low (Administrative)", "None"),
    "compensating_controls": (
        "Apply Compensating Control", "Would apply '%2$s' temporarily blocking/filtering traffic to %1$s.",
        "High", "Medium (Potential false positives)"),
}
GUIDED_REPORT = (
    "Guided Workflow", "Would initiate a step-by-step guided workflow requiring human interaction for playbook: %s.",
    "Variable (Depends on human execution)", "Minimal")


def _eligible(pb: Playbook) -> Column:
    wanted = {k: [allowed] if isinstance(allowed, str) else allowed for k, allowed in pb.match_rules.items()}
    checks = [F.coalesce(F.col(k).isin(*allowed), F.lit(False)) for k, allowed in wanted.items()]
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def match_playbooks(insights: DataFrame, playbooks: Sequence[Playbook] = PLAYBOOKS) -> DataFrame:
    """One row per insight and eligible playbook; rules become predicates, so nothing is shuffled."""
    found = F.array_compact(F.array(*[
        F.when(_eligible(pb), F.struct(
            F.lit(pb.pb_id).alias("pb_id"), F.lit(pb.name).alias("pb_name"), F.lit(pb.pb_type).alias("pb_type"),
            F.lit(position).alias("pb_position"), F.lit(len(pb.approval_roles) > 0).alias("requires_approval"),
            F.array(*[F.lit(r) for r in pb.approval_roles]).cast("array<string>").alias("approval_roles")))
        for position, pb in enumerate(playbooks)
    ]))
    return insights.select("*", F.inline(found))


def state_key() -> Column:
    return F.concat(F.coalesce("type", F.lit("unknown")), F.lit("_"), F.coalesce("severity", F.lit("low")))


def fold_q(outcomes: DataFrame, keys: list[str], order: list[str], reward: str, rate: float = LEARNING_RATE,
           start: float = START_VALUE, **scan: float) -> DataFrame:
    """q <- q + rate (reward - q) in order, per key.

    The recursion has the closed form (1-rate)^n start + sum rate r_i (1-rate)^(places after i), an ordinary sum
    once each outcome knows how many follow it, so a state that holds most outcomes is folded by all tasks together.
    """
    placed = KeyedScan(outcomes.select(*keys, *order, reward), keys, order, descending=True, **scan).row_number("_i").done()
    keep = F.lit(1.0 - rate)
    term = F.lit(rate) * F.col(reward).cast("double") * F.pow(keep, F.col("_i") - 1)
    return placed.groupBy(*keys).agg(
        (F.sum(term) + F.lit(start) * F.pow(keep, F.count(F.lit(1)))).alias("q"), F.count(F.lit(1)).alias("updates"))


def pick_playbooks(insights: DataFrame, values: DataFrame, playbooks: Sequence[Playbook] = PLAYBOOKS,
                   key: str = "insight_id", explore: float = EXPLORE_SHARE, seed: int = 0, unmatched: bool = False) -> DataFrame:
    """Best eligible playbook per insight: highest value, first in table order on ties. `unmatched` keeps insights without one.

    Choice depends only on the columns the rules look at, so it is made once per distinct combination of them
    and joined back. With probability `explore` a hash of the insight id picks any eligible playbook instead.
    """
    columns = sorted({"type", "severity", *[k for pb in playbooks for k in pb.match_rules]})
    contexts = insights.select(*columns).distinct()
    matched = match_playbooks(contexts, playbooks).withColumn("state", state_key())
    valued = matched.join(values.select("state", "pb_id", "q"), ["state", "pb_id"], "left").withColumn(
        "q", F.coalesce("q", F.lit(START_VALUE)))
    best = valued.groupBy(*columns).agg(
        F.max_by(F.struct("pb_id", "q"), F.struct("q", -F.col("pb_position"))).alias("best"),
        F.sort_array(F.collect_list(F.struct("pb_position", "pb_id", "q"))).alias("eligible"))
    left, right = insights.alias("i"), best.alias("b")
    same = reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    joined = left.join(right, same, "left" if unmatched else "inner").select("i.*", "b.best", "b.eligible")
    if explore <= 0:
        chosen = F.struct(F.col("best.pb_id").alias("pb_id"), F.col("best.q").alias("q"))
    else:
        draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
        slot = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.size("eligible")) + 1
        other = F.element_at("eligible", slot.cast("int"))
        random_pick = F.struct(other["pb_id"].alias("pb_id"), other["q"].alias("q"))
        greedy = F.struct(F.col("best.pb_id").alias("pb_id"), F.col("best.q").alias("q"))
        chosen = F.when(draw < explore, random_pick).otherwise(greedy)
    return joined.withColumn("_c", chosen).select(
        *insights.columns, F.col("_c.pb_id").alias("pb_id"), F.col("_c.q").alias("q"))


def step_reports(columns: Sequence[str], playbooks: Sequence[Playbook] = PLAYBOOKS) -> Column:
    """Reports of the steps of the playbook `pb_id`, as an array: action, target, impact, effects, success (precondition), params.

    A guided playbook gives one report for the workflow it would start. The vendor's address is `vendor_email` where the
    insight has one, else made from the vendor's id.
    """
    vendor = F.coalesce("vendor_id", F.lit("Unknown Vendor"))
    derived = F.concat(F.lit("security@"), vendor, F.lit(".com"))
    address = F.coalesce("vendor_email", derived) if "vendor_email" in columns else derived
    # Per action: the parameter shown, what it acts on, what fills its impact text after that, the column it cannot do without.
    subjects = {
        "network_segmentation": ("isolation_level", F.coalesce("asset_id", F.lit("Unknown")), [], "asset_id"),
        "soar_integration": ("platform", None, [F.coalesce("title", F.lit("Unknown Incident"))], None),
        "vendor_communication": ("template_type", address, [vendor], "vendor_id"),
        "compensating_controls": ("control_type", F.coalesce("target_endpoint", F.lit("Unknown Endpoint")), [], "target_endpoint"),
    }

    def report(texts: tuple[str, str, str, str], target: Column, filled: list[Column], ok: Column, params: Mapping) -> Column:
        title, impact, reduction, disruption = texts
        return F.struct(
            F.lit(title).alias("action"), target.alias("target"), F.format_string(impact, *filled).alias("impact"),
            F.lit(reduction).alias("risk_reduction"), F.lit(disruption).alias("business_disruption"), ok.alias("success"),
            F.lit(json.dumps(params, sort_keys=True)).alias("params"))

    def step(action: str, params: Mapping) -> Column:
        shown, target, extra, needed = subjects[action]
        value = F.lit(params[shown])
        filled = [value, *extra] if target is None else [target, value, *extra]
        ok = F.lit(True) if needed is None else F.coalesce(F.length(needed) > 0, F.lit(False))
        return report(ACTION_REPORTS[action], value if target is None else target, filled, ok, params)

    def guided(pb: Playbook) -> Column:
        return report(GUIDED_REPORT, F.lit("Human Operator"), [F.lit(pb.name)], F.lit(True), {})

    steps = None
    for pb in playbooks:
        rows = F.array(*[step(s["action"], s["params"]) for s in pb.steps]) if pb.pb_type == "automated" else F.array(guided(pb))
        cond = F.col("pb_id") == pb.pb_id
        steps = F.when(cond, rows) if steps is None else steps.when(cond, rows)
    return steps


def plan_actions(matched: DataFrame, playbooks: Sequence[Playbook] = PLAYBOOKS) -> DataFrame:
    """Simulated impact of each step of the matched playbook, its parameters as JSON, and whether its precondition holds."""
    return matched.select("*", F.inline(step_reports(matched.columns, playbooks)))


def process_insights(insights: DataFrame, values: DataFrame, votes: DataFrame, playbooks: Sequence[Playbook] = PLAYBOOKS,
                     key: str = "insight_id", at: str = "ts_us", explore: float = EXPLORE_SHARE, seed: int = 0) -> DataFrame:
    """From insight to outcome: the picked playbook, its status, the roles still missing, and the reward once it has run.

    votes(key, role, decision `approve` or `reject`, at): a playbook with approval roles waits until each has approved; a
    rejection by anybody up to then ends it, later votes change nothing, nor do approvals by other roles. Adds pb_id, state,
    status, remaining, done_at (of the last approval needed, else of the insight) and reward (null where nothing ran):
    NO_PLAYBOOK_FOUND, WORKFLOW_STARTED (guided), AWAITING_APPROVAL, AWAITING_FURTHER_APPROVAL, REJECTED, AUTOMATED_SUCCESS,
    AUTOMATED_FAILED (a step's precondition does not hold). Votes are reduced to one row per insight before they are joined.
    """
    roles = sorted({r for pb in playbooks for r in pb.approval_roles})
    approve, reject = F.col("decision") == "approve", F.col("decision") == "reject"
    earliest = votes.filter(approve | reject).groupBy(key, "role").agg(F.min(F.when(approve, F.col("at"))).alias("_ok"), F.min(F.when(reject, F.col("at"))).alias("_no"))
    given = F.when(F.col("_ok").isNotNull() & F.col("role").isin(*roles), F.struct("role", F.col("_ok").alias("at")))
    voted = earliest.groupBy(key).agg(F.collect_list(given).alias("_given"), F.min("_no").alias("_no"))
    picked = pick_playbooks(insights, values, playbooks, key, explore, seed, unmatched=True).withColumn("state", state_key())

    def per_playbook(value) -> Column:
        out = F.lit(None)
        for pb in playbooks:
            out = F.when(F.col("pb_id") == pb.pb_id, value(pb)).otherwise(out)
        return out

    nobody = F.array().cast("array<string>")
    rows = picked.join(voted, key, "left").withColumns({
        "_kind": per_playbook(lambda pb: F.lit(pb.pb_type)),
        "_roles": F.coalesce(per_playbook(lambda pb: F.array(*map(F.lit, pb.approval_roles)).cast("array<string>")), nobody),
        "_works": F.forall(step_reports(insights.columns, playbooks), lambda r: r["success"])})
    rows = rows.withColumn("_mine", F.filter(F.coalesce("_given", F.array().cast(voted.schema["_given"].dataType)), lambda g: F.array_contains("_roles", g["role"])))
    rows = rows.withColumns({"_last": F.array_max("_mine.at"), "_full": F.size("_mine") == F.size("_roles")})
    ended = F.col("_no").isNotNull() & (~F.col("_full") | (F.col("_no") <= F.col("_last")))
    waits = F.size("_roles") > 0
    status = (
        F.when(F.col("pb_id").isNull(), "NO_PLAYBOOK_FOUND").when(F.col("_kind") == "guided", "WORKFLOW_STARTED")
        .when(waits & ended, "REJECTED").when(waits & (F.size("_mine") == 0), "AWAITING_APPROVAL").when(~F.col("_full"), "AWAITING_FURTHER_APPROVAL")
        .when(F.col("_works"), "AUTOMATED_SUCCESS").otherwise("AUTOMATED_FAILED"))
    rows = rows.withColumn("status", status)
    ran = F.col("status").isin("AUTOMATED_SUCCESS", "AUTOMATED_FAILED")
    waiting = F.col("status").isin("AWAITING_APPROVAL", "AWAITING_FURTHER_APPROVAL")
    return rows.select(
        *insights.columns, "pb_id", "state", "status",
        F.when(waiting, F.sort_array(F.array_except("_roles", "_mine.role"))).otherwise(nobody).alias("remaining"),
        F.when(ran, F.greatest(at, "_last")).alias("done_at"), F.when(ran, (F.col("status") == "AUTOMATED_SUCCESS").cast("int")).alias("reward"))


def learn_outcomes(values: DataFrame, processed: DataFrame, key: str = "insight_id", rate: float = LEARNING_RATE, **scan: float) -> DataFrame:
    """values(state, pb_id, q, updates) after the rewards of `process_insights`, in the order in which the playbooks ran."""
    ran = processed.filter(F.col("reward").isNotNull()).select("state", "pb_id", "done_at", key, "reward")
    # From a start of zero the fold gives what the new rewards add; what was known before fades with each of them.
    added = fold_q(ran, ["state", "pb_id"], ["done_at", key], "reward", rate, 0.0, **scan).select(
        "state", "pb_id", F.col("q").alias("_add"), F.col("updates").alias("_more"))
    more = F.coalesce("_more", F.lit(0).cast("long"))
    return values.join(added, ["state", "pb_id"], "full").select(
        "state", "pb_id", (F.coalesce("q", F.lit(START_VALUE)) * F.pow(F.lit(1.0 - rate), more) + F.coalesce("_add", F.lit(0.0))).alias("q"),
        (F.coalesce("updates", F.lit(0).cast("long")) + more).alias("updates"))


def approval_status(requests: DataFrame, approvals: DataFrame, key: str = "execution_id") -> DataFrame:
    """Per pending execution: approved, which roles remain, or the status of a rejection.

    Votes are reduced to the distinct roles of an execution (a short list) before they are joined. Only roles
    outside the required set give INVALID_ROLE, votes on unknown executions NOT_FOUND.
    """
    votes = approvals.groupBy(key).agg(
        F.collect_set(F.when(F.col("decision") == "approve", F.col("role"))).alias("_voted"),
        F.bool_or(F.col("decision") == "reject").alias("_rejected"))
    joined = requests.join(votes, key, "full")
    required = F.when(F.size("approval_roles") > 0, F.col("approval_roles")).otherwise(F.array(F.lit("SOC_ANALYST")))
    voted = F.coalesce("_voted", F.array().cast("array<string>"))
    remaining = F.sort_array(F.array_except(required, voted))
    status = (
        F.when(F.col("approval_roles").isNull(), "NOT_FOUND")
        .when(F.coalesce("_rejected", F.lit(False)), "REJECTED")
        .when(F.size(remaining) == 0, "APPROVED")
        .when((F.size(voted) > 0) & (F.size(F.array_intersect(required, voted)) == 0), "INVALID_ROLE")
        .when(F.size(voted) > 0, "AWAITING_FURTHER_APPROVAL")
        .otherwise("AWAITING_APPROVAL")
    )
    return joined.select(key, status.alias("status"), F.when(F.col("approval_roles").isNotNull(), remaining).alias("remaining"))


def role_gap(required: Column, held: Column) -> tuple[Column, Column]:
    """Roles still missing, and whether the required set is included in the held one."""
    missing = F.array_except(required, held)
    return missing, F.size(missing) == 0


def listing(df: DataFrame, text: Mapping[str, str] | None = None, ident: tuple[str, object] | None = None) -> DataFrame:
    """Listing filters: case-insensitive text columns, and look-up by id."""
    for column, wanted in (text or {}).items():
        df = df.filter(F.lower(F.col(column)) == wanted.lower())
    if ident is not None:
        df = df.filter(F.col(ident[0]) == F.lit(ident[1]))
    return df
