"""Registered queries: aggregations (section 2.4 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.functions.numeric import euclidean, half_up
from riskfabric.operators import aggregates, evaluate, govern, graph, joins, remediate, risk, textscan
from riskfabric.plans.joins import ASSETS_ALL, HOST_EDGES, SHADOW, TRIPLETS
from riskfabric.plans.registry import query, rounded
from riskfabric.plans.scalar import PAGE_PATTERNS, _unsafe
from riskfabric.session import cut

REACH = """reach AS (SELECT vendor_id AS root, vendor_id AS node, 0 AS depth FROM vendors
  UNION SELECT reach.root, s.dst, reach.depth + 1 FROM reach JOIN supplies s ON s.src = reach.node WHERE reach.depth < 4),
 near AS (SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node)"""

PROFILE = f"""{REACH},
 comps AS MATERIALIZED (SELECT DISTINCT near.root, d.comp_id FROM near JOIN developed d ON d.vendor_id = near.node WHERE near.depth < 4),
 cves AS (SELECT comp_id, count(*) AS n FROM component_vulns GROUP BY comp_id),
 parts AS (SELECT root, count(DISTINCT c.comp_id) AS component_count, CAST(sum(coalesce(v.n, 0)) AS BIGINT) AS active_cves FROM comps c LEFT JOIN cves v ON v.comp_id = c.comp_id GROUP BY root),
 users AS (SELECT root, count(DISTINCT r.device_id) AS device_count FROM comps c JOIN runs r ON r.comp_id = c.comp_id GROUP BY root),
 known AS (SELECT root, count(DISTINCT node) AS vendor_count, CAST(sum(security_score) AS BIGINT) AS rating_sum, sum(security_score) / count(*) AS avg_rating
   FROM near JOIN vendors n ON n.vendor_id = near.node GROUP BY root),
 profile AS (SELECT k.*, coalesce(component_count, 0) AS component_count, coalesce(device_count, 0) AS device_count, coalesce(active_cves, 0) AS active_cves
   FROM known k LEFT JOIN parts p ON p.root = k.root LEFT JOIN users u ON u.root = k.root)"""


def profiles(t: Lake):
    vendors = t.vendors
    edges = cut(t.supplies.select("src", "dst"))
    reach = graph.nth_party(edges, vendors.select(F.col("vendor_id").alias("id")))
    return aggregates.subgraph_profile(reach, vendors, t.developed, t.runs, t.component_vulns, edges=edges)


@query("a1_subgraph_profile", f"""WITH RECURSIVE {PROFILE}
SELECT root, vendor_count, component_count, device_count, rating_sum, active_cves, {rounded('avg_rating')} AS avg_rating FROM profile""")
def a1(t: Lake):
    return profiles(t).withColumn("avg_rating", half_up(F.col("avg_rating"), 6))


VENDOR_RISK = "greatest(5, least(95, (100 - avg_rating) * 0.4e0 + active_cves * 15e0 + vendor_count * 4e0))"


@query("vendor_risk_prediction", f"""WITH RECURSIVE {PROFILE}, s AS (SELECT *, {VENDOR_RISK} AS risk FROM profile)
SELECT root, {rounded('risk', 2)} AS risk, {rounded('least(0.99e0, 0.05e0 + least(vendor_count, 8) * 0.05e0 + least(active_cves, 4) * 0.15e0)', 3)} AS cascade,
 CASE WHEN risk >= 75 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, vendor_count - 1 AS nth_party_affected FROM s""")
def vendor_risk(t: Lake):
    return risk.predict_vendors(profiles(t)).select(
        "root", half_up(F.col("risk"), 2).alias("risk"), half_up(F.col("cascade"), 3).alias("cascade"), "risk_level", "nth_party_affected")


@query("a3_affected_counts", """
SELECT signal_id, 1 + CASE type WHEN 'sbom' THEN 2 WHEN 'report' THEN 2 * (CASE WHEN contains(content, 'sandworm') THEN 2 ELSE 0 END) WHEN 'network_scan' THEN 1 ELSE 0 END AS nodes_affected FROM signals""")
def a3(t: Lake):
    kind = F.col("type")
    counted = aggregates.affected_counts(
        components=(kind == "sbom").cast("int"), models=F.lit(0), binaries=F.lit(0),
        actors=F.size(F.coalesce(textscan.extract_actors(F.col("content")), F.array().cast("array<string>"))),
        devices=(kind == "network_scan").cast("int"))
    return t.signals.select("signal_id", counted.alias("nodes_affected"))


@query("a4_evidence_package", f"""
SELECT 'assets_inventoried' AS section, id, type AS kind, name AS label, 'SOC2' AS framework FROM ({ASSETS_ALL}) a UNION ALL
SELECT 'known_exposures' AS section, concat('exposure--shadow-it--', id) AS id, 'HIGH' AS kind, 'Unmanaged Shadow IT Asset' AS label, 'SOC2' AS framework FROM ({SHADOW}) s""")
def a4(t: Lake):
    assets = t.sql(ASSETS_ALL)
    exposures, _ = joins.shadow_exposures(joins.shadow_candidates(assets, t.sql(HOST_EDGES)))
    return govern.evidence_package(assets, exposures, "SOC2")


def metric_sql(prob: str) -> str:
    return f"""count(*) FILTER ({prob} >= 0.5 AND y = 1) AS tp, count(*) FILTER ({prob} >= 0.5 AND y <> 1) AS fp,
 count(*) FILTER ({prob} < 0.5 AND y = 1) AS fn, avg(({prob} - y) * ({prob} - y)) AS brier"""


RATIOS = "CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_score"


@query("a6_binary_metrics", f"""WITH m AS (SELECT model, {metric_sql('prob')} FROM predictions GROUP BY model), r AS (SELECT *, {RATIOS} FROM m)
SELECT model, tp, fp, fn, {rounded('precision')} AS precision, {rounded('recall')} AS recall, {rounded('f1_score')} AS f1_score FROM r""")
def a6(t: Lake):
    out = evaluate.binary_metrics(t.predictions, "y", "prob", by=["model"])
    return out.select("model", "tp", "fp", "fn", *[half_up(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1_score")])


@query("a7_roc_auc", f"""WITH s AS (SELECT prob, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM predictions GROUP BY prob),
 r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT {rounded('sum(p * (below + n / 2)) / (sum(p) * sum(n))')} AS roc_auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM r""")
def a7(t: Lake):
    return evaluate.roc_auc(t.predictions, "y", "prob").withColumn("roc_auc", half_up(F.col("roc_auc"), 6))


@query("a8_brier_score", f"SELECT model, {rounded('avg((prob - y) * (prob - y))')} AS brier FROM predictions GROUP BY model")
def a8(t: Lake):
    return evaluate.binary_metrics(t.predictions, "y", "prob", by=["model"]).select("model", half_up(F.col("brier"), 6).alias("brier"))


F1 = "CASE WHEN 2 * {0}tp + {0}fp + {0}fn = 0 THEN 0e0 ELSE 2 * {0}tp / (2 * {0}tp + {0}fp + {0}fn) END"
SHADOW_SQL = f"""WITH m AS (SELECT count(*) FILTER (prob >= 0.5 AND y = 1) AS a_tp, count(*) FILTER (prob >= 0.5 AND y <> 1) AS a_fp, count(*) FILTER (prob < 0.5 AND y = 1) AS a_fn,
  count(*) FILTER (prob2 >= 0.5 AND y = 1) AS b_tp, count(*) FILTER (prob2 >= 0.5 AND y <> 1) AS b_fp, count(*) FILTER (prob2 < 0.5 AND y = 1) AS b_fn FROM predictions),
 f AS (SELECT {F1.format('a_')} AS primary_f1, {F1.format('b_')} AS shadow_f1 FROM m)
SELECT {rounded('primary_f1')} AS primary_f1, {rounded('shadow_f1')} AS shadow_f1, {rounded('shadow_f1 - primary_f1')} AS improvement, shadow_f1 - primary_f1 > 0.02 AS recommend_promotion FROM f"""


@query("a9_compare_shadow", SHADOW_SQL)
def a9(t: Lake):
    out = evaluate.compare_shadow(t.predictions, "y", "prob", "prob2")
    return out.select(half_up(F.col("primary_f1_score"), 6).alias("primary_f1"), half_up(F.col("shadow_f1_score"), 6).alias("shadow_f1"),
                      half_up(F.col("improvement"), 6).alias("improvement"), "recommend_promotion")


@query("a10_promotion_gate", f"""WITH m AS (SELECT asset_id, {metric_sql('CAST(1 - quality AS DOUBLE)')} FROM predictions GROUP BY asset_id), r AS (SELECT *, {RATIOS} FROM m)
SELECT asset_id, {rounded('f1_score')} AS f1_score, f1_score > 0.85 AS promoted FROM r""")
def a10(t: Lake):
    scored = t.predictions.withColumn("prob", 1.0 - F.col("quality"))
    metrics = evaluate.binary_metrics(scored, "y", "prob", by=["asset_id"])
    return evaluate.promotion_gate(metrics).select("asset_id", half_up(F.col("f1_score"), 6).alias("f1_score"), "promoted")


MOVED = "list_transform(embedding, lambda v: greatest(0e0, least(1e0, CAST(v AS DOUBLE) + 0.05e0 * sign(0.5e0 - CAST(v AS DOUBLE)))))"


@query("a11_robustness", f"""WITH p AS (SELECT list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) > 0.5 AS a, list_sum({MOVED}) > 1.6 AS b FROM embeddings),
 s AS (SELECT count(*) AS total_samples, count(*) FILTER (a = b) * 100e0 / count(*) AS score FROM p)
SELECT total_samples, {rounded('score')} AS robustness_score, {rounded('100 - score')} AS evasion_success_rate, CASE WHEN score >= 80 THEN 'PASS' ELSE 'FAIL_REQUIRES_RETRAINING' END AS status FROM s""")
def a11(t: Lake):
    x = F.transform("embedding", lambda v: v.cast("double"))
    moved = evaluate.perturb(x, F.transform(x, lambda v: F.lit(0.5) - v), 0.05)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e)
    out = evaluate.robustness(t.embeddings, total(x) > 0.5, total(moved) > 1.6)
    return out.withColumns({c: half_up(F.col(c), 6) for c in ("robustness_score", "evasion_success_rate")})


MC = "SELECT model, avg(prob) * 100 AS mean, coalesce(stddev_samp(prob * 100), 0) AS std, count(*) AS passes FROM predictions GROUP BY model"


@query("a12_mc_summary", f"""WITH s AS ({MC}), e AS (SELECT 'ensemble' AS model, avg(mean) AS mean, sqrt(avg(std * std)) AS std, CAST(sum(passes) AS BIGINT) AS passes FROM s), u AS (SELECT * FROM s UNION ALL SELECT * FROM e)
SELECT model, {rounded('mean', 4)} AS mean, {rounded('std', 4)} AS std, passes, {rounded('greatest(0, mean - 1.96e0 * std)', 4)} AS ci_low, {rounded('least(100, mean + 1.96e0 * std)', 4)} AS ci_high FROM u""")
def a12(t: Lake):
    per_model = evaluate.mc_summary(t.predictions.withColumn("risk", F.col("prob") * 100), "model", "risk", 0.0, 100.0)
    both = per_model.unionByName(evaluate.mc_ensemble(per_model, 0.0, 100.0).withColumn("model", F.lit("ensemble")))
    return both.select("model", "passes", *[half_up(F.col(c), 4).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])


@query("a13_aggregate_shares", "SELECT sum(security_score) % 1000003 AS global_sum, 4 AS parties FROM vendors")
def a13(t: Lake):
    return aggregates.aggregate_shares(aggregates.split_shares(t.vendors, "vendor_id", "security_score", 4, seed=5))


APPROVALS = """SELECT user_id AS execution_id, CASE event_type WHEN 'click' THEN 'SOC_ANALYST' WHEN 'view' THEN 'LEGAL' ELSE 'CFO' END AS role,
  CASE WHEN event_type = 'error' AND value > 120 THEN 'reject' WHEN value > 25 THEN 'approve' ELSE 'comment' END AS decision FROM events"""


@query("a14_approval_status", f"""
WITH votes AS (SELECT execution_id, bool_or(role = 'SOC_ANALYST' AND decision = 'approve') AS soc, bool_or(role = 'LEGAL' AND decision = 'approve') AS legal,
   bool_or(decision = 'approve') AS voted, bool_or(decision = 'reject') AS rejected FROM ({APPROVALS}) a GROUP BY execution_id),
 req AS (SELECT vendor_id AS execution_id, tier < 3 AS two FROM vendors),
 j AS (SELECT coalesce(req.execution_id, votes.execution_id) AS execution_id, req.execution_id IS NOT NULL AS known, two, coalesce(soc, false) AS soc, coalesce(legal, false) AS legal,
   coalesce(voted, false) AS voted, coalesce(rejected, false) AS rejected FROM req FULL JOIN votes ON req.execution_id = votes.execution_id)
SELECT execution_id, CASE WHEN NOT known THEN 'NOT_FOUND' WHEN rejected THEN 'REJECTED' WHEN soc AND (legal OR NOT two) THEN 'APPROVED'
   WHEN voted AND NOT soc AND NOT (two AND legal) THEN 'INVALID_ROLE' WHEN voted THEN 'AWAITING_FURTHER_APPROVAL' ELSE 'AWAITING_APPROVAL' END AS status,
  CASE WHEN known THEN concat_ws(',', CASE WHEN two AND NOT legal THEN 'LEGAL' END, CASE WHEN NOT soc THEN 'SOC_ANALYST' END) ELSE '' END AS remaining FROM j""")
def a14(t: Lake):
    roles = F.when(F.col("tier") < 3, F.array(F.lit("SOC_ANALYST"), F.lit("LEGAL"))).otherwise(F.array().cast("array<string>"))
    requests = t.vendors.select(F.col("vendor_id").alias("execution_id"), roles.alias("approval_roles"))
    out = remediate.approval_status(requests, t.sql(APPROVALS))
    return out.withColumn("remaining", F.concat_ws(",", "remaining"))


@query("u2_role_gap", f"""WITH h AS (SELECT execution_id, bool_or(role = 'SOC_ANALYST' AND decision = 'approve') AS soc, bool_or(role = 'LEGAL' AND decision = 'approve') AS legal FROM ({APPROVALS}) a GROUP BY execution_id)
SELECT execution_id, concat_ws(',', CASE WHEN NOT soc THEN 'SOC_ANALYST' END, CASE WHEN NOT legal THEN 'LEGAL' END) AS missing, soc AND legal AS complete FROM h""")
def u2(t: Lake):
    held = t.sql(APPROVALS).groupBy("execution_id").agg(
        F.collect_set(F.when(F.col("decision") == "approve", F.col("role"))).alias("held"))
    missing, complete = remediate.role_gap(F.array(F.lit("SOC_ANALYST"), F.lit("LEGAL")), F.col("held"))
    return held.select("execution_id", F.concat_ws(",", missing).alias("missing"), complete.alias("complete"))


DIST = "sqrt(list_sum(list_transform(range(1, len({0}) + 1), lambda i: pow(CAST({0}[i] AS DOUBLE) - CAST({1}[i] AS DOUBLE), 2))))"


@query("a16_triplet_loss", f"""WITH {TRIPLETS}, d AS (SELECT trip.label, greatest(0, {DIST.format('a.embedding', 'p.embedding')} - {DIST.format('a.embedding', 'g.embedding')} + 1) AS loss FROM trip
  JOIN embeddings a ON a.vec_id = trip.anchor JOIN embeddings p ON p.vec_id = trip.positive JOIN embeddings g ON g.vec_id = trip.negative)
SELECT label, {rounded('avg(loss)')} AS triplet_loss, count(*) AS triplets FROM d GROUP BY label""")
def a16(t: Lake):
    vec = t.embeddings.select("vec_id", "embedding")
    trip = joins.mine_triplets(t.embeddings.select("vec_id", "label"), "vec_id", "label")
    for role in ("anchor", "positive", "negative"):
        trip = trip.join(vec.select(F.col("vec_id").alias(role), F.col("embedding").alias(f"{role}_v")), role)
    loss = F.greatest(F.lit(0.0), euclidean(F.col("anchor_v"), F.col("positive_v")) - euclidean(F.col("anchor_v"), F.col("negative_v")) + 1.0)
    return trip.groupBy("label").agg(half_up(F.avg(loss), 6).alias("triplet_loss"), F.count(F.lit(1)).alias("triplets"))


CLIPPED = "greatest(1e-12, least(1 - 1e-12, prob))"


@query("a16_bce_loss", f"SELECT model, {rounded(f'avg(-(y * ln({CLIPPED}) + (1 - y) * ln(1 - {CLIPPED})))', 4)} AS bce FROM predictions GROUP BY model")
def a16_bce(t: Lake):
    return t.predictions.groupBy("model").agg(half_up(F.avg(evaluate.bce(F.col("y"), F.col("prob"))), 4).alias("bce"))


ISSUES = " UNION ALL ".join(_unsafe(k, p) for k, p in PAGE_PATTERNS.items())


@query("a17_scan_summary", f"""SELECT w.scheme, i.kind, count(*) AS issues FROM ({ISSUES}) i JOIN web_assets w ON w.page_id = i.page_id
GROUP BY GROUPING SETS ((w.scheme, i.kind), (w.scheme), (i.kind), ())""")
def a17(t: Lake):
    issues = textscan.scan_unsafe(t.web_assets.select("page_id", "scheme", "html"), "html", ["page_id", "scheme"], PAGE_PATTERNS)
    return aggregates.scan_summary(issues, "scheme", "kind")


@query("a18_feedback_targets", f"""SELECT asset_id, {rounded('avg(CASE WHEN y = 1 THEN 1e0 ELSE -1e0 END)')} AS mean_target, count(*) AS feedback FROM predictions GROUP BY asset_id""")
def a18(t: Lake):
    return aggregates.feedback_targets(t.predictions, "asset_id", "y").withColumn("mean_target", half_up(F.col("mean_target"), 6))
