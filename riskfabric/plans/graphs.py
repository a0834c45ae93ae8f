"""Registered queries: graph operators (section 2.6 of the survey) over the supply graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfabric.bindings import Lake
from riskfabric.functions.numeric import half_up
from riskfabric.operators import graph
from riskfabric.plans.aggregates import REACH
from riskfabric.plans.registry import query, rounded
from riskfabric.session import cut


def supply_nodes(t: Lake):
    return t.vendors.select(F.col("vendor_id").alias("id"), "cves")


def supply_edges(t: Lake):
    """Read once, then shared by all rounds of an iteration."""
    return cut(t.supplies)


@query("g1_nth_party", f"WITH RECURSIVE {REACH} SELECT root, node, depth FROM near")
def g1(t: Lake):
    return graph.nth_party(supply_edges(t), supply_nodes(t).select("id"))


@query("g1_subgraph_edges", f"""WITH RECURSIVE {REACH} SELECT near.root, count(*) AS edges, {rounded('sum(s.weight)', 4)} AS weight FROM near JOIN supplies s ON s.src = near.node WHERE near.depth < 4 GROUP BY near.root""")
def g1_edges(t: Lake):
    edges = supply_edges(t)
    reach = graph.nth_party(edges, supply_nodes(t).select("id"))
    return graph.subgraph_edges(reach, edges).groupBy("root").agg(
        F.count(F.lit(1)).alias("edges"), half_up(F.sum("weight"), 4).alias("weight"))


SEEDS = "SELECT vendor_id AS id FROM vendors WHERE tier >= 3"


@query("g2_discover", f"""WITH RECURSIVE walk AS (SELECT id AS vendor, 0 AS depth FROM ({SEEDS}) s UNION SELECT s.src, walk.depth + 1 FROM walk JOIN supplies s ON s.dst = walk.vendor WHERE walk.depth < 2)
SELECT w.vendor, min(w.depth) AS depth, any_value(v.cves) AS cves FROM walk w JOIN vendors v ON v.vendor_id = w.vendor GROUP BY w.vendor""")
def g2(t: Lake):
    deps = supply_edges(t).select(F.col("dst").alias("vendor"), F.col("src").alias("supplier"))
    infra = t.vendors.select(F.col("vendor_id").alias("vendor"), "cves")
    return graph.discover(t.sql(SEEDS), deps, infra, max_depth=3)


TOPOLOGY_EDGES = """SELECT concat('v', src) AS src, concat('v', dst) AS dst, 'SUPPLIES' AS relation, 1e0 AS weight FROM supplies
 UNION SELECT DISTINCT concat(c.name, '@', c.version), concat('v', d.vendor_id), 'RUNS', 0.8e0 FROM developed d JOIN components c ON c.comp_id = d.comp_id"""


def topology(t: Lake):
    """Topology rows per vendor; the dependency list is that vendor's own record, as discovery reports it."""
    vendor_deps = t.supplies.select(
        F.col("dst").alias("vendor_id"), F.struct(F.lit("vendor").alias("type"), F.concat(F.lit("v"), "src").alias("name"),
                                                  F.lit(None).cast("string").alias("version")).alias("d"))
    part_deps = t.developed.join(t.components.select("comp_id", "name", "version"), "comp_id").select(
        "vendor_id", F.struct(F.lit("component").alias("type"), F.col("name"), F.col("version")).alias("d"))
    listed = vendor_deps.unionByName(part_deps).select(
        F.concat(F.lit("v"), "vendor_id").alias("vendor_name"), F.array("d").alias("dependencies"))
    cves = t.vendors.select(F.concat(F.lit("v"), "vendor_id").alias("vendor_name"), "cves")
    bare = cves.withColumn("dependencies", F.array().cast(listed.schema["dependencies"].dataType))
    return listed.withColumn("cves", F.lit(0)).unionByName(bare)


@query("g3_build_graph_edges", TOPOLOGY_EDGES)
def g3(t: Lake):
    return graph.build_graph(topology(t))[1]


@query("g3_build_graph_nodes", """SELECT concat('v', vendor_id) AS id, 'Vendor' AS label, cves FROM vendors
 UNION SELECT DISTINCT concat(c.name, '@', c.version), 'Component', 0 FROM developed d JOIN components c ON c.comp_id = d.comp_id""")
def g3_nodes(t: Lake):
    return graph.build_graph(topology(t))[0]


#: Rounds of the check, past the point where ranks change in the places shown.
ROUNDS = 60


def pagerank_sql() -> str:
    text = f"""WITH nodes AS MATERIALIZED (SELECT vendor_id AS id, (0.1e0 + 0.5e0 * cves) / (SELECT sum(0.1e0 + 0.5e0 * cves) FROM vendors) AS p FROM vendors),
 outw AS (SELECT src, sum(weight) AS o FROM supplies GROUP BY src), e AS MATERIALIZED (SELECT s.src, s.dst, s.weight / outw.o AS w FROM supplies s JOIN outw ON outw.src = s.src),
 r0 AS (SELECT id, p, 1e0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""
    for i in range(ROUNDS):
        text += f""",
 f{i} AS (SELECT e.dst AS id, sum(r.rank * e.w) AS x FROM e JOIN r{i} r ON r.id = e.src GROUP BY e.dst),
 r{i + 1} AS MATERIALIZED (SELECT r.id, r.p, 0.85e0 * (coalesce(f.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM outw)) * r.p) + 0.15e0 * r.p AS rank
   FROM r{i} r LEFT JOIN f{i} f ON f.id = r.id)"""
    return text + f" SELECT id, {rounded('rank', 7)} AS rank FROM r{ROUNDS}"


@query("g4_risk_pagerank", pagerank_sql())
def g4(t: Lake):
    out = graph.risk_pagerank(supply_nodes(t), supply_edges(t), tol=1e-13)
    return out.withColumn("rank", half_up(F.col("rank"), 7))


def belief_sql(strength: str, forced: str | None = None) -> str:
    """CTEs b0..b4 by tier: an edge always leads to a higher tier, so five steps settle every vendor.

    `forced` is a query (scenario, id, value); without it there is the one scenario 'observed'.
    """
    scen = f"(SELECT DISTINCT scenario FROM ({forced}) f)" if forced else "(SELECT 'observed' AS scenario)"
    fixed = f"({forced})" if forced else "(SELECT 'none' AS scenario, CAST(-1 AS BIGINT) AS id, 0e0 AS value)"
    text = f"""sc AS {scen}, fx AS {fixed}, st AS (SELECT scenario, vendor_id AS id, tier, least(0.99e0, 0.05e0 + cves * 0.2e0) AS u FROM vendors, sc)"""
    done = ""
    for tier in range(5):
        upstream = (f"coalesce((SELECT product(1 - d.p * s.weight * {strength}) FROM supplies s JOIN ({done}) d ON d.id = s.src AND d.scenario = st.scenario WHERE s.dst = st.id), 1)"
                    if done else "1")
        text += f""",
 b{tier} AS MATERIALIZED (SELECT scenario, id, coalesce(value, u + (1 - safe) - u * (1 - safe)) AS p FROM (
   SELECT st.scenario, st.id, u, fx.value, {upstream} AS safe FROM st LEFT JOIN fx ON fx.scenario = st.scenario AND fx.id = st.id WHERE st.tier = {tier}) x)"""
        done = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(tier + 1))
    return text + f", belief AS ({done})"


@query("g5_propagate_belief", f"WITH {belief_sql('0.9e0')} SELECT id, {rounded('p')} AS p FROM belief")
def g5(t: Lake):
    return graph.propagate_belief(supply_nodes(t), supply_edges(t)).select("id", half_up(F.col("p"), 6).alias("p"))


@query("g6_observational_risk", f"WITH {belief_sql('0.85e0')} SELECT id, {rounded('p')} AS p FROM belief")
def g6(t: Lake):
    out = graph.propagate_belief(supply_nodes(t), supply_edges(t), graph.CAUSAL_STRENGTH)
    return out.select("id", half_up(F.col("p"), 6).alias("p"))


FORCED = """SELECT 'breach' AS scenario, vendor_id AS id, 1e0 AS value FROM vendors WHERE cves > 0
 UNION ALL SELECT 'patched' AS scenario, vendor_id AS id, 0e0 AS value FROM vendors WHERE cves > 0"""


@query("g7_interventions", f"WITH {belief_sql('0.85e0', FORCED)} SELECT scenario, id, {rounded('p')} AS p FROM belief")
def g7(t: Lake):
    forced = t.sql(FORCED)
    out = graph.propagate_belief(supply_nodes(t), supply_edges(t), graph.CAUSAL_STRENGTH, interventions=forced)
    return out.select("scenario", "id", half_up(F.col("p"), 6).alias("p"))


EFFECTS = """SELECT concat(vendor_id, '|', v) AS scenario, vendor_id AS id, CAST(v AS DOUBLE) AS value FROM vendors, (VALUES (0), (1)) x(v)"""


@query("g8_causal_effects", f"""WITH {belief_sql('0.85e0', EFFECTS)}
SELECT s.dst AS target, s.src AS source, {rounded('a.p - b.p')} AS effect FROM supplies s
JOIN belief a ON a.scenario = concat(s.src, '|1') AND a.id = s.dst JOIN belief b ON b.scenario = concat(s.src, '|0') AND b.id = s.dst""")
def g8(t: Lake):
    edges = supply_edges(t)
    pairs = edges.select(F.col("dst").alias("target"), F.col("src").alias("source"))
    return graph.causal_effects(supply_nodes(t), edges, pairs).withColumn("effect", half_up(F.col("effect"), 6))


@query("g9_topological_levels", """WITH RECURSIVE walk AS (SELECT vendor_id AS id, 0 AS level FROM vendors UNION SELECT s.dst, walk.level + 1 FROM walk JOIN supplies s ON s.src = walk.id)
SELECT id, max(level) AS level FROM walk GROUP BY id""")
def g9(t: Lake):
    return graph.topological_levels(supply_nodes(t), supply_edges(t))[0]


@query("a15_graph_summary", """SELECT (SELECT count(*) FROM vendors) AS node_count, (SELECT count(*) FROM supplies) AS edge_count, true AS is_dag""")
def a15(t: Lake):
    return graph.graph_summary(supply_nodes(t), supply_edges(t))


@query("g10_degree_centrality", f"""WITH d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM supplies UNION ALL SELECT dst FROM supplies) x GROUP BY id)
SELECT v.vendor_id AS id, coalesce(degree, 0) AS degree, {rounded('coalesce(degree, 0) / ((SELECT count(*) FROM vendors) - 1)')} AS centrality FROM vendors v LEFT JOIN d ON d.id = v.vendor_id""")
def g10(t: Lake):
    out = graph.degree_centrality(supply_nodes(t), supply_edges(t))
    return out.withColumn("centrality", half_up(F.col("centrality"), 6))


LINKS = """SELECT w.page_id AS src, f.page_id AS dst FROM web_assets w JOIN (SELECT title, min(page_id) AS page_id FROM web_assets GROUP BY title) f ON f.title = w.title
 UNION SELECT w.page_id AS src, f.page_id AS dst FROM web_assets w JOIN (SELECT host, min(page_id) AS page_id FROM web_assets GROUP BY host) f ON f.host = w.host"""


@query("g11_connected_components", f"""WITH RECURSIVE both_ways AS (SELECT src, dst FROM ({LINKS}) l UNION SELECT dst, src FROM ({LINKS}) l),
 reach AS (SELECT page_id AS id, page_id AS other FROM pages UNION SELECT reach.id, b.dst FROM reach JOIN both_ways b ON b.src = reach.other)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def g11(t: Lake):
    return graph.connected_components(t.pages.select(F.col("page_id").alias("id")), t.sql(LINKS))
