"""Joins of the risk domain: feeds, shadow assets, as-of ratings, endpoint checks, triplets, enrichment."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators.normalize import DEFAULT_RATING, rating_tier
from riskfabric.operators.scan import KeyedScan
from riskfabric.session import cut

# The shadow exposure.
SHADOW_TEXT = "Asset %s (%s) was discovered externally but is not present in internal telemetry systems (Splunk/Sentinel)."
SHADOW_TITLE = "Unmanaged Shadow IT Asset"
SHADOW_REMEDIATION = (
    "Investigate the asset owner and onboard it into internal telemetry or decommission it."
)
SHADOW_CONFIDENCE = 0.9


def match_vulns(components: DataFrame, feed: DataFrame) -> DataFrame:
    """Components with the number of feed entries and the first CVE, by purl or else by lower-case name.

    The feed is reduced per key first: a name shared by many components and many entries joins one row.
    """
    def per(key: str) -> DataFrame:
        return feed.groupBy(F.col(key).alias(f"_{key}")).agg(
            F.count(F.lit(1)).alias(f"_{key}_n"), F.min("cve").alias(f"_{key}_cve"))

    joined = components.join(per("purl"), F.col("purl") == F.col("_purl"), "left").join(
        per("name"), F.lower(F.col("name")) == F.col("_name"), "left")
    return joined.select(
        *components.columns,
        F.when(F.col("_purl").isNotNull(), "purl").when(F.col("_name").isNotNull(), "name").alias("matched_by"),
        F.coalesce("_purl_n", "_name_n", F.lit(0)).alias("cve_count"),
        F.coalesce("_purl_cve", "_name_cve").alias("first_cve"))


def shadow_candidates(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """External address or domain assets without a host or cloud neighbour over resolves_to / hosts."""
    internal = assets.filter(F.col("type").isin("host", "cloud-resource")).select(F.col("id").alias("other"))
    external = assets.filter(
        F.col("type").isin("ipv4-addr", "domain-name")
        & ~F.col("id").startswith("asset--splunk") & ~F.col("id").startswith("asset--sentinel"))
    both = edges.filter(F.col("type").isin("resolves_to", "hosts")).select(
        F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.col("dst").alias("other")),
            F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e")).select("e.id", "e.other")
    known = both.join(internal, "other", "left_semi").select("id")
    return external.join(known, "id", "left_anti")


def shadow_assets(assets: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """The scan's report by id: all shadow assets, or the first page of `limit` if the caller asks for one."""
    found = shadow_candidates(assets, edges).orderBy("id")
    return found if limit is None else found.limit(limit)


def shadow_exposures(shadow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exposure rows and edges with ids derived from the asset, so a repeated scan changes nothing."""
    ident = F.concat(F.lit("exposure--shadow-it--"), "id")
    text = F.format_string(SHADOW_TEXT, F.col("value"), F.col("type"))
    exposures = shadow.select(
        ident.alias("id"), F.lit(SHADOW_TITLE).alias("title"), text.alias("description"),
        F.lit("HIGH").alias("severity"), F.lit(SHADOW_REMEDIATION).alias("remediation"))
    edges = shadow.select(
        F.col("id").alias("src"), ident.alias("dst"), F.lit("has_exposure").alias("type"),
        F.lit(SHADOW_CONFIDENCE).alias("confidence"))
    return exposures, edges


def details_of(ids: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Detail rows of the listed ids."""
    return details.join(ids.select(key), key, "left_semi")


def ratings_asof(df: DataFrame, entity: str, order: list[str], rating: str, **scan: float) -> DataFrame:
    """Current rating, else the last one seen for the entity, else the fallback."""
    carried = KeyedScan(df, [entity], order, **scan).last_value(F.col(rating), "_last").done()
    score = F.coalesce("_last", F.lit(DEFAULT_RATING))
    origin = F.when(F.col(rating).isNotNull(), "provider").when(F.col("_last").isNotNull(), "cache").otherwise("fallback")
    tier = F.when(origin == "fallback", F.lit("Medium")).otherwise(rating_tier(score))
    return carried.withColumns({"score": score, "origin": origin, "risk_tier": tier}).drop("_last")


def insertable_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two endpoints exist, and the rest for the quarantine."""
    ids = nodes.select("id").distinct()
    flagged = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(
        ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    error = F.when(F.col("_s").isNull(), "source missing").when(F.col("_d").isNull(), "target missing")
    judged = cut(flagged.withColumn("error", error).drop("_s", "_d"))
    good = judged.filter(F.col("error").isNull()).select(*edges.columns)
    return good, judged.filter(F.col("error").isNotNull()).select(*edges.columns, "error")


def mine_triplets(df: DataFrame, ident: str, category: str, seed: int = 0, **scan: float) -> DataFrame:
    """(anchor, positive, negative): another row of the same category and one of the next category.

    Rows are numbered within their category by a chunked scan; partners are found by equi-joins on
    (category, number), one each, so no category is ever paired with itself or another in full.
    """
    placed = KeyedScan(df.select(ident, category), [category], [ident], **scan).row_number("_n").done().withColumn(
        "_n", F.col("_n") - 1)
    sizes = placed.groupBy(category).agg(F.count(F.lit(1)).alias("_size"))
    # The category after this one in order; the last wraps to the first.
    first = sizes.agg(F.min(category)).scalar()
    following = KeyedScan(sizes.select(category), [], [category], descending=True).lag([category]).done().withColumn(
        "_other", F.coalesce(f"{category}_prev", first)).filter(F.col("_other") != F.col(category)).select(category, "_other")
    plan = sizes.join(following, category).join(
        sizes.select(F.col(category).alias("_other"), F.col("_size").alias("_other_size")), "_other")
    rows = placed.join(plan, category).filter(F.col("_size") > 1)
    shift = F.lit(1) + F.pmod(F.lit(seed), F.col("_size") - 1)
    asked = rows.select(
        F.col(ident).alias("anchor"), category, "_other",
        F.pmod(F.col("_n") + shift, F.col("_size")).alias("_pos"),
        F.pmod(F.col("_n") + F.lit(seed), F.col("_other_size")).alias("_neg"))
    partner = placed.select(F.col(category).alias("_cat"), F.col("_n").alias("_at"), F.col(ident).alias("_id"))
    positive = asked.join(partner, (asked[category] == partner["_cat"]) & (asked["_pos"] == partner["_at"])).select(
        "anchor", category, "_other", "_neg", F.col("_id").alias("positive"))
    return positive.join(partner, (positive["_other"] == partner["_cat"]) & (positive["_neg"] == partner["_at"])).select(
        "anchor", "positive", F.col("_id").alias("negative"), category)


def ipv4_number(ip: Column) -> Column:
    """Number of a dotted address; null where a part is no number."""
    parts = F.split(ip, r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.try_cast("long"))


def enrich_by_domain(df: DataFrame, registry: DataFrame, domain: str) -> DataFrame:
    return df.join(registry, domain, "left")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, position, end) in order; an end opens a range, none asks for the open range that started last.

    The heap holds the open ranges of one chunk; a range whose end is passed never comes back, so it is dropped when it surfaces.
    """
    chunk, open_ranges = None, []
    for batch in batches:
        found = []
        for at, position, end in zip(*[batch.column(c).to_pylist() for c in ("_chunk", "_at", "_end")]):
            if at != chunk:
                chunk, open_ranges = at, []
            if end is not None:
                heapq.heappush(open_ranges, (-position, end))
                continue
            while open_ranges and open_ranges[0][1] < position:
                heapq.heappop(open_ranges)
            if open_ranges:
                found.append((position, -open_ranges[0][0], open_ranges[0][1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["_ip", "_lo", "_hi"])


def innermost_ranges(positions: DataFrame, networks: DataFrame, **scan: int) -> DataFrame:
    """(_ip, _lo, _hi): for each of the distinct `positions(_ip)` the range that started last before it, then the shortest.

    An interval sweep: positions and range starts are laid out together by order, a range that reaches into later chunks opens
    in each of them again, and every chunk is swept on its own. Ranges may nest and overlap.
    """
    none = F.lit(None).cast("long")
    starts = networks.select(F.col("lo").cast("long").alias("_at"), F.col("hi").cast("long").alias("_end")).filter(
        F.col("_at") <= F.col("_end")).distinct().withColumn("_kind", F.lit(0))
    asked = positions.select(F.col("_ip").alias("_at"), none.alias("_end"), F.lit(1).alias("_kind"))
    laid = KeyedScan(starts.unionByName(asked), [], ["_at", "_kind", "_end"], split_over=0, **scan).df
    # One entry per chunk, so at most as many as the layout has.
    borders = laid.filter(F.col("_kind") == 1).groupBy("_chunk").agg(F.min("_at").alias("least")).agg(
        F.collect_list(F.struct(F.col("_chunk").alias("c"), "least")))
    reached = F.filter("_borders", lambda b: (b["c"] > F.col("_chunk")) & (b["least"] <= F.col("_end")))
    again = laid.filter(F.col("_kind") == 0).withColumn("_borders", borders.scalar()).withColumn("_b", F.explode(reached)).select(
        "_at", "_end", "_kind", F.col("_b.c").alias("_chunk"))
    rows = laid.unionByName(again).repartition("_chunk").sortWithinPartitions("_chunk", "_at", "_kind")
    return rows.select("_chunk", "_at", "_end").mapInArrow(_sweep, "_ip long, _lo long, _hi long")


def enrich_by_range(df: DataFrame, networks: DataFrame, ip: str, **scan: int) -> DataFrame:
    """Attributes of the address range (lo to hi, both included) an address falls in.

    Of several ranges the one that starts last wins, then the shortest, then the least attributes; an address in none, null or
    not an address gets nulls. The ranges are found once per distinct address, so a frequent one costs the sweep a single row.
    """
    other = [c for c in networks.columns if c not in ("lo", "hi")]
    rows = df.withColumn("_ip", ipv4_number(F.col(ip)))
    distinct = rows.select("_ip").filter(F.col("_ip").isNotNull()).distinct()
    packed = networks.groupBy(F.col("lo").cast("long").alias("_lo"), F.col("hi").cast("long").alias("_hi")).agg(F.min(F.struct(*other)).alias("_r"))
    found = innermost_ranges(distinct, networks, **scan).join(packed, ["_lo", "_hi"]).select("_ip", "_r.*")
    return rows.join(found, "_ip", "left").select(*[rows[c] for c in df.columns], *[found[c] for c in other])
