"""Aggregations: subgraph profiles, run counters, secret shares, feedback, scan summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators import idsets
from riskfabric.operators.risk import DEFAULT_VENDOR_RATING

MODULUS = 1_000_003

# Nodes counted per fused item.
PER_COMPONENT, PER_MODEL, PER_BINARY, PER_ACTOR, PER_DEVICE = 2, 3, 1, 2, 1


def _bits(df: DataFrame, owner: list[str], ident: str) -> DataFrame:
    """(owner, _b, _bits): the ids of each owner as one bitmap per 32,768 ids. Ids move as rows; bitmaps are made where their owner lies."""
    return df.repartition(owner[0]).groupBy(*owner, F.bitmap_bucket_number(F.col(ident)).alias("_b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ident))).alias("_bits"))


#: Bits of a bitmap.
BUCKET = 32_768


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vendor_id, _b, _at) in order of the first two -> (vendor_id, _b, _bits), a row per key and batch."""
    for batch in batches:
        owner, bucket = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])))) if len(owner) else []
        ends = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        at = batch.column(2).flatten().to_numpy()
        for lo in range(0, len(first), 256):
            rows = np.append(first[lo:lo + 257], len(owner))[:257]
            edges = ends[rows]
            keys = rows[:-1]
            bits = np.zeros((len(keys), BUCKET), dtype=bool)
            bits[np.repeat(np.arange(len(keys)), np.diff(edges)), at[edges[0]:edges[-1]]] = True
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array(owner[keys]), pa.array(bucket[keys]), pa.array([p.tobytes() for p in packed], pa.binary())], ["vendor_id", "_b", "_bits"])


def _users(developed: DataFrame, runs: DataFrame) -> DataFrame:
    """(vendor_id, _b, _bits): devices that run a component of the vendor, perhaps in several bitmaps of one key.

    A component has few devices, so these travel as lists of two bytes each, and only a vendor's become a bitmap, batch by batch.
    """
    held = runs.groupBy("comp_id", F.bitmap_bucket_number(F.col("device_id")).alias("_b")).agg(
        F.collect_list(F.bitmap_bit_position(F.col("device_id")).cast("short")).alias("_at"))
    fanned = developed.select(F.col("vendor_id").cast("long").alias("vendor_id"), "comp_id").join(held, "comp_id").select("vendor_id", "_b", "_at")
    return fanned.repartition("vendor_id", "_b").sortWithinPartitions("vendor_id", "_b").mapInArrow(_pack, "vendor_id bigint, _b bigint, _bits binary")


def subgraph_profile(reach: DataFrame, vendors: DataFrame, developed: DataFrame, runs: DataFrame,
                     vulns: DataFrame, depth: int = 4, edges: DataFrame | None = None) -> DataFrame:
    """Per root: distinct vendors, components and devices in its subgraph, rating sum and mean, active CVEs.

    A node counts once however many ways lead to it. Components lie one hop below their vendor, so vendors at the depth
    limit add none. RUNS leads from a device to a component and a directed walk meets no device there; devices are
    those that run a component of the subgraph. A component's CVEs count once. Ids are whole numbers. With the `edges(src, dst)` that `reach`
    was walked over, sets are passed and counted within tasks (`idsets`); without them, bitmaps are or-ed per root, one per row of `reach`.
    """
    cves = vulns.groupBy("comp_id").agg(F.count(F.lit(1)).alias("_cves"))
    if edges is not None:
        sets = [idsets.counts_below(edges, developed, runs, cves, depth - 1)]
    else:
        parts = _bits(developed.join(cves, "comp_id", "left").withColumn("_cves", F.coalesce("_cves", F.lit(0))), ["vendor_id", "_cves"], "comp_id")
        inner = reach.filter(F.col("depth") < depth).select("root", F.col("node").alias("vendor_id"))

        def below(own: DataFrame, keys: list[str]) -> DataFrame:
            return inner.join(own, "vendor_id").groupBy("root", *keys).agg(F.bitmap_or_agg("_bits").alias("_bits"))

        sized = F.bitmap_count("_bits")
        sets = [below(parts, ["_b", "_cves"]).select("root", "_cves", sized.alias("_n")).groupBy("root").agg(
                    F.sum("_n").alias("component_count"), F.sum(F.col("_n") * F.col("_cves")).alias("active_cves")),
                below(_users(developed, runs), ["_b"]).select("root", sized.alias("_n")).groupBy("root").agg(F.sum("_n").alias("device_count"))]
    counted = reach.join(vendors.select(F.col("vendor_id").alias("node"), "security_score"), "node").groupBy("root").agg(
        F.count(F.lit(1)).alias("vendor_count"), F.sum("security_score").alias("rating_sum"))
    rating = F.when(F.col("vendor_count") > 0, F.col("rating_sum") / F.col("vendor_count")).otherwise(
        F.lit(DEFAULT_VENDOR_RATING))
    full = counted
    for found in sets:
        full = full.join(found, "root", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("component_count", "device_count", "active_cves")}).withColumn("avg_rating", rating)


def affected_counts(components: Column, models: Column, binaries: Column, actors: Column, devices: Column) -> Column:
    """Nodes touched by fusing one signal: its identity plus what each section adds."""
    zero = F.lit(0)
    return (
        F.lit(1) + F.coalesce(components, zero) * PER_COMPONENT + F.coalesce(models, zero) * PER_MODEL
        + F.coalesce(binaries, zero) * PER_BINARY + F.coalesce(actors, zero) * PER_ACTOR
        + F.coalesce(devices, zero) * PER_DEVICE
    )


def split_shares(df: DataFrame, owner: str, secret: str, parties: int, seed: int, modulus: int = MODULUS) -> DataFrame:
    """Additive shares: all but the last are drawn by a keyed hash, the last completes the secret."""
    if parties < 2:
        raise ValueError("at least 2 parties")
    def drawn(i: int) -> Column:
        digits = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(owner).cast("string"), F.lit(str(i))), 256)
        return F.pmod(F.conv(F.substring(digits, 1, 12), 16, 10).cast("long"), F.lit(modulus))

    first = [drawn(i) for i in range(parties - 1)]
    total = first[0]
    for share in first[1:]:
        total = total + share
    shares = F.array(*first, F.pmod(F.col(secret).cast("long") - total, F.lit(modulus)))
    return df.select(owner, F.posexplode(shares).alias("party", "share"))


def aggregate_shares(shares: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """Sum per party, then over the parties, both modulo."""
    local = shares.groupBy("party").agg(F.pmod(F.sum("share"), F.lit(modulus)).alias("local_sum"))
    return local.agg(F.pmod(F.sum("local_sum"), F.lit(modulus)).alias("global_sum"), F.count(F.lit(1)).alias("parties"))


def feedback_targets(df: DataFrame, asset: str, label: str) -> DataFrame:
    target = F.when(F.col(label) == 1, 1.0).otherwise(-1.0)
    return df.groupBy(asset).agg(F.avg(target).alias("mean_target"), F.count(F.lit(1)).alias("feedback"))


def scan_summary(issues: DataFrame, by: str, kind: str) -> DataFrame:
    """Issue counts by source and kind with all subtotals."""
    return issues.cube(by, kind).agg(F.count(F.lit(1)).alias("issues"))
