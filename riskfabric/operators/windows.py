"""Upserts, rolling scores, health states, workflow replay, rankings and fan-out to the graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.operators.scan import KeyedScan

FAILURES_TO_OPEN = 5
RECOVERY_SECONDS = 60


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], stamp: str) -> DataFrame:
    """Last write wins per property, first and last time kept; one aggregate, no sort, combines map-side."""
    both = old.unionByName(new, allowMissingColumns=True)
    place = F.struct(*order)
    values = [c for c in both.columns if c not in (*keys, *order, stamp)]
    return both.groupBy(*keys).agg(
        F.min(stamp).alias("first_seen"), F.max(stamp).alias("last_seen"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in values])


def rolling_zscore(df: DataFrame, key: str, order: list[str], value: str, n: int, **scan: float) -> DataFrame:
    """Deviation of each value from the mean of the n before it, in their sample deviations.

    Null until two values precede, and where they do not vary. A hot key is cut into runs of rows; each run
    gets a copy of the n rows before it, which serve as context and are dropped again.
    """
    length = max(n * 16, 10_000)
    rows = KeyedScan(df, [key], order, **scan).row_number("_rn").done().withColumn("_run", F.floor((F.col("_rn") - 1) / length))
    tail = (F.col("_rn") - 1) % length >= length - n
    copies = F.array(F.struct(F.col("_run").alias("r"), F.lit(False).alias("c")), F.struct((F.col("_run") + 1).alias("r"), F.lit(True).alias("c")))
    single = F.slice(copies, 1, 1)
    rows = rows.withColumn("_t", F.explode(F.when(tail, copies).otherwise(single))).withColumns(
        {"_run": F.col("_t.r"), "_context": F.col("_t.c")}).drop("_t", "_rn")
    frame = Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(-n, -1)
    mean, std = F.avg(value).over(frame), F.stddev_samp(value).over(frame)
    scored = rows.withColumn("zscore", F.when(std > 0, (F.col(value) - mean) / std))
    return scored.filter(~F.col("_context")).drop("_context", "_run")


def source_health(results: DataFrame, source: str, order: list[str], failed: Column, ts_us: str,
                  threshold: int = FAILURES_TO_OPEN, recovery: int = RECOVERY_SECONDS, **scan: float) -> DataFrame:
    """Failures in a row, breaker state after each result, and the state the request met."""
    marked = results.withColumn("_f", failed.cast("int"))
    scanner = KeyedScan(marked, [source], order, **scan).prefix_sum(F.col("_f"), "_fails")
    scanner.last_value(F.when(F.col("_f") == 0, F.col("_fails")), "_base")
    in_row = F.col("_fails") - F.coalesce("_base", F.lit(0))
    scanner.df = scanner.df.withColumn("failures_in_row", in_row).withColumn(
        "state_after", F.when(F.col("failures_in_row") >= threshold, "OPEN").otherwise("CLOSED"))
    lagged = scanner.lag(["state_after", ts_us]).done()
    waited = F.col(ts_us) - F.col(f"{ts_us}_prev") > recovery * 1_000_000
    met = F.when(F.col("state_after_prev") == "OPEN", F.when(waited, "HALF_OPEN").otherwise("OPEN")).otherwise("CLOSED")
    return lagged.withColumn("state_before", met).drop("state_after_prev", f"{ts_us}_prev", "_f", "_fails", "_base")


def workflow_state(events: DataFrame, key: str, order: str, kind: str, needs_evidence: Sequence[bool]) -> DataFrame:
    """State of each guided workflow after replaying its start, advance and evidence events.

    A step is left by the first matching event after the previous step was left, whatever else happens in
    between, so replay is one minimum per step: an aggregate that combines map-side however long a log is.
    """
    started = events.groupBy(key).agg(F.min(F.when(F.col(kind) == "start", F.col(order))).alias("_at"))
    current = started.withColumn("_step", F.lit(0))
    for needed in needs_evidence:
        wanted = "evidence" if needed else "advance"
        later = events.join(current.select(key, "_at"), key).filter(F.col(order) > F.col("_at"))
        left = later.groupBy(key).agg(F.min(F.when(F.col(kind) == wanted, F.col(order))).alias("_next"))
        current = current.join(left, key, "left").select(
            key, F.col("_next").alias("_at"), (F.col("_step") + F.col("_next").isNotNull().cast("int")).alias("_step"))
    base = started.select(key, F.col("_at").isNotNull().alias("_started"))
    waiting = reduce(lambda a, b: a | b, [(F.col("_step") == i) for i, e in enumerate(needs_evidence) if e], F.lit(False))
    state = (
        F.when(~F.col("_started"), "PENDING").when(F.col("_step") >= len(needs_evidence), "COMPLETED")
        .when(waiting, "WAITING_EVIDENCE").otherwise("IN_PROGRESS"))
    return base.join(current, key).select(key, F.col("_step").alias("step_index"), state.alias("state"))


def recent_k(df: DataFrame, thread: str, order: str, k: int) -> DataFrame:
    """The k latest rows of each thread; Spark keeps k per task before the shuffle."""
    w = Window.partitionBy(thread).orderBy(F.desc(order))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_similar(base: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, block_rows: int = 32_768, query_rows: int = 4_096) -> DataFrame:
    """(query, ident, score, rank): exact cosine neighbours of all query rows among all base rows of another id.

    Base rows are dealt to blocks and queries to groups, by place and not by id, so copies of one id spread. Each block meets each group once in a matrix
    product, from which k rows per query go on to the ranking. Null vectors count as zero, shorter ones end in zeros; the score of a zero vector
    is 0, equal scores go to the smaller id.
    """
    blocks, groups = (max(1, -(-rows.count() // size)) for rows, size in ((base, block_rows), (queries, query_rows)))
    place = F.monotonically_increasing_id()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    values = F.transform(F.coalesce(F.col(vector), F.array()), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    left = base.select(F.col(ident).alias("_id"), values.alias("_x"), F.pmod(place, F.lit(blocks)).cast("int").alias("_block")).withColumn("_group", every(groups))
    right = queries.select(F.col(ident).alias("_id"), values.alias("_x"), F.pmod(place, F.lit(groups)).cast("int").alias("_group")).withColumn("_block", every(blocks))
    kind = base.schema[ident].dataType.simpleString()

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query", asked.schema.field("_id").type), (ident, rows.schema.field("_id").type), ("score", pa.float64())])
        out = [[], [], []]
        if rows.num_rows and asked.num_rows:
            width = max(pc.max(pc.list_value_length(t.column("_x"))).as_py() for t in (rows, asked)) or 1
            x, q = (_padded(t.column("_x").combine_chunks(), width) for t in (rows, asked))
            ids, qids = (t.column("_id").to_pylist() for t in (rows, asked))
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
            x, ids = x[order], [ids[i] for i in order]
            sizes = np.sqrt(_in_order(x, x))
            for start in range(0, len(q), 256):
                part = q[start:start + 256]
                lengths = np.sqrt(_in_order(part, part))
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = np.nan_to_num((part @ x.T) / (lengths[:, None] * sizes), nan=0.0, posinf=0.0, neginf=0.0)
                for row, own, size, vec in zip(near, qids[start:], lengths, part, strict=False):
                    # The product's sums have another order than a row's own; what could be among the k is computed anew, component by component.
                    least = np.partition(row, -k - 1)[-k - 1] if len(row) > k + 1 else -2.0
                    maybe = [i for i in np.flatnonzero(row >= least - 1e-8) if ids[i] != own]
                    if len(maybe) < k and len(row) > k + 1:
                        maybe = [i for i in range(len(row)) if ids[i] != own]
                    exact = _in_order(x[maybe], vec[None, :])
                    scale = sizes[maybe] * size
                    scores = np.where(scale > 0, exact / np.where(scale > 0, scale, 1.0), 0.0)
                    best = sorted(zip((-scores).round(9).tolist(), maybe))[:k]
                    out[0] += [own] * len(best)
                    out[1] += [ids[i] for _, i in best]
                    out[2] += [-s for s, _ in best]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    keys = ["_block", "_group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query {kind}, `{ident}` {kind}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), ident)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed component by component."""
    total = np.zeros(max(len(a), len(b)))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def job_order(jobs: DataFrame, target: str, order: list[str], **scan: float) -> DataFrame:
    """Place of each job in its target's queue."""
    return KeyedScan(jobs, [target], order, **scan).row_number("position").done()


def page(df: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1..1000")
    return df.orderBy(order).offset(offset).limit(limit)


def signals_to_graph(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows and edge rows of fused signals, several per signal, by signal type.

    Input: signal_id, ts_us, type, entity, package, version, actors, ip_address, cves, score, open_ports (none where the
    column is missing). A device keeps the ports and CVEs of its latest scan, empty lists included.
    """
    ident = F.concat(F.lit("Identity:"), "entity")
    comp_version = F.when(F.col("type") == "vulnerability", F.lit("unknown")).otherwise(F.coalesce("version", F.lit("0.0.0")))
    comp = F.concat(F.lit("SoftwareComponent:pkg:generic/"), "package", F.lit("@"), comp_version)
    device = F.concat(F.lit("Device:"), "ip_address")
    has_comp = F.col("type").isin("sbom", "vulnerability") & F.col("package").isNotNull()
    has_device = (F.col("type") == "network_scan") & F.col("ip_address").isNotNull()
    no_actor = F.array().cast("array<string>")
    actors = F.when(F.col("type") == "report", F.coalesce("actors", no_actor)).otherwise(no_actor)
    vulns = F.when(has_device, F.coalesce("cves", no_actor)).otherwise(no_actor)

    def node(cond: Column, key: Column, label: str) -> Column:
        return F.when(cond, F.struct(key.alias("id"), F.lit(label).alias("label")))

    def edge(cond: Column, src: Column, dst: Column, kind: str, confidence: float) -> Column:
        return F.when(cond, F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))

    always = F.lit(True)
    one_nodes = F.array_compact(F.array(
        node(always, ident, "Identity"), node(has_comp, comp, "SoftwareComponent"), node(has_device, device, "Device")))
    actor_nodes = F.transform(actors, lambda a: F.struct(F.concat(F.lit("ThreatActor:"), a).alias("id"), F.lit("ThreatActor").alias("label")))
    vuln_nodes = F.transform(vulns, lambda v: F.struct(F.concat(F.lit("Vulnerability:"), v).alias("id"), F.lit("Vulnerability").alias("label")))
    no_port = F.array().cast("array<int>")
    ports = F.coalesce("open_ports", no_port) if "open_ports" in df.columns else no_port
    scanned = F.col("label") == "Device"
    nodes = df.select("ts_us", "signal_id", F.col("score").alias("_score"), ports.alias("_ports"), F.coalesce("cves", no_actor).alias("_cves"),
                      F.inline(F.concat(one_nodes, actor_nodes, vuln_nodes))).select(
        "id", "label", F.when(F.col("label") == "Identity", F.col("_score")).alias("security_score"),
        F.when(scanned, F.col("_ports")).alias("open_ports"), F.when(scanned, F.col("_cves")).alias("cves"), "ts_us", "signal_id")
    one_edges = F.array_compact(F.array(edge(has_comp, ident, comp, "DEVELOPED", 1.0)))
    actor_edges = F.transform(actors, lambda a: F.struct(
        F.concat(F.lit("ThreatActor:"), a).alias("src"), ident.alias("dst"), F.lit("TARGETS").alias("type"), F.lit(0.85).alias("confidence")))
    vuln_edges = F.transform(vulns, lambda v: F.struct(
        device.alias("src"), F.concat(F.lit("Vulnerability:"), v).alias("dst"), F.lit("HAS_VULNERABILITY").alias("type"), F.lit(1.0).alias("confidence")))
    edges = df.select("ts_us", "signal_id", F.inline(F.concat(one_edges, actor_edges, vuln_edges))).select(
        "src", "dst", "type", "confidence", "ts_us", "signal_id")
    return nodes, edges
