"""Hot keys: chunked scans give what plain windows give, and one key holding most rows changes no result."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.operators import aggregates, evaluate, graph, idsets, joins, ledger, remediate, windows
from riskfabric.operators.scan import KeyedScan
from riskfabric.plans import catalog
from riskfabric.streaming import throttle

SPLIT = {"ranges": 13}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}"
        rows.append((key, rng.randrange(400) * 1_000_000, i, rng.choice([None, rng.random() * 100]), rng.random() < 0.5))
    return spark.createDataFrame(rows, "k string, ts_us long, id int, v double, bad boolean").cache()


def same(a, b):
    left = sorted(map(repr, (tuple(r) for r in a.collect())))
    right = sorted(map(repr, (tuple(r) for r in b.collect())))
    assert left == right


@pytest.mark.parametrize("scan", [SPLIT, SPLIT | {"split_over": 300}, {}])
@pytest.mark.parametrize("descending", [False, True])
def test_scans_equal_windows(skewed, descending, scan):
    order = [F.desc("ts_us"), F.desc("id")] if descending else [F.asc("ts_us"), F.asc("id")]
    w = Window.partitionBy("k").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "id", F.row_number().over(w).cast("long").alias("rn"), F.sum(F.col("id").cast("long")).over(running).alias("s"),
        F.last("v", True).over(running).alias("l"), F.lag("id").over(w).alias("id_prev"))
    scan = KeyedScan(skewed, ["k"], ["ts_us", "id"], descending=descending, **scan)
    got = scan.row_number("rn").prefix_sum(F.col("id").cast("long"), "s").last_value(F.col("v"), "l").lag(["id"]).done()
    assert got.select("rn").count() == skewed.count()
    same(got.select("id", "rn", "s", "l", "id_prev"), want)


def test_only_hot_keys_are_laid_out(skewed):
    df = skewed.withColumn("k", F.when(F.col("k") != "k3", F.col("k"))).unionByName(skewed.filter("k = 'hot'").withColumn("k", F.lit(None).cast("string")))
    scan = KeyedScan(df, ["k"], ["ts_us", "id"], split_over=300, **SPLIT)
    assert {r.k for r in scan.df.filter("_chunk <> 0").select("k").distinct().collect()} == {"hot", None}
    assert scan.df.count() == df.count()


def test_scan_without_key(skewed):
    w = Window.orderBy("ts_us", "id")
    want = skewed.select("id", F.row_number().over(w).cast("long").alias("rn"))
    same(KeyedScan(skewed, [], ["ts_us", "id"], **SPLIT).row_number("rn").done().select("id", "rn"), want)


def test_chunks_are_small(skewed):
    scan = KeyedScan(skewed, ["k"], ["ts_us", "id"], **SPLIT)
    largest = scan.df.filter("k = 'hot'").groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert largest < 300


def test_auc_split(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(int(rng.random() < 0.3), rng.randrange(300) / 300) for _ in range(2000)], "y int, p double")
    plain, split = evaluate.roc_auc(df, "y", "p").first(), evaluate.roc_auc(df, "y", "p", **SPLIT).first()
    assert abs(plain.roc_auc - split.roc_auc) < 1e-12


def test_rolling_split(skewed):
    rows = skewed.filter("v IS NOT NULL")
    plain = windows.rolling_zscore(rows, "k", ["ts_us", "id"], "v", 5).select("id", F.round("zscore", 6))
    split = windows.rolling_zscore(rows, "k", ["ts_us", "id"], "v", 5, **SPLIT).select("id", F.round("zscore", 6))
    same(plain, split)


def test_health_split(skewed):
    args = (skewed, "k", ["ts_us", "id"], F.col("bad"), "ts_us")
    columns = ["id", "failures_in_row", "state_after", "state_before"]
    same(windows.source_health(*args).select(*columns), windows.source_health(*args, **SPLIT).select(*columns))


def test_fold_split(skewed):
    rows = skewed.withColumn("r", F.col("bad").cast("int"))
    plain = remediate.fold_q(rows, ["k"], ["ts_us", "id"], "r").select("k", F.round("q", 9))
    same(plain, remediate.fold_q(rows, ["k"], ["ts_us", "id"], "r", **SPLIT).select("k", F.round("q", 9)))


def test_ratings_split(skewed):
    columns = ["id", "score", "origin", "risk_tier"]
    plain = joins.ratings_asof(skewed, "k", ["ts_us", "id"], "v").select(*columns)
    same(plain, joins.ratings_asof(skewed, "k", ["ts_us", "id"], "v", **SPLIT).select(*columns))


def test_triplets_split(spark):
    df = spark.createDataFrame([(i, 0 if i % 3 else i % 5) for i in range(900)], "vec_id int, label int")
    same(joins.mine_triplets(df, "vec_id", "label", seed=3), joins.mine_triplets(df, "vec_id", "label", seed=3, **SPLIT))


def test_outcomes_split(skewed):
    said = skewed.select(F.col("k").alias("a"), "ts_us", (F.coalesce("v", F.lit(0.0)) / 100).alias("p"))
    breaches = skewed.filter("bad").select(F.col("k").alias("a"), "ts_us")
    plain = evaluate.track_outcomes(said, breaches, "a", "ts_us", "p", 0.9, days=1)
    split = evaluate.track_outcomes(said, breaches, "a", "ts_us", "p", 0.9, days=1, **SPLIT)
    same(plain[0], split[0])
    same(plain[1], split[1])


def test_outcomes_equal_brute_force(skewed):
    said = skewed.select(F.col("k").alias("a"), "ts_us", (F.coalesce("v", F.lit(0.0)) / 100).alias("p"))
    breaches = skewed.filter("bad AND id % 5 = 0").select(F.col("k").alias("a"), "ts_us")
    flagged, caught = evaluate.track_outcomes(said, breaches, "a", "ts_us", "p", 0.95, days=0)
    by_key = {}
    for r in breaches.collect():
        by_key.setdefault(r.a, []).append(r.ts_us)
    want = sorted((r.a, r.ts_us, any(t == r.ts_us for t in by_key.get(r.a, []))) for r in said.filter("p >= 0.95").collect())
    assert sorted(tuple(r) for r in flagged.collect()) == want


def test_throttle_equals_serial_bucket(skewed):
    cap, rate = 5.0, 0.2
    rows = skewed.orderBy("ts_us", "id").collect()
    state, want = {}, {}
    for r in rows:
        tokens, last = state.get(r.k, (cap, None))
        ok, tokens, last = throttle.take([r.ts_us], tokens, last, cap, rate)
        state[r.k], want[r.id] = (tokens, last), ok[0]
    for options in ({}, SPLIT):
        out = throttle.throttle(skewed.select("k", "ts_us", "id"), "k", ["ts_us", "id"], cap, rate, **options)
        assert {r.id: r.allowed for r in out.collect()} == want


def test_ranges_nest_and_overlap(spark):
    rng = random.Random(4)
    ranges = [(lo, lo + rng.choice([0, 3, 40, 700, 5000]), f"n{i}") for i, lo in enumerate(rng.randrange(6000) for _ in range(150))]
    ranges += [(0, 1 << 30, "all"), (7, 7, "b"), (7, 7, "a"), (50, 40, "reversed")]
    numbers = [rng.randrange(12_000) for _ in range(700)] + [7] * 300
    texts = [f"0.0.{n >> 8}.{n & 255}" for n in numbers] + [None, "no address", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, ip string")
    table = spark.createDataFrame(ranges, "lo long, hi long, network string")

    def brute(n):
        fits = [(-lo, hi, name) for lo, hi, name in ranges if lo <= n <= hi]
        return min(fits)[2] if fits else None

    want = {i: brute(n) for i, n in enumerate(numbers)} | {len(numbers) + i: None for i in range(3)}
    got = joins.enrich_by_range(df, table, "ip", **SPLIT).collect()
    assert len(got) == len(texts) and {r.id: r.network for r in got} == want
    none = joins.enrich_by_range(df, table.limit(0), "ip", **SPLIT)
    assert none.columns == ["id", "ip", "network"] and none.filter("network IS NOT NULL").count() == 0
    assert joins.enrich_by_range(df.limit(0), table, "ip", **SPLIT).count() == 0


def test_sweep_spreads_one_block(spark):
    """All addresses lie in one /20: the sweep still deals them over all chunks."""
    positions = spark.range(4096).select((F.col("id") + (10 << 24)).alias("_ip"))
    ranges = spark.createDataFrame([(10 << 24, (10 << 24) + 4095)], "lo long, hi long")
    found = joins.innermost_ranges(positions, ranges, **SPLIT)
    assert found.count() == 4096
    laid = KeyedScan(positions, [], ["_ip"], **SPLIT).df.groupBy("_chunk").count().collect()
    assert len(laid) == SPLIT["ranges"] and max(r["count"] for r in laid) < 2 * 4096 / SPLIT["ranges"]


@pytest.mark.parametrize("round_rows", [100, 10_000])
def test_chain_of_one_key(spark, round_rows):
    """One key holds nearly all events, null keys and events included: rounds and the single pass give the same chain."""
    rows = [("hot", i, f'{{"n": {i}}}') for i in range(950)] + [(None, i, None if i == 2 else f"{i}") for i in range(5)] + [("k", 0, '"\u00e9"')]
    df = spark.createDataFrame(rows, "k string, t int, event string")
    chain = ledger.build_chain(df, "k", ["t"], "event", round_rows=round_rows)
    want = []
    for key in ("hot", None, "k"):
        last = ledger.GENESIS_PREV
        for index, event in enumerate([ledger.GENESIS_EVENT] + [e or "null" for k, _, e in rows if k == key]):
            done = hashlib.sha256(f'{{"event": {event}, "index": {index}, "prev_hash": "{last}"}}'.encode()).hexdigest()
            want.append((key, index, event, last, done))
            last = done
    assert sorted(map(tuple, chain.collect()), key=repr) == sorted(want, key=repr)
    assert ledger.build_chain(df.limit(0), "k", ["t"], "event", round_rows=round_rows).count() == 0


def test_profile_by_edges_equals_brute_force(spark):
    """Sets pass along the edges: a hub, ids in several bitmaps, a hot component, cycles; the same as by rows of the reach."""
    rng = random.Random(11)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(0, i) for i in range(1, 12)}
    developed = {(rng.randrange(30), rng.randrange(40) * 3001) for _ in range(200)}
    runs = {(rng.randrange(200_000), c) for _, c in developed for _ in range(4)} | {(d, 3001) for d in range(40_000)}
    vulns = [(c * 3001, f"CVE-{c}-{i}") for c in range(0, 40, 3) for i in range(c % 4)]
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    e = frame(edges, "src long, dst long")
    vendors = frame([(i, i) for i in range(30)], "vendor_id long, security_score int")
    reach = graph.nth_party(e, vendors.selectExpr("vendor_id AS id"))
    tables = [frame(developed, "vendor_id long, comp_id long"), frame(runs, "device_id long, comp_id long"), frame(vulns, "comp_id long, cve string")]
    rows = lambda df: {r.root: (r.vendor_count, r.component_count, r.device_count, r.active_cves) for r in df.collect()}
    got = rows(aggregates.subgraph_profile(reach, vendors, *tables, edges=e))
    for root in range(30):
        near, last = {root}, {root}
        for hop in range(4):
            inner = set(near)
            last = {d for s, d in edges if s in last}
            near |= last
        comps = {c for v, c in developed if v in inner}
        assert got[root] == (len(near), len(comps), len({d for d, c in runs if c in comps}), sum(c in comps for c, _ in vulns)), root
    assert rows(aggregates.subgraph_profile(reach, vendors, *tables)) == got
    plan = aggregates.subgraph_profile(reach, vendors, *tables, edges=e)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_or_agg" not in plan.lower()  # no set leaves a task


@pytest.mark.parametrize("name", ["a1_subgraph_profile", "vendor_risk_prediction"])
def test_profiles_move_no_sets(spark, small_dir, name):
    plan = catalog.queries()[name](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "bitmap" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("matrix, piece, together", [(1, 1, 1), (1 << 13, 1 << 10, 50), (1 << 25, 1 << 24, 1_000_000)])
def test_counts_below_in_slices(monkeypatch, matrix, piece, together):
    """A part with several ranges of ids, negative ones too, in slices and pieces of any size."""
    for name, value in {"MATRIX": matrix, "PIECE": piece, "TOGETHER": together}.items():
        monkeypatch.setattr(idsets, name, value)
    rng = random.Random(7)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    step = idsets.PARTS << idsets.RANGE_BITS  # the next range of the same part
    comps = [rng.choice([-1, 0, 2]) * step + rng.randrange(200) for _ in range(60)]
    developed = {(rng.randrange(25), c) for c in comps for _ in range(2)}
    used = {(c, rng.choice([0, step, 40_000]) + rng.randrange(2000)) for c in comps for _ in range(5)} | {(999, 1)}
    weights = {c: rng.randrange(1, 9) for c in comps[::2]}

    def dealt(pairs, kind, part):
        a, b = (np.array(v, np.int64) for v in zip(*sorted(pairs), strict=True))
        return idsets._blobs(part(a, b).astype(np.int32), a, b, kind)

    zero = lambda a, b: a * 0
    to = lambda ids: (ids >> idsets.RANGE_BITS) % idsets.PARTS
    lines = dealt(edges, idsets.EDGES, zero)
    inputs = [lines, dealt(developed, idsets.OWNED, lambda a, b: to(b)), dealt(used, idsets.USED, lambda a, b: to(a)), dealt(weights.items(), idsets.WEIGHTS, lambda a, b: to(a))]
    out = pa.Table.from_batches(idsets._components(3)(iter(inputs))).to_pylist()
    found = {r["root"]: (r["n"], r["weight"]) for r in out if r["kind"] == idsets.COUNTS}
    devices = {}
    for part in {r["part"] for r in out} - {None}:
        mine = [pa.RecordBatch.from_pylist([r for r in out if r["part"] == part], inputs[0].schema)]
        here = [pa.RecordBatch.from_pylist([{**r, "part": part} for r in lines.to_pylist()], inputs[0].schema)]
        for r in pa.Table.from_batches(idsets._devices(3)(iter(here + mine))).to_pylist():
            devices[r["root"]] = devices.get(r["root"], 0) + r["n"]
    for root in range(25):
        near = {root}
        for _ in range(3):
            near |= {d for s, d in edges if s in near}
        own = {c for v, c in developed if v in near}
        assert found.get(root, (0, 0)) == (len(own), sum(weights.get(c, 0) for c in own)), root
        assert devices.get(root, 0) == len({d for c, d in used if c in own}), root


def test_graph_nodes_are_not_sorted(spark):
    """Nodes are grouped by a flag and a number, so a task holds the distinct ids, not its rows; a vendor name wins over a component."""
    rows = [("v", 2, [("component", "lib", "1"), ("vendor", "w", None)]), ("w", 0, [("component", "lib", "1"), ("vendor", "x", None)]), ("lib@1", 1, [])]
    nodes, _ = graph.build_graph(spark.createDataFrame(rows, "vendor_name string, cves int, dependencies array<struct<type:string,name:string,version:string>>"))
    assert sorted(map(tuple, nodes.collect())) == [("lib@1", "Vendor", 1), ("v", "Vendor", 2), ("w", "Vendor", 0), ("x", "Vendor", 0)]
    assert "SortAggregate" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_causal_effects_equal_two_whole_runs(spark):
    """Parallel edges, weights that make a factor 0, hubs and parents outside a source's reach: as forcing each source in the whole graph."""
    rng = random.Random(3)
    edges = [(s, d, rng.choice([0.3, 1.0, 1 / 0.85])) for s in range(16) for d in range(s + 1, 16) if rng.random() < 0.3] + [(0, 15, 0.5)] * 2
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, i % 3) for i in range(16)], "id long, cves int")
    asked = sorted({(d, s) for s, d, _ in edges} | {(3, 9), (14, 0), (99, 1)})
    got = {(r.target, r.source): r.effect for r in graph.causal_effects(nodes, e, spark.createDataFrame(asked, "target long, source long")).collect()}
    forced = spark.createDataFrame([(f"{s}|{v}", s, float(v)) for s in range(16) for v in (0, 1)], "scenario string, id long, value double")
    whole = {(r.scenario, r.id): r.p for r in graph.propagate_belief(nodes, e, graph.CAUSAL_STRENGTH, interventions=forced).collect()}
    assert set(got) == set(asked) and got[99, 1] == 0.0
    for (target, source), effect in got.items():
        if target != 99:
            assert effect == pytest.approx(whole[f"{source}|1", target] - whole[f"{source}|0", target], abs=1e-12)
