"""Streams: state over several micro-batches, quarantine, run log, replays, and the same answer as the batch form."""

from __future__ import annotations

import json
import random
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from riskfabric.operators import models, windows
from riskfabric.plans import catalog
from riskfabric.plans import landing as feeds
from riskfabric.session import ensure_checkpoint_dir, scratch
from riskfabric.sources import graphstore, landing, schemas, streams
from riskfabric.streaming import jobs, ordered, throttle, workflow
from riskfabric.streaming.ordered import PROVIDER, ROCKSDB


def lines(spark, folder, rows):
    spark.createDataFrame([json.dumps(r) if not isinstance(r, str) else r for r in rows], "string").coalesce(1).write.mode("append").text(folder)


def parsed(spark, folder, schema):
    raw = streams.read_values(spark, {"path": folder}, "text")
    return raw.select(F.from_json("value", schema).alias("s")).select("s.*")


def test_configured_checkpoint_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    used = ensure_checkpoint_dir(spark)
    if configured:
        assert configured.rstrip("/") in used
    assert scratch(spark, "x").startswith(used)


def test_helpers_travel_to_workers():
    """The pickled helper runs where the package cannot be imported."""
    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); print(f([0, 1], 1.0, None, 1.0, 1.0)[0], 'riskfabric' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(throttle.take), capture_output=True, cwd="/", check=True)
    assert out.stdout.decode().strip() == "[True, False] False"


@pytest.mark.parametrize("batches", [1, 3, 50])
def test_bucket_stream_equals_the_batch_form(spark, batches):
    """However rows are cut into micro-batches, out of order within the delay; a third of them have one key, some keys fall idle."""
    folder, rng = scratch(spark, "bucket"), random.Random(batches)
    rows = [{"id": i, "k": "hot" if i % 3 == 0 else f"k{rng.randrange(4 + i // 100)}", "ts": 10**12 + i * 300_000 + rng.randrange(5_000_000)} for i in range(600)]
    schema = "id long, k string, ts long"
    size = -(-len(rows) // batches)
    for n in range(batches):
        part = rows[n * size:(n + 1) * size]
        rng.shuffle(part)
        lines(spark, f"{folder}/in", part)
    end = {"id": -1, "k": "heartbeat", "ts": 10**13}
    lines(spark, f"{folder}/in", [end])
    raw = streams.read_values(spark, {"path": f"{folder}/in", "maxFilesPerTrigger": "1"}, "text")
    stream = throttle.throttle_stream(raw.select(F.from_json("value", schema).alias("s")).select("s.*"), "k", "id", "ts", 3.0, 1.0, "20 seconds", slice_ms=7_000)
    got = {r.id: r.allowed for r in streams.drain(stream, folder).collect() if r.id >= 0}
    batch = throttle.throttle(spark.createDataFrame([(r["id"], r["k"], r["ts"]) for r in rows], schema), "k", ["ts", "id"], 3.0, 1.0)
    want = {r.id: r.allowed for r in batch.collect()}
    assert got == want and not all(want.values())


class Store:
    """What a processor keeps, without Spark."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        return State(self.values, name)

    def getMapState(self, name, key, value):
        return Pairs(self.values, name)

    def registerTimer(self, at):
        self.timers.append(at)


class State:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value

    def clear(self):
        self.values.pop(self.name, None)


class Pairs:
    def __init__(self, values, name):
        self.held, self.read = values.setdefault(name, {}), 0

    def keys(self):
        return list(self.held)

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


def test_ordered_fold_holds_back_and_lets_go():
    """Late rows wait for the watermark, pieces are not put together, an idle key leaves nothing."""
    log = []

    def fold(key, state, rows):
        log.append(rows)
        return ((state or (0,))[0] + len(rows),), [(key[0], r[1]) for r in rows]

    fold_of = ordered.OrderedFold(["ts", "id"], "n long", fold, ["k", "id"], idle_ms=1000, slice_ms=10)
    store = Store()
    fold_of.init(store)
    piece = lambda *rows: pd.DataFrame(rows, columns=["ts", "id"])
    clock = lambda ms: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    run = lambda pieces, ms: [i for out in fold_of.handleInputRows(("a",), iter(pieces), clock(ms)) for i in out["id"]]
    assert run([piece((25_000, 1), (3_000, 2)), piece((14_000, 3), (15_500, 4))], 0) == [] and store.timers == [1]
    assert run([piece((2_000, 5))], 15) == [5, 2, 3] and store.timers[-1] == 16
    assert run([], 16) == [4] and [i for out in fold_of.handleExpiredTimer(("a",), clock(26), None) for i in out["id"]] == [1]
    assert store.values["value"] == (5,) and not store.values["waiting"] and store.timers[-1] == 1026
    assert all(len({r[0] // 10_000 for r in rows}) == 1 for rows in log)
    assert list(fold_of.handleExpiredTimer(("a",), clock(1026), None)) == []
    assert store.values == {"waiting": {}}
    assert list(fold_of.handleExpiredTimer(("a",), clock(2000), None)) == []


def test_few_rows_cost_few_calls():
    """A key with few rows reads and writes its state a fixed number of times, however many slices they lie in; one with many goes to blocks."""
    def fold(key, state, rows):
        return ((state or (0,))[0] + len(rows),), [(key[0], r[1]) for r in rows]

    calls = []
    for rows, most in ((60, 12), (ordered.FEW * 2, 10**9)):
        store = Store()
        fold_of = ordered.OrderedFold(["ts", "id"], "n long", fold, ["k", "id"], idle_ms=1000, slice_ms=10)
        fold_of.init(store)
        calls.clear()
        for state in (fold_of.place, fold_of.value, fold_of.waiting):
            for name in ("exists", "get", "update", "clear", "keys", "getValue", "updateValue", "removeKey"):
                if hasattr(state, name):
                    setattr(state, name, lambda *a, _f=getattr(state, name), _n=name: (calls.append(_n), _f(*a))[1])
        clock = lambda ms: type("Clock", (), {"getCurrentWatermarkInMs": lambda self: ms})()
        piece = pd.DataFrame([(i * 10_000, i) for i in reversed(range(rows))], columns=["ts", "id"])
        assert not list(fold_of.handleInputRows(("a",), iter([piece[:rows // 2], piece[rows // 2:]]), clock(0)))
        assert bool(store.values["waiting"]) == (rows > ordered.FEW)
        half = rows * 5
        assert [i for out in fold_of.handleExpiredTimer(("a",), clock(half), None) for i in out["id"]] == list(range(rows // 2))
        assert [i for out in fold_of.handleExpiredTimer(("a",), clock(10**7), None) for i in out["id"]] == list(range(rows // 2, rows))
        assert len(calls) <= most and not store.values["waiting"]


def test_workflow_state_lives_on_between_runs(spark):
    folder = scratch(spark, "flow")
    schema = "w long, ts long, kind string"
    states = []

    def keep(batch, batch_id):
        states.extend((r.w, r.state) for r in batch.collect() if r.w > 0)

    def run(*rows):
        lines(spark, f"{folder}/in", [{"w": w, "ts": ts * 10**6, "kind": kind} for w, ts, kind in rows])
        df = workflow.workflow_stream(parsed(spark, f"{folder}/in", schema), "w", "ts", "kind", [False, True], "1 second")
        (df.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep)
         .trigger(availableNow=True).start().awaitTermination())

    run((1, 12, "evidence"), (1, 11, "start"), (-1, 15, "note"))
    assert states == [(1, "IN_PROGRESS")]
    run((1, 24, "evidence"), (1, 20, "advance"), (-1, 22, "note"))
    assert states == [(1, "IN_PROGRESS"), (1, "WAITING_EVIDENCE")]
    run((-1, 30, "note"))
    assert states == [(1, "IN_PROGRESS"), (1, "WAITING_EVIDENCE"), (1, "COMPLETED")]


def test_sources_are_bounded():
    assert streams.LIMITS["kafka"]["maxOffsetsPerTrigger"] and streams.LIMITS["text"]["maxFilesPerTrigger"]


SIGNALS = [
    {"signal_id": 1, "ts_us": 1, "source": "npm", "type": "sbom", "package": "react", "version": "1.0.0", "dependencies_count": 40},
    {"signal_id": 2, "ts_us": 2, "source": "threat_feed", "type": "report", "actor": "APT29", "content": "sandworm again"},
    {"signal_id": 3, "ts_us": 3, "source": "network_scanner", "type": "network_scan", "ip_address": "10.0.0.9", "cve_detections": ["CVE-2024-1"]},
]
SCHEMA = schemas.SIGNAL + ", signal_id bigint, ts_us bigint"


def test_ingest_quarantines_and_survives_replay(spark):
    folder = scratch(spark, "ingest")
    lines(spark, f"{folder}/in", [*SIGNALS, "not json", "[1, 2]"])
    store = graphstore.GraphStore(spark, f"{folder}/graph", "a")
    handle = landing.logged(f"{folder}/runs", "ingest", jobs.ingest_batch(store, f"{folder}/dlq", SCHEMA, "salt"))
    for i in range(2):
        streams.drain_batches(streams.read_values(spark, {"path": f"{folder}/in"}, "text"), f"{folder}/run{i}", handle)
    bad = spark.read.json(f"{folder}/dlq")
    assert sorted(r.payload for r in bad.collect()) == ["[1, 2]", "not json"]
    nodes = {r.id: r for r in store.current("nodes", ["id"], ["ts_us", "signal_id"], "seen").collect()}
    assert nodes["Identity:react"].security_score == 65
    assert {"SoftwareComponent:pkg:generic/react@1.0.0", "ThreatActor:Sandworm", "Vulnerability:CVE-2024-1"} <= set(nodes)
    assert not any("10.0.0.9" in k for k in nodes)
    edges = store.current("edges", ["src", "dst", "type"], ["ts_us", "signal_id"], "seen")
    assert edges.count() == 3
    log = spark.read.parquet(f"{folder}/runs").groupBy("state").count().collect()
    assert {r.state: r["count"] for r in log} == {"START": 2, "COMPLETE": 2}


def test_a_new_run_keeps_the_deltas_of_earlier_ones(spark):
    folder = scratch(spark, "runs")
    rows = lambda *ids: spark.createDataFrame([(i, 1, 1, 1) for i in ids], "id string, ts_us long, signal_id long, seen long")
    first, second = graphstore.GraphStore(spark, folder, "one"), graphstore.GraphStore(spark, folder, "two")
    first.append(0, nodes=(rows("a", "b"), ["id"]))
    first.append(1, nodes=(rows("c", "d"), ["id"]))
    first.append(1, nodes=(rows("c", "d"), ["id"]))
    second.append(0, nodes=(rows("e"), ["id"]))
    assert sorted(r.id for r in second.current("nodes", ["id"], ["ts_us", "signal_id"], "seen").collect()) == ["a", "b", "c", "d", "e"]


KEYS, ORDER = ["id"], ["ts_us", "signal_id"]


def versions(spark, rows):
    return spark.createDataFrame(rows, "id string, ts_us long, signal_id long, seen long, score long, name string")


def seen(store):
    return sorted(tuple(r) for r in store.current("nodes", KEYS, ORDER, "seen").collect())


def test_store_folds_snapshots_and_late_deltas(spark):
    """Whatever is compacted when, every key has its latest value of each property; compaction rewrites only what deltas touch."""
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(30)}", rng.randrange(1000), i, 0, rng.choice([None, i]), rng.choice([None, f"v{i}"])) for i in range(300)]
    rows = [(k, t, s, t, a, b) for k, t, s, _, a, b in rows]
    want = sorted((k, min(r[1] for r in own), max(r[1] for r in own),
                   max(((r[1], r[2], r[4]) for r in own if r[4] is not None), default=(0, 0, None))[2], max(((r[1], r[2], r[5]) for r in own if r[5] is not None), default=(0, 0, None))[2])
                  for k in {r[0] for r in rows} for own in [[r for r in rows if r[0] == k]])
    folder = scratch(spark, "store")
    plain, store = (graphstore.GraphStore(spark, f"{folder}/{name}", "one", parts=5) for name in ("plain", "compacted"))
    for batch in range(6):
        part = versions(spark, rows[batch::6])
        plain.append(batch, nodes=(part, KEYS))
        store.append(batch, nodes=(part, KEYS))
        if batch % 2:
            store.compact("nodes", KEYS, ORDER, "seen")
        if batch == 3:
            store.append(3, nodes=(part, KEYS))  # replayed after it was compacted
    assert seen(plain) == seen(store) == want
    before = store.log.newest()["tables"]["nodes"]
    assert store.compact("nodes", KEYS, ORDER, "seen") == []
    store.append(9, nodes=(versions(spark, [("n1", 5000, 1, 5000, 1, "new")]), KEYS))
    (touched,) = store.compact("nodes", KEYS, ORDER, "seen")
    after = store.log.newest()["tables"]["nodes"]
    assert after["deltas"] == [] and {p for p in after["parts"] if after["parts"][p] != before["parts"].get(p)} == {str(touched)}
    assert ("n1", 5000, 1, "new") in [(r[0], *r[2:]) for r in seen(store)]
    gone = store.vacuum(keep=1)
    assert gone and len(store.log.numbers()) == 1 and ("n1", 5000, 1, "new") in [(r[0], *r[2:]) for r in seen(store)]


def test_a_batch_is_seen_as_a_whole_or_not_at_all(spark):
    folder = scratch(spark, "crash")
    store = graphstore.GraphStore(spark, folder, "one")
    store.append(0, nodes=(versions(spark, [("a", 1, 1, 1, 1, "x")]), KEYS), edges=(versions(spark, []), KEYS))
    reader = store.current("nodes", KEYS, ORDER, "seen")
    written = {t: store.write(versions(spark, [("b", 2, 2, 2, 2, "y")]), KEYS) for t in ("nodes", "edges")}
    assert [r[0] for r in seen(store)] == ["a"]  # the writer died here
    store.publish(written, 1)
    assert [r[0] for r in seen(store)] == ["a", "b"] and store.current("edges", KEYS, ORDER, "seen").count() == 1
    store.compact("nodes", KEYS, ORDER, "seen")
    assert [r.id for r in reader.collect()] == ["a"]  # opened before, still whole


def test_two_writers_do_not_lose_each_others_versions(spark):
    folder = scratch(spark, "writers")
    one, two = graphstore.GraphStore(spark, folder, "one"), graphstore.GraphStore(spark, folder, "two")
    newest, calls = one.log.newest, []

    def late():
        found = newest()
        if not calls:
            calls.append(1)
            two.append(0, nodes=(versions(spark, [("b", 1, 1, 1, 1, "x")]), KEYS))
        return found

    one.log.newest = late
    one.append(0, nodes=(versions(spark, [("a", 1, 1, 1, 1, "x")]), KEYS))
    assert [r[0] for r in seen(two)] == ["a", "b"] and two.log.numbers() == [1, 2]
    assert not two.log.commit({"version": 2, "tables": {}})


def test_failed_batch_is_logged(spark):
    folder = scratch(spark, "fail")

    def broken(batch, batch_id):
        raise ValueError("no such sink")

    with pytest.raises(ValueError):
        landing.logged(folder, "job", broken)(spark.range(1), 0)
    rows = {r.state: r.error for r in spark.read.parquet(folder).collect()}
    assert rows == {"START": None, "FAIL": "no such sink"}


def test_events_go_to_the_primary_sink_when_it_is_up(spark):
    folder = scratch(spark, "events")
    df = spark.range(5)
    assert streams.write_events(df, lambda d: d.write.parquet(f"{folder}/a"), f"{folder}/b") == "primary"
    assert spark.read.parquet(f"{folder}/a").count() == 5


def test_stream_windows_equal_batch_windows(spark, small_dir):
    from riskfabric.bindings import Lake
    from riskfabric.plans.landing import FEED, as_lines

    lake, folder = Lake(spark, small_dir), scratch(spark, "windows")
    as_lines(lake.sql(FEED), f"{folder}/in")
    stream = jobs.window_features(streams.read_telemetry(spark, path=f"{folder}/in"))
    batch = jobs.window_features(lake.sql(FEED).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    forest = models.IsolationForest.fit(batch.withColumn("k", F.xxhash64("window_start", "asset_id")), models.TELEMETRY_FEATURES, "k", trees=20)
    got = streams.drain(jobs.anomalies(stream, forest.predict), folder).select("window_start", "asset_id")
    closed = batch.filter(F.col("window_end") <= F.lit(batch.agg(F.max("window_end")).first()[0]) - F.expr("INTERVAL 20 MINUTES"))
    want = jobs.anomalies(closed, forest.predict).select("window_start", "asset_id")
    assert want.join(got, ["window_start", "asset_id"], "left_anti").count() == 0
    assert got.join(jobs.anomalies(batch, forest.predict), ["window_start", "asset_id"], "left_anti").count() == 0


def test_keyed_json_and_page_limits(spark):
    row = streams.keyed_json(spark.createDataFrame([("a", 1)], "k string, v int"), "k").first()
    assert (row.key, json.loads(row.value)) == ("a", {"k": "a", "v": 1})
    with pytest.raises(ValueError):
        windows.page(spark.range(3), "id", 0, 0)
    assert [r.id for r in windows.page(spark.range(10), "id", 3, 4).collect()] == [4, 5, 6]


def test_kafka_options_ask_for_committed_records():
    options = streams.kafka_options("broker:9092", "t", "latest", **{"kafka.isolation.level": "read_committed"})
    assert options["subscribe"] == "t" and options["kafka.isolation.level"] == "read_committed"


def test_telemetry_arrives_in_time_order(spark, tmp_path, monkeypatch):
    """Rows in no order: files of a feed come in time order, so micro-batches of one file lose no window and keep only open ones."""
    monkeypatch.setattr(feeds, "FILE_ROWS", 40)
    rng = random.Random(2)
    rows = [(f"a{i % 7}", i * 37, i % 5, float(i % 3), i % 4, 0.5) for i in range(600)]
    rng.shuffle(rows)
    batch = spark.createDataFrame(rows, "asset_id string, s int, connection_count int, cve_criticality double, unique_ips int, centrality double").repartition(5).select(
        "asset_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("timestamp"), "connection_count", "cve_criticality", "unique_ips", "centrality")
    feeds.as_feed(batch, f"{tmp_path}/in", "timestamp")
    read = streams.read_telemetry(spark, path=f"{tmp_path}/in", maxFilesPerTrigger="1")
    seen = []
    query = read.writeStream.foreachBatch(lambda b, n: seen.append(b.agg(F.min("timestamp"), F.max("timestamp")).first())).option(
        "checkpointLocation", f"{tmp_path}/plain").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) > 5 and all(a[1] <= b[0] for a, b in zip(seen, seen[1:], strict=False))
    got = streams.drain(jobs.window_features(read), str(tmp_path))
    last = batch.agg(F.max("timestamp")).first()[0]
    want = jobs.window_features(batch).filter(F.col("window_end") <= F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_stream_anomalies_keep_state_out_of_the_heap(spark, small_dir, monkeypatch):
    """Micro-batches are bounded and windows lie in RocksDB; the same rows whatever the size of a micro-batch."""
    taken = []
    drain = streams.drain
    monkeypatch.setattr(streams, "drain", lambda df, folder, *a: (taken.append((folder, df.sparkSession.conf.get(PROVIDER))), drain(df, folder, *a))[1])
    run = catalog.queries()["t3_stream_anomalies"]
    whole = sorted(map(tuple, run(spark, small_dir).collect()))
    monkeypatch.setattr(feeds, "FILE_ROWS", 50)
    assert sorted(map(tuple, run(spark, small_dir).collect())) == whole and whole
    batches = [len([p for p in (Path(folder.removeprefix("file:")) / "checkpoint/offsets").iterdir() if p.name.isdigit()]) for folder, _ in taken]
    assert batches[0] <= 2 < batches[1] and {provider for _, provider in taken} == {ROCKSDB}
