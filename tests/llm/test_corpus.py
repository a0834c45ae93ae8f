"""Conversation repair, mixing and centroids against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskfabric.llm import centroids, dialogue, mixing, plans_corpus

# --- conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
OTHER = {0: 2, 1: 2, 2: 3, 3: 2}


def plain_repair(rows):
    """Every state after every row, no bounds: (cost, audit)."""
    def with_inserts(best):
        best, changed = dict(best), True
        while changed:
            changed = False
            for state, (cost, audit) in list(best.items()):
                way = cost + 2, audit + "I"
                if OTHER[state] not in best or way < best[OTHER[state]]:
                    best[OTHER[state]], changed = way, True
        return best

    best = {0: (0, "")}
    for row in rows:
        after = {}
        for state, (cost, audit) in with_inserts(best).items():
            broken = int(row.isupper())
            ways = [(state, 3, "D")]
            if row != "x":
                ways.append((OTHER[state], 2 + broken, "R"))
                if (state, row.lower()) in NEXT:
                    ways.append((NEXT[state, row.lower()], broken, "K"))
            for end, more, letter in ways:
                way = cost + more, audit + letter
                if end not in after or way < after[end]:
                    after[end] = way
        best = after
    best = with_inserts(best)
    return min(best[state] for state in (0, 3) if state in best)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="suaoxSUAO", max_size=40), st.integers(1, 12))
def test_search_equals_all_states(rows, stretch):
    assert dialogue.Repairer().repair(rows) == plain_repair(rows)
    assert dialogue.Repairer().repair(rows, stretch) == plain_repair(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="suaoxSUAO", max_size=12), st.sampled_from([0, 1, 2, 3]), st.booleans())
def test_bounds_never_exceed_the_cost(rows, state, last):
    found = dialogue.search(rows, state, last)
    bounds = dialogue.Bounds(rows, last)
    assert all(bounds.at(0, state) <= cost for cost, _ in found.values())


@pytest.mark.parametrize("alphabet", ["s", "o", "oO", "ox", "sssu", "sooo", "uU", "suaoxSUAO"])
def test_long_conversations_stay_cheap(alphabet):
    rows = "".join(random.Random(5).choice(alphabet) for _ in range(3000))
    calls = []
    repairer = dialogue.Repairer()
    plain = dialogue.Bounds.at
    try:
        dialogue.Bounds.at = lambda self, i, state: calls.append(1) or plain(self, i, state)
        assert repairer.repair(rows) == plain_repair(rows)
    finally:
        dialogue.Bounds.at = plain
    assert len(calls) < 600 * len(rows)


def plain_conversations(rows):
    """What the query returns, row by row."""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        own = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind, role, text = zlib.crc32(own.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, group in groups.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        turns = {r[0] for r in group} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, codes, counts = set(), "", dict.fromkeys("bdt", 0)
        for _, role, text in group:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not words else "d" if (role, text) in seen else "" if words[-1] in ".!?" else "t"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("b", "d") else code.upper() if fault else code
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(group, group[1:], strict=False))
        cost, audit = plain_repair(codes)
        state, done, left = 0, [], iter(group)
        for edit in audit:
            if edit == "I":
                state = OTHER[state]
                done.append(["user", "assistant"][state - 2] + ":")
                continue
            _, role, text = next(left)
            if edit == "K":
                state = NEXT[state, role[0]]
                done.append(f"{role}:{text}")
            elif edit == "R":
                state = OTHER[state]
                done.append(["user", "assistant"][state - 2] + f":{text}")
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def conversation_rows(rng, n=60):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "assistant", "tool", "", None, "user"])
            text = rng.choice(["Yes.", "No!", "Why", "Ä? \n", "", " \t", None, "A b c.", " ", "x " * 30_000 + "end."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), role, text))
    rows += [(5, 3, "user", "again.")] * 7 + [(6, 2**40, "user", "far."), (6, -(2**40), "assistant", "far.")]
    rows += [(9000, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(400)]
    rng.shuffle(rows)
    return rows


def test_conversations_equal_brute_force(spark, tmp_path):
    rows = conversation_rows(random.Random(11))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("clash") for c in ("present", "_conv", "audit", "_kind")})
    frame.repartition(7).write.parquet(str(tmp_path / "conversations.parquet"))
    got = plans_corpus.op11_conversations(spark, str(tmp_path)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: (*[r[n] for n in dialogue.NUMBERS], r["audit"], r["repaired_sha256"]) for r in got} == plain_conversations(rows)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert plans_corpus.op11_conversations(spark, str(tmp_path)).collect() == []


def test_repaired_rows_are_legal(spark):
    rows = conversation_rows(random.Random(12), 30)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found, fixed = dialogue.repair(frame)
    by = {}
    for r in sorted(fixed.collect(), key=lambda r: r["position"]):
        by.setdefault(r["conv_id"], []).append(r)
    for r in found.collect():
        own = by.get(r["conv_id"], [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in own))
        assert [x["position"] for x in own] == list(range(len(own)))
        assert "".join(x["edit"] for x in own) == r["audit"].replace("D", "")
        assert all(x["turn"] is None and x["text"] == "" for x in own if x["edit"] == "I")


# --- mixing


def plain_targets(sizes, weights, most):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[n] for n in capped)
        free = sum(w for n, w in weight.items() if n not in capped)
        out = {n: most * sizes[n] if n in capped else rest * weight[n] / free for n in names}
        above = {n for n in names if n not in capped and out[n] > most * sizes[n]}
        if not above:
            return out
        capped |= above


def plain_rates(sizes, target, most):
    """exp(l * size / largest), cut at `most`, l by halving."""
    largest = max(sizes)
    rates = lambda at: [min(most, math.exp(min(50, at * s / largest))) for s in sizes]
    low, high = -1e7, 1e7
    for _ in range(200):
        mid = (low + high) / 2
        if sum(r * s for r, s in zip(rates(mid), sizes, strict=True)) > target:
            high = mid
        else:
            low = mid
    return rates(low)


def documents_of(rng, sources, n):
    words = lambda k: " ".join(["wörd"] * k)
    rows = [(i, words(int(rng.paretovariate(1.1) * 5) % 900), sources[int(rng.random() ** 2 * len(sources))]) for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", "b"), (None, "a b", "b"), (None, "a b", "b"), (7, "t a b\tc\x0bd", None), (n + 2, words(200_000), "huge")]


def test_mix_meets_targets(spark):
    rows = documents_of(random.Random(2), ["a", "b", "ä", "z\U0001f600", "z￮", "tiny", "", None], 1500) + [(5000 + i, "s o", "small") for i in range(3)] + [(1, "same text", "b")] * 400
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "_tie": F.lit(2), "target": F.lit("x")})
    first = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in first) == sorted((i is None, i, size(t)) for i, t, _ in rows)
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + size(t)
    wanted = plain_targets(per, (5, 2, 1), 3)
    for source, goal in wanted.items():
        own = [r for r in first if r["source"] == source]
        assert all(r["target"] == pytest.approx(goal, rel=1e-12) and r["source_size"] == per[source] for r in own)
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in own)
        smallest = min((r["size"] for r in own if r["size"]), default=0)
        assert abs(sum(r["taken"] for r in own) - goal) <= max(smallest, 1e-6 * goal), source
        if per[source] and goal < 3 * per[source]:
            sized = [r for r in own if r["size"]]
            for r, rate in zip(sized, plain_rates([r["size"] for r in sized], goal, 3), strict=True):
                assert r["rate"] == pytest.approx(rate, rel=2e-4, abs=2e-4)


def test_mix_copies_follow_rates(spark):
    """Where documents are many and short, those of a size are taken as often as their rate says."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), ["a", "b", "c"][i % 3]) for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["source"], r["size"]), []).append(r)
    for own in groups.values():
        assert abs(sum(r["copies"] for r in own) - sum(r["rate"] for r in own)) <= 3
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)], [(1, "one two", None)], [(1, "x", "a"), (2, "y " * 50, "b")]])
def test_mix_of_few_rows(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert all(r["target"] is not None and 0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_mix_of_one_hot_id(spark):
    frame = spark.createDataFrame([(i if i % 3 else 0, "a b c d", "hot" if i % 3 else "cold") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(frame).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 4 for r in got)


def test_mix_has_no_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# --- centroids


def plain_clusters(rows, clusters=40, rounds=5):
    kept = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows
            if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [list(x) for _, x in start]
    measure = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        choice = [measure(x)[1] for _, x in kept]
        for n in set(choice):
            own = [x for (_, x), c in zip(kept, choice, strict=True) if c == n]
            centres[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, *measure(x)[::-1]) for i, x in kept]
    inertia = {n: sum(d for _, c, d in found if c == n) for _, n, _ in found}
    most = 2**63 - 1
    return sorted(((i, n, min(most, d), min(most, inertia[n]), min(most, sum(inertia.values())), ",".join(map(str, centres[n]))) for i, n, d in found), key=repr)


def clustered(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "_id": F.lit(1), "distance": F.lit(0)})
    got = centroids.cluster(frame.repartition(5), **options).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], ",".join(r["centroid"])) for r in got), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 64))
    rows = [(i, (middles[i % 12] + rng.normal(size=64) * [0.05, 1.0][i % 2]).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [])]
    rows += [(7, rows[7][1])] * 40 + [(None, [0.5] * 64), (None, [-0.5] * 64), (400, [0.0] * 64), (401, [0.0] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)


@pytest.mark.parametrize("scale", [1e-3, 1e6, 1e15])
def test_clusters_of_extreme_components(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * scale).tolist()) for i in range(90)] + [(90, [2.0] * 64), (91, [-3.0] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_clusters_with_ties(spark):
    """Equal centroids: all go to the first; centroids that nobody chooses stay."""
    rows = [(i, [float(i % 2)] * 64) for i in range(120)]
    assert clustered(spark, rows) == plain_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)], [(1, [0.25] * 64), (1, [0.25] * 64)]])
def test_few_vectors(spark, rows):
    assert clustered(spark, rows) == plain_clusters(rows)


def test_bounds_spare_most_distances():
    """Where the vectors lie along few axes the filter measures few centroids, and the result is exact all the same."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(2000, 6)) @ rng.normal(size=(6, 64)) * 256).astype(np.int64)
    centres = x[:40]
    axes = np.linalg.eigh(np.cov(x.T.astype(float)))[1][:, ::-1]
    rotation = centroids.Rotation(x.mean(0), axes, 16)
    choice, best, measured = centroids.nearest(x, *rotation.project(x), centres, rotation)
    exact = ((x[:, None] - centres) ** 2).sum(2)
    assert (choice == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert measured < 3 * len(x)
