"""Contamination, URL rules, near duplicates and top-k against brute force, with awkward rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskfabric.llm import common, decontam, nearcopies, simhash, topk, urls

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Ñandú", "été", "x1"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# --- near duplicates


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(marks))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "a b c", "A  b\u00a0c\x0bd\x1ce f", "é " * 50 + "É", "w " * 70_000 + "end"])
def test_fingerprint_of_awkward_texts(text):
    assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "one", "one", "One"]
    for _ in range(25):
        words = prose(rng, rng.randrange(5, 200)).split()
        for _ in range(rng.randrange(1, 8)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = [(i * 7 + 1, t, 5, "x") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _fp int, component_id string")).collect()
    marks = [plain_fingerprint(t) for t in texts]
    groups = plain_components(marks)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        row[0]: (f"{m:016x}", rows[g][0]) for row, m, g in zip(rows, marks, groups, strict=True)}
    assert len(got) == len(rows)


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    schema = "doc_id long, text string"
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words here")], schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_anchors_of_close_fingerprints_meet(mark, flips):
    other = mark
    for bit in set(flips):
        other ^= 1 << bit
    mask = (1 << 23) - 1
    reach = PATTERNS
    own = []
    for half in (mark & mask, mark >> 23 & mask):
        patterns, weights = reach[int(simhash.syndromes(np.array(half)))]
        assert weights[0] <= simhash.RADIUS
        own.append(half ^ int(patterns[0]))
    over = 0
    for half, anchor in zip((other & mask, other >> 23 & mask), own, strict=True):
        patterns, weights = reach[int(simhash.syndromes(np.array(half)))]
        at = np.flatnonzero((half ^ patterns) == anchor)
        assert len(at) == 1
        over += max(0, int(weights[at[0]]) - simhash.RADIUS)
    assert over <= 2


PATTERNS = simhash.error_patterns(simhash.RADIUS + 2)


def test_a_large_group_of_copies_makes_no_pairs(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same words again and again' AS text")
    marks = simhash.fingerprints(docs).select("_fp").distinct()
    assert simhash.near_pairs(marks).count() == 0
    assert simhash.near_duplicates(docs).select("component_id").distinct().collect() == [(0,)]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_anchors_are_not_broadcast(spark):
    """Spark sizes 61 anchors a fingerprint like the fingerprint alone, which passes for small."""
    pairs = simhash.near_pairs(spark.range(2000).select(F.xxhash64("id").alias("_fp")).repartition("_fp"))
    pairs.count()
    assert "SortMergeJoin" in (plan := plan_of(pairs)) and "Broadcast" not in plan


def test_an_exploded_side_is_not_broadcast(spark):
    exploded = spark.range(2000).select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("n"))
    met = exploded.join(common.small_or_shuffled(spark.range(3000).withColumnRenamed("id", "m"), 0, to_exploded=True), F.col("n") == F.col("m"))
    met.count()
    assert "SortMergeJoin" in (plan := plan_of(met)) and "Broadcast" not in plan


# --- near copies by Jaccard similarity


def plain_word_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_similar_components(texts, threshold=0.8):
    sets = [plain_word_shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= threshold * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", "  ", "one", "One ", "one two", "a b c d e", "A  b c d\te", "a b c d f"]
    passage = prose(rng, 30)
    for _ in range(30):
        words = prose(rng, rng.randrange(5, 250)).split()
        for _ in range(rng.randrange(1, 8)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    texts += [" ".join([passage, *prose(rng, k).split()]) for k in range(1, 12) for _ in range(4)]
    rng.shuffle(texts)
    rows = [(i * 7 + 1, t, 5, "x") for i, t in enumerate(texts)]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string, _key int, component_id string")).collect()
    groups = plain_similar_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == {row[0]: rows[g][0] for row, g in zip(rows, groups, strict=True)}
    assert len(got) == len(rows)
    marks = [plain_fingerprint(t) for t in texts]
    far = [(i, j) for i in range(len(texts)) for j in range(i) if groups[i] == groups[j] and (marks[i] ^ marks[j]).bit_count() > 2]
    assert len(far) > 50  # what fingerprints two bits apart do not link
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- contamination


def plain_shingles(text, width=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(5, 60))) for i in range(30)] + [(100, None), (101, ""), (102, "...")]
    docs = []
    for d in range(120):
        body = prose(rng, rng.randrange(0, 400)).split()
        if d % 3 == 0:
            item = rng.choice(items[:30])[1].split()
            keep = item[: max(5, int(len(item) * rng.choice([0.5, 0.85, 0.95, 1])))]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in keep]
        docs.append((d, " ".join(body), 1, 2))
    docs += [(500, None, 1, 2), (None, items[0][1], 1, 2), (501, "", 1, 2), (502, items[1][1], 1, 2), (502, items[1][1], 1, 2), (503, "pad " * 60_000 + items[2][1], 1, 2)]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string, n_shared int, _words int"),
                                  spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id int")).collect()
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            sought = plain_shingles(item)
            shared = len(sought & plain_shingles(text))
            if d is not None and sought and shared >= 0.8 * len(sought) - 1e-9:
                want[d, i] = (shared, len(sought))
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in found} == want
    assert len(found) == len(want) > 20


def test_items_shorter_than_a_shingle_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Short item"), (2, "word"), (2, "word"), (3, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a short, item here"), (2, "shortitem"), (3, "no such Word"), (4, "one two three four five six")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()) == [(1, 1), (3, 2), (4, 3)]


@pytest.mark.parametrize("which", ["docs", "items"])
def test_contamination_of_empty_tables(spark, which):
    docs = spark.createDataFrame([] if which == "docs" else [(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([] if which == "items" else [(1, "some words")], "item_id long, text string")
    assert decontam.contaminated(docs, items).count() == 0


# --- urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("Net", "/es/a", "allow"),
         ("org", "", "block"), ("org", "", "allow"), ("a.org", "/x", "allow")]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    top = max(fits, default=None)
    return host, path, top and top[3], top[2] if top else "allow"


URLS = [None, "", "no scheme.com/", "http://example.com/en/a", "http://EXAMPLE.com/en/a?q=/en/", "https://www.example.com/en/", "https://sub.www.example.com/en/x#y",
        "http://example.com", "http://notexample.com/en/", "http://xcom/", "http://com/", "http://a.net/es/", "http://a.net/es/a/b", "http://net/ES/", "http://b.net?x=/es/",
        "http://a.org/x/y", "http://b.a.org/x", "http://org", "://a.org/x", "http://u://x.net/es/", "http://é.com/é", "http://.com/", "http://a..net/es/", "http://example.com/en/" + "p" * 5000]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, u, "h", 3) for i, u in enumerate(URLS)] + [(None, URLS[3], "h", 3), (3, URLS[3], "h", 3), (3, URLS[3], "h", 3)]
    rows += [(1000 + i, f"http://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example.com', 'net', 'a.org', 'x.y'])}{rng.choice(['/en/', '/es/', '/x', '/', ''])}{rng.randrange(50)}", "h", 3) for i in range(2000)]
    rows += [(5000 + i, "http://example.com/en/hot", "h", 3) for i in range(1500)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, _key int"), rules).collect()
    found = sorted(((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got))
    want = sorted((i is None, i or 0, h, p, rule or "", v) for (i, u, *_) in rows for h, p, rule, v in [plain_verdict(u)])
    assert found == want


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in urls.filter_urls(pages, none).collect()] == ["allow"]
    assert urls.filter_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


# --- top-k


def plain_top_k(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "cell_rows"), [(400, 8, 32), (5, 3, 4096), (1, 2, 8), (300, 1, 16)])
def test_top_k_equals_brute_force(spark, n, width, cell_rows):
    rng = random.Random(n)
    rows = [(i, [rng.randrange(-900, 900) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 4)]  # a common vector: ties go to the smaller id
    base = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, vector array<long>, score int")
    got = topk.top_k(base, base.filter("vec_id % 10 = 0"), 10, cell_rows=cell_rows, pivots=5, rings=4).collect()
    assert sorted(tuple(r) for r in got) == plain_top_k(rows, [r for r in rows if r[0] % 10 == 0], 10)


def test_top_k_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (100, None), (200, [None, 1.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [-0.0001, 2.0]), (4, [])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    got = topk.top_k(base, base.filter("vec_id % 100 = 0"), 3).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 512 * 1024 - 256 * 1024), (0, 2, 2, 0), (0, 3, 4, 0)]
    assert topk.top_k(base.limit(0), base.limit(0), 3).count() == 0
    big = spark.createDataFrame([(0, [2**40, 1]), (1, [2**21, 5]), (2, [2**21, 4])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(big, big.filter("vec_id = 0"), 2).collect()] == [(0, 1, 1, 2**61 + 5), (0, 2, 2, 2**61 + 4)]
