"""Nearest vectors and controls against brute force, without bounds on queries or controls."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from riskfabric.operators import match, windows
from riskfabric.sources.matchindex import MatchIndex


def cosine(a, b):
    pad = lambda v: [0.0 if x is None else float(x) for x in v or []]
    a, b = pad(a), pad(b)
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


@pytest.mark.parametrize(("block", "group"), [(32_768, 4_096), (40, 7)])
def test_top_k_equals_brute_force(spark, block, group):
    rng = random.Random(block)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.random()]) for _ in range(6)]) for i in range(180)]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, 2.0]), (204, [None, 1.0, 1.0, 0.0, 0.0, 0.0])] + [(7, [1.0] * 6)] * 60
    asked = rows[:50] + rows[180:185] + [(999, [1.0] * 6)]
    schema = "id long, v array<double>"
    got = windows.top_k_similar(spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(asked, schema), "id", "v", 4, block, group)
    by = {}
    for r in got.collect():
        by.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    for query, vector in asked:
        own = sorted((-round(cosine(vector, v), 9), i) for i, v in rows if i != query)[:4]
        found = sorted(by[query])
        assert [i for _, i, _ in found] == [i for _, i in own], query
        assert [s for _, _, s in found] == pytest.approx([-s for s, _ in own], abs=2e-9)


def test_many_queries_and_controls_are_no_error(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    assert windows.top_k_similar(frame, frame, "id", "v", 2).count() == 3000
    controls = spark.createDataFrame([(i, f"control number{i} topic{i % 50}") for i in range(12_000)], "position int, description string")
    texts = spark.createDataFrame([(1, "about number7 and topic7"), (2, "nothing known"), (3, None)], "id int, text string")
    got = match.map_requirements(texts, "id", "text", controls, 2).collect()
    assert [r["position"] for r in got if r["id"] == 1 and r["rank"] == 1] == [7]
    assert {r["id"] for r in got} == {1}


def test_hot_term_on_a_grid(spark):
    """300 queries share a term with 700 texts: cells of 25 postings a side give the pairs of one cell, and no cell holds many."""
    texts = spark.range(700).select(F.concat(F.lit("acme unit "), (F.col("id") % 350).cast("string")).alias("value"), F.col("id").alias("ord"),
                                    F.concat(F.lit("i"), "id").alias("id"), F.lit("").alias("name"), F.lit("").alias("cert_hash"))
    asked = texts.filter("ord < 300").withColumns({"id": F.concat(F.lit("e"), "ord"), "value": F.concat("value", F.lit("x"))})
    whole = sorted(map(tuple, match.match_fuzzy(asked, texts, threshold=0.6, fan=1_000_000).collect()))
    split = sorted(map(tuple, match.match_fuzzy(asked, texts, threshold=0.6, fan=25).collect()))
    assert whole and split == whole
    pairs = lambda fan: sorted(map(tuple, match.similar_pairs(None, texts.select(
        F.col("id").alias("c"), F.concat("value", F.lit(" "), "id").alias("text"), F.lit(1).alias("copies")).limit(120), 0.6, match.char_wb(), fan).collect()))
    assert pairs(10) == pairs(1_000_000) and pairs(10)


def test_pairs_that_only_share_terms_are_no_rows(spark):
    """Texts of one frequent word and own numbers: all 500,000 pairs share terms, few are similar; what is shuffled follows the texts."""
    texts = spark.range(1000).select(F.concat(F.lit("acme "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(1).alias("copies"),
                                     F.concat(F.lit("t"), "id").alias("c"))
    texts = texts.unionByName(texts.filter("c = 't7'").select(F.concat("text", F.lit(" x")).alias("text"), "copies", F.lit("u7").alias("c")))
    pairs = match.similar_pairs(None, texts, 0.8, match.char_wb(), fan=100)
    assert [(r["q"], r["c"]) for r in pairs.collect()] == [("t7", "u7")]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan and "Aggregate" not in plan


def test_index_gives_what_the_inventory_gives(spark, tmp_path):
    columns = "id string, ord long, value string, name string, cert_hash string"
    inventory = spark.createDataFrame([("a", 1, "10.0.0.1", "web frontend alpha", None), ("b", 2, "10.0.0.2", "database primary", "cc"),
                                       ("c", 3, "10.0.0.2", "database primary", None), ("d", 4, None, "mail relay north", "")], columns)
    arriving = spark.createDataFrame([("x", 1, "10.0.0.2", "other", None), ("y", 2, None, "mail relay north", None), ("z", 3, "new", "nothing alike", "cc"),
                                      ("u", 4, None, None, None), ("v", 5, "", "web frontend alphas", "")], columns)
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        MatchIndex.newest(spark, root)
    assert MatchIndex.build(inventory, root, threshold=0.7).version == 1
    rows = lambda df: sorted(map(tuple, df.select("ext_id", "int_id", "score", "method").collect()))
    got = rows(MatchIndex.newest(spark, root).match(arriving, 0.7))
    assert got == rows(match.match_assets(arriving, inventory, 0.7)) and ("x", "b", 1.0, "exact") in got
    with pytest.raises(ValueError):
        MatchIndex.newest(spark, root).match(arriving, 0.5)
    old = MatchIndex.newest(spark, root)
    smaller = inventory.filter("id <> 'b'")
    MatchIndex.build(smaller, root, threshold=0.7)
    newest = MatchIndex.newest(spark, root)
    assert newest.version == 2 and rows(newest.match(arriving, 0.7)) == rows(match.match_assets(arriving, smaller, 0.7)) != got
    assert rows(old.match(arriving, 0.7)) == got
    assert newest.match(arriving.limit(0), 0.7).count() == 0
