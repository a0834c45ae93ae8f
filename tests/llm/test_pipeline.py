"""Each stage of the pipeline against a brute-force version on its own input, and the run as a whole."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
import test_search as search
import test_text as text_tests
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskfabric.llm import langid
from riskfabric.llm.plans_text import tokenizer_definition

@pytest.fixture(scope="module")
def lake(spark, small_dir, tmp_path_factory):
    """The smallest tables with awkward rows and a further column whose names clash with those used inside."""
    folder = str(tmp_path_factory.mktemp("lake"))
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rng = random.Random(1)
    item = spark.read.parquet(f"{small_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = docs.orderBy("doc_id").first()["text"]
    more = [(9001, None), (9002, ""), (9003, "12 34 !!"), (9004, "the " * 40_000), (9005, f"{clean} {item}"), (9006, clean), (9006, clean), (None, clean + " and more text of its own"),
            (9007, "the token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" in the text of the that"), (9008, search.prose(rng, 300))]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in more], docs.schema)
    docs.unionByName(rows).withColumns({"_spans": F.lit("x"), "component_id": F.lit(1), "_id": F.lit(2)}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_stages_keep_the_columns(spark, lake):
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, docs, lake).columns == docs.columns, name


def test_language_drops_what_has_no_language(spark, lake):
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    kept = stage("language")(spark, docs, lake)
    profiles = langid.Profiles()

    def stays(text):
        bundle = profiles.bundle(text)
        return bundle is not None

    assert rows_of(kept) == sorted(repr(tuple(r)) for r in docs.collect() if stays(r["text"]))
    assert {9001, 9002, 9003} & {r["doc_id"] for r in kept.select("doc_id").collect()} == set()
    assert kept.count() >= docs.count() - 6
    empty = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stage("language")(spark, empty, lake).count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_language_keeps_short_clean_texts(spark, lake):
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    short = ["A.", "Avec.", "Onhaha sh.", "Qx", "zzqj"]
    rows = spark.createDataFrame([(9100 + i, t, None, None, None) for i, t in enumerate([*short, None, "", "12 34 !!", "\u2026 ?"])], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    more = docs.unionByName(rows, allowMissingColumns=True)
    kept = {r["doc_id"] for r in stage("language")(spark, more, lake).filter("doc_id >= 9100").collect()}
    assert kept == {9100 + i for i in range(len(short))}


def with_odd_ids(spark, lake):
    """Ids that stand for different texts, clean and contaminated, and rows without an id; columns with the names used inside."""
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    item = spark.read.parquet(f"{lake}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(3)
    first, second, third = (search.prose(rng, 80) for _ in range(3))
    odd = [(9200, first), (9200, second), (9200, third), (9200, first), (9201, first), (9202, f"{second} {item}"), (9202, third + " more"), (9203, None), (9203, ""), (9204, ""),
           (None, first), (None, f"so {item}"), (None, f"so {item}"), (None, third + " else"), (None, third + " else"), (None, None)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    clash = {name: F.lit("y") for name in ("_row", "_gone", "_several", "_key", "group", "_guess", "_found", "_ROW_")}
    return docs.unionByName(rows, allowMissingColumns=True).withColumns(clash)


def plain_key(r):
    part = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    return hashlib.md5(f"{part(r['doc_id'])}/{part(r['text'])}".encode()).hexdigest()


def first_rows(rows, groups):
    best = {}
    for r, g in zip(rows, groups, strict=True):
        rank = r["doc_id"] is None, r["doc_id"] or 0, plain_key(r)
        if g not in best or rank < best[g][0]:
            best[g] = rank, r
    return sorted(((r["doc_id"], r["text"]) for _, r in best.values()), key=repr)


def ids_and_texts(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_one_document_of_each_group_stays(spark, lake):
    docs = with_odd_ids(spark, lake)
    rows = docs.collect()
    groups = search.plain_components([search.plain_fingerprint(r["text"]) for r in rows])
    kept = stage("near_duplicates")(spark, docs, lake)
    assert kept.columns == docs.columns
    assert ids_and_texts(kept) == first_rows(rows, groups)


def test_similar_documents_go_where_similarity_is_given(spark, lake):
    docs = with_odd_ids(spark, lake)
    rows = docs.collect()
    groups = search.plain_similar_components([r["text"] for r in rows])
    kept = stage("near_duplicates")(spark, docs, lake, similarity=0.8)
    assert ids_and_texts(kept) == first_rows(rows, groups)
    assert {145, 177, 9005} & {r["doc_id"] for r in kept.collect()} == set()  # similar to 6, 1 and 0, but 7 to 11 bits away


def test_contaminated_documents_go(spark, lake):
    docs = with_odd_ids(spark, lake)
    items = [search.plain_shingles(r["text"]) for r in spark.read.parquet(f"{lake}/benchmark.parquet").collect()]

    def dirty(r):
        own = search.plain_shingles(r["text"])
        return any(i and len(i & own) >= 0.8 * len(i) - 1e-9 for i in items)

    kept = stage("decontaminate")(spark, docs, lake)
    assert rows_of(kept) == sorted(repr(tuple(r)) for r in docs.collect() if not dirty(r))
    assert 9005 not in {r["doc_id"] for r in kept.collect()}


def test_run_leaves_one_folder(spark, lake):
    made, gone = [], []
    scratch, discard = corpus_pipeline.scratch, corpus_pipeline.discard
    try:
        corpus_pipeline.scratch = lambda spark, name: made.append(scratch(spark, name)) or made[-1]
        corpus_pipeline.discard = lambda spark, folder: gone.append(folder) or discard(spark, folder)
        out = corpus_pipeline.run(spark, lake)
    finally:
        corpus_pipeline.scratch, corpus_pipeline.discard = scratch, discard
    assert gone == made[:-1] and out.count()
    assert not any(Path(folder.removeprefix("file:")).exists() for folder in gone)


def test_secrets_are_replaced(spark, lake):
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    got = {(r["doc_id"], i): r for i, r in enumerate(stage("redact_secrets")(spark, docs, lake).orderBy("doc_id", "n_chars", "text").collect())}
    assert len(got) == docs.count()
    before = {}
    for r in docs.collect():
        before.setdefault(r["doc_id"], []).append(r["text"])
    for r in got.values():
        if any(r["text"] == t for t in before[r["doc_id"]]):
            assert not text_tests.plain_spans(r["text"])
        else:
            assert "[SECRET]" in r["text"] and not text_tests.plain_spans(r["text"]) and r["n_chars"] in (None, len(r["text"]))
    assert any(r["doc_id"] == 9007 and r["text"].startswith("the [SECRET]\"") for r in got.values())


def test_run_applies_all_stages(spark, lake):
    out = corpus_pipeline.run(spark, lake).collect()
    docs = spark.read.parquet(f"{lake}/documents.parquet")
    for name, run in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(run(spark, docs, lake).collect(), docs.schema)
    tokenizer = Tokenizer.from_str(tokenizer_definition("word_bpe_49k.json"))
    want = sorted(repr((r["doc_id"], *text_tests.plain_encoding(tokenizer, r["text"]))) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in out) == want and len(want) > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "redact_secrets", "tokenize"]


def test_empty_documents_pass(spark, lake):
    docs = spark.read.parquet(f"{lake}/documents.parquet").limit(0)
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, docs, lake).count() == 0, name
