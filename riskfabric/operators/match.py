"""Entity matching: exact, fuzzy by TF-IDF cosine, fusion of matched assets, identity resolution."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.functions.tfidf import (
    Tokenizer, char_wb, fit_idf, numbered_vectors, term_counts, vectors, words,
)
from riskfabric.operators.graph import connected_components
from riskfabric.session import cut, scratch

THRESHOLD = 0.85
#: Part of the threshold that the terms of a query which are not added up may add.
REMAINDER = 0.75


def exact_keys(internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First candidate per value and per certificate hash; a value shared by many candidates multiplies nothing."""
    def first_by(key: str) -> DataFrame:
        usable = internal.filter(F.length(key) > 0)
        return usable.groupBy(F.col(key).alias(f"_{key}")).agg(F.min(F.struct("ord", "id")).alias(f"_by_{key}"))

    return first_by("value"), first_by("cert_hash")


def match_keys(ext: DataFrame, by_value: DataFrame, by_cert: DataFrame) -> DataFrame:
    """(ext_id, int_id, score 1.0): equal non-empty value or certificate hash, first candidate wins; two equi-joins replace the OR."""
    joined = (
        ext.select("id", "value", "cert_hash")
        .join(by_value, (F.col("value") == F.col("_value")), "left")
        .join(by_cert, (F.col("cert_hash") == F.col("_cert_hash")), "left")
    )
    first = F.least("_by_value", "_by_cert_hash")
    return joined.select(F.col("id").alias("ext_id"), first.alias("_m")).filter(F.col("_m").isNotNull()).select(
        "ext_id", F.col("_m.id").alias("int_id"), F.lit(1.0).alias("score"))


def match_exact(ext: DataFrame, internal: DataFrame) -> DataFrame:
    """Exact matches. Columns: id, ord (candidate order), value, cert_hash."""
    return match_keys(ext, *exact_keys(internal))


def _counted(texts: DataFrame, key: str, tokenize: Tokenizer) -> DataFrame:
    """Term counts, written once in columns, where a key and a term repeated in many rows cost little."""
    folder = scratch(texts.sparkSession, "terms")
    term_counts(texts, key, "text", tokenize).write.parquet(folder)
    return texts.sparkSession.read.schema(f"`{key}` string, term string, tf bigint").parquet(folder)


def fitted(corpus: DataFrame, tokenize: Tokenizer) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf, t) and (c, terms, weights) of `corpus(c, text, copies)`, which holds distinct texts with unique string keys."""
    counts = _counted(corpus, "c", tokenize)
    idf = cut(fit_idf(counts, corpus, "c", "copies").withColumn("t", F.monotonically_increasing_id()))
    return idf, cut(numbered_vectors(counts, _side(idf), "c"))


#: Texts a side of a cell at most, about 80 MB of terms and weights.
SIDE = 32_768
#: Cells wanted, as long as their sides stay between `fan` and SIDE texts.
CELLS = 64


def _scored(asked: Vectors, held: Vectors, threshold: float, remainder: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of asked, rows of held, scores >= threshold), each pair once.

    Of a query only the terms that this cell holds count, shortest posting list first. Once the norm of the rest falls below `remainder`,
    the rest can add no more than that norm to a dot product of unit vectors: pairs whose partial product cannot reach the threshold
    with it are left out, and the others are computed in full. Exact: nothing is capped.
    """
    vocabulary, at = np.unique(held.terms, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rows = np.repeat(np.arange(len(held.starts) - 1), np.diff(held.starts))[order]
    weights = held.weights[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(vocabulary)))))
    dense = np.zeros(len(vocabulary))
    for i in range(len(asked.starts) - 1):
        own = slice(asked.starts[i], asked.starts[i + 1])
        place = np.searchsorted(vocabulary, asked.terms[own])
        known = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == asked.terms[own])
        place, weight = place[known], asked.weights[own][known]
        shortest = np.argsort(first[place + 1] - first[place], kind="stable")
        place, weight = place[shortest], weight[shortest]
        rest = np.sqrt(np.append(np.cumsum((weight * weight)[::-1])[::-1], 0.0))
        if rest[0] < threshold - 1e-6:
            continue
        partial, used = np.zeros(len(held.starts) - 1), 0
        while used < len(place) and rest[used] >= remainder - 1e-9:
            span = slice(first[place[used]], first[place[used] + 1])
            partial[rows[span]] += weight[used] * weights[span]
            used += 1
        found = np.flatnonzero((partial >= threshold - rest[used] - 1e-9) & (partial > 0))
        if not len(found):
            continue
        sizes = held.starts[found + 1] - held.starts[found]
        ends = np.cumsum(sizes)
        picked = np.arange(ends[-1]) + np.repeat(held.starts[found] - (ends - sizes), sizes)
        dense[place] = weight
        score = np.round(np.add.reduceat(dense[at[picked]] * held.weights[picked], ends - sizes), 9)
        dense[place] = 0.0
        good = score >= threshold
        if good.any():
            yield i, found[good], score[good]


class Vectors(NamedTuple):
    """Vectors of a cell, one after the other: keys, where each begins, term numbers, weights."""

    keys: pa.Array
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, key: str) -> Vectors:
        lists = table[f"{key}_terms"].combine_chunks()
        starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        return cls(table[key].combine_chunks(), starts, lists.flatten().to_numpy(), table[f"{key}_weights"].combine_chunks().flatten().to_numpy())


def pairs_on_grid(q_vec: DataFrame, c_vec: DataFrame, threshold: float, remainder: float, fan: int, within: bool) -> DataFrame:
    """(q, c, score >= threshold) of fitted vectors with string keys; `within`: pairs q < c of one set.

    Both sides are dealt into blocks by a hash of their key, and a task joins a block of queries with a block of texts: its cell of the
    grid. Only vectors are shuffled, each once per block of the other side, and the pairs that reach the threshold come out; no pair that
    merely shares a term is ever a row. Blocks grow with the input from `fan` up to SIDE texts, so up to there the copies stay as many.
    """
    held = c_vec.count()
    sought = held if within else q_vec.count()
    side = max(1, min(max(fan, math.ceil(math.sqrt(held * sought / CELLS))), SIDE))
    down, across = max(1, math.ceil(sought / side)), max(1, math.ceil(held / side))

    def block(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def dealt(vec: DataFrame, key: str, own: str, blocks: int, other: str, start: Column, stop: Column) -> DataFrame:
        placed = vec.select(key, F.col("terms").alias(f"{key}_terms"), F.col("weights").alias(f"{key}_weights"), block(key, blocks).alias(own))
        return placed.withColumn(other, F.explode(F.sequence(start, stop)))

    zero = F.lit(0)
    q_cells = dealt(q_vec, "q", "_qb", down, "_cb", F.col("_qb") if within else zero, F.lit(across - 1))
    c_cells = dealt(c_vec, "c", "_cb", across, "_qb", zero, F.col("_cb") if within else F.lit(down - 1))
    out = pa.schema([("q", pa.string()), ("c", pa.string()), ("score", pa.float64())])

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            asked, texts = Vectors.of(left, "q"), Vectors.of(right, "c")
            for i, rows, scores in _scored(asked, texts, threshold, remainder):
                parts.append(pa.Table.from_arrays([pa.repeat(asked.keys[i], len(rows)).cast(pa.string()), texts.keys.take(pa.array(rows)).cast(pa.string()), pa.array(scores)], schema=out))
        return pa.concat_tables(parts) if parts else out.empty_table()

    pairs = q_cells.groupBy("_qb", "_cb").cogroup(c_cells.groupBy("_qb", "_cb")).applyInArrow(joined, "q string, c string, score double")
    if not within:
        return pairs
    # A pair of one block is met from both ends, one of two blocks from either.
    return pairs.filter((F.col("q") < F.col("c")) | (block("q", down) != block("c", down))).select(
        F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c"), "score")


def query_vectors(queries: DataFrame, idf: DataFrame, tokenize: Tokenizer) -> DataFrame:
    """(q, terms, weights) of `queries(q, text)` under a fitted vocabulary."""
    return cut(numbered_vectors(_counted(queries, "q", tokenize), _side(idf), "q"))


def similar_pairs(queries: DataFrame | None, corpus: DataFrame, threshold: float, tokenize: Tokenizer, fan: int = 4096) -> DataFrame:
    """(q, c, score >= threshold) between distinct texts; without queries, pairs q < c inside the corpus.

    A shorter remainder verifies fewer pairs but adds up more terms; both costs grow alike, so the share between them is fixed.
    """
    remainder = REMAINDER * threshold
    idf, c_vec = fitted(corpus, tokenize)
    q_vec = c_vec.withColumnRenamed("c", "q") if queries is None else query_vectors(queries, idf, tokenize)
    return pairs_on_grid(q_vec, c_vec, threshold, remainder, fan, queries is None)


def asset_text(df: DataFrame) -> DataFrame:
    text = F.concat(F.coalesce("value", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")))
    return df.select("id", "ord", text.alias("text"))


def candidate_texts(internal: DataFrame) -> DataFrame:
    """(c, text, copies, first): equal texts once, with their first candidate."""
    return asset_text(internal).groupBy("text").agg(
        F.min(F.struct("ord", "id")).alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("c", F.sha2("text", 256))


def best_match(ext: DataFrame, first: DataFrame, idf: DataFrame, c_vec: DataFrame, threshold: float, remainder: float, fan: int = 4096) -> DataFrame:
    """Best candidate per external asset against fitted texts; copies of a text take its answer, ties go to the first candidate."""
    asked = asset_text(ext).withColumn("q", F.sha2("text", 256))
    q_vec = query_vectors(asked.select("q", "text").distinct(), idf, char_wb())
    pairs = pairs_on_grid(q_vec, c_vec, threshold, remainder, fan, False)
    ranked = pairs.join(first.select("c", "first"), "c").groupBy("q").agg(
        F.max_by(F.struct(F.col("first.id").alias("id"), F.col("score").alias("score")),
                 F.struct("score", -F.col("first.ord"))).alias("best"))
    return asked.join(ranked, "q").select(
        F.col("id").alias("ext_id"), F.col("best.id").alias("int_id"), F.col("best.score").alias("score"))


def match_fuzzy(ext: DataFrame, internal: DataFrame, threshold: float = THRESHOLD, fan: int = 4096) -> DataFrame:
    """Best internal asset per external one by character n-gram cosine of value and name."""
    remainder = REMAINDER * threshold
    corpus = cut(candidate_texts(internal))
    return best_match(ext, corpus, *fitted(corpus, char_wb()), threshold, remainder, fan)


def match_assets(ext: DataFrame, internal: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact match first, fuzzy for the rest."""
    exact = cut(match_exact(ext, internal))
    rest = ext.join(exact.select(F.col("ext_id").alias("id")), "id", "left_anti")
    return exact.withColumn("method", F.lit("exact")).unionByName(
        match_fuzzy(rest, internal, threshold).withColumn("method", F.lit("fuzzy")))


def fuse_assets(ext: DataFrame, internal: DataFrame, matches: DataFrame, properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fused asset rows and RESOLVES_TO edges.

    A matched external asset is merged into the internal one, whose id, type and properties win; an unmatched
    one is kept as new.
    """
    i = internal.select(F.col("id").alias("int_id"), F.col("type").alias("_type"), *[F.col(p).alias(f"_{p}") for p in properties])
    joined = ext.join(matches, ext["id"] == matches["ext_id"], "left").join(i, "int_id", "left")
    fused = joined.select(
        F.coalesce("int_id", "id").alias("id"), F.coalesce("_type", "type").alias("type"),
        F.col("id").alias("discovered_as"), F.col("int_id").isNotNull().alias("matched"),
        *[F.coalesce(f"_{p}", p).alias(p) for p in properties])
    edges = matches.select(
        F.col("ext_id").alias("src"), F.col("int_id").alias("dst"), F.lit("resolves_to").alias("type"),
        F.col("score").alias("confidence"))
    return fused, edges


def resolve_identities(names: DataFrame, name: str = "name", threshold: float = THRESHOLD) -> DataFrame:
    """(name, resolved, merged): names linked by similarity >= threshold share the smallest of them.

    The order in which names arrive does not matter: similarity edges in either direction are closed into
    connected components.
    """
    distinct = cut(names.select(F.col(name).alias("text")).filter(F.col("text").isNotNull()).distinct()
                   .withColumn("c", F.col("text")))
    pairs = similar_pairs(None, distinct.withColumn("copies", F.lit(1)), threshold, char_wb())
    edges = pairs.select(F.col("q").alias("src"), F.col("c").alias("dst"))
    component = connected_components(distinct.select(F.col("c").alias("id")), edges)
    return component.select(
        F.col("id").alias("name"), F.col("component").alias("resolved"), (F.col("id") != F.col("component")).alias("merged"))


#: Rows of a term table up to which it is broadcast (a term, a key and a weight: about 4 MB); counted before use.
TERM_ROWS = 100_000


def _side(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(TERM_ROWS + 1).count() <= TERM_ROWS else rows


def map_requirements(texts: DataFrame, key: str, text: str, corpus: DataFrame, k: int = 2) -> DataFrame:
    """Top-k controls per text by word TF-IDF cosine, zero scores dropped.

    `corpus(position, description)` is the control table, of any size. The words of the texts meet its vocabulary in a join, a broadcast one
    where the vocabulary is counted to be small, so only vocabulary words go on. Stop words are not in the vocabulary, so the texts need no stop-word pass.
    """
    tokenize = words()
    rows = corpus.select(F.col("position").alias("c"), F.col("description").alias("text"), F.lit(1).alias("copies"))
    counts = term_counts(rows, "c", "text", tokenize)
    idf = cut(fit_idf(counts, rows, "c", "copies"))
    control = cut(vectors(counts, idf, "c").select("c", F.inline("vec")).select("c", "term", F.col("w").alias("cw")))
    seen = texts.select(key, F.explode(words(stop_words=False)(F.col(text))).alias("term"))
    known = seen.join(_side(idf), "term").groupBy(key, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    weighted = known.withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(_side(control), "term").groupBy(key, "c").agg(F.sum(F.col("w") * F.col("cw")).alias("dot"))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "c"))).filter(F.col("rank") <= k)
    return ranked.select(key, "rank", F.col("c").alias("position"), "score")
