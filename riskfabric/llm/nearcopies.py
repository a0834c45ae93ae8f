"""Near copies by the Jaccard similarity of word shingles, without loss.

To reach similarity t, two texts share ceil(t n) shingles of each, so in any order common to all texts the first
n - ceil(t n) + 1 shingles of both (their prefixes) have one in common. Rare shingles come first; which are common is
estimated from a sample, which decides how many candidates there are but never which pairs are found. Candidates are verified
with the whole shingle sets. No Hamming radius on fingerprints would do: at 0.8 they differ in about 10 of 64 bits, some in 18.

A shingle of many texts would make pairs by the square, so in the first rounds every text of a bucket meets one
member only and buckets whose texts are linked by then are done; what is left meets pairwise across groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.common import lower_ascii, small_or_shuffled
from riskfabric.llm.simhash import shingle_hashes
from riskfabric.operators.graph import connected_components
from riskfabric.session import cut

THRESHOLD = 0.8
SHINGLE_WORDS = 5
#: One text in so many tells which shingles are common, and so many of these are told apart.
SAMPLED, COMMON = 16, 20_000
STAR_ROUNDS = 2


def text_key(text: Column) -> Column:
    """One value for all texts of the same words, whatever the case of A to Z and the white space; null is like empty."""
    return F.xxhash64(F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+", " ")))


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, ascending, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), width)).view("<i8"))], names=["_hash"])

    counts = texts.filter(F.pmod("_key", F.lit(SAMPLED)) == 0).select("_text").mapInArrow(run, "_hash long").groupBy("_hash").count()
    top = counts.filter("count > 2").orderBy(F.desc("count"), "_hash").limit(COMMON).collect()
    hashes = np.array([r["_hash"] for r in top], np.int64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["count"] for r in top], np.int64)[order]


def _prefixes(texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """`_hash`, `_key`, `_n`: the prefix of each text and its number of distinct shingles."""
    common, counts = _common(texts, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[int] = set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in before:
                    continue
                if len(before) < 100_000:  # copies are folded here as far as memory goes, and after the shuffle for good
                    before.add(key)
                own = np.unique(shingle_hashes(text.as_py(), width)).view("<i8")
                if not (n := len(own)):
                    continue
                rank = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, counts[at], 0)
                first = own[np.lexsort((own, rank))[:n - int(np.ceil(threshold * n - 1e-9)) + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), key, np.int64)), pa.array(np.full(len(first), n, np.int32))],
                                                 names=["_hash", "_key", "_n"])

    return texts.select("_key", "_text").mapInArrow(run, "_hash long, _key long, _n int")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """`_key` and `_set`, the distinct shingles, once per key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[int] = set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key not in before:
                    if len(before) < 100_000:
                        before.add(key)
                    own = np.unique(shingle_hashes(text.as_py(), width)).view("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=["_key", "_set"])

    return texts.select("_key", "_text").mapInArrow(run, "_key long, _set array<long>").dropDuplicates(["_key"])


def links(texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE_WORDS) -> DataFrame:
    """`_a`, `_b`: keys of similar texts, not all pairs but enough to connect all that are. texts: `_key`, `_text`."""
    prefixes = _prefixes(texts, threshold, width).repartition("_hash")
    several = prefixes.groupBy("_hash").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high")).filter("_low <> _high").select(F.col("_hash").alias("_at"))
    shared = cut(prefixes.join(several, F.col("_hash") == F.col("_at"), "left_semi").distinct())
    wanted = small_or_shuffled(cut(shared.select(F.col("_key").alias("_wanted")).distinct()))
    sets = cut(_sets(texts.join(wanted, F.col("_key") == F.col("_wanted"), "left_semi"), width))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("_key").alias("_a"), F.col("_set").alias("_x")), sets.select(F.col("_key").alias("_b"), F.col("_set").alias("_y"))
        common = F.size(F.array_intersect("_x", "_y"))
        return cut(pairs.join(a, "_a").join(b, "_b").filter(common >= (F.size("_x") + F.size("_y") - common) * threshold - 1e-9).select("_a", "_b"))

    def similar_size(n: Column, m: Column) -> Column:
        return F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9

    found, left = None, shared.withColumn("_group", F.col("_key"))
    for i in range(STAR_ROUNDS + 1):
        if i < STAR_ROUNDS:
            centres = left.groupBy(F.col("_hash").alias("_at")).agg(F.min(F.struct(F.xxhash64("_key", F.lit(i)), F.col("_key").alias("key"), F.col("_n").alias("n"), F.col("_group").alias("group"))).alias("_c"))
            met = left.join(centres, F.col("_hash") == F.col("_at")).filter((F.col("_group") != F.col("_c.group")) & similar_size(F.col("_n"), F.col("_c.n")))
            met = met.select(F.least("_key", "_c.key").alias("_a"), F.greatest("_key", "_c.key").alias("_b"))
        else:
            other = left.select(F.col("_hash").alias("_at"), F.col("_key").alias("_b"), F.col("_n").alias("_m"), F.col("_group").alias("_other"))
            met = left.join(other, (F.col("_hash") == F.col("_at")) & (F.col("_key") < F.col("_b")) & (F.col("_group") != F.col("_other")) & similar_size(F.col("_n"), F.col("_m")))
            met = met.select(F.col("_key").alias("_a"), "_b")
        more = verified(met.distinct())
        found = more if found is None else found.unionByName(more)
        if i < STAR_ROUNDS:
            groups = connected_components(found.select(F.explode(F.array("_a", "_b")).alias("id")).distinct(), found.select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
            grouped = shared.join(groups, F.col("_key") == F.col("id"), "left").select("_hash", "_key", "_n", F.coalesce("component", "_key").alias("_group"))
            unlinked = grouped.groupBy(F.col("_hash").alias("_at")).agg(F.min("_group").alias("_low"), F.max("_group").alias("_high")).filter("_low <> _high").select("_at")
            left = cut(grouped.join(unlinked, F.col("_hash") == F.col("_at"), "left_semi"))
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE_WORDS) -> DataFrame:
    """id and `component_id`, the smallest id reachable over links of similarity >= threshold; one row per input row.

    Words are as in `simhash`. Texts of fewer words than a shingle are one shingle; null and empty texts are linked with each
    other only. Rows with a null id pass links on. Only the two columns are read.
    """
    texts = docs.select(text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    pairs = cut(links(texts, threshold, width))
    groups = connected_components(pairs.select(F.explode(F.array("_a", "_b")).alias("id")).distinct(), pairs.select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
    marks = rows.groupBy("_key").agg(F.min("_id").alias("_least"))
    merged = cut(marks.join(groups, F.col("_key") == F.col("id"), "left").select("_key", "_least", F.coalesce("component", "_key").alias("_group")))
    least = merged.groupBy("_group").agg(F.min("_least").alias("_component"))
    classes = cut(merged.join(least, "_group").select(F.col("_key").alias("_mark"), "_component"))
    return rows.join(classes, F.col("_key") == F.col("_mark")).select(F.col("_id").alias(id_col), F.col("_component").alias("component_id"))
