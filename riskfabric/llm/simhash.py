"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of the binary Golay code [23, 12], whose balls of radius 3 cover all 23-bit words, on bits 0-22
and again on bits 23-45. A fingerprint x stands at its own pair of anchors. A fingerprint y within `threshold` bits of x
lies, in each half, within the covering radius plus the bits by which they differ there of x's anchor; so y is copied to
every pair of anchors within 3 + t1 and 3 + t2 bits, t1 + t2 <= threshold, and the two meet at x's anchors. There the full
64 bits are compared, in the condition of an equi-join. Copies with equal fingerprints are folded before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.common import bound_batches
from riskfabric.llm.worker import give_back
from riskfabric.operators.graph import connected_components
from riskfabric.session import cut

THRESHOLD = 2
SHINGLE_WORDS = 3
SEED = 42
HALF_BITS = 23
RADIUS = 3
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101
#: Fingerprints whose anchors, some sixty each, are made and sent together.
MARKS_AT_ONCE = 1_024


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    words = words.astype(np.int64)
    for bit in range(HALF_BITS - 1, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def error_patterns(most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By syndrome: all patterns of up to `most` bits with it, and their weights, lightest first."""
    found = [(sum(1 << b for b in bits), w) for w in range(most + 1) for bits in combinations(range(HALF_BITS), w)]
    patterns, weights = (np.array(c, np.int64) for c in zip(*found, strict=True))
    of = syndromes(patterns)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return {int(of[g[0]]): (patterns[g], weights[g]) for g in np.split(order, cuts)}


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 hashes of the runs of `words` words, repeats included; a shorter text is one run, one without words has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not parts:
        return np.zeros(0, "<u8")
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], "<u8")


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; see `fingerprints`."""
    hashes = shingle_hashes(text, words, seed)
    n = len(hashes)
    if not n:
        return 0
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        set_bits += np.unpackbits(hashes[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """`_id`, `_fp` (long) and, if asked for, `_key` (text): each bit is 1 if set in over half of the XXH64 hashes of the text's word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint_of(t.as_py()) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), *batch.columns[2:]], names=["_id", "_fp", *batch.schema.names[2:]])

    key = [F.col(key_col).cast("string").alias("_key")] if key_col else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *key)
    bound_batches(docs.sparkSession)
    return rows.mapInArrow(give_back(run), "_id long, _fp long" + (", _key string" if key_col else ""))


def anchored(marks: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(`_anchor`, `_fp`) at the own anchors, and again at every pair of anchors in reach."""
    mask = (1 << HALF_BITS) - 1
    reach = error_patterns(RADIUS + threshold)

    def run(batches: Iterator[pa.RecordBatch], all_in_reach: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MARKS_AT_ONCE):
                anchors, owners = [], []
                marks = batch.column("_fp").slice(at, MARKS_AT_ONCE).to_numpy()
                lows, highs = marks & mask, marks >> HALF_BITS & mask
                for mark, low, high, s1, s2 in zip(*(a.tolist() for a in (marks, lows, highs, syndromes(lows), syndromes(highs))), strict=True):
                    (e1, w1), (e2, w2) = reach[s1], reach[s2]
                    if not all_in_reach:
                        e1, e2, w1, w2 = e1[:1], e2[:1], w1[:1], w2[:1]
                    over = np.maximum(0, w1 - RADIUS)[:, None] + np.maximum(0, w2 - RADIUS)[None, :]
                    i, j = np.nonzero(over <= threshold)
                    anchors.append((low ^ e1[i]) << HALF_BITS | (high ^ e2[j]))
                    owners.append(np.full(len(i), mark))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors), pa.int64()), pa.array(np.concatenate(owners), pa.int64())], names=["_anchor", "_fp"])

    schema = "_anchor long, _fp long"
    return marks.mapInArrow(give_back(lambda b: run(b, False)), schema), marks.mapInArrow(give_back(lambda b: run(b, True)), schema)


def near_pairs(marks: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`_a` < `_b`: distinct fingerprints that differ in 1 to `threshold` bits. marks: distinct `_fp`.

    Spark takes both sides to be as large as `marks`, though one has some sixty rows for each, so neither may be broadcast by size.
    """
    own, reached = anchored(marks, threshold)
    own, reached = own.select("_anchor", F.col("_fp").alias("_a")), reached.select(F.col("_anchor").alias("_at"), F.col("_fp").alias("_b"))
    return own.hint("merge").join(reached, (F.col("_anchor") == F.col("_at")) & (F.col("_a") < F.col("_b")) & (F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= threshold)).select("_a", "_b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, key_col: str | None = None) -> DataFrame:
    """id, `fingerprint` (16 hex digits) and `component_id`, the smallest id reachable over links of <= threshold bits.

    One row per input row; rows of the same id are linked by their texts alone and a row always reaches itself. Null and
    empty texts have fingerprint zero, linked like any other. Rows with a null id pass links on and take part in the
    component, which is null only where no row of it has an id. Only the two columns are read. With `key_col`, a text that names rows, that
    column and `group` (a number for each component, null ids or not) follow.
    """
    rows = cut(fingerprints(docs, id_col, text_col, key_col))
    marks = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    pairs = cut(near_pairs(marks.select("_fp").repartition("_fp"), threshold))
    linked = pairs.select(F.explode(F.array("_a", "_b")).alias("id")).distinct()
    groups = connected_components(linked, pairs.select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
    merged = cut(marks.join(groups, F.col("_fp") == F.col("id"), "left").select("_fp", "_least", F.coalesce("component", "_fp").alias("_group")))
    least = cut(merged.groupBy("_group").agg(F.min("_least").alias("_component")))
    classes = cut(merged.join(least, "_group").select(F.col("_fp").alias("_mark"), "_component", "_group"))
    more = [F.col("_key").alias(key_col), F.col("_group").alias("group")] if key_col else []
    return rows.join(classes, F.col("_fp") == F.col("_mark")).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"), *more)
