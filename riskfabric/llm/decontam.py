"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Containment |Q & X| / |Q| of a short item Q in a long document X says nothing about X's size, so only items are sketched:
they are partitioned by their number of shingles, and each partition has a sketch length, the least hashes of the item
of which a document with enough of the item's shingles must hold at least one (of n shingles at most n - ceil(t n) are
missing). A document is a candidate if one of its shingle hashes is in the sketch of an item and it has enough words
for the items of that partition. Candidates are verified with the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.common import let, small_or_shuffled
from riskfabric.session import cut

SHINGLE_WORDS = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _each_shingle(words: Column, width: int, body) -> Column:
    """body(words, start) for each run of `width` words; null if there are fewer."""
    return let(words, lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: body(w, i))))


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of `width` words; null if there are fewer."""
    return _each_shingle(words, width, lambda w, i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(width)]))


def shingles(words: Column, width: int) -> Column:
    """Distinct runs of `width` words, space-joined; null if there are fewer."""
    return F.array_distinct(_each_shingle(words, width, lambda w, i: F.concat_ws(" ", F.slice(w, i, F.lit(width)))))


def sketched(items: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """`_item`, `_key` (of the item's row), `_width`, `_shingles`, `_need` (shingles that make a match) and `_sketch`.

    Items without a word are left out. Items with fewer words than a shingle are one shingle of their own width. The sketch length is that of the item's size
    partition (sizes up to the same power of two), at least what the item itself needs.
    """
    words = items.select(F.col(id_col).alias("_item"), F.xxhash64(id_col, text_col).alias("_key"), words_of(F.col(text_col)).alias("_words")).filter("size(_words) > 0")
    by_width = [words.filter(F.size("_words") >= width).withColumn("_width", F.lit(width))] + [
        words.filter(F.size("_words") == n).withColumn("_width", F.lit(n)) for n in range(1, width)]
    parts = [part.select("_item", "_key", F.lit(n).alias("_width"), shingles(F.col("_words"), n).alias("_shingles"))
             for n, part in zip([width, *range(1, width)], by_width, strict=True)]
    all_items = parts[0]
    for part in parts[1:]:
        all_items = all_items.unionByName(part)
    size = F.size("_shingles")
    partition = F.pow(F.lit(2.0), F.ceil(F.log2(size))).cast("int")
    # A match holds ceil(t n) shingles, so n - ceil(t n) + 1 hashes are enough for any size n of the partition.
    enough = F.least(size, F.floor(partition * (1 - threshold) + 1e-9).cast("int") + 1)
    return all_items.withColumn("_need", F.ceil(size * threshold - 1e-9).cast("int")).withColumn("_partition", partition).withColumn(
        "_sketch", F.slice(F.array_sort(F.array_distinct(F.transform("_shingles", _hash_of_joined(width)))), F.lit(1), enough))


def _hash_of_joined(width: int):
    """The hash of a space-joined shingle, equal to that of its words."""
    def body(joined: Column) -> Column:
        parts = F.split(joined, " ")
        hashes = [F.xxhash64(*[F.get(parts, F.lit(k)) for k in range(n)]) for n in range(1, width + 1)]
        out = hashes[-1]
        for n in range(1, width):
            out = F.when(F.size(parts) == n, hashes[n - 1]).otherwise(out)
        return out

    return body


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item id, `n_shared`, `n_item` and `containment` of all pairs with containment >= threshold.

    Shingles are distinct runs of `width` words after lower-casing and dropping punctuation. Null and empty texts, and rows
    with a null id, match nothing. Of repeated ids the best text counts. Only ids and texts are read.
    """
    sketches = cut(sketched(items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_id"), F.col(item_text_col).alias("_text")).distinct(), threshold, width, "_id", "_text"))
    probes = cut(sketches.select("_key", "_width", "_need", F.explode("_sketch").alias("_hash")))
    widths = sorted(r["_width"] for r in probes.select("_width").distinct().collect())  # at most `width` numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null")
    found = None
    for n in widths:
        probe = small_or_shuffled(probes.filter(F.col("_width") == n).select("_key", "_need", F.col("_hash").alias("_probe")), to_exploded=True)
        hashed = texts.select("_id", shingle_hashes(words_of(F.col("_text")), n).alias("_hashes"))
        hits = hashed.select("_id", F.size("_hashes").alias("_n"), F.explode("_hashes").alias("_hash")).join(
            probe, (F.col("_hash") == F.col("_probe")) & (F.col("_n") >= F.col("_need"))).select("_id", "_key")
        found = hits if found is None else found.unionByName(hits)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    result = f"_id {kinds[0]}, _item {kinds[1]}, n_shared int, n_item int"
    if found is None:
        verified = docs.sparkSession.createDataFrame([], result)
    else:
        candidates = cut(found.distinct())
        wanted = small_or_shuffled(candidates.select(F.col("_id").alias("_wanted")).distinct())
        own = texts.join(wanted, F.col("_id") == F.col("_wanted"), "left_semi")
        needed = small_or_shuffled(cut(sketches.select(F.col("_key").alias("_sought"), "_width", "_need", F.explode("_shingles").alias("_shingle"))), 50_000, to_exploded=True)
        parts = [own.select("_id", F.xxhash64("_text").alias("_row"), F.explode(shingles(words_of(F.col("_text")), n)).alias("_own")).join(
            needed.filter(F.col("_width") == n), F.col("_own") == F.col("_shingle")) for n in widths]
        shared = parts[0]
        for part in parts[1:]:
            shared = shared.unionByName(part)
        counted = shared.groupBy("_id", "_row", F.col("_sought").alias("_key")).agg(
            F.count_distinct("_shingle").cast("int").alias("n_shared"), F.first("_need").alias("_need"))
        kept = counted.filter(F.col("n_shared") >= F.col("_need")).join(candidates, ["_id", "_key"], "left_semi")
        sizes = sketches.select("_key", "_item", F.size("_shingles").alias("n_item"))
        verified = kept.join(sizes, "_key").groupBy("_id", "_item").agg(
            F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("_best")).select("_id", "_item", "_best.n_shared", "_best.n_item")
    return verified.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "n_shared", "n_item",
                           (F.col("n_shared") / F.col("n_item")).alias("containment"))
