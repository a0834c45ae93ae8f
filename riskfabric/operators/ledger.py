"""Hash-chained audit ledger: block hashes, building, verification, custody logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.operators.scan import KeyedScan
from riskfabric.session import cut, discard, scratch

# The genesis block.
GENESIS_PREV = "0" * 64
GENESIS_EVENT = '{"type": "GENESIS"}'


def block_body(event: Column, index: Column, prev_hash: Column, timestamp: Column | None = None) -> Column:
    """Canonical JSON of a block without its hash: sorted keys, ', ' and ': ' separators.

    `event` is already canonical JSON text and `timestamp` its number as text.
    """
    parts = [
        F.lit('{"event": '), event, F.lit(', "index": '), index.cast("string"),
        F.lit(', "prev_hash": "'), prev_hash, F.lit('"'),
    ]
    if timestamp is not None:
        parts += [F.lit(', "timestamp": '), timestamp.cast("string")]
    return F.concat(*parts, F.lit("}"))


def block_hash(event: Column, index: Column, prev_hash: Column, timestamp: Column | None = None) -> Column:
    return F.sha2(block_body(event, index, prev_hash, timestamp), 256)


def _links(key: str, first: int, start: str):
    """Arrow fold over rows sorted by key and order: number, previous hash and hash of each, one batch in memory at a time.

    The chain of a key begins at number `first` behind `_last` of its rows, or behind `start` where they have no such column.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, last = object(), first, start
        for batch in batches:
            names = batch.schema.names
            opening = batch.column("_last").to_pylist() if "_last" in names else [start] * batch.num_rows
            numbers, before, hashes = [], [], []
            for k, event, opened in zip(batch.column(key).to_pylist(), batch.column("event").to_pylist(), opening):
                if k != current:
                    current, index, last = k, first, opened
                numbers.append(index)
                before.append(last)
                last = hashlib.sha256(f'{{"event": {event}, "index": {index}, "prev_hash": "{last}"}}'.encode()).hexdigest()
                hashes.append(last)
                index += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(numbers, pa.int64()), batch.column("event"), pa.array(before, pa.string()), pa.array(hashes, pa.string())],
                names=[key, "index", "event", "prev_hash", "hash"])

    return fold


def build_chain(df: DataFrame, key: str, order: list[str], event: str, round_rows: int = 1_000_000) -> DataFrame:
    """Chain the events of each key in order behind a genesis block: (key, index, event, prev_hash, hash).

    Block numbers run on from the genesis block 0 and every block holds the hash of the one before; a null event is the JSON
    null. A chain is serial by nature: the rows of a key stream through one task in order, which holds one Arrow batch. Keys
    are independent and run side by side. Where a key has more than `round_rows` events, all rows are numbered first and
    written as slices of that many per key; each round reads its own slice only and starts from the last hash of the round
    before, so every event is read once and a task sorts at most `round_rows` of a key.
    """
    spark = df.sparkSession
    rows = df.select(key, *order, F.coalesce(F.col(event), F.lit("null")).alias("event"))
    sizes = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size")))
    longest = sizes.agg(F.max("_size")).first()[0] or 0
    first = F.struct(F.lit(0).cast("long").alias("index"), F.lit(GENESIS_EVENT).alias("event"), F.lit(GENESIS_PREV).alias("prev_hash"))
    genesis = sizes.select(key, first.alias("_b")).select(key, "_b.*").withColumn(
        "hash", block_hash(F.col("event"), F.col("index"), F.col("prev_hash")))
    opening = hashlib.sha256(f'{{"event": {GENESIS_EVENT}, "index": 0, "prev_hash": "{GENESIS_PREV}"}}'.encode()).hexdigest()
    folder = scratch(spark, "chain")
    genesis.write.parquet(f"{folder}/genesis")
    written = [f"{folder}/genesis"]

    def extend(part: DataFrame, by: list[str], at: int) -> None:
        placed = part.repartition(key).sortWithinPartitions(key, *by)
        written.append(f"{folder}/from-{at}")
        placed.mapInArrow(_links(key, at + 1, opening), genesis.schema).write.parquet(written[-1])

    if longest <= round_rows:
        extend(rows.select(key, *[c for c in order if c != key], "event"), order, 0)
    else:
        slices = scratch(spark, "slices")
        numbered = KeyedScan(rows, [key], order).row_number("_n").done()
        numbered.select(key, "_n", "event", F.floor((F.col("_n") - 1) / round_rows).alias("_round")).write.partitionBy("_round").parquet(slices)
        plain = numbered.select(key, "_n", "event").schema
        for at in range(0, longest, round_rows):
            part = spark.read.schema(plain).parquet(f"{slices}/_round={at // round_rows}")
            if at:
                ends = spark.read.schema(genesis.schema).parquet(written[-1]).filter(F.col("index") == at)
                last = ends.select(F.col(key).alias("_key"), F.col("hash").alias("_last"))
                part = part.join(last, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
            extend(part, ["_n"], at)
        discard(spark, slices)
    return spark.read.schema(genesis.schema).parquet(*written)


def check_blocks(df: DataFrame, keys: list[str], timestamp: str | None = None) -> DataFrame:
    """Flag each block: hash recomputed, and previous hash equal to the block before; block 0 must be the genesis block.

    The block before is found by an equi-join on (chain, index), so a single huge chain is checked in parallel.
    """
    prior = df.select(*keys, (F.col("index") + 1).alias("index"), F.col("hash").alias("_before"))
    joined = df.join(prior, [*keys, "index"], "left")
    ts = F.col(timestamp) if timestamp else None
    recomputed = block_hash(F.col("event"), F.col("index"), F.col("prev_hash"), ts) == F.col("hash")
    linked = F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False))
    genesis = (F.col("event") == GENESIS_EVENT) & (F.col("prev_hash") == GENESIS_PREV)
    return joined.withColumn("ok", F.coalesce(recomputed & F.when(F.col("index") == 0, genesis).otherwise(linked), F.lit(False))).drop("_before")


def verify_chain(df: DataFrame, keys: list[str], timestamp: str | None = None) -> DataFrame:
    """Per chain: intact or not, number of blocks and the first bad index."""
    checked = check_blocks(df, keys, timestamp)
    return checked.groupBy(*keys).agg(
        F.bool_and("ok").alias("valid"), F.count(F.lit(1)).alias("blocks"),
        F.min(F.when(~F.col("ok"), F.col("index"))).alias("first_bad"))


def custody_log(df: DataFrame, keys: list[str], target: str | None = None) -> DataFrame:
    """Blocks whose event names the asset, each with the integrity of the whole ledger."""
    intact = verify_chain(df, keys).agg(F.bool_and("valid")).scalar()
    rows = df
    if target is not None:
        direct = F.get_json_object("event", "$.target") == target
        nested = F.get_json_object("event", "$.details.target_asset") == target
        rows = df.filter(F.coalesce(direct, F.lit(False)) | F.coalesce(nested, F.lit(False)))
    return rows.withColumn("integrity_verified", intact)
