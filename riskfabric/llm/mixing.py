"""Mixing sources to target weights by entropy balancing.

Per source the rates of its documents are the ones closest to 1 in relative entropy, sum r log r - r + 1, among those
between 0 and `most` whose words add up to the source's target. By duality r = min(most, exp(l * size / largest size)) with one
multiplier l per source, found by Newton steps on the logarithm of the tilted words, inside a bracket that shrinks at every step.
Rates depend on source and size only, so the steps run over the table of (source, size, documents), which grows with the
distinct lengths, not with the documents. All sums are of whole numbers (rates count in units of 2^-30), so no
result depends on the order in which tasks finish.

Rates become copies without chance: documents of a source in descending size, the copies up to each size are the rounded sum of the
rates up to it. What is then missing or too much is made up by copies of the largest sizes that still fit, until none fits.
Among documents of one source and size those of the least hash of the id get the copy more.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.llm.common import small_or_shuffled
from riskfabric.operators.scan import KeyedScan
from riskfabric.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Rates count in units of 1 / UNIT.
UNIT = 2**30
#: A source is balanced where its tilted words are this close to the target, in proportion.
TOLERANCE = 1e-6
#: Rows of (source, size) up to which the copies per size are broadcast (about 2 MB).
WIDE_ROWS = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _whole(*factors: Column) -> Column:
    """Product of whole numbers as a decimal that sums can take."""
    out = factors[0].cast("decimal(12,0)")
    for factor in factors[1:]:
        out = out * factor.cast("decimal(12,0)")
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """`source`, `source_size`, `_largest`, `_least` and `target` per source of (`source`, `size`, `_n`).

    Weights go round the sources in code-point order, null last. What a source cannot take (`most` times its words) is shared
    by the others: the target is the smaller of that and weight x level, the level found by steps over the table of sources.
    """
    n_size = _whole(F.col("_n"), F.col("size"))
    per = sizes.groupBy("source").agg(F.sum(n_size).cast("long").alias("source_size"), F.max("size").alias("_largest"),
                                      F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"))
    place = KeyedScan(per.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"]).row_number("_place").done()
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = cut(place.withColumn("_weight", F.element_at(cycle, (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("_null", "_place"))
    cap = F.col("source_size") * most
    wanted = float(share) * float(weighed.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = cap.cast("double") < F.col("_weight") * F.lit(level)
        held, rest, count = weighed.agg(F.sum(F.when(above, cap.cast("decimal(38,0)"))), F.sum(F.when(~above, F.col("_weight"))), F.count(F.when(above, 1))).first()
        if count == full or not rest:
            break
        level, full = (wanted - float(held or 0)) / float(rest), count
    return weighed.withColumn("target", F.least(cap.cast("double"), F.col("_weight") * F.lit(level))).drop("_weight")


def _rate(multiplier: str, most: int) -> Column:
    """min(most, exp(l * size / largest)) in units."""
    tilt = F.col(multiplier) * F.col("size") / F.col("_largest")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(tilt, F.lit(50.0)))))
    return F.floor(rate * UNIT + 0.5).cast("long")


def multipliers(sizes: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """`wanted` with the multiplier `_l` of each source: safeguarded Newton steps, all sources at once, until each is balanced."""
    least = F.col("_least") / F.col("_largest")
    start = wanted.withColumns({
        "_low": F.log(F.least(F.col("target") / F.col("source_size"), F.lit(1.0))) / least - 1e-6,
        "_high": F.lit(1 + 1e-9) * F.log(F.lit(float(most))) / least + 1e-9})
    full = F.col("target") >= F.col("source_size") * most
    state = cut(start.withColumn("_done", F.coalesce(full, F.lit(True)) | (F.col("source_size") == 0) | (F.col("target") <= 0))
                .withColumn("_l", F.when(F.col("source_size") == 0, 0.0).when(F.col("_done") & ~full, -1e300).when(full, F.col("_high")).otherwise(0.0)))
    while not state.filter("not _done").isEmpty():
        open_ = small_or_shuffled(state.filter("not _done").select(F.col("source").alias("_source"), "_l", "_largest"))
        terms = sizes.join(open_, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_r", _rate("_l", most))
        free = F.when(F.col("_r") < most * UNIT, F.floor(F.col("_r") * F.col("size") / F.col("_largest"))).otherwise(0)
        sums = terms.groupBy("_source").agg(F.sum(_whole(F.col("_n"), F.col("size"), F.col("_r"))).alias("_g"),
                                            F.sum(_whole(F.col("_n"), F.col("size"), free)).alias("_d"))
        sums = small_or_shuffled(sums.select("_source", (F.col("_g").cast("double") / UNIT).alias("_g"), (F.col("_d").cast("double") / UNIT).alias("_d")))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left")
        over, judged = F.col("_g") > F.col("target"), F.col("_g").isNotNull()
        low = F.when(judged & ~over, F.col("_l")).otherwise(F.col("_low"))
        high = F.when(judged & over, F.col("_l")).otherwise(F.col("_high"))
        step = F.when((F.col("_g") > 0) & (F.col("_d") > 0), F.col("_l") + (F.log("target") - F.log("_g")) * F.col("_g") / F.col("_d"))
        near = (F.abs(F.col("_g") - F.col("target")) <= TOLERANCE * F.col("target")) | (high - low <= 1e-13 * (1 + F.abs(F.col("_l"))))
        moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        state = cut(joined.select(*wanted.columns, low.alias("_low"), high.alias("_high"),
                                  (F.col("_done") | F.coalesce(near, F.lit(False))).alias("_done"),
                                  F.when(judged & ~near, moved).otherwise(F.col("_l")).alias("_l")))
    return state.select(*wanted.columns, "_l")


def _copies(cells: DataFrame, most: int) -> DataFrame:
    """`_m` copies in all for the `_n` documents of each (source, size)."""
    by_size = Window.partitionBy("source").orderBy(F.desc("size"))
    # A row per distinct size of a source.
    up_to = F.sum(_whole(F.col("_n"), F.col("_r"))).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.floor(up_to / F.lit(Decimal(UNIT)) + F.lit(Decimal("0.5"))).cast("long")
    cells = cells.withColumn("_upto", whole)
    cells = cut(cells.withColumn("_m", F.col("_upto") - F.lag("_upto", 1, 0).over(by_size)).drop("_upto"))
    while True:
        taken = F.sum(_whole(F.col("size"), F.col("_m"))).over(Window.partitionBy("source"))
        gap = cells.withColumn("_gap", F.col("target") - taken.cast("double"))
        room = F.when(F.col("_gap") > 0, F.col("_n") * most - F.col("_m")).otherwise(F.col("_m"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_gap"))
        gap = gap.withColumn("_room", F.when(fits, room).otherwise(0))
        before = F.coalesce(F.sum(_whole(F.col("_room"), F.col("size"))).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.floor((F.abs("_gap") - before.cast("double")) / F.col("size"))
        more = F.when(F.col("_room") > 0, F.least("_room", F.greatest(left, F.lit(0)))).otherwise(0).cast("long")
        cells = cut(gap.withColumn("_more", more).withColumn("_m", F.col("_m") + F.when(F.col("_gap") > 0, F.col("_more")).otherwise(-F.col("_more"))).drop("_gap", "_room"))
        if cells.filter("_more > 0").isEmpty():
            return cells.drop("_more")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, `source`, `size` (words), `source_size`, `target`, `rate`, `copies` and `taken` (copies x size).

    `share` of all words is dealt to the sources by weight, no source above `most` times its words, no row above `most` copies.
    A null source is a source of its own; texts that are null or without a word have size 0, rate 1 and count for nothing. Repeated
    rows are rows of their own; which of several equal rows has the copy more is left open, how many have it is not. An empty table gives an
    empty one. Only the three columns are read, further columns do not pass.
    """
    sized = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
                .withColumn("_tie", F.monotonically_increasing_id()))
    sizes = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n")))
    state = small_or_shuffled(multipliers(sizes, targets(sizes, weights, share, most), most).withColumnRenamed("source", "_source"))
    cells = sizes.join(state, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_r", _rate("_l", most))
    cells = _copies(cells, most).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target",
                                        (F.col("_r") / UNIT).alias("rate"), F.floor(F.col("_m") / F.col("_n")).alias("_each"), F.pmod("_m", "_n").alias("_extra"))
    ranked = KeyedScan(sized.withColumn("_hash", F.xxhash64("_id")), ["source", "size"], ["_hash", "_id", "_tie"]).row_number("_rank").done()
    joined = ranked.join(small_or_shuffled(cells, WIDE_ROWS), F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    copies = F.col("_each") + (F.col("_rank") <= F.col("_extra")).cast("long")
    return joined.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "rate", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))
