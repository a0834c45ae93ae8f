"""URL filters by a sort-merge range join of reversed-host keys with nested rule intervals.

The canonical key of a rule is its host with the labels reversed, "/", and its path: `com.example//en/`. Hosts hold no
"/", so a rule covers exactly the keys that start with its own, an interval of the sorted keys, and any two rules are
nested or apart. A url has one key for each ancestor of its host. Keys and rule starts are dealt to ranges and swept in
order; each rule start carries the stack of rules that are open there, and a url takes the stack of the last start
before it and drops what has ended. What is left on top is the longest rule of that host.

Ranges are cut at sampled (key, row hash) pairs, so one url or host with a third of the rows is spread as well; the cuts
only balance the work. A range starts with the stack that is open at its cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskfabric.llm.common import lower_ascii, shuffle_width

#: Characters of a range cut; cuts balance the work and need not be keys.
CUT_CHARS = 256
SAMPLES_PER_RANGE = 16


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.")))


def open_stacks(points: DataFrame, rules: DataFrame) -> DataFrame:
    """`_key` and `_stack`, the rules open at each point, shortest first. Every rule open at a point is a prefix of it."""
    prefixes = points.select("_key", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_key"), F.lit(1)))).alias("_n")).select(
        "_key", F.expr("substring(_key, 1, _n)").alias("_rule_key"))
    return prefixes.join(rules, "_rule_key").groupBy("_key").agg(F.sort_array(F.collect_list("_open")).alias("_stack"))


def range_cuts(keyed: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ranges - 1 ordered (key, hash) pairs from the rows with the least row hashes."""
    sample = sorted((r["_key"][:CUT_CHARS], r["_salt"]) for r in keyed.select("_key", "_salt").orderBy("_salt", "_key").limit(ranges * SAMPLES_PER_RANGE).collect())
    # The salt decides which rows are sampled, so within one key the cuts are spread over all salts instead.
    cuts, step = [], max(1, len(sample) // ranges)
    for i in range(step, len(sample), step):
        key = sample[i][0]
        same = [j for j in range(len(sample)) if sample[j][0] == key]
        share = (i - same[0]) / len(same)
        cuts.append((key, int(-(2**63) + share * 2**64)))
    return sorted(set(cuts))


def range_of(key: Column, salt: Column, cuts: list[tuple[str, int]]) -> Column:
    """The number of cuts up to (key, salt), found by groups of cuts first."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + size] for i in range(0, len(cuts), size)]
    literal = lambda pairs: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("long").alias("s")) for k, s in pairs])
    own = F.struct(key.alias("k"), salt.alias("s"))
    group = F.size(F.filter(literal([g[0] for g in groups]), lambda c: c <= own))
    inside = F.element_at(F.array(*[literal(g) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * size + F.size(F.filter(inside, lambda c: c <= own)))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (`host` + `path` of the longest fitting rule, or null) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; a longer
    host + path wins, then the longer host, then `block` before `allow`. Null urls and urls without `://` have empty host
    and path. Repeated rows come back as often as they are there. Other columns of the inputs are not read.
    """
    spark = pages.sparkSession
    rule_rows = rules.select(F.coalesce(lower_ascii("host"), F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
    rule_rows = rule_rows.groupBy("h", "p").agg(F.max("v").alias("v")).select(  # block is the larger of the two
        F.concat_ws("/", reversed_host(F.col("h")), F.col("p")).alias("_rule_key"),
        F.struct(F.length(F.concat("h", "p")).alias("len"), F.length("h").alias("host_len"), F.concat("h", "p").alias("rule"),
                 F.col("v").alias("verdict"), F.concat_ws("/", reversed_host(F.col("h")), F.col("p")).alias("key")).alias("_open"))

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).groupBy("_id", "_url").agg(F.count(F.lit(1)).alias("_copies")).select(
        "_id", "_copies", url_host(F.col("_url")).alias("_host"), url_path(F.col("_url")).alias("_path"), F.xxhash64("_id", "_url").alias("_salt"))
    keyed = rows.withColumn("_labels", F.reverse(F.split("_host", r"\."))).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_level")).select(
        "_id", "_copies", "_host", "_path", "_salt", "_level",
        F.concat_ws("/", F.expr("array_join(slice(_labels, 1, _level), '.')"), F.col("_path")).alias("_key"))

    ranges = max(32, shuffle_width(spark))
    cuts = range_cuts(keyed, ranges)
    starts = rule_rows.select(F.col("_rule_key").alias("_key"))
    stacks = open_stacks(starts.distinct(), rule_rows)
    least = -(2**63)
    events = stacks.select(range_of(F.col("_key"), F.lit(least), cuts).alias("_range"), "_key", F.lit(least).alias("_salt"), "_stack")
    if cuts:
        carried = spark.createDataFrame([(i + 1, k, s) for i, (k, s) in enumerate(cuts)], "_range int, _key string, _salt long")
        at_cut = open_stacks(carried.select("_key").distinct(), rule_rows)
        events = events.unionByName(carried.join(at_cut, "_key").select("_range", "_key", F.col("_salt"), "_stack"))
    both = keyed.withColumn("_range", range_of(F.col("_key"), F.col("_salt"), cuts)).withColumn("_is_url", F.lit(1)).unionByName(
        events.withColumn("_is_url", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("_range").orderBy("_key", "_salt", "_is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_last", F.last("_stack", ignorenulls=True).over(order)).filter("_is_url = 1").select(
        "_id", "_copies", "_host", "_path", "_level",
        F.expr("try_element_at(filter(_last, r -> startswith(_key, r.key)), -1)").alias("_top"))
    best = swept.groupBy("_id", "_host", "_path").agg(F.max("_top").alias("_best"), F.sum(F.when(F.col("_level") == 1, F.col("_copies"))).alias("_copies"))
    return best.select(F.explode(F.expr("sequence(1L, _copies)")).alias("_copy"), "*").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
