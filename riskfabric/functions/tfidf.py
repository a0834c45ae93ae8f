"""TF-IDF vectors as DataFrames: character n-grams inside words, or word tokens.

Smooth inverse document frequency ln((1+n)/(1+df))+1, raw term counts, L2 norm. The model is fitted on the
corpus only; terms of a query outside its vocabulary are dropped before the query is normalised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def char_wb(low: int = 2, high: int = 4) -> Tokenizer:
    """All n-grams of each blank-padded word, as one array; a short word counts once."""
    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        return F.flatten(F.transform(
            F.sequence(F.lit(low), F.least(F.lit(high), size)),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n)),
        ))

    def tokenize(text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)
        return F.flatten(F.transform(words, grams))

    return tokenize


def words(stop_words: bool = True) -> Tokenizer:
    """Lower-case runs of two or more letters, digits or underscores, less English stop words."""
    drop = StopWordsRemover.loadDefaultStopWords("english") if stop_words else []

    def tokenize(text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        return F.filter(found, lambda w: ~w.isin(*drop)) if drop else found

    return tokenize


def term_counts(texts: DataFrame, key: str, text: str, tokenize: Tokenizer) -> DataFrame:
    """(key, term, tf); `key` is unique per row of `texts`. The texts are dealt out by key, so no exchange carries terms."""
    return texts.select(key, text).repartition(key).select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf"))


def fit_idf(counts: DataFrame, sizes: DataFrame, key: str, copies: str) -> DataFrame:
    """(term, df, idf). Equal texts are fitted once and weigh `copies` times in every count."""
    n = sizes.agg(F.sum(copies)).scalar()
    df = counts.join(sizes.select(key, copies), key).groupBy("term").agg(F.sum(copies).alias("df"))
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)


def vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """One row per text: its normalised vector of (term, w, df), rarest term first (ties by term)."""
    weighted = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    packed = weighted.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("df", "term", "w"))).alias("raw"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = F.transform("raw", lambda e: F.struct(e["term"].alias("term"), (e["w"] / F.col("norm")).alias("w"), e["df"].alias("df")))
    return packed.select(key, unit.alias("vec"))


def numbered_vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """One row per text: its normalised vector as two arrays, the numbers `t` that `idf` gives the terms, and the weights."""
    weighted = counts.join(idf.select("term", "t", "idf"), "term").select(key, "t", (F.col("tf") * F.col("idf")).alias("w"))
    packed = weighted.groupBy(key).agg(F.collect_list(F.struct("t", "w")).alias("raw"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return packed.select(key, F.col("raw.t").alias("terms"), F.transform("raw.w", lambda w: w / F.col("norm")).alias("weights"))
